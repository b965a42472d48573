"""The n-gram join where hashes fail: equal polynomials, equal longs, clashing shingles, hot contents, many blocks."""

import random

import numpy as np
import pytest

from tests.llm.test_operators import brute_components, sets_of
from weirstream.llm import partition_jaccard as pj


def joined(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in pj.near_duplicates(docs).collect()}


def brute(texts):
    sets = sets_of(dict(enumerate(texts)))
    return {i: (len(sets[i]), c) for i, c in brute_components(sets).items()}


def test_words_of_equal_polynomials(spark):
    """A Thue-Morse word and its complement have equal polynomials modulo 2 ** 64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    texts = [f"{a} {a}x {a}y {a}z {a}w {a}v", f"{b} {b}x {b}y {b}z {b}w {b}v", a, b]
    assert {i: c for i, (_, c) in joined(spark, texts).items()} == {0: 0, 1: 1, 2: 2, 3: 3}


def family_texts(r):
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (40, 130):
        base = [r.choice(vocabulary) for _ in range(n)]
        for _ in range(40):
            w = list(base)
            for _ in range(r.randrange(0, n // 9)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
        passage = [r.choice(vocabulary) for _ in range(n)]
        texts += [" ".join([r.choice(vocabulary) for _ in range(n // 8)] + passage + [r.choice(vocabulary) for _ in range(n // 6)]) for _ in range(40)]
    return texts + [texts[0], texts[0].upper(), "a b", "A  b", "c", ""]


@pytest.mark.parametrize("patch", [{"SPLIT": 0, "FREQUENT": 2, "BROADCAST_PAIRS": 0}, {"BLOCK": 1_500, "TEXT_WEIGHT": 0}, {"FEW_CENTRES": 1, "BLOCK": 4_000}])
def test_any_bound(spark, monkeypatch, patch):
    for name, value in patch.items():
        monkeypatch.setattr(pj, name, value)
    texts = family_texts(random.Random(3))
    assert joined(spark, texts) == brute(texts)


def test_classes_with_names_of_their_own(spark, monkeypatch):
    """All classes renamed, as if their first 64 bits were shared."""
    texts = family_texts(random.Random(4))
    monkeypatch.setattr(pj, "renamed_classes", lambda classes: {(r.h1, r.h2): i - 50 for i, r in enumerate(classes.collect())})
    assert joined(spark, texts) == brute(texts)


def test_renamed_classes(spark):
    classes = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 3), (1, 3)], "h1 long, h2 long")
    new = pj.renamed_classes(classes)
    assert set(new) == {(1, 1), (1, 2), (1, 3)} and len(set(new.values()) | {1, 2, 3}) == 6
    assert pj.renamed_classes(classes.where("h1 > 1")) == {}


@pytest.mark.parametrize("weak", [False, True])
def test_clashing_shingles_are_counted_by_words(monkeypatch, weak):
    """With one bit of the first hash left, nearly all shingles clash."""
    if weak:
        mix = pj.mix
        monkeypatch.setattr(pj, "mix", lambda h: mix(h) & np.array([[1], [(1 << 64) - 1]], np.uint64) if h.ndim == 2 and h.shape[0] == 2 else mix(h))
    r = random.Random(7)
    texts = [" ".join(r.choice("abcdefg") for _ in range(r.randrange(0, 90))) for _ in range(30)]
    want = list(sets_of(dict(enumerate(texts))).values())
    found = pj.shingle_sets(texts, pj.Lexicon())
    assert [s.n for s in found] == [len(w) for w in want]
    assert any(s.clash for s in found) == weak
    for s, w in zip(found, want, strict=True):
        assert [pj.common_shingles(s, x) for x in found] == [len(w & v) for v in want]


def test_hashes_of_words():
    """Words by place and length: near misses, long words, and blanks of all kinds."""
    words = ["a", "aa", "ab", "ba", "a" * 63, "a" * 64, "a" * 65, "b" + "a" * 64, "a" * 64 + "b", "é", "\u00a0", *(f"w{i}" for i in range(20_000))]
    hashes, size = pj.word_hashes([" ".join(words).encode(), b"", b" \t\n", "\x0ba \r aa\x0c".encode()])
    assert size == [len(words), 0, 0, 2]
    assert len(set(hashes[0].tolist())) == len(set(hashes[1].tolist())) == len(words)
    assert (hashes[:, len(words) :] == hashes[:, :2]).all()


def test_null_and_shared_ids_link(spark):
    """Near copies are one component whatever their ids; a shared id joins nothing by itself."""
    r = random.Random(9)
    base = [f"u{r.randrange(500)}" for _ in range(60)]
    near = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in (10, 50)]
    other = " ".join(f"v{r.randrange(500)}" for _ in range(60))
    rows = [(3, " ".join(base)), (None, near[0]), (None, near[1]), (7, other), (3, "unlike " + other + " " + " ".join(f"z{i}" for i in range(60))), (None, "alone " * 3), (None, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(t.n_shingles, t.component_id) for t in pj.near_duplicates(docs).orderBy("n_shingles").collect()]
    sets = sets_of(dict(enumerate([t for _, t in rows])))
    of = brute_components(sets)
    want = []
    for i, s in sets.items():
        ids = [rows[j][0] for j in of if of[j] == of[i] and rows[j][0] is not None]
        want.append((len(s), min(ids, default=None)))
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert [c for n, c in found if n == 56] == [3, 3, 3, 7]
