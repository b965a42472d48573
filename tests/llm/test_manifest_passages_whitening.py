"""Manifest, passages and whitening against plain loops: nulls, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weirstream.llm import merkle_manifest as mm
from weirstream.llm import recompression as rc
from weirstream.llm import tiled_whitening as tw

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    text = row[4]
    if lower and text is not None:
        text = text.translate(str.maketrans(mm.UPPER, mm.LOWER))
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def climb(hashes):
    """The top of a tree, and for each leaf its siblings."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, own in enumerate(at):
            run = runs[own // 16]
            paths[k].append((run[: own % 16], run[own % 16 + 1 :]))
            at[k] = own // 16
        level = [h(*r) for r in runs]
    return level[0], paths


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (own, *climb([leaf(r) for r in own]))
    root, above = climb([trees[s][1] for s in order])
    out = []
    for n, s in enumerate(order):
        own, top, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            steps = path + above[n]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf(r, hit)
            for left, right in steps:
                now = h(*left, now, *right)
            out.append((r[0], leaf(r), top, root, h(*[x for a, b in steps for x in (*a, *b)]), now, now == root))
    return sorted(out, key=repr)


def manifest_of(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("tree", "pos", "hash", "__at", "leaf", "root", "size"):
        docs = docs.withColumn(name, F.lit(1))
    found = mm.document_manifest(docs)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in found.select(columns).collect()], key=repr)


def test_manifest_against_a_loop(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice(["a", "b", "ä", None]), draw.choice(["en", None]), draw.choice([i, None]), draw.choice(["Some TEXT", "text", "", None, "ÄB 年" * 9])) for i in range(300)]
    rows += [(900 + i, f"only {i}", "en", 1, "X") for i in range(30)] + [(None, "a", None, None, None)] * 3 + rows[:5] + [(7, "a", "en", 7, "Other")]
    assert manifest_of(spark, rows) == brute_manifest(rows)
    documents = pd.DataFrame(rows, columns=["doc_id", "source", "lang", "n_chars", "text"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    assert len(documents) == len(rows)
    wanted = duckdb.sql(mm.manifest_sql()).project("doc_id, leaf, subroot, root, proof_sha256, folded_root, verified").fetchall()
    assert sorted(wanted, key=repr) == brute_manifest(rows)


@pytest.mark.parametrize("rows", [[(5, "s", "en", 1, "A Text")], [(i, "s", "en", 1, "x" * 20_000) for i in range(17)], [(i, f"s{i}", None, None, "T") for i in range(257)]])
def test_manifest_of_few_and_many_groups(spark, rows):
    assert manifest_of(spark, rows) == brute_manifest(rows)


def test_manifest_of_equal_rows_and_none(spark):
    assert manifest_of(spark, [(1, "s", "en", 1, "T")] * 40) == brute_manifest([(1, "s", "en", 1, "T")] * 40)
    assert manifest_of(spark, []) == []


# ---- passages ----


def brute_passages(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            known = least.get(key, ())
            least[key] = min([x for x in (*known, i) if x is not None], default=None),
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            low = least[tuple(w[k : k + window])][0]
            if low is not None and (i is None or low < i):
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("chunk", "range", "ids", "state")})
    found = rc.substring_dedup(docs, **more)
    return sorted([tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=repr)


def passage_rows():
    draw = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["é", "年", "."]
    shared = [[draw.choice(words) for _ in range(n)] for n in (12, 30, 75)] + [["la"] * 60, ["la", "lo"] * 40]
    rows = []
    for i in range(120):
        text = []
        for _ in range(draw.randrange(4)):
            text += [draw.choice(words) for _ in range(draw.randrange(15))]
            part = draw.choice(shared)
            at = draw.randrange(len(part))
            text += part[at : at + draw.randrange(1, 80)]
        rows.append((i, draw.choice([" ", "\n", " \t"]).join(text)))
    rows += [(None, rows[3][1]), (None, rows[3][1]), (None, " ".join(shared[2])), (200, None), (201, ""), (202, "  \n"), (5, rows[9][1]), *rows[:4]]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("window", "rounds", "chunk_words", "range_words"), [(8, 1, 50, 400), (20, 4, 300, 10**6), (50, 3, 10**6, 1000), (2, 2, 100, 100)])
def test_passages_against_a_loop(spark, window, rounds, chunk_words, range_words):
    rows = passage_rows()
    assert passages(spark, rows, window=window, rounds=rounds, chunk_words=chunk_words, range_words=range_words) == brute_passages(rows, window)


def test_passages_of_nothing_and_of_long_texts(spark):
    assert passages(spark, []) == []
    long = " ".join(f"x{i % 70_001}" for i in range(150_000))
    rows = [(1, "y " + long), (2, long + " z"), (3, "a " * 70_000), (4, "b " + "a " * 60)]
    assert passages(spark, rows) == brute_passages(rows, 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: (r.kept, r.spans) for r in rc.substring_dedup(docs, texts=True).collect()}
    assert kept[2][0] == "z" and [tuple(s) for s in kept[2][1]] == [(0, 150_000)] and kept[4][0] == "b"


def test_passages_of_text_ids(spark):
    docs = spark.createDataFrame([("b", "p q r s"), ("a", "x p q r"), (None, "q r s")], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in rc.substring_dedup(docs, window=3).collect()} == {"a": 0, "b": 3, None: 3}


def test_rounds_leave_shared_windows_only(spark):
    """Interiors of equal windows have equal symbols after any rounds, and windows without a partner go."""
    draw = random.Random(6)
    common = [draw.randbytes(2).hex() for _ in range(80)]
    texts = [[draw.randbytes(2).hex() for _ in range(200)] + common + [draw.randbytes(2).hex() for _ in range(100)] for _ in range(2)]
    chunks = rc.to_chunks(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)).collect()
    chunk = rc.Chunk(chunks[0].asDict())
    windows = chunk.windows(50)
    for turn in range(1, 5):
        parse = rc.Parse(chunk, windows, 50)
        for k in range(1, turn + 1):
            parse.advance(k)
        inside = {int(w): parse.name[(parse.start >= b) & (parse.start < e)].tolist() for w, b, e in zip(parse.windows, parse.begin, parse.end, strict=True)}
        for k in range(31):
            assert inside[200 + k] == inside[len(texts[0]) + 200 + k], turn
        assert any(inside.values())
        windows = parse.live(parse.names[1])
    # a word more or less at the rim lies in no interior; the comparison of windows tells those apart
    left = set(windows.tolist())
    assert left >= {x + k for k in range(31) for x in (200, len(texts[0]) + 200)} and len(left) < 2 * 40


# ---- whitening ----


def brute_whitening(vectors):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    v = c.T @ c / n
    e, p = np.linalg.eigh(v)
    order = np.argsort(-e)[:4]
    return x, n, s, v, e[order], p[:, order].T


@pytest.mark.parametrize(("dims", "tile", "block_rows"), [(7, 3, 10), (64, 32, 4096), (3, 32, 5)])
def test_whitening_against_numpy(spark, dims, tile, block_rows):
    r = np.random.default_rng(3)
    vectors = (r.normal(size=(150, dims)) * np.arange(1, dims + 1) / dims).astype(np.float32)
    vectors[140:] = vectors[0]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(vectors)]
    odd = [(1000, None, "c"), (1001, [float("nan")] * dims, "c"), (1002, [float("inf")] + [0.0] * (dims - 1), "c"), (1003, [None] + [0.0] * (dims - 1), "c"), (1004, [0.5], "c"), (1005, [], "c"), (None, vectors[1].tolist(), "c")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, x string")
    found = tw.whiten(frame, tile=tile, block_rows=block_rows, keep=["vec_id", "x"]).toDF("vec_id", "own", "component", "n", "deviation", "whitened", "explained", "identity_error").toPandas()
    x, n, s, v, e, p = brute_whitening(vectors)
    k = min(4, dims)
    assert set(found["own"]) == {"c"} and len(found) == (len(rows) + 3) * k
    other = found[found.vec_id.isin([1004, 1005])]
    assert other["whitened"].isna().all() and other["deviation"].isna().all()
    known = found[found.vec_id.notna() & (found.vec_id < 1000)]
    for c in range(k):
        own = known[known.component == c + 1].sort_values("vec_id")
        want = (x - s / n) @ p[c] / np.sqrt(e[c])
        assert min(np.abs(own.whitened - want).max(), np.abs(own.whitened + want).max()) < 1e-8
        assert own.deviation.tolist() == ((n * x - s) ** 2).sum(axis=1).tolist() and set(own.n) == {n}
        assert abs(own.explained.iloc[0] - e[c] / np.trace(v)) < 1e-9
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-9


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert tw.whiten(spark.createDataFrame([], schema)).count() == 0
    assert tw.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = tw.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    line = tw.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], schema)).collect()
    assert all(r.whitened is not None if r.component == 1 else r.whitened is None for r in line) and line[0].identity_error < 1e-9
    large = tw.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], schema)).collect()
    assert [r.deviation for r in large] == [None, None]
