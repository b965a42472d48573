"""Words of very many symbols, wide vocabularies, and the attribution query as it is registered."""

import json
import random
import time

import pytest
from tokenizers import Tokenizer

from tests.llm.test_operators import docs, rows  # noqa: F401
from weirstream.llm.bpe_codec import LONG, BytePairTable, byte_alphabet, encode_decode
from weirstream.llm.common import tokenizer_path
from weirstream.llm.token_attribution import attribute

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return BytePairTable(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def ids_of(own, text):
    return [i for p in own.pretokens(text) for i in next(own.ids_of([p]))]


@pytest.mark.parametrize("letters", ["a", "ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "éß漢🙂", "=-_", "\n ", "0123456789"])
def test_long_words(own, lib, letters):
    r = random.Random(len(letters))
    for n in (LONG - 1, LONG, LONG + 1, 3 * LONG, 4_000):
        text = "".join(r.choice(letters) for _ in range(n))
        assert ids_of(own, text) == lib.encode(text, add_special_tokens=False).ids


def test_both_ways_agree(own):
    r = random.Random(2)
    for n in (1, 2, 3, 50, 200):
        word = "".join(r.choice("erstan ") for _ in range(n)).encode()
        ids, at = own.encode_words([word])
        assert own.encode_long(word) == ids.tolist() and at.tolist() == [0, len(ids)]


def test_time_grows_with_length(spark, own, lib):
    r = random.Random(3)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.process_time()
    found = ids_of(own, word)
    assert time.process_time() - began < 4  # about one second on an idle machine
    assert found == lib.encode(word, add_special_tokens=False).ids
    row = encode_decode(spark.createDataFrame([(1, f"see {word} there")], "doc_id long, text string"), with_ids=True).first()
    assert row.ids == lib.encode(f"see {word} there", add_special_tokens=False).ids and row.decoded == f"see {word} there"


def test_ids_beyond_17_bits():
    """Two pairs whose keys would be equal if a symbol had 17 bits."""
    alphabet = byte_alphabet()
    vocab = {c: b for b, c in alphabet.items()} | {"ab": 300, "cd": 1 << 17 | 5, "abcd": 400_000, "abe": 400_001}
    spec = {"model": {"vocab": vocab, "merges": [["a", "b"], ["c", "d"], ["ab", "cd"], ["ab", "e"]]}, "added_tokens": []}
    table = BytePairTable(json.dumps(spec).encode())
    for word, want in ((b"abcd", [400_000]), (b"abe", [400_001]), (b"cdab", [1 << 17 | 5, 300])):
        assert table.encode_words([word])[0].tolist() == table.encode_long(word) == want


def test_attribution_as_registered(spark, docs, lib):  # noqa: F811
    r = random.Random(4)
    texts = ["first line\nsecond\nthird", "\n\nno lead", "no end", "", None, " \n x", "lead ends\r\n  here", "".join(r.choice("xyzq") for _ in range(3_000)) + "\ntail"]
    extra = spark.createDataFrame([(100 + i, t, "en", None if i % 2 else "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    known = {i: (t[3], t[2], t[1]) for i, t in enumerate(rows()[:-3])} | {100 + i: (None if i % 2 else "web", "en", t) for i, t in enumerate(texts)}
    found = attribute(docs.select(extra.columns).where("doc_id is not null").union(extra), ["source", "lang", "text"], lead_of="text", rule="most", separator=" ").collect()
    assert len(found) == len(rows()) - 1 + len(texts)
    for x in found:
        source, lang, text = (v or "" for v in known[x.doc_id])
        lead = text[: text.find("\n") + 1] or text
        parts = [source, " ", lang, " ", lead, text[len(lead) :]]
        place = [k for k, p in enumerate(parts) for _ in p]
        total, crossing = [0] * 6, 0
        encoded = lib.encode("".join(parts), add_special_tokens=False)
        for a, b in encoded.offsets:
            held = [place[a:b].count(k) for k in range(6)]
            total[held.index(max(held))] += 1
            crossing += sum(h > 0 for h in held) > 1
        assert (x.n_tokens, x.source_tokens, x.lang_tokens, x.lead_tokens, x.body_tokens, x.separator_tokens, x.n_crossing) == (len(encoded.ids), total[0], total[2], total[4], total[5], total[1] + total[3], crossing)
