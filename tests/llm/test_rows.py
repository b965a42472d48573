"""Results follow rows, not ids: null and shared ids change nothing but themselves; odd groups and names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from weirstream.llm.bpe_codec import encode_decode
from weirstream.llm.fertility import fertility
from weirstream.llm.flow_reshard import shard_documents
from weirstream.llm.license_rules import scan
from weirstream.llm.prefix_decontam import decontaminate
from weirstream.llm.token_attribution import attribute
from weirstream.llm.url_markov import filter_urls
from weirstream.llm.warc_members import archive_pages
from weirstream.llm.zstd_langid import identify, learn_dictionaries

TEXTS = ["The ferry left the harbour a little after nine, and by noon the fog had lifted from the islands.", "Released under the MIT License.", "one two three four five six seven eight nine ten eleven", None, "", " \n", "a" * 300, "Der Kapitän und die Leute fahren mit einem Boot über den Fluss."]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, ids):
    return spark.createDataFrame([(i, t, "de" if t and "Der" in t else "en", "s", 1) for i, t in zip(ids, TEXTS * 3, strict=True)], SCHEMA)


def results(frame, name="doc_id"):
    return Counter(repr([r[c] for c in sorted(frame.columns) if c != name]) for r in frame.collect())


def test_rows_of_any_ids(spark):
    n = 3 * len(TEXTS)
    plain, null, shared = table(spark, range(n)), table(spark, [None] * n), table(spark, [7] * n)
    learned = learn_dictionaries(plain)
    items = spark.createDataFrame([("i", "two three four five six seven eight nine ten eleven")], "item_id string, text string")
    operators = {
        "fertility": fertility, "language": lambda d: identify(d, learned), "benchmark": lambda d: decontaminate(d, items), "tokens": encode_decode, "licences": scan,
        "attribution": lambda d: attribute(d, ["source", "lang", "text"], lead_of="text", rule="most", separator=" "),
    }
    for name, of in operators.items():
        want = results(of(plain))
        assert sum(want.values()) == n and results(of(null)) == want and results(of(shared)) == want, name


def test_a_third_of_equal_rows_is_one_block(spark):
    """Every row comes back once with a place of its own, also where blocks are larger than shards may differ."""
    rows = [(1, "same", "en", "s", 4)] * 40 + [(i, f"text {i} " * (i % 7), "en", f"s{i % 5}", 1) for i in range(80)]
    found = shard_documents(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r[0], len(r[1]) + 1) for r in rows)
    for shard in range(4):
        own = sorted(r.slot for r in found if r.shard == shard)
        assert own == list(range(len(own)))


def test_pages_of_repeated_and_null_ids(spark):
    pages = [(1, "http://a.com/x", "<p>one</p>"), (1, "http://a.com/y", "<p>one</p>"), (None, "http://b.net/es/", "<p>one</p>"), (None, None, None), (3, "", ""), (3, "x", "<p>two</p>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    archived = archive_pages(frame).collect()
    assert Counter(r.payload_bytes for r in archived) == Counter(len(h or "") for _, _, h in pages)
    for payload in {r.payload_digest for r in archived}:
        assert sum(r.record_type == "response" for r in archived if r.payload_digest == payload) == 1
    judged = filter_urls(frame)
    assert Counter((r.page_id, r.host) for r in judged.collect()) == Counter([(1, "a.com"), (1, "a.com"), (None, "b.net"), (None, ""), (3, ""), (3, "")])
    with pytest.raises(ValueError, match="clash"):
        filter_urls(frame.withColumn("score", F.lit(1)), keep=["score"])
