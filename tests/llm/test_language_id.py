"""Language ID against a plain version: every dictionary, every block, ties, margins, many labels; figures held out."""

import random

import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.test_operators import by_id, docs, rows  # noqa: F401
from weirstream.llm.queries import op4_zstd_langid
from weirstream.llm.zstd_langid import held_out, identify, learn_dictionaries


def brute(text, dictionaries, level=6, block=4096):
    """(language, margin) with a fresh compressor for every block."""
    if not text or not any(c.isalpha() for c in text) or not dictionaries:
        return "und", 0.0
    raw, total = text.encode(), {}
    for name, content in dictionaries.items():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        total[name] = sum(len(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False).compress(raw[i : i + block])) for i in range(0, len(raw), block))
    order = sorted(total, key=total.get)  # stable: of equal sizes the earlier language
    return order[0], 1 - total[order[0]] / total[order[1]] if len(order) > 1 else 1.0


@pytest.mark.parametrize("case", ["learned", "tie", "one"])
def test_against_plain_version(docs, case):  # noqa: F811
    known = learn_dictionaries(docs)
    if case == "tie":  # two languages of equal content: the earlier one, margin 0, not accepted
        known = {"b": known["en"], "a": known["en"]}
    elif case == "one":
        known = {"de": known["de"]}
    for i, r in by_id(identify(docs, known)).items():
        lang, margin = brute(rows()[i][1], known)
        assert (r.lang_pred, r.accepted) == (lang, lang != "und" and margin >= 0.004) and abs(r.margin - margin) < 1e-12 and abs(r.score - min(1, margin / 0.1)) < 1e-12
        assert case != "tie" or lang == "und" or (lang == "b" and margin == 0 and not r.accepted)


def test_narrow_margins_are_rejected(docs):  # noqa: F811
    known = learn_dictionaries(docs)
    found = identify(docs, known, min_margin=0.05).where("lang_pred <> 'und'").collect()
    assert {r.accepted for r in found} == {True, False} and all(r.accepted == (r.margin >= 0.05) for r in found)


def test_more_labels_than_dictionaries(spark):
    r = random.Random(1)
    rows = [(i, " ".join(f"l{i % 300}w{r.randrange(9)}" for _ in range(30)), f"l{i % 300:03}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = learn_dictionaries(docs)
    counts = {x.lang: x.n for x in docs.where(~held_out("doc_id")).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert list(known) == sorted(counts, key=lambda k: (-counts[k], k))[:256]
    assert list(learn_dictionaries(docs, max_languages=3)) == list(known)[:3]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = op4_zstd_langid(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    share = {x.lang: x.right for x in found.where("lang is not null").groupBy("lang").agg(F.avg(F.expr("cast(lang = lang_pred as double)")).alias("right")).collect()}
    assert len(share) == 4 and min(share.values()) >= 0.93
