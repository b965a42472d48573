"""A training corpus from raw documents: quality, language, near-duplicates, benchmark passages, tokens.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and gives the documents that stay,
with the columns that it got, whatever their names. The last one gives the token digest of each remaining document.
Stages decide by row: repeated rows fare alike but in the near-duplicate stage, null ids are ids like any other, and an
empty table stays empty. A null or empty text fails the quality rules; a stage that is given one all the same says below
what becomes of it. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstream.llm.bpe_codec import encode_decode
from weirstream.llm.common import discard, persisted, shared_folder, table
from weirstream.llm.fertility import fertility
from weirstream.llm.partition_jaccard import near_duplicates
from weirstream.llm.prefix_decontam import decontaminate
from weirstream.llm.zstd_langid import identify, learn_dictionaries

#: Keys of dropped copies that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _kept(docs: DataFrame, judge: Callable[[DataFrame, list[str]], DataFrame], condition: str) -> DataFrame:
    """Rows of ``docs`` whose verdict fits. The judge sees neutral names, so extra columns can't clash with its own."""
    neutral = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    return judge(neutral, neutral.columns).where(condition).select(neutral.columns).toDF(*docs.columns)


def _at(docs: DataFrame, name: str) -> str:
    return f"__c{docs.columns.index(name)}"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a fertility band go; null and empty texts fail the base rule."""
    return _kept(docs, lambda d, keep: fertility(d, text=_at(docs, "text"), keep=keep), "kept")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or whose two best languages are too close (ties too), go.

    If no document has a label, nothing is learned and all go.
    """
    dictionaries = learn_dictionaries(docs)
    return _kept(docs, lambda d, keep: identify(d, dictionaries, text=_at(docs, "text"), keep=keep), "accepted")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least id stays, null ids last; of equal ids one row.

    Groups are made of rows, not ids: null and repeated ids neither save a copy nor cost another text of that id.
    Null and blank texts are copies of nothing and stay.
    """
    row = next(n for n in (f"__row{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    # written, so every branch sees the same key
    keyed = persisted(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed, doc_id=row).select(F.col(row), "component_id")
    groups = persisted(found.join(keyed.select(row, "doc_id"), row), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias("first"), F.count("*").alias("n")).where("n > 1")
    dropped = persisted(groups.join(first, "component_id").where(F.col(row) != F.col("first")).select(row), "dropped")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return keyed.join(dropped, row, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none. Without items all stay."""
    items = table(spark, sf_dir, "benchmark")
    return _kept(docs, lambda d, keep: decontaminate(d, items, text=_at(docs, "text"), keep=keep), "not contaminated")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document that is left; of a null text those of the empty one."""
    return encode_decode(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicate),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: Tokenisers and compressors are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; a stage's table goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name.replace(" ", "-"))
        docs = persisted(stage(spark, docs, sf_dir), "documents", folder)
        if before is not None:
            discard(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
