"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstream.llm import license_rules
from weirstream.llm.bpe_codec import encode_decode
from weirstream.llm.common import table
from weirstream.llm.fertility import fertility
from weirstream.llm.flow_reshard import shard_documents
from weirstream.llm.merkle_manifest import document_manifest, manifest_sql
from weirstream.llm.partition_jaccard import near_duplicates, near_duplicates_sql
from weirstream.llm.prefix_decontam import decontaminate, decontaminate_sql
from weirstream.llm.recompression import dedup_sql, substring_dedup
from weirstream.llm.tiled_whitening import whiten
from weirstream.llm.token_attribution import attribute
from weirstream.llm.url_markov import filter_sql, filter_urls
from weirstream.llm.warc_members import archive_pages, archive_sql
from weirstream.llm.zstd_langid import held_out, identify, learn_dictionaries


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility(table(spark, sf_dir, "documents"))


def op2_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op4_zstd_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn_dictionaries(docs))
    return found.withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False)))


def op5_prefix_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op6_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).drop("archive", "member_offset", "member_length")


def op7_partition_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(table(spark, sf_dir, "documents"))


def op10_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute(table(spark, sf_dir, "documents"), ["source", "lang", "text"], lead_of="text", rule="most", separator=" ")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(table(spark, sf_dir, "documents"))


def op12_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op13_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_fertility, op2_flow_reshard, op3_url_markov, op4_zstd_langid, op5_prefix_decontam, op6_warc_members, op7_partition_jaccard, op8_bpe_codec, op9_license_rules, op10_token_attribution, op11_merkle_manifest, op12_recompression, op13_tiled_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_markov": filter_sql(), "op5_prefix_decontam": decontaminate_sql(), "op6_warc_members": archive_sql(), "op7_partition_jaccard": near_duplicates_sql(), "op9_license_rules": license_rules.scan_sql(), "op11_merkle_manifest": manifest_sql(), "op12_recompression": dedup_sql()}
