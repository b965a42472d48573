"""Corpora of clean texts from JSON lines, and data sets written with their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str | None, min_len: int = 700, limit: int = 400, fallback: DataFrame | None = None, least: int = 10) -> DataFrame:
    """text: rows of a JSON-lines file that are long enough, at most ``limit``; broken lines are skipped.

    If fewer than ``least`` are found, the texts of ``fallback`` follow.
    """
    found = spark.createDataFrame([], "text string")
    if path is not None:
        lines = spark.read.schema("text string, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
        found = lines.where("text is not null").where(F.length("text") >= min_len).select("text").limit(limit)
    if fallback is not None and found.limit(least).count() < least:
        found = found.unionByName(fallback.select("text"))
    return found


def write_dataset(rows: DataFrame, path: str, by: str = "split") -> None:
    """JSON lines in a folder for each part."""
    rows.write.partitionBy(by).mode("errorifexists").json(path)


def dataset_statistics(rows: DataFrame) -> DataFrame:
    """split, corruption_class, n, chars with totals of each split and of all (nulls)."""
    return rows.cube("split", "corruption_class").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).where("split is not null or corruption_class is null")
