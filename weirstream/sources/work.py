"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write a table under ``spark.checkpoint.dir`` and read it again: its lineage ends there, lost executors cost nothing.

    by: the last column; rows of each value lie in a folder of their own, so a filter on it reads these alone. Where the setting is absent a local master takes a folder of its warehouse; a cluster has none that could be guessed.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
