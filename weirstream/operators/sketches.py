"""Count-min sketches as tables: cells add up across partitions, texts and sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstream.operators.sequence_features import SHINGLE, STRIDE

#: Rows and columns. With n items counted, an estimate is more than 2.72 n / WIDTH too high for at most one in e ** DEPTH.
DEPTH, WIDTH = 4, 2048


def shingles_of(text: Column) -> Column:
    """The shingles of a text in order, one each STRIDE characters; one pass, however long the text is."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{SHINGLE}}})).{{{STRIDE}}}"), F.lit(1))


def column_of(row: Column, item: Column, width: int = WIDTH) -> Column:
    """The column of an item in a row, from the md5 of both."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", row.cast("string"), item)), 1, 8), 16, 10).cast("long") % width).cast("int")


def count_min(items: DataFrame, item: str, by: list[str] | None = None, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """by, row, col, n: the cells that are not zero. Null items are not counted. Tasks count their own first."""
    rows = F.explode(F.array(*[F.lit(r) for r in range(depth)])).alias("row")
    placed = items.where(F.col(item).isNotNull()).groupBy(*(by or []), item).agg(F.count("*").alias("n")).select(*(by or []), item, "n", rows)
    return placed.groupBy(*(by or []), "row", column_of(F.col("row"), F.col(item), width).alias("col")).agg(F.sum("n").alias("n"))


def merged(*sketches: DataFrame) -> DataFrame:
    """The sketch of all that these have counted; they must be of one shape."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def estimates(items: DataFrame, item: str, sketch: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """Distinct items with ``estimate``: the least of their cells, never less than the count."""
    asked = items.select(item).where(F.col(item).isNotNull()).distinct()
    placed = asked.select(item, F.explode(F.array(*[F.lit(r) for r in range(depth)])).alias("row")).withColumn("col", column_of(F.col("row"), F.col(item), width))
    # a sketch has depth x width cells at most
    return placed.join(F.broadcast(sketch), ["row", "col"], "left").groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
