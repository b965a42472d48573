"""Running sums, extremes, last values and moving averages over long ordered sequences, by blocks.

A window over a whole sequence is one task's work. Here rows are ordered in blocks of bounded size, each block is
summed up in a row, a small window over these rows gives every block what came before it, and the two are combined. So a
sequence of any length is as many tasks as it has blocks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 65_536


def block_of(position: Column, size: int = BLOCK) -> Column:
    """The block of a position from 1."""
    return F.floor((position - 1) / size).cast("long")


def positions(rows: DataFrame, key: str, bucket: Column, order: list[str], name: str = "pos") -> DataFrame:
    """Adds a row's place, from 1, among those of its key.

    ``bucket`` rises with the order, and so cuts a key's rows into pieces that are ordered one by one; a null bucket comes
    first.
    """
    placed = rows.withColumn("__bucket", bucket)
    counted = placed.groupBy(F.col(key).alias("__key"), F.col("__bucket").alias("__of")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select("__key", "__of", F.coalesce(before, F.lit(0)).alias("__before"))
    joined = placed.join(starts, F.col(key).eqNullSafe(F.col("__key")) & F.col("__bucket").eqNullSafe(F.col("__of")))
    rank = F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(*order))
    return joined.withColumn(name, F.col("__before") + rank).drop("__bucket", "__key", "__of", "__before")


def scan(rows: DataFrame, key: str, order: str, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, minima: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, block: str = "block") -> DataFrame:
    """Adds columns: sums, maxima and minima of all rows up to each one, itself included; ``lasts``: the last value that is
    not null of the rows before it. A key, block and order are never null."""
    sums, maxima, minima, lasts = (x or {} for x in (sums, maxima, minima, lasts))
    own = Window.partitionBy(key, block).orderBy(order)
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    within = {n: F.sum(c).over(own) for n, c in sums.items()} | {n: F.max(c).over(own) for n, c in maxima.items()} | {n: F.min(c).over(own) for n, c in minima.items()}
    within |= {n: F.last(c, ignorenulls=True).over(earlier) for n, c in lasts.items()}
    ends = [F.sum(c).alias(n) for n, c in sums.items()] + [F.max(c).alias(n) for n, c in maxima.items()] + [F.min(c).alias(n) for n, c in minima.items()]
    ends += [F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(n) for n, c in lasts.items()]
    across = Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(F.col(key).alias("__key"), F.col(block).alias("__of")).agg(*ends)
    carried = [F.sum(n).over(across).alias(f"__{n}") for n in sums] + [F.max(n).over(across).alias(f"__{n}") for n in maxima] + [F.min(n).over(across).alias(f"__{n}") for n in minima]
    carried += [F.last(n, ignorenulls=True).over(across).alias(f"__{n}") for n in lasts]
    carry = carry.select("__key", "__of", *carried)
    joined = rows.withColumns(within).join(carry, (F.col(key) == F.col("__key")) & (F.col(block) == F.col("__of")))
    both = {n: F.coalesce(F.col(f"__{n}"), F.lit(0)) + F.coalesce(F.col(n), F.lit(0)) for n in sums}
    both |= {n: F.greatest(n, f"__{n}") for n in maxima} | {n: F.least(n, f"__{n}") for n in minima} | {n: F.coalesce(n, f"__{n}") for n in lasts}
    return joined.withColumns(both).drop("__key", "__of", *[f"__{n}" for n in (*sums, *maxima, *minima, *lasts)])


def block_lists(rows: DataFrame, key: str, order: str, value: str, size: int = BLOCK) -> DataFrame:
    """key, block, n, l: the values of each block in order; ``order`` is a whole position from 1."""
    listed = rows.groupBy(key, block_of(F.col(order), size).alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("x")))).alias("l"))
    return listed.select(key, "block", F.size("l").cast("long").alias("n"), F.col("l")["x"].alias("l"))


def moving(lists: DataFrame, key: str, alpha: float, start: float | None = None) -> DataFrame:
    """key, n, mean, mad: exponentially moving mean and mean absolute deviation over ``block_lists`` of each key.

    The first value sets the mean, unless there is a ``start``. A block takes the mean m before it to (1 - alpha)^n m + b, so
    means are known at the begin of all blocks before a deviation is looked at; deviations are composed the same way.
    """
    kind = lists.schema[key].dataType.simpleString()
    b = F.aggregate("l", F.lit(0.0), lambda m, x: m + alpha * (x - m))

    def starts(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks, m, found = blocks.sort_values("block"), start, []
        for n, own, first in zip(blocks["n"], blocks["b"], blocks["first"], strict=True):
            m = first if m is None else m
            found.append(m)
            m = (1 - alpha) ** n * m + own
        return blocks[[key, "block"]].assign(m=found)

    def ends(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks, d = blocks.sort_values("block"), 0.0
        for n, own in zip(blocks["n"], blocks["d"], strict=True):
            d = (1 - alpha) ** n * d + own
        return blocks[[key]].tail(1).assign(n=blocks["n"].sum(), mean=blocks["mean"].iat[-1], mad=d)

    # a row for each block
    known = lists.select(key, "block", "n", b.alias("b"), F.element_at("l", 1).alias("first")).groupBy(key).applyInPandas(starts, f"{key} {kind}, block long, m double")
    step = lambda s, x: F.struct((s["mean"] + alpha * (x - s["mean"])).alias("mean"), (s["mad"] + alpha * (F.abs(x - s["mean"]) - s["mad"])).alias("mad"))
    folded = lists.join(known, [key, "block"]).select(key, "block", "n", F.aggregate("l", F.struct(F.col("m").alias("mean"), F.lit(0.0).alias("mad")), step).alias("f"))
    return folded.select(key, "block", "n", F.col("f.mean").alias("mean"), F.col("f.mad").alias("d")).groupBy(key).applyInPandas(ends, f"{key} {kind}, n long, mean double, mad double")
