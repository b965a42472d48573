"""Resharding by minimum-cost flow: which blocks of old shards go to which new ones, moving the fewest bytes.

Rows fall into a fixed number of blocks of each old shard by a hash. Block sizes are one aggregate of
bounded size. On the driver, old shard sizes and new capacities are a transportation problem (keeping a
byte where it is costs nothing, moving it costs one); its flows are filled with whole blocks, largest
first, and a last pass evens out what rounding to blocks has left. Then every shard that gains or loses a
block is written anew as a whole, in files of bounded size; shards that do neither stay where they are.

No row passes the driver. The files of a shard are dealt by block with sizes known from the plan, so tasks are even.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstream.llm.common import shared_folder

#: Blocks of one old shard. With the number of old shards, this bounds what the driver collects and broadcasts.
BLOCKS, MAX_OLD_SHARDS = 1_024, 1_024
#: Bytes of text in a rewritten file, about.
FILE_BYTES = 128_000_000


def min_cost_flow(supply: np.ndarray, capacity: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Integer flows from sources to sinks that place all supply at the least cost.

    Successive shortest paths: from all sources with supply left, over forward arcs and (at negative cost)
    arcs that carry flow, to the cheapest sink with room; each path is filled to its bottleneck.
    """
    if supply.sum() > capacity.sum():
        raise ValueError(f"{supply.sum()} do not fit into {capacity.sum()}")
    left, room = supply.astype(np.int64).copy(), capacity.astype(np.int64).copy()
    flow = np.zeros(cost.shape, np.int64)
    while left.any():
        source = np.where(left > 0, 0.0, np.inf)
        came = np.full(len(left), -1)  # the sink from which a source is reached, -1: a start
        sink, by = np.full(len(room), np.inf), np.full(len(room), -1)
        while True:
            near = (source[:, None] + cost).argmin(axis=0)
            reach = source[near] + cost[near, np.arange(cost.shape[1])]
            nearer = reach < sink - 1e-9  # only strictly, so predecessors never form a cycle
            sink[nearer], by[nearer] = reach[nearer], near[nearer]
            back = np.where(flow > 0, sink[None, :] - cost, np.inf)
            via = back.argmin(axis=1)
            better = back[np.arange(len(left)), via] < source - 1e-9
            if not better.any():
                break
            source[better] = back[np.arange(len(left)), via][better]
            came[better] = via[better]
        goal = int(np.where(room > 0, sink, np.inf).argmin())
        path, j = [], goal
        while True:
            i = int(by[j])
            path.append((i, j, 1))
            if came[i] < 0:
                break
            j = int(came[i])
            path.append((i, j, -1))
        amount = min([int(left[path[-1][0]]), int(room[goal]), *(int(flow[i, j]) for i, j, d in path if d < 0)])
        for i, j, d in path:
            flow[i, j] += d * amount
        left[path[-1][0]] -= amount
        room[goal] -= amount
    return flow


def capacities_of(total: int, weights: list[float]) -> np.ndarray:
    """Whole capacities in proportion to the weights that sum to the total."""
    exact = total * np.array(weights, float) / sum(weights)
    whole = np.floor(exact).astype(np.int64)
    order = np.argsort(-(exact - whole), kind="stable")
    whole[order[np.arange(total - int(whole.sum())) % len(whole)]] += 1
    return whole


@dataclass
class Plan:
    """Block transfers: rows (old shard, block, bytes, rows, new shard), flows (old shards x new ones), and new capacities."""

    blocks: list[tuple[int, int, int, int, int]]
    flow: np.ndarray
    capacity: np.ndarray

    @property
    def moved_bytes(self) -> int:
        return sum(b for old, _, b, _, new in self.blocks if old != new)

    @property
    def affected(self) -> set[int]:
        """New shards that gain or lose blocks."""
        return {shard for old, _, _, _, new in self.blocks if old != new for shard in (old, new)}


def plan_transfers(blocks: list[tuple[int, int, int, int]], n_old: int, weights: list[float]) -> Plan:
    """Fill the flows with whole blocks. blocks: (old shard, block, bytes, rows)."""
    blocks = sorted(blocks)
    size = np.array([b[2] for b in blocks], np.int64)
    old = np.array([b[0] for b in blocks], np.int64)
    supply = np.bincount(old, weights=size, minlength=n_old).astype(np.int64) if len(blocks) else np.zeros(n_old, np.int64)
    capacity = capacities_of(int(supply.sum()), weights)
    cost = 1.0 - np.eye(n_old, len(weights))
    flow = min_cost_flow(supply, capacity, cost)
    new = np.zeros(len(blocks), np.int64)
    left = flow.astype(np.int64).copy()
    for k in np.lexsort((np.arange(len(blocks)), -size)):
        j = int(left[old[k]].argmax())
        new[k] = j
        left[old[k], j] -= size[k]
    # rounding: move the best-fitting block from the fullest to the emptiest shard while that evens them out
    over = np.bincount(new, weights=size, minlength=len(weights)) - capacity if len(blocks) else np.zeros(len(weights))
    for _ in range(4 * len(blocks)):
        a, b = int(over.argmax()), int(over.argmin())
        gap = over[a] - over[b]
        own = np.flatnonzero((new == a) & (size < gap))
        if not len(own):
            break
        k = own[np.abs(size[own] - gap / 2).argmin()]
        new[k] = b
        over[a] -= size[k]
        over[b] += size[k]
    return Plan([(*b, int(j)) for b, j in zip(blocks, new, strict=True)], flow, capacity)


def text_bytes(text: str) -> Column:
    """UTF-8 bytes of the text and one for its end; null has no bytes."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def reshard(docs: DataFrame, old_shard: Column, n_old: int, weights: list[float], folder: str | None = None, doc_id: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> tuple[DataFrame, Plan]:
    """Move rows to new shards of capacities in proportion to ``weights`` and rewrite the shards that this changes.

    ``old_shard`` gives 0 to ``n_old`` - 1 for every row (null counts as 0). Returns the input columns with
    __old, __block, __shard and __base (the first slot of the block), for ``with_slots``, and the plan. Shard sizes come within
    about the smallest block of their capacities; a block holds the rows of a shard with equal hash of id
    and text, so a shard of fewer rows than blocks is dealt row by row. Every shard that gains or loses a block is
    written whole to ``folder``/shard=N and read from there; rows of other shards are read where they are. Null texts
    are empty; equal rows share a block and get neighbouring slots; an empty table has no blocks.
    """
    if n_old > MAX_OLD_SHARDS or len(weights) > MAX_OLD_SHARDS:
        raise ValueError(f"at most {MAX_OLD_SHARDS} shards")
    spark = docs.sparkSession
    columns = docs.columns
    block = F.pmod(F.xxhash64(F.col(doc_id), F.crc32(F.col(text))), F.lit(blocks)).cast("int")
    placed = docs.withColumns({"__old": F.coalesce(old_shard, F.lit(0)).cast("int"), "__block": block, "__size": text_bytes(text)})
    sizes = placed.groupBy("__old", "__block").agg(F.sum("__size").alias("bytes"), F.count("*").alias("rows")).collect()
    plan = plan_transfers([(r[0], r[1], r.bytes, r.rows) for r in sizes], n_old, weights)
    # first slot of each block in its new shard, in the order of old shard and block, and the file that it goes to
    filled, written = [0] * len(weights), [0] * len(weights)
    numbers: dict[tuple[int, int], int] = {}
    rows, affected = [], plan.affected
    for old, b, size, n, new in plan.blocks:
        file = -1 if new not in affected else numbers.setdefault((new, written[new] // FILE_BYTES), len(numbers))
        rows.append((old, b, new, filled[new], file))
        filled[new] += n
        written[new] += size
    transfers = spark.createDataFrame(rows, "__old int, __block int, __shard int, __base long, __file int")
    # bounded: one row for each block
    dealt = placed.drop("__size").join(F.broadcast(transfers), ["__old", "__block"])
    left = dealt.where("__file < 0").drop("__file").select(*columns, "__old", "__block", "__shard", "__base")
    if not numbers:
        return left, plan
    path = folder or shared_folder(spark, "shards")
    whole = dealt.where("__file >= 0").repartitionById(len(numbers), F.col("__file")).drop("__file")
    whole.withColumn("shard", F.col("__shard")).write.partitionBy("shard").parquet(path)
    rewritten = spark.read.schema(whole.schema).parquet(path)
    return left.unionByName(rewritten.select(left.columns)), plan


def with_slots(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds slot, gapless from 0 in each new shard. Only blocks are put in order, so no shard is one task's work;
    rows are shuffled, so callers drop the text first if they don't need it."""
    place = F.row_number().over(Window.partitionBy("__old", "__block").orderBy(*order))
    return rows.withColumn("slot", F.col("__base") + place - 1)


def shard_documents(docs: DataFrame, n_shards: int = 16, folder: str | None = None, blocks: int = BLOCKS) -> DataFrame:
    """Even out a layout that was hashed by ``source`` into shards of equal bytes.

    Returns doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null: the law depends on
    more than id and shard count), old_shard. Sizes and checksums are those of the new files.
    """
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(n_shards))
    slim = docs.select("doc_id", "text", "source")
    whole, _ = reshard(slim, old, n_shards, [1.0] * n_shards, folder, blocks=blocks)
    slim = whole.select("doc_id", text_bytes("text").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), "__old", "__block", "__shard", "__base")
    placed = with_slots(slim, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("__shard").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("__old").alias("old_shard"))
