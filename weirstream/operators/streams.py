"""Finished texts and chunked streams as tables; positions are counts of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstream.functions.text import window_at
from weirstream.operators.blocks import BLOCK

#: First checkpoint, distance of further ones, characters of a chunk, characters of the sliding window.
HOLD, EVERY, CHUNK, WINDOW = 350, 400, 40, 600
#: Characters that checkpoints carry, a chunk more: the deflate ratio is that of a window that ended up to 200 earlier.
REACH = WINDOW + 200


def chunks(streams: DataFrame, chunk: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """stream_id, seq (from 1), chunk and columns to keep. Empty and null texts have none. Texts are cut in one pass."""
    cut = F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).alias("at", "chunk")
    return streams.where(F.length("text") > 0).select("stream_id", *(keep or []), cut).select("stream_id", (F.col("at") + 1).cast("long").alias("seq"), "chunk", *(keep or []))


def assembled(pieces: DataFrame) -> DataFrame:
    """stream_id, text: the chunks of each stream in the order of seq; of equal seq the least chunk counts once."""
    once = pieces.groupBy("stream_id", "seq").agg(F.min("chunk").alias("chunk"))
    return once.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda s: s["chunk"]), "").alias("text"))


def checkpoint_positions(length: Column, chunk: int = CHUNK, hold: int = HOLD, every: int = EVERY) -> Column:
    """Where a stream that arrives in chunks is scored: at the first chunk end that reaches ``hold`` and then
    at each that is ``every`` further on. The last chunk may be short, and its end counts as well."""
    first, step = chunk * -(-hold // chunk), chunk * -(-every // chunk)
    regular = F.when(length >= first, F.sequence(F.lit(first), length, F.lit(step))).otherwise(F.array().cast("array<int>"))
    due = F.when(F.size(regular) > 0, F.element_at(regular, -1) + every).otherwise(F.lit(hold))
    return F.when((length >= due) & (F.size(regular) == 0) | (length >= due) & (F.element_at(regular, -1) < length), F.concat(regular, F.array(length))).otherwise(regular)


def checkpoint_at(chars: Column, length: Column, chunk: int = CHUNK, hold: int = HOLD, every: int = EVERY) -> Column:
    """The number of the last of ``checkpoint_positions`` that a chunk end has reached; 0 before the first."""
    first, step = chunk * -(-hold // chunk), chunk * -(-every // chunk)
    reached = lambda n: F.when(n >= first, F.floor((n - first) / step) + 1).otherwise(F.lit(0))
    regular = reached(length)
    last = F.lit(first) + (regular - 1) * step
    extra = F.when(regular > 0, (last < length) & (length >= last + every)).otherwise(length >= hold)
    return (reached(chars) + F.when(extra & (chars == length), 1).otherwise(0)).cast("int")


def checkpoints(streams: DataFrame, chunk: int = CHUNK, hold: int = HOLD, every: int = EVERY) -> DataFrame:
    """stream_id, k (from 1), pos, n_chars, and text: the last characters up to pos, as many as any window reads.

    Texts are cut before positions become rows, so what is carried grows with a stream's length, not with its square.
    """
    length = F.length("text")
    cut = F.transform(checkpoint_positions(length, chunk, hold, every), lambda p: F.struct(p.alias("pos"), window_at(F.col("text"), p, REACH + chunk).alias("text")))
    each = streams.select("stream_id", length.alias("n_chars"), F.posexplode(cut).alias("k", "c"))
    return each.select("stream_id", "c.text", "n_chars", (F.col("k") + 1).alias("k"), "c.pos")


def final_positions(streams: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row at the end of every stream, for scores on finishing: k is null."""
    return streams.select("stream_id", F.right("text", F.lit(REACH + chunk)).alias("text"), F.length("text").alias("n_chars"), F.lit(None).cast("int").alias("k"), F.length("text").alias("pos"))


def blocked_characters(streams: DataFrame, spread: bool = True, size: int = BLOCK) -> DataFrame:
    """stream_id, block, i (from 1), ch. Texts are cut into blocks in one pass; with ``spread`` these are dealt out by stream
    and block before they become characters, so windows by both shuffle no character."""
    whole = streams.where(F.length("text") > 0)
    cut = F.when(F.length("text") <= size, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    pieces = whole.select("stream_id", F.posexplode(cut).alias("block", "piece")).withColumn("block", F.col("block").cast("long"))
    if spread:
        pieces = pieces.repartition("stream_id", "block")
    chars = pieces.select("stream_id", "block", F.posexplode(F.split("piece", "")).alias("i", "ch")).where("ch <> ''")
    return chars.withColumn("i", (F.col("block") * size + F.col("i") + 1).cast("int"))


def characters(streams: DataFrame, spread: bool = False) -> DataFrame:
    """stream_id, i (from 1), ch. ``spread`` deals streams out before further work."""
    exploded = blocked_characters(streams, spread=False).drop("block")
    return exploded.repartition("stream_id") if spread else exploded


def by_stream(*more: str):
    return Window.partitionBy("stream_id", *more).orderBy("i")
