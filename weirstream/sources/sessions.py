"""Recorded guard sessions, models and thresholds as tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from weirstream.operators.fusion import Thresholds

SESSION_ID = "^[0-9a-f]{12}$"


def record(frames: DataFrame, ended: DataFrame) -> DataFrame:
    """Sessions from frames (session_id, t, chars, p, state, released, and any of reasons, onset, features) and ends
    (session_id, created_at, mode, state, p, and chars where not all of them are in frames).

    Frames of a session are kept in order of t; released and blocked characters add up to those read.
    """
    fields = ["t", "chars", "p", "state", "released", *[c for c in ("reasons", "onset", "features") if c in frames.columns]]
    listed = frames.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("frames"), F.max("chars").alias("chars"), F.sum(F.length(F.coalesce("released", F.lit("")))).alias("released_chars"))
    if "chars" in ended.columns:
        listed = listed.drop("chars")
    return ended.join(listed, "session_id", "left").withColumn("released_chars", F.coalesce("released_chars", F.lit(0))).withColumn("blocked_chars", F.col("chars") - F.col("released_chars")).withColumn("day", F.to_date(F.timestamp_seconds("created_at")))


def save(sessions: DataFrame, path: str) -> None:
    """Append sessions with well-formed ids, partitioned by day."""
    sessions.where(F.col("session_id").rlike(SESSION_ID)).write.mode("append").partitionBy("day").parquet(path)


def sink(path: str):
    """A foreachBatch function that writes each micro-batch of sessions once, partitioned by batch and day.

    A batch that comes again replaces the folders that it has written before, so a query that restarts between
    writing and committing leaves the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        own = batch.where(F.col("session_id").rlike(SESSION_ID)).withColumn("batch", F.lit(number))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(path)

    return write


def newest(sessions: DataFrame, n: int = 50) -> DataFrame:
    return sessions.orderBy(F.desc("created_at"), "session_id").limit(n).drop("frames")


def get(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.where(F.col("session_id") == session_id)


def without(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """What is left after deleting sessions; written as a new version of the table."""
    return sessions.join(ids.select("session_id"), "session_id", "left_anti")


def replay(sessions: DataFrame, speed: float = 1.0) -> DataFrame:
    """Frames with the time at which a player shows them, in milliseconds; speed from 1 to 128."""
    if not 1 <= speed <= 128:
        raise ValueError("speed is from 1 to 128")
    return sessions.select("session_id", F.inline("frames")).withColumn("emit_ms", F.col("t") / speed)


def write_thresholds(spark: SparkSession, t: Thresholds, path: str) -> None:
    spark.createDataFrame([(t.corrupt_at, t.suspect_at, t.learned_weight)], "corrupt_at double, suspect_at double, learned_weight double").coalesce(1).write.mode("overwrite").json(path)


def read_thresholds(spark: SparkSession, path: str) -> Thresholds:
    """Missing fields take the defaults; a missing weight is 1.0, as older files mean it."""
    r = spark.read.schema("corrupt_at double, suspect_at double, learned_weight double").json(path).first()
    return Thresholds(0.7 if r.corrupt_at is None else r.corrupt_at, 0.5 if r.suspect_at is None else r.suspect_at, 1.0 if r.learned_weight is None else r.learned_weight)


def write_model(model: DataFrame, path: str) -> None:
    model.select("w", "b", "seen").coalesce(1).write.mode("overwrite").json(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("w array<double>, b double, seen long").json(path)


def write_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    """One JSON document, for whoever polls it: written beside ``path`` and renamed over it, so a reader never finds it
    missing or half written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    target = fs.Path(path)
    beside = fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = beside.getFileSystem(conf).create(beside, True)
    out.write(bytearray(json.dumps(metrics, sort_keys=True).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    over[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(target.toUri(), conf).rename(beside.makeQualified(beside.getFileSystem(conf).getUri(), beside.getFileSystem(conf).getWorkingDirectory()), target, over)


def read_metrics(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


class MetricsListener(StreamingQueryListener):
    """Writes what streaming queries ``observe`` after each micro-batch: observed metrics by name, batch and rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = {name: row.asDict() for name, row in p.observedMetrics.items()}
        write_metrics(self.spark, {"batch": p.batchId, "rows": p.numInputRows, "observed": seen}, self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
