"""Evaluation of scores against labels: ranks, losses, rates by group, and verdicts against known onsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks in which distinct scores are ordered.
SCORE_BLOCKS = 200


def auroc(rows: DataFrame, score: str, label: str, by: list[str] | None = None, ties: str = "mid", one_class: float | None = None) -> DataFrame:
    """Area under the ROC curve from rank sums; ``one_class`` (else null) if a class is missing.

    ``ties``: mid (equal scores count half), positive (positives come first among equals), negative.
    Distinct scores are counted before they are ranked. They are ordered in blocks between quantiles of them, and the
    blocks' totals by group, so neither rows nor distinct scores of a group are ever one task's work.
    """
    by = by or []
    counted = rows.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("__s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg"))
    share = {"mid": 0.5, "positive": 0.0, "negative": 1.0}[ties]
    group = F.struct(F.lit(0).alias("all"), *by).alias("__g")  # a key in which nulls are equal
    edges = counted.groupBy(*by).agg(F.percentile_approx("__s", [k / SCORE_BLOCKS for k in range(1, SCORE_BLOCKS)]).alias("__e")).select(group, "__e")
    if not by:
        edges = F.broadcast(edges)  # one row
    placed = counted.select(group, *by, "__s", "pos", "neg").join(edges, "__g").withColumn("__b", F.size(F.filter("__e", lambda e: e < F.col("__s")))).drop("__e")
    totals = placed.groupBy("__g", "__b").agg(F.sum("neg").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__g", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__g", "__b").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("__before") + F.coalesce(F.sum("neg").over(inside), F.lit(0))
    ranked = placed.join(totals, ["__g", "__b"]).withColumn("__a", F.col("pos") * (below + share * F.col("neg")))
    found = ranked.groupBy(*by).agg(F.sum("__a").alias("__a"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return found.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("__a") / (F.col("p") * F.col("n"))).otherwise(F.lit(one_class)).alias("auroc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def log_loss(p: Column, label: Column, eps: float = 1e-7) -> Column:
    """Mean negative log-likelihood, as an aggregate."""
    q = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p))
    return F.avg(F.when(label == 1, -F.log(q)).otherwise(-F.log(1 - q)))


def accuracy(p: Column, label: Column, at: float = 0.5) -> Column:
    return F.avg(((p >= at) == (label == 1)).cast("double"))


def precision_recall(rows: DataFrame, score: str, label: str, by: list[str] | None = None, at: float = 0.5) -> DataFrame:
    """n, positives, flagged, precision, recall, accuracy of each group."""
    hit, true = F.col(score) >= at, F.col(label) == 1
    tp = F.sum((hit & true).cast("long"))
    flagged, positives = F.sum(hit.cast("long")), F.sum(true.cast("long"))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), positives.alias("positives"), flagged.alias("flagged"),
        F.when(flagged > 0, tp / flagged).alias("precision"), F.when(positives > 0, tp / positives).alias("recall"), accuracy(F.col(score), F.col(label), at).alias("accuracy"),
    )


def tpr_at_fpr(rows: DataFrame, score: str, label: str, fpr: float = 0.01) -> DataFrame:
    """threshold (a quantile of the negatives, linear between values) and tpr (positives above it); no row without both.

    The two values around the quantile are found by narrowing intervals of counts, so no task sorts all negatives; scores
    and labels are written first, so they are computed once.
    """
    from weirstream.operators.fusion import order_statistic
    from weirstream.sources.work import written

    slim = written(rows.select(F.col(score).cast("double").alias("s"), F.col(label).alias("y")).where("s is not null and y in (0, 1)"), "scores")
    negatives = slim.where("y = 0")
    n = negatives.count()
    kind = "threshold double, tpr double"
    if not n or not slim.where("y = 1").limit(1).count():
        return rows.sparkSession.createDataFrame([], kind)
    place = (1 - fpr) * (n - 1)
    low, part = int(place), place - int(place)
    threshold = order_statistic(negatives, "s", low + 1)
    if part:
        threshold = (1 - part) * threshold + part * order_statistic(negatives, "s", min(n, low + 2))
    return slim.where("y = 1").agg(F.lit(threshold).alias("threshold"), F.avg((F.col("s") > threshold).cast("double")).alias("tpr"))


def stream_evaluation(verdicts: DataFrame, truth: DataFrame, hold: int = 350) -> DataFrame:
    """By corruption class: streams, flagged, early alarms (before the onset), recall, latency and onset errors.

    Latency is in characters read past the onset; alarms before it count apart. read_chars says what was
    really read, so throughput isn't overstated by aborted streams.
    """
    v = verdicts.join(truth, "stream_id")
    flagged = F.col("state") == "corrupt"
    late = flagged & (F.col("read_chars") >= F.col("onset_char"))
    early_onset = (F.col("label") == 1) & (F.col("onset_char") < hold)
    return v.groupBy("corruption_class").agg(
        F.count("*").alias("streams"), F.sum(flagged.cast("long")).alias("flagged"), F.sum((flagged & ~late & (F.col("label") == 1)).cast("long")).alias("early_alarms"),
        F.avg(flagged.cast("double")).alias("rate"), F.percentile(F.when(late, F.col("read_chars") - F.col("onset_char")), 0.5).alias("latency_median"),
        F.percentile(F.when(late, F.col("read_chars") - F.col("onset_char")), 0.9).alias("latency_p90"), F.percentile(F.when(flagged, F.abs(F.col("onset") - F.col("onset_char"))), 0.5).alias("onset_error_median"),
        F.sum((early_onset & flagged & (F.col("released_chars") == 0)).cast("long")).alias("nothing_leaked"), F.sum(early_onset.cast("long")).alias("could_leak"), F.sum("read_chars").alias("read_chars"),
    )


def bucket(key: Column, parts: int = 1000) -> Column:
    """A stable part number of a key from its md5, the same on any engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("long") % parts


def split_by_key(key: Column, test_share: float = 0.2) -> Column:
    """train or test; rows of one key are never divided."""
    return F.when(bucket(key) < round(1000 * test_share), "test").otherwise("train")
