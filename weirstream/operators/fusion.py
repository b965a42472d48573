"""From detector scores to one probability and a state, with calibrated thresholds."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    corrupt_at: float = 0.7
    suspect_at: float = 0.5
    learned_weight: float = 0.75


def fuse(scores: Column, learned_p: Column | None = None, thresholds: Thresholds = Thresholds()) -> Column:
    """struct(p, reasons, classes, top): the strongest source, and 0.12 more if two or more reach one half.

    Reasons and classes come from scores of one half or more; a model that is the strongest gives its own.
    """
    strong = F.filter(scores, lambda s: s["p"] >= 0.5)
    best = F.coalesce(F.array_max(F.transform(scores, lambda s: s["p"])), F.lit(0.0))
    model = F.lit(0.0) if learned_p is None else F.least(F.lit(0.999), F.lit(thresholds.learned_weight) * learned_p)
    leads = model > best
    top = F.when(leads, "learned").when(best > 0, F.get(F.filter(scores, lambda s: s["p"] == best), F.lit(0))["name"]).otherwise("")
    sources = F.size(strong) + (model >= 0.5).cast("int")
    strongest = F.greatest(best, model)
    reasons = F.flatten(F.transform(strong, lambda s: s["reasons"]))
    if learned_p is not None:
        reasons = F.concat(reasons, F.when(leads, F.array(F.concat(F.lit("learned model p="), F.format_string("%.2f", learned_p)))).otherwise(F.array().cast("array<string>")))
    return F.struct(
        F.when(sources >= 2, F.least(F.lit(1.0), strongest + 0.12)).otherwise(strongest).alias("p"),
        F.array_distinct(reasons).alias("reasons"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(strong, lambda s: s["classes"])))).alias("classes"),
        top.alias("top"),
    )


def decide(p: Column, thresholds: Thresholds = Thresholds()) -> Column:
    return F.when(p >= thresholds.corrupt_at, "corrupt").when(p >= thresholds.suspect_at, "suspect").otherwise("clean")


def order_statistic(scores: DataFrame, column: str, rank: int, bins: int = 1024) -> float | None:
    """The value of 1-based ``rank`` in ascending order, by narrowing down: each pass counts ``bins`` equal parts
    of the range that is left and goes on in the one that holds the rank. No pass sorts or collects the rows."""
    x = F.col(column)
    low, high = scores.agg(F.min(x), F.max(x)).first()
    while low is not None and low < high:
        part = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
        counts = scores.where(x.between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        for r in counts.orderBy("part").collect():
            if rank <= r.n:
                low, high = r.low, r.high
                break
            rank -= r.n
    return low


def conformal_rank(n: int, alpha: float, compat: bool = False) -> int:
    """1-based rank of the threshold among n clean scores: the ceiling of (1 - alpha)(n + 1), or its floor (``compat``)."""
    exact = (1 - alpha) * (n + 1)
    return max(1, min(n, int(exact) if compat else math.ceil(exact - 1e-9)))


def calibrate(clean: DataFrame, column: str = "p", alpha: float = 0.02, suspect_alpha: float = 0.1, start: Thresholds = Thresholds(), compat: bool = False) -> Thresholds:
    """Thresholds that at most a share ``alpha`` of clean streams reach; fewer than five scores change nothing."""
    clean = clean.where(F.col(column).isNotNull())
    n = clean.count()
    if n < 5:
        return start
    corrupt = max(0.55, min(0.95, order_statistic(clean, column, conformal_rank(n, alpha, compat)) + 1e-6))
    suspect = max(0.4, min(corrupt - 0.05, order_statistic(clean, column, conformal_rank(n, suspect_alpha, compat))))
    return Thresholds(corrupt, suspect, start.learned_weight)
