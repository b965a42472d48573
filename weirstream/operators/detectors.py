"""Detectors: each turns feature columns into a score with reasons and classes. New ones are added by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirstream.functions.text import count_of, logistic, ramp

REPETITION, DRIFT, REGURGITATION, STRUCTURAL, SEMANTIC = "repetition_collapse", "cross_lingual_drift", "regurgitation", "structural_breakdown", "semantic_discontinuity"
TAXONOMY = (REPETITION, DRIFT, REGURGITATION, STRUCTURAL, SEMANTIC)
#: Order of the packed feature vector.
VECTOR = ("digit_frac", "foreign_frac", "repeat_rate", "zlib_ratio", "ttr", "script_switch_rate", "structural_density", "symbol_frac", "max_char_run", "space_frac", "surprise_z", "surprise_low_frac", "simhash_drift", "entropy", "max_shingle_count")
#: Detectors that are registered from the start; ``batch_kernel`` and ``stream_kernel`` fuse their scores as well.
STANDARD = ("rules", "ngram", "sketch", "simhash", "entropy")

Detector = Callable[[], Column]
_registry: dict[str, Detector] = {}


def register(name: str) -> Callable[[Detector], Detector]:
    """Decorator: a function without arguments that gives a score over the feature columns."""
    def add(f: Detector) -> Detector:
        _registry[name] = f
        return f
    return add


def unregister(name: str) -> None:
    _registry.pop(name, None)


def names() -> list[str]:
    return list(_registry)


def build(chosen: list[str] | None = None) -> Column:
    """Array of the scores of all registered detectors, or of some, in the order of registration."""
    return F.array(*[_registry[n]() for n in (chosen if chosen is not None else _registry)])


def said(*parts: tuple[Column, Column]) -> Column:
    """Texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, t) for c, t in parts]))


def classes(*parts: tuple[Column, list[str]]) -> Column:
    every = F.flatten(F.array(*[F.when(c, F.array(*map(F.lit, own))).otherwise(F.array().cast("array<string>")) for c, own in parts]))
    return F.array_sort(F.array_distinct(every))


def score(name: str, p: Column, reasons: Column, labels: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), p.cast("double").alias("p"), reasons.cast("array<string>").alias("reasons"), labels.cast("array<string>").alias("classes"))


def fixed(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", x)


@register("rules")
def rules() -> Column:
    """Calibrated thresholds; the strongest branch counts, and three weak signs together count a little."""
    digit, foreign, rate, deflate, run, density, ttr, symbol = map(F.col, ("digit_frac", "foreign_frac", "repeat_rate", "zlib_ratio", "max_char_run", "structural_density", "ttr", "symbol_frac"))
    dump, alien, loop = digit > 0.28, foreign > 0.05, (rate > 0.55) & (deflate < 0.32)
    repeats, runs, traces, poor = ~loop & (rate > 0.72), run >= 0.5, density > 1.2, (ttr < 0.22) & (rate > 0.45)
    strength = lambda on, p: F.when(on, p).otherwise(F.lit(0.0))
    strong = F.greatest(
        strength(dump, 0.7 + 0.3 * F.least(F.lit(1.0), (digit - 0.28) / 0.2)), strength(alien, 0.7 + 0.3 * F.least(F.lit(1.0), (foreign - 0.05) / 0.25)),
        strength(loop, F.lit(0.85)), strength(repeats, F.lit(0.75)), strength(runs, F.lit(0.7)), strength(traces, F.lit(0.75)), strength(poor, F.lit(0.7)),
    )
    signs = sum(((c).cast("int") for c in (digit > 0.10, foreign > 0.02, rate > 0.5, density > 0.6, symbol > 0.18)), F.lit(0))
    weak = (signs >= 3) & (strong < 0.6)
    reasons = said(
        (dump, F.concat(F.lit("numeric dump digit_frac="), fixed(digit, 2))), (alien, F.concat(F.lit("foreign-script frac="), fixed(foreign, 2))),
        (loop, F.concat(F.lit("repetition loop rate="), fixed(rate, 2), F.lit(" zlib="), fixed(deflate, 2))), (repeats, F.concat(F.lit("repetition rate="), fixed(rate, 2))),
        (runs, F.lit("long same-char run")), (traces, F.concat(F.lit("structural artifacts density="), fixed(density, 1))),
        (poor, F.concat(F.lit("vocabulary collapse ttr="), fixed(ttr, 2))), (weak, F.lit("multiple weak anomalies")),
    )
    labels = classes((dump, [STRUCTURAL]), (alien, [DRIFT]), (loop | repeats | poor, [REPETITION]), (runs, [STRUCTURAL]), (traces, [STRUCTURAL, REGURGITATION]))
    return score("rules", F.when(weak, F.lit(0.6)).otherwise(strong), reasons, labels)


@register("ngram")
def ngram() -> Column:
    """High surprise against the baseline is drift; its collapse is repetition, if repeats confirm it."""
    z, low = F.col("surprise_z"), F.col("surprise_low_frac")
    spike = ramp(z, 3.0, 9.0)
    collapse = F.when(F.col("repeat_rate") > 0.4, ramp(low, 0.85, 0.97)).otherwise(F.lit(0.0))
    reasons = said((spike >= 0.5, F.concat(F.lit("surprise spike z="), fixed(z, 1))), (collapse >= 0.5, F.concat(F.lit("surprise collapse low_frac="), fixed(low, 2))))
    return score("ngram", F.greatest(spike, collapse), reasons, classes((spike >= 0.5, [DRIFT, REGURGITATION]), (collapse >= 0.5, [REPETITION])))


@register("sketch")
def sketch() -> Column:
    """The share of repeated shingles; the highest count only sharpens a high share."""
    rate, most = F.col("repeat_rate"), F.col("max_shingle_count")
    p = F.least(F.lit(1.0), ramp(rate, 0.55, 0.9) + F.when(rate > 0.5, 0.3 * ramp(most, 0.3, 0.8)).otherwise(F.lit(0.0)))
    text = F.concat(F.lit("repetition rate="), fixed(rate, 2), F.lit(" maxcount="), F.floor(most * 30 + 1e-9).cast("string"))
    return score("sketch", p, said((p >= 0.5, text)), classes((p >= 0.5, [REPETITION])))


@register("simhash")
def simhash() -> Column:
    """Distance from the fingerprint of the beginning; capped, so it can only confirm others."""
    d = F.col("simhash_drift")
    p = 0.60 * ramp(d, 0.42, 0.52)
    return score("simhash", p, said((p >= 0.5, F.concat(F.lit("semantic drift hamming="), fixed(d, 2)))), classes((p >= 0.5, [REGURGITATION, SEMANTIC])))


@register("entropy")
def entropy() -> Column:
    """Few different characters, together with digits or repeats."""
    h = F.col("entropy")
    on = (h < 0.45) & ((F.col("digit_frac") > 0.25) | (F.col("repeat_rate") > 0.5))
    p = F.when(on, ramp(0.45 - h, 0.0, 0.25) * 0.9 + 0.1).otherwise(F.lit(0.0))
    return score("entropy", p, said((on, F.concat(F.lit("entropy collapse H="), fixed(h, 2)))), classes((on, [REPETITION, STRUCTURAL])))


def lexicon(name: str, patterns: list[str], labels: tuple[str, ...] = ("custom",), bar: float = 0.35) -> Detector:
    """A detector of known markers: hits of the patterns (any case) for each 100 characters of ``window``."""
    def own() -> Column:
        w = F.col("window")
        hits = sum((count_of(w, f"(?i){p}") for p in patterns), F.lit(0).cast("long"))
        density = hits / F.greatest(F.lit(1.0), F.length(w) / 100)
        p = F.when((F.length(w) >= 80) & (density >= bar), F.least(F.lit(1.0), 0.7 + 0.3 * density / (3 * bar))).otherwise(F.lit(0.0))
        text = F.concat(F.lit(f"lexicon:{name} hits="), hits.cast("string"), F.lit(" density="), fixed(density, 2))
        return score(f"lexicon:{name}", p, said((p >= 0.5, text)), classes((p >= 0.5, list(labels))))
    return own


def linear_score(weights: list[float], bias: float, features: tuple[str, ...] = VECTOR) -> Column:
    """Probability of a linear model over feature columns."""
    if len(weights) != len(features):
        raise ValueError(f"{len(weights)} weights for {len(features)} features")
    return logistic(sum((F.lit(w) * F.col(f) for w, f in zip(weights, features, strict=True)), F.lit(0.0)) + bias)


def learned(name: str, weights: list[float], bias: float, cap: float = 0.9, labels: tuple[str, ...] = ("custom",)) -> Detector:
    """A detector fitted for one failure, never surer than ``cap``."""
    def own() -> Column:
        p = F.least(F.lit(cap), linear_score(weights, bias))
        return score(f"custom:{name}", p, said((p >= 0.5, F.concat(F.lit(f"custom:{name} p="), fixed(p, 2)))), classes((p >= 0.5, list(labels))))
    return own
