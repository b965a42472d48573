"""Features of the last 600 characters at each checkpoint, as column expressions without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstream.functions.text import ARTEFACTS, DIGITS, EXPECTED, LETTERS, SPACES, SYMBOLS, WORD, count_of, foreign, one_of, ratio
from weirstream.operators.streams import WINDOW


def window_counts(points: DataFrame, expected: tuple[str, ...] = EXPECTED, size: int = WINDOW) -> DataFrame:
    """Adds n, digits, spaces, symbols, letters and foreign_letters of the window to checkpoints."""
    w = F.col("window")
    counted = points.withColumn("window", F.right("text", F.lit(size)))
    other = foreign(expected)
    return counted.withColumns({
        "n": F.length(w).cast("long"),
        "digits": count_of(w, one_of(DIGITS)),
        "spaces": count_of(w, one_of(SPACES)),
        "symbols": count_of(w, one_of(SYMBOLS)),
        "letters": count_of(w, one_of(LETTERS)),
        "foreign_letters": count_of(w, one_of(other)) if other else F.lit(0).cast("long"),
        "artefacts": sum((count_of(w, p) for p in ARTEFACTS), F.lit(0).cast("long")),
        "words": F.regexp_extract_all(w, F.lit(WORD), F.lit(0)),
    })


def window_features(points: DataFrame, expected: tuple[str, ...] = EXPECTED, size: int = WINDOW) -> DataFrame:
    """stream_id, k, pos, n_chars with digit_frac, space_frac, symbol_frac, foreign_frac, ttr and structural_density."""
    n = F.greatest(F.col("n"), F.lit(1))
    return window_counts(points, expected, size).select(
        "stream_id", "k", "pos", "n_chars",
        (F.col("digits") / n).alias("digit_frac"),
        ratio(F.col("foreign_letters"), F.col("letters")).alias("foreign_frac"),
        F.when(F.size("words") > 0, F.size(F.array_distinct("words")) / F.size("words")).otherwise(F.lit(1.0)).alias("ttr"),
        (F.col("artefacts") / F.greatest(F.lit(1.0), n / 100)).alias("structural_density"),
        (F.col("symbols") / n).alias("symbol_frac"),
        (F.col("spaces") / n).alias("space_frac"),
    )


def char_entropy(points: DataFrame, chars: DataFrame, size: int = WINDOW) -> DataFrame:
    """stream_id, pos, entropy: of the window's characters, relative to the alphabet seen since the stream began."""
    w = points.select("stream_id", "pos", F.explode(F.split(F.right("text", F.lit(size)), "")).alias("ch")).where("ch <> ''")
    counts = w.groupBy("stream_id", "pos", "ch").agg(F.count("*").alias("c"))
    spread = counts.groupBy("stream_id", "pos").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    first = chars.groupBy("stream_id", "ch").agg(F.min("i").alias("i"))
    seen = points.select("stream_id", "pos").join(first, "stream_id").where("i <= pos").groupBy("stream_id", "pos").agg(F.count("*").alias("alphabet"))
    h = F.log2("n") - F.col("s") / F.col("n")
    return spread.join(seen, ["stream_id", "pos"]).select("stream_id", "pos", F.when(F.col("n") < 2, F.lit(1.0)).otherwise(h / F.log2(F.greatest("alphabet", F.lit(2)))).alias("entropy"))
