"""Features that depend on the order of characters since a stream began, as window functions.

Switches and runs are scans by blocks of positions (``blocks``), so one stream may be many tasks. The other windows are
partitioned by the stream and what they count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstream.functions.text import RUN_EXCLUDED, SCRIPTS, char_class
from weirstream.operators.blocks import block_of, scan
from weirstream.operators.streams import by_stream

#: Weights of orders 3 to 0 and additive smoothing of the online model; least alphabet.
WEIGHTS, SMOOTHING, LEAST_ALPHABET = (0.55, 0.28, 0.12, 0.05), 0.02, 30
#: Characters of the surprise baseline, of the recent mean, and the rate of the moving averages.
BASELINE, RECENT, ALPHA = 300, 200, 0.03
#: Length and distance of shingles; words of the fingerprint window; least words of a baseline fingerprint.
SHINGLE, STRIDE, FINGERPRINT_WORDS, LEAST_WORDS = 12, 4, 48, 8
#: Caps of the run and shingle features.
LONGEST_RUN, MOST_SHINGLES = 40, 30


def with_block(chars: DataFrame) -> DataFrame:
    return chars if "block" in chars.columns else chars.withColumn("block", block_of(F.col("i")))


def script_switches(chars: DataFrame) -> DataFrame:
    """Adds ``switches``: changes of script between successive letters up to each character; by blocks of positions."""
    letter = F.col("cls").isin(*SCRIPTS)
    known = with_block(chars).withColumn("cls", char_class(F.col("ch")))
    known = scan(known, "stream_id", "i", lasts={"__from": F.when(letter, F.col("cls"))})
    return scan(known, "stream_id", "i", sums={"switches": F.coalesce((letter & (F.col("__from") != F.col("cls"))).cast("long"), F.lit(0))}).drop("__from")


def char_runs(chars: DataFrame) -> DataFrame:
    """Adds ``longest_run``: length of the longest run of one character so far; excluded characters never accumulate. By
    blocks of positions: a run is as long as the last break lies back."""
    known = scan(with_block(chars), "stream_id", "i", lasts={"__from": F.col("ch")})
    breaks = F.coalesce((F.col("ch") != F.col("__from")) | F.col("ch").isin(*RUN_EXCLUDED), F.lit(True))
    known = scan(known, "stream_id", "i", maxima={"__start": F.when(breaks, F.col("i"))})
    return scan(known, "stream_id", "i", maxima={"longest_run": (F.col("i") - F.col("__start") + 1).cast("long")}).drop("__from", "__start")


def surprise(chars: DataFrame) -> DataFrame:
    """Adds ``surprise``: bits of each character under an interpolated n-gram model of all characters before it.

    Counts before a character are row numbers over its context. With fewer characters of history (n) than
    the order k, the context is the last min(n, k - n) of them.
    """
    order = len(WEIGHTS) - 1
    lags = {f"__l{j}": F.lag("ch", j).over(by_stream()) for j in range(1, order + 1)}
    n = F.col("i") - 1
    context = {}
    for k in range(1, order + 1):
        whole = F.concat_ws("", *[F.col(f"__l{j}") for j in range(k, 0, -1)])
        context[f"__c{k}"] = F.when(n >= k, whole).otherwise(F.concat_ws("", *[F.when((n >= j) & (k - n >= j), F.col(f"__l{j}")) for j in range(k, 0, -1)]))
    out = chars.withColumns(lags).withColumns(context).withColumn("__c0", F.lit(""))
    first = (F.row_number().over(by_stream("ch")) == 1).cast("long")
    out = out.withColumn("__new", first)
    seen = F.coalesce(F.sum("__new").over(by_stream().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alphabet = F.greatest(F.lit(LEAST_ALPHABET), seen + 1)
    p: Column = F.lit(0.0)
    for k, weight in zip(range(order, -1, -1), WEIGHTS, strict=True):
        total = F.row_number().over(by_stream(f"__c{k}")) - 1
        count = F.row_number().over(by_stream(f"__c{k}", "ch")) - 1
        out = out.withColumns({f"__t{k}": total, f"__n{k}": count})
        p = p + weight * (F.col(f"__n{k}") + SMOOTHING) / (F.col(f"__t{k}") + SMOOTHING * F.col("__v"))
    out = out.withColumn("__v", alphabet).withColumn("surprise", -F.log2(F.least(F.lit(1.0), F.greatest(F.lit(1e-9), p))))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def moving_baseline(values: Column, alpha: float = ALPHA) -> Column:
    """struct(mean, mad) of an array: an exponentially moving mean and mean absolute deviation; the first value sets the mean alone."""
    step = lambda s, x: F.struct((s["mean"] + alpha * (x - s["mean"])).alias("mean"), (s["mad"] + alpha * (F.abs(x - s["mean"]) - s["mad"])).alias("mad"))
    start = F.struct(F.coalesce(F.get(values, F.lit(0)), F.lit(0.0)).alias("mean"), F.lit(0.0).alias("mad"))
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), start, step)


def baselines(surprised: DataFrame, alpha: float = ALPHA, first: int = BASELINE) -> DataFrame:
    """stream_id, mean, mad, n of the first characters' surprise."""
    head = surprised.where(F.col("i") <= first).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("i", "surprise"))).alias("s"))
    values = F.transform("s", lambda s: s["surprise"])
    folded = head.select("stream_id", moving_baseline(values, alpha).alias("b"), F.size("s").alias("n"))
    return folded.select("stream_id", F.col("b.mean").alias("mean"), F.col("b.mad").alias("mad"), "n")


def surprise_windows(surprised: DataFrame, base: DataFrame, points: DataFrame) -> DataFrame:
    """stream_id, pos, surprise_z, surprise_low_frac over the last characters before each checkpoint."""
    recent = by_stream().rowsBetween(1 - RECENT, 0)
    joined = surprised.join(base, "stream_id")
    low = (F.col("surprise") < F.greatest(F.lit(0.5), F.col("mean") - F.col("mad"))).cast("double")
    rows = joined.withColumns({"now": F.avg("surprise").over(recent), "surprise_low_frac": F.avg(low).over(recent)})
    z = F.when(F.col("n") < 3, F.lit(0.0)).otherwise((F.col("now") - F.col("mean")) / (1.4826 * F.col("mad") + 1e-6))
    at = points.select("stream_id", F.col("pos").alias("i"))
    return rows.join(at, ["stream_id", "i"]).select("stream_id", F.col("i").alias("pos"), z.alias("surprise_z"), "surprise_low_frac")


def shingles(streams: DataFrame) -> DataFrame:
    """stream_id, i (last character), total, repeats, most: shingles so far, those seen before, and the highest count.

    Texts are cut in one pass; what is counted so far is a scan by blocks of shingles.
    """
    each = F.regexp_extract_all("text", F.lit(rf"(?s)(?=(.{{{SHINGLE}}})).{{{STRIDE}}}"), F.lit(1))
    cut = streams.where(F.length("text") >= SHINGLE).select("stream_id", F.posexplode(each).alias("j", "shingle"))
    cut = cut.select("stream_id", "shingle", (F.col("j") + 1).cast("long").alias("total"), (SHINGLE + STRIDE * F.col("j")).cast("int").alias("i"))
    counted = cut.withColumn("__n", F.row_number().over(by_stream("shingle")).cast("long")).withColumn("block", block_of(F.col("total")))
    return scan(counted, "stream_id", "i", sums={"repeats": (F.col("__n") > 1).cast("long")}, maxima={"most": F.col("__n")}).select("stream_id", "i", "total", "repeats", "most")


def repetition(streams: DataFrame, points: DataFrame) -> DataFrame:
    """stream_id, pos, repeat_rate, max_shingle_count by exact counts of all shingles up to each checkpoint."""
    last = F.when(F.col("pos") >= SHINGLE, SHINGLE + STRIDE * F.floor((F.col("pos") - SHINGLE) / STRIDE)).cast("int")
    at = points.select("stream_id", "pos", last.alias("i"))
    found = at.join(shingles(streams), ["stream_id", "i"], "left")
    return found.select("stream_id", "pos", F.coalesce(F.col("repeats") / F.col("total"), F.lit(0.0)).alias("repeat_rate"), (F.least(F.coalesce("most", F.lit(0)), F.lit(MOST_SHINGLES)) / MOST_SHINGLES).alias("max_shingle_count"))


def fingerprint_words(chars: DataFrame) -> DataFrame:
    """stream_id, w (from 1), i (where the word ended), bits: 64 of the word's md5.

    A word is the letters and digits between two separators (white space or ASCII symbols), in lower case;
    other characters are passed over, and the last word of a stream needs a separator behind it.
    """
    separator = F.col("cls").isin("space", "symbol")
    marked = chars.withColumn("cls", char_class(F.col("ch"))).withColumn("__g", F.sum(separator.cast("long")).over(by_stream()) - separator.cast("long"))
    alnum = F.col("ch").rlike(r"[\p{L}\p{N}]")
    letters = F.array_sort(F.collect_list(F.when(alnum & ~separator, F.struct("i", "ch"))))
    words = marked.groupBy("stream_id", "__g").agg(F.max(F.when(separator, F.col("i"))).alias("i"), F.lower(F.array_join(F.transform(letters, lambda s: s["ch"]), "")).alias("word")).where("i is not null and word <> ''")
    hexes = F.translate(F.substring(F.md5("word"), 1, 16), "0123456789abcdef", "ghijklmnopqrstuv")
    for d, c in enumerate("ghijklmnopqrstuv"):
        hexes = F.replace(hexes, F.lit(c), F.lit(f"{d:04b}"))
    return words.select("stream_id", F.row_number().over(by_stream()).alias("w"), "i", hexes.alias("bits"))


def fingerprints(words: DataFrame, points: DataFrame) -> DataFrame:
    """stream_id, pos, n_words, fingerprint: the majority of each bit over the last words before each checkpoint (a tie is 0)."""
    # words and checkpoints in one order: a checkpoint knows the number of the last word before it, and so which words it reads
    both = words.select("stream_id", "i", "w", F.lit(None).cast("int").alias("pos")).unionByName(points.select("stream_id", F.col("pos").alias("i"), F.lit(None).cast("int").alias("w"), "pos"))
    order = Window.partitionBy("stream_id").orderBy("i", F.col("pos").isNotNull())
    last = both.withColumn("__w", F.max("w").over(order)).where("pos is not null and __w is not null").select("stream_id", "pos", F.col("__w"))
    read = last.select("stream_id", "pos", F.explode(F.sequence(F.greatest(F.lit(1), F.col("__w") - FINGERPRINT_WORDS + 1), F.col("__w"))).alias("w"))
    near = read.join(words.select("stream_id", "w", "bits"), ["stream_id", "w"])
    ones = [F.sum(F.substring("bits", b + 1, 1).cast("int")).alias(f"__b{b}") for b in range(64)]
    voted = near.groupBy("stream_id", "pos").agg(F.count("*").alias("n_words"), *ones)
    return voted.select("stream_id", "pos", "n_words", F.concat(*[F.when(2 * F.col(f"__b{b}") > F.col("n_words"), "1").otherwise("0") for b in range(64)]).alias("fingerprint"))


def drift(words: DataFrame, points: DataFrame) -> DataFrame:
    """stream_id, pos, simhash_drift: share of bits that differ from the fingerprint at the first checkpoint."""
    found = fingerprints(words, points)
    first = Window.partitionBy("stream_id").orderBy("pos")
    joined = points.select("stream_id", "k", "pos").join(found, ["stream_id", "pos"], "left")
    base = F.first("fingerprint").over(first)
    warm = (F.first("n_words").over(first) >= LEAST_WORDS) & (F.first("k").over(first) == 1) & (F.col("n_words") >= LEAST_WORDS)
    pairs = F.arrays_zip(F.split("fingerprint", "").alias("a"), F.split(base, "").alias("b"))
    differ = F.size(F.filter(pairs, lambda p: p["a"] != p["b"])) / 64
    later = F.coalesce(F.row_number().over(first) > 1, F.lit(False))
    return joined.select("stream_id", "pos", F.when(warm & later, differ).otherwise(F.lit(0.0)).alias("simhash_drift"))
