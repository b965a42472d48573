"""Hold, release and abort: states of checkpoints, the onset of a collapse, and verdicts of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstream.operators import detectors
from weirstream.operators.blocks import block_of, scan
from weirstream.operators.fusion import Thresholds, decide, fuse
from weirstream.operators.sequence_features import BASELINE, LONGEST_RUN, baselines, char_runs, drift, fingerprint_words, repetition, script_switches, surprise, surprise_windows
from weirstream.operators.streams import CHUNK, EVERY, HOLD, blocked_characters, characters, checkpoint_at, checkpoints, chunks, final_positions
from weirstream.operators.window_features import char_entropy, window_features

#: Page-Hinkley: tolerated drift, alarm level, updates before the first alarm. Score from which rules alone abort.
DELTA, LAMBDA, BURN_IN, HARD = 0.02, 0.35, 3, 0.85
#: Chunk ends at which the deflate ratio is renewed lie at least this far apart.
DEFLATE_EVERY = 200


def features(streams: DataFrame, chunk: int = CHUNK, hold: int = HOLD, every: int = EVERY, with_deflate: bool = False, final: bool = False, expected: tuple[str, ...] = ("latin", "cyrillic"), by_text: bool = False) -> DataFrame:
    """All features at every checkpoint (and with ``final`` at the end of each stream, k null).

    Without ``with_deflate`` zlib_ratio is 1.0 and nothing leaves the JVM; with it, the ratio at a checkpoint is
    that of the latest chunk end where it was due. Features of all characters before a position are window functions over
    a row for each character; with ``by_text`` they come from the task that holds the text, and only those of the sliding
    window are column expressions.
    """
    points = checkpoints(streams, chunk, hold, every)
    if final:
        points = points.unionByName(final_positions(streams.where(F.length("text") > 0), chunk))
    if by_text:
        from weirstream.operators import kernel_tier

        own = window_features(points, expected)
        far = tuple(c for c in detectors.VECTOR if c not in own.columns)
        rest = kernel_tier.features(streams, chunk, hold, every, with_deflate, final, expected, columns=far).drop("n_chars")
        same = ["stream_id", "pos", F.col("k").isNull().alias("__end")]  # a checkpoint and an end may be at one place
        return own.select(*same, *[c for c in own.columns if c not in ("stream_id", "pos")]).join(rest.select(*same, *far), ["stream_id", "pos", "__end"]).select("stream_id", "k", "pos", "n_chars", *detectors.VECTOR)
    at = points.select("stream_id", "pos").distinct()
    chars = characters(streams)
    here = at.withColumnRenamed("pos", "i")
    # the baseline is that of a text's first characters: their surprise is computed anew rather than kept
    base = baselines(surprise(characters(streams.withColumn("text", F.left("text", F.lit(BASELINE))))))
    running = char_runs(script_switches(blocked_characters(streams))).join(here, ["stream_id", "i"]).select("stream_id", F.col("i").alias("pos"), (F.col("switches") / F.col("i") * 100).alias("script_switch_rate"), (F.least(F.col("longest_run"), F.lit(LONGEST_RUN)) / LONGEST_RUN).alias("max_char_run"))
    known = points.groupBy("stream_id", "pos").agg(F.min("k").alias("k"), F.first("text").alias("text"), F.first("n_chars").alias("n_chars"))
    out = points.select("stream_id", "k", "pos").join(window_features(known, expected).drop("k"), ["stream_id", "pos"])
    for part in (running, surprise_windows(surprise(chars), base, at), repetition(streams, at), drift(fingerprint_words(chars), known), char_entropy(known, chars)):
        out = out.join(part, ["stream_id", "pos"])
    if with_deflate:
        out = out.join(deflate_at(known, chunk), ["stream_id", "pos"])
    else:
        out = out.withColumn("zlib_ratio", F.lit(1.0))
    return out.select("stream_id", "k", "pos", "n_chars", *detectors.VECTOR)


def deflate_at(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """stream_id, pos, zlib_ratio."""
    from weirstream.functions.kernels import deflate_ratio
    from weirstream.functions.text import window_at
    from weirstream.operators.streams import WINDOW

    step = chunk * -(-DEFLATE_EVERY // chunk)
    regular = (F.floor(F.col("pos") / step) * step).cast("int")
    due = F.when((F.col("pos") == F.col("n_chars")) & (F.col("pos") - regular >= DEFLATE_EVERY), F.col("pos")).otherwise(regular)
    return points.select("stream_id", "pos", F.coalesce(deflate_ratio(window_at(F.col("text"), F.length("text") - (F.col("pos") - due), F.least(due, F.lit(WINDOW)))), F.lit(1.0)).alias("zlib_ratio"))


def scored(rows: DataFrame, learned_p: Column | None = None, thresholds: Thresholds = Thresholds(), chosen: list[str] | None = None) -> DataFrame:
    """Adds scores, p, reasons, classes, top, and hard (rules alone are sure)."""
    # one-element explodes: else every field that is read later would score and fuse anew
    out = rows.withColumn("scores", F.explode(F.array(detectors.build(chosen))))
    out = out.withColumn("__f", F.explode(F.array(fuse(F.col("scores"), learned_p, thresholds))))
    hard = F.exists("scores", lambda s: (s["name"] == "rules") & (s["p"] >= HARD))
    return out.select("*", "__f.*", hard.alias("hard")).drop("__f")


def page_hinkley(rows: DataFrame, value: str = "p", key: str = "stream_id", order: str = "k", delta: float = DELTA, level: float = LAMBDA, burn_in: int = BURN_IN, block: int | None = None) -> DataFrame:
    """Adds ph (cumulative excess over its minimum) and alarm (the first row that passes the level).

    With ``block`` the order is a whole number from 1 without gaps, and a key's rows are scanned in blocks of so many.
    """
    if block:
        out = scan(rows.withColumn("__b", block_of(F.col(order), block)), key, order, sums={"__s": F.col(value)}, block="__b")
        out = out.withColumn("__x", F.col(value) - F.col("__s") / F.col(order) - delta)
        out = scan(scan(out, key, order, sums={"__cum": F.col("__x")}, block="__b"), key, order, minima={"__low": F.col("__cum")}, block="__b")
        out = out.withColumn("ph", F.col("__cum") - F.least(F.lit(0.0), "__low"))
        out = out.withColumn("__o", (F.col("ph") > level) & (F.col(order) > burn_in))
        first = out.where("__o").groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first"))
        out = out.join(first, F.col(key) == F.col("__key"), "left")
        return out.withColumn("alarm", F.coalesce(F.col(order) == F.col("__first"), F.lit(False))).drop("__b", "__s", "__x", "__cum", "__low", "__o", "__key", "__first")
    w = Window.partitionBy(key).orderBy(order)
    out = rows.withColumn("__n", F.row_number().over(w)).withColumn("__x", F.col(value) - F.avg(value).over(w) - delta)
    out = out.withColumn("__cum", F.sum("__x").over(w))
    out = out.withColumn("ph", F.col("__cum") - F.least(F.lit(0.0), F.min("__cum").over(w)))
    over = (F.col("ph") > level) & (F.col("__n") > burn_in)
    return out.withColumn("__o", over.cast("int")).withColumn("alarm", over & (F.sum("__o").over(w) == 1)).drop("__n", "__x", "__cum", "__o")


def marked(points: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Adds state, onset, alarm and after (a corrupt checkpoint came before) to scored checkpoints.

    Corrupt is a sure rule, a second hot checkpoint in a row, or a hot first one while all text is held.
    """
    w = Window.partitionBy("stream_id").orderBy("k")
    hot = F.col("p") >= thresholds.corrupt_at
    out = page_hinkley(points)
    corrupt = F.col("hard") | (hot & ((F.col("k") == 1) | F.coalesce(F.lag(hot).over(w), F.lit(False))))
    out = out.withColumn("__c", corrupt)
    out = out.withColumn("after", F.coalesce(F.max("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    alarm_at = F.first(F.when(F.col("alarm"), F.col("pos")), ignorenulls=True).over(w)
    out = out.withColumn("onset", F.when(F.col("__c"), F.coalesce(alarm_at, F.col("pos"))))
    state = F.when(F.col("__c"), "corrupt").when((F.col("p") >= thresholds.suspect_at) | hot, "suspect").otherwise("clean")
    return out.withColumn("state", state).drop("__c")


def states(points: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Adds state, onset and alarm to scored checkpoints and drops those after the first corrupt one."""
    return marked(points, thresholds).where(~F.col("after")).drop("after")


def verdicts(scored_rows: DataFrame, thresholds: Thresholds = Thresholds(), chunk: int = CHUNK) -> DataFrame:
    """One row for each stream from its scored checkpoints and final row (k null), read in chunks of ``chunk`` characters.

    stream_id, n_chars, state, p, reasons, classes, onset, checkpoints, read_chars (up to the abort),
    released_chars, blocked_chars, aborted. An aborted stream has the verdict of its abort; any other is
    decided by its final score alone, and what is still held then goes out unless that score is corrupt.
    Rows are read once: a final row comes behind its checkpoints, and what is running over them never looks ahead.
    """
    rows = scored_rows.select("stream_id", "pos", "n_chars", "p", "reasons", "classes", "hard", F.col("k").isNull().alias("__end"), F.coalesce("k", F.lit(2**31 - 1)).alias("k"))
    rows = marked(rows, thresholds)
    live = ~F.col("__end") & ~F.col("after")
    both = rows.groupBy("stream_id").agg(
        F.max_by(F.struct("state", "p", "reasons", "classes", "onset", "pos"), F.when(live, F.col("k"))).alias("c"), F.max(F.when(live, F.col("k"))).alias("checkpoints"), F.min(F.when(live & F.col("alarm"), F.col("pos"))).alias("alarm_at"),
        F.first(F.when(F.col("__end"), F.struct("n_chars", F.col("p").alias("fp"), F.col("reasons").alias("fr"), F.col("classes").alias("fc"))), ignorenulls=True).alias("__last"),
    ).where(F.col("__last").isNotNull()).select("stream_id", "c", "checkpoints", "alarm_at", "__last.*")
    aborted = F.coalesce(F.col("c.state") == "corrupt", F.lit(False))
    state = F.when(aborted, "corrupt").otherwise(decide(F.col("fp"), thresholds))
    # text goes out chunk by chunk once the first checkpoint has passed; the chunk of the abort stays back
    released = F.when(aborted & (F.col("checkpoints") == 1), F.lit(0)).when(aborted, F.floor((F.col("c.pos") - 1) / chunk) * chunk).when(F.col("checkpoints").isNull() & (F.col("fp") >= thresholds.corrupt_at), F.lit(0)).otherwise(F.col("n_chars"))
    read = F.when(aborted, F.col("c.pos")).otherwise(F.col("n_chars"))
    onset = F.when(aborted, F.col("c.onset")).when(state == "corrupt", F.coalesce("alarm_at", "c.pos"))
    return both.select(
        "stream_id", "n_chars", state.alias("state"), F.when(aborted, F.col("c.p")).otherwise(F.col("fp")).alias("p"),
        F.when(aborted, F.col("c.reasons")).otherwise(F.col("fr")).alias("reasons"), F.when(aborted, F.col("c.classes")).otherwise(F.col("fc")).alias("classes"),
        onset.cast("long").alias("onset"), F.coalesce("checkpoints", F.lit(0)).cast("long").alias("checkpoints"), read.cast("long").alias("read_chars"),
        released.cast("long").alias("released_chars"), (read - released).cast("long").alias("blocked_chars"), aborted.alias("aborted"),
    )


def guard(streams: DataFrame, chunk: int = CHUNK, thresholds: Thresholds = Thresholds(), with_deflate: bool = False, learned_p: Column | None = None, by_text: bool = False) -> DataFrame:
    """Verdicts of finished texts that are read as if they had come in chunks."""
    return verdicts(scored(features(streams, chunk, with_deflate=with_deflate, final=True, by_text=by_text), learned_p, thresholds), thresholds, chunk)


def released_text(streams: DataFrame, found: DataFrame) -> DataFrame:
    """stream_id, released: what was safe to show."""
    return streams.join(found.select("stream_id", "released_chars"), "stream_id").select("stream_id", F.substring(F.col("text"), F.lit(1), F.col("released_chars").cast("int")).alias("released"))


def events(streams: DataFrame, scored_rows: DataFrame, thresholds: Thresholds = Thresholds(), chunk: int = CHUNK, hold: int = HOLD, every: int = EVERY) -> DataFrame:
    """What a reader of the guard is told, chunk by chunk: a row where text goes out, a score is above 0 or the state changes.

    stream_id, seq, chars (read so far), p, state, released, reasons, onset, features (null where p is 0). Text is held up
    to the first checkpoint and then goes out whole; the first chunk tells the state; nothing comes after a corrupt
    chunk. A chunk finds its checkpoint by arithmetic, so a long stream is rows of many keys, not one ordered window.
    Null and empty texts have no events; what is still held at the end of a short stream is released by its verdict.
    """
    checked = states(scored_rows.where(F.col("k").isNotNull()), thresholds)
    vector = F.struct(*[F.round(c, 5).alias(c) for c in detectors.VECTOR])
    known = checked.select("stream_id", F.col("k").alias("__k"), F.col("pos").alias("__pos"), "p", "state", "reasons", "onset", vector.alias("features"))
    length = F.length("text")
    # the first chunks as one text, for the release of what was held; only chunks of the first checkpoint carry it
    held = streams.where(length > 0).select("stream_id", "text", length.alias("__n"), F.left("text", F.lit(hold + chunk)).alias("__held"))
    told = chunks(held, chunk, keep=["__n", "__held"]).withColumn("chars", F.least(F.col("seq") * chunk, F.col("__n")))
    told = told.withColumn("__k", checkpoint_at(F.col("chars"), F.col("__n"), chunk, hold, every)).withColumn("__held", F.when(F.col("__k") == 1, F.col("__held")))
    out = told.join(known, ["stream_id", "__k"], "left").where("__k = 0 or (__pos is not null and (state <> 'corrupt' or chars = __pos))")
    here = F.col("chars") == F.col("__pos")
    state = F.coalesce("state", F.lit("clean"))
    released = F.when((F.col("__k") == 0) | (state == "corrupt"), "").when(here & (F.col("__k") == 1), F.left("__held", F.col("chars").cast("int"))).otherwise(F.col("chunk"))
    p = F.when(here, F.round("p", 6)).otherwise(0.0)
    hot = here & (F.col("p") > 0)
    out = out.select("stream_id", "seq", "chars", p.alias("p"), state.alias("state"), released.alias("released"), F.when(here, F.col("reasons")).otherwise(F.array().cast("array<string>")).alias("reasons"), F.when(here, F.col("onset")).alias("onset"), F.when(hot, F.col("features")).alias("features"), hot.alias("__hot"))
    return out.where((F.col("released") != "") | F.col("__hot") | (F.col("seq") == 1)).drop("__hot")
