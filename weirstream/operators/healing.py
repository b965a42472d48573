"""Repair of corrupt texts: what to do, where to cut, and how to join a continuation."""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstream.functions.arrow import pieces
from weirstream.functions.kernels import loop_onset
from weirstream.operators.detectors import DRIFT, REGURGITATION, REPETITION, SEMANTIC, STRUCTURAL
from weirstream.operators.protocol import DEFLATE_EVERY

#: Instructions of a repair, by class in order of priority; our own words.
INSTRUCTIONS = {
    REPETITION: "Continue without repeating what was said; if nothing is left to say, end.",
    DRIFT: "Continue in the language and script of the text so far.",
    STRUCTURAL: "Continue in plain sentences, without tables or markup.",
    REGURGITATION: "Continue on the topic; do not recite unrelated documents.",
}
#: Bytes of texts whose probes are scored together.
TRIM_BYTES = 8_000_000
#: Overlaps of a continuation with the end of its prefix: longest, shortest, distance of lengths that are tried.
LONGEST_ECHO, SHORTEST_ECHO, ECHO_STRIDE = 240, 24, 4


def inferred_classes(reasons: Column, classes: Column) -> Column:
    """The classes given and those that words of the reasons stand for, sorted."""
    said = F.lower(F.array_join(reasons, " "))
    signs = [(REPETITION, ["repetition", "vocabulary collapse"]), (DRIFT, ["foreign"]), (STRUCTURAL, ["structural", "numeric dump", "same-char run"]), (REGURGITATION, ["regurgitat"]), (SEMANTIC, ["semantic", "simhash"])]
    more = []
    for name, words in signs:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(said, F.lit(w))
        more.append(F.when(found, F.lit(name)))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(classes, F.array().cast("array<string>")), F.array_compact(F.array(*more)))))


def plan(verdicts: DataFrame) -> DataFrame:
    """Adds heal_classes, strategy (retry if the meaning broke, else repair) and instruction."""
    own = F.col("heal_classes")
    repair = ~F.array_contains(own, SEMANTIC)
    text = F.when(~repair, F.lit(""))
    for name, words in INSTRUCTIONS.items():
        text = text.when(F.array_contains(own, name), F.lit(words))
    out = verdicts.withColumn("heal_classes", inferred_classes(F.col("reasons"), F.col("classes")))
    return out.withColumns({"strategy": F.when(repair, "repair").otherwise("retry"), "instruction": text.otherwise(F.lit(INSTRUCTIONS[REPETITION]))})


def snapped(text: Column, cut: Column, least: int = 0) -> Column:
    """The text up to a cut, moved on to the next blank if it is near; empty below ``least``."""
    blank = F.instr(F.substring(text, cut + 1, F.lit(200)), " ")
    end = F.when((cut < F.length(text)) & (blank > 0), cut + blank).otherwise(cut)
    return F.when(cut < least, F.lit("")).otherwise(F.substring(text, F.lit(1), end.cast("int")))


def echo_length(prefix: Column, continuation: Column) -> Column:
    """Characters at the start of a continuation that repeat the end of its prefix, apart from case and blanks."""
    plain = lambda s: F.replace(F.lower(s), F.lit(" "), F.lit(""))
    n = F.least(F.length(prefix), F.lit(LONGEST_ECHO))
    tried = F.when(n >= SHORTEST_ECHO, F.sequence(n, F.lit(SHORTEST_ECHO), F.lit(-ECHO_STRIDE))).otherwise(F.array().cast("array<int>"))
    echoes = F.filter(tried, lambda k: plain(F.substring(continuation, F.lit(1), k)) == plain(F.right(prefix, k)))
    return F.coalesce(F.get(echoes, F.lit(0)), F.lit(0))


def stitched(prefix: Column, continuation: Column) -> Column:
    """Prefix and continuation without the echo between."""
    p, c = F.coalesce(prefix, F.lit("")), F.coalesce(continuation, F.lit(""))
    return F.concat(p, F.substring(c, echo_length(p, c) + 1, F.length(c)))


def loop_trimmed(streams: DataFrame) -> DataFrame:
    """stream_id, loop_onset, trimmed: text before a loop at its end, up to the next blank; whole if there is none."""
    found = streams.withColumn("loop_onset", loop_onset("text"))
    return found.select("stream_id", "loop_onset", F.when(F.col("loop_onset").isNull(), F.col("text")).otherwise(snapped(F.col("text"), F.col("loop_onset").cast("int"))).alias("trimmed"))


class StreamState:
    """A short text that grows by chunks, with what its features depend on besides: where things were renewed."""

    def __init__(self, text: str = "", since_deflate: int = 0, deflated: int = -1, frozen: int = -1):
        self.text, self.since_deflate, self.deflated, self.frozen = text, since_deflate, deflated, frozen

    def feed(self, chunk: str) -> None:
        self.text += chunk
        self.since_deflate += len(chunk)
        if self.since_deflate >= DEFLATE_EVERY:
            self.since_deflate = 0
            if len(self.text) >= 120:
                self.deflated = len(self.text)

    def mark(self) -> tuple[int, int | None, int | None]:
        """What the features of the text so far depend on: its length, and where things were renewed."""
        return len(self.text), self.deflated if self.deflated >= 0 else None, self.frozen if 0 <= self.frozen < len(self.text) else None

    def vector(self) -> dict[str, float]:
        from weirstream.functions.stream_kernel import TextFeatures

        return TextFeatures(self.text).at(*self.mark())

    def fused(self) -> tuple[float, dict[str, float]]:
        from weirstream.functions.stream_kernel import fused_probability

        f = self.vector()
        return fused_probability(f), f


def in_batches(parts: list[str]) -> Iterator[list[str]]:
    """Short texts, as many at a time as are scored together."""
    from weirstream.functions.batch_kernel import PIECE_BYTES

    many = max(1, PIECE_BYTES // max((len(p) for p in parts), default=1))
    yield from (parts[a : a + many] for a in range(0, len(parts), many))


def window_scores(parts: list[str]) -> list[float]:
    """Fused scores of short texts, read in about forty chunks each, as ``StreamState`` gives them one by one."""
    from weirstream.functions.batch_kernel import TextBatch
    from weirstream.operators.kernel_tier import deflate_positions

    out = []
    for own in in_batches(parts):
        size = np.array([len(p) for p in own], np.int64)
        nothing = np.full(len(own), -1)  # is frozen in a window
        out += TextBatch(own).fused(np.arange(len(own)), size, deflate_positions(size, size, np.maximum(1, size // 40)), nothing)[0].tolist()
    return out


def least_scores(parts: list[str]) -> list[float]:
    """What ``window_scores`` are at least, by features that are found at once."""
    from weirstream.functions.batch_kernel import TextBatch

    return [p for own in in_batches(parts) for p in TextBatch(own).at_least(np.arange(len(own)), np.array([len(x) for x in own], np.int64)).tolist()]


def trim_to_clean(streams: DataFrame, min_len: int = 0, windows: tuple[int, ...] = (250, 600, 1200), corrupt_at: float = 0.7) -> DataFrame:
    """stream_id, trimmed: the longest prefix whose end scores clean, null if none can be trusted.

    With a loop the cut is its onset, and that must score clean. Else cuts are halved down to 100 characters,
    and every window that ends at a cut must score below ``corrupt_at``. A probe scores one bounded window
    in the task that holds the text, so no probe needs a shuffle.
    """
    from weirstream.functions.kernels import loop_start

    def clean(probes: list[tuple[str, int]]) -> list[bool]:
        good = [True] * len(probes)
        for scores in (least_scores, window_scores):  # most corrupt ends are told at once
            for before, size in zip((0, *windows), windows):
                # a window that reached the text's begin before is the same again
                asked = [(i, text[max(0, at - size) : at]) for i, (text, at) in enumerate(probes) if good[i] and (not before or at > before) and min(at, size) >= 60]
                for (i, _), p in zip(asked, scores([part for _, part in asked]), strict=True):
                    good[i] = p < corrupt_at
        return good

    def snap(text: str, cut: int) -> str:
        blank = text.find(" ", cut, cut + 200)
        return text[: blank + 1 if cut < len(text) and blank >= 0 else cut] if cut >= min_len else ""

    def trimmed(text: str | None) -> Generator[int, bool, str | None]:
        """Yields where to probe and takes whether the text is clean up to there."""
        if not text:
            return None
        start = loop_start(text)
        if start is not None:
            return snap(text, start) if (yield start) else None
        if (yield len(text)):
            return text
        low, high = 0, len(text)
        while high - low > 100:
            middle = (low + high) // 2
            low, high = (middle, high) if (yield middle) else (low, middle)
        cut = high // 100 * 100
        return snap(text, cut) if cut >= min_len and (yield cut) else None

    def together(texts: list[str | None]) -> list[str | None]:
        """All texts at once: each waits for its probe, and the probes of all are scored together."""
        out: list[str | None] = [None] * len(texts)
        waiting, answers = dict(enumerate(map(trimmed, texts))), dict.fromkeys(range(len(texts)))
        while waiting:
            probes = []
            for i in list(waiting):
                try:
                    probes.append((i, waiting[i].send(answers[i])))
                except StopIteration as done:
                    out[i] = done.value
                    del waiting[i]
            answers = dict(zip([i for i, _ in probes], clean([(texts[i], at) for i, at in probes]), strict=True))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, 1, TRIM_BYTES)):
            yield pa.RecordBatch.from_pydict({"stream_id": batch.column(0), "trimmed": pa.array(together(batch.column(1).to_pylist()), pa.string())})

    kind = streams.schema["stream_id"].dataType.simpleString()
    return streams.select("stream_id", "text").mapInArrow(run, f"stream_id {kind}, trimmed string")


def first_success(attempts: DataFrame) -> DataFrame:
    """Of each request's attempts (request_id, n, label, ok) the first that worked, else the last; and how many there were."""
    best = F.coalesce(F.min_by(F.struct("n", "label"), F.when(F.col("ok"), F.col("n"))), F.max_by(F.struct("n", "label"), "n"))
    return attempts.groupBy("request_id").agg(best.alias("b"), F.max("ok").alias("ok"), F.count("*").alias("attempts")).select("request_id", "ok", F.col("b.n").alias("n"), F.col("b.label").alias("label"), "attempts", (F.col("ok") & F.col("b.label").startswith("heal")).alias("healed"))
