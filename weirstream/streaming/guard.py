"""Live guarding of chunk streams with Structured Streaming.

Three steps: a stateful operator orders the chunks of each stream and gives the features of every checkpoint
that has been reached; scores and fusion are the same column expressions as in batch; a second, small
stateful operator keeps the protocol (held, released, aborted) and gives one verdict row for each checkpoint.
Chunks may come in any order and more than once: state keeps what is early and drops what was seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weirstream.operators import detectors
from weirstream.operators.fusion import Thresholds
from weirstream.operators.protocol import BURN_IN, DEFLATE_EVERY, DELTA, LAMBDA, scored
from weirstream.operators.streams import EVERY, HOLD

#: Characters that are counted at once.
PIECE = 65_536
FEATURES = ", ".join(f"{c} double" for c in detectors.VECTOR)


class Checkpoints(StatefulProcessor):
    """Chunks (in a chain from ``first``, the last one marked) to features at checkpoints and at the end (k null).

    State is that of ``GrowingFeatures``, in named parts of bounded size, never the text; a micro-batch reads it once,
    counts its new characters in pieces of about ``PIECE`` and writes the parts that changed.
    """

    def __init__(self, hold: int = HOLD, every: int = EVERY, idle_ms: int | None = None, first: int = 1):
        self.hold, self.every, self.idle_ms, self.first = hold, every, idle_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "pos long, since_deflate long, next_seq long, k int, due long, ended boolean", ttlDurationMs=self.idle_ms)
        self.parts = handle.getMapState("parts", "part string", "data binary", ttlDurationMs=self.idle_ms)
        self.early = handle.getMapState("early", "seq long", "chunk string, last boolean, next_seq long", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        from weirstream.functions.stream_state import GrowingFeatures

        pos, since, next_seq, k, due, ended = self.state.get() if self.state.exists() else (0, 0, self.first, 0, self.hold, False)
        out: list[dict] = []
        if not ended:
            for frame in rows:
                for seq, chunk, last, following in zip(frame["seq"], frame["chunk"], frame["last"], frame["next_seq"], strict=True):
                    if seq >= next_seq and not self.early.containsKey((int(seq),)):
                        self.early.updateValue((int(seq),), (chunk or "", bool(last), int(following)))
            before = {part[0]: bytes(data[0]) for part, data in self.parts.iterator()} if pos else {}
            features = GrowingFeatures.load(before) if before else GrowingFeatures()
            piece, begun, due_now = [], pos, []

            def settle() -> None:
                """Counts the piece, then what falls due in it, in order."""
                features.feed("".join(piece))
                for what, at, number in due_now:
                    if what == "renew":
                        features.renew(at)
                    elif what == "freeze":
                        features.freeze(at)
                    else:
                        out.append({"k": number, "pos": at} | features.at(at))
                piece.clear()
                due_now.clear()

            while not ended and self.early.containsKey((next_seq,)):
                chunk, ended, following = self.early.getValue((next_seq,))
                self.early.removeKey((next_seq,))
                next_seq = following
                piece.append(chunk)
                pos, since = pos + len(chunk), since + len(chunk)
                if since >= DEFLATE_EVERY:
                    since = 0
                    due_now.append(("renew", pos, None))
                if chunk and pos >= due:
                    k, due = k + 1, pos + self.every
                    due_now.append(("check", pos, k))
                    if k == 1:
                        due_now.append(("freeze", pos, None))
                if ended and pos:
                    due_now.append(("check", pos, None))
                if pos - begun >= PIECE and chunk:
                    settle()
                    begun = pos
            if piece and (pos > begun or due_now):
                settle()
            if ended:  # keeps only the mark that it ended
                self.parts.clear()
            else:
                for part, data in features.dump().items():
                    if before.get(part) != data:
                        self.parts.updateValue((part,), (data,))
            self.state.update((pos, since, next_seq, k, due, ended))
        frame = pd.DataFrame(out, columns=["k", "pos", *detectors.VECTOR])
        frame.insert(0, "stream_id", [key[0]] * len(frame))
        yield frame.astype({"stream_id": object, "k": "Int32", "pos": "int32"})

    def close(self) -> None:
        pass


class Protocol(StatefulProcessor):
    """Scored checkpoints to verdict rows: the state machine of hold, release and abort."""

    def __init__(self, thresholds: Thresholds, idle_ms: int | None = None):
        self.thresholds, self.idle_ms = thresholds, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("protocol", "n int, mean double, cum double, low double, alarm int, hot boolean, aborted boolean, released int, pos int", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, mean, cum, low, alarm, hot, aborted, released, last = self.state.get() if self.state.exists() else (0, 0.0, 0.0, 0.0, -1, False, False, 0, -1)
        t, out = self.thresholds, []
        frame = pd.concat(list(rows), ignore_index=True)
        frame["__end"] = frame["k"].isna()
        for r in frame.sort_values(["pos", "__end"]).itertuples(index=False):
            if aborted:
                break
            if pd.isna(r.k):
                state = "corrupt" if r.p >= t.corrupt_at else "suspect" if r.p >= t.suspect_at else "clean"
                if n or state != "corrupt":
                    released = r.pos
                onset = None if state != "corrupt" or not n else alarm if alarm >= 0 else last
                out.append((key[0], None, r.pos, state, r.p, list(r.reasons), list(r.classes), onset, released, True))
                continue
            n += 1
            mean += (r.p - mean) / n
            cum += r.p - mean - DELTA
            low = min(low, cum)
            if n > BURN_IN and alarm < 0 and cum - low > LAMBDA:
                alarm = r.pos
            now = r.p >= t.corrupt_at
            aborted = bool(r.hard or (now and (hot or n == 1)))
            state = "corrupt" if aborted else "suspect" if now or r.p >= t.suspect_at else "clean"
            hot, last = now, r.pos
            if not aborted:
                released = r.pos
            out.append((key[0], int(r.k), r.pos, state, r.p, list(r.reasons), list(r.classes), (alarm if alarm >= 0 else r.pos) if aborted else None, released, aborted))
        self.state.update((n, float(mean), float(cum), float(low), int(alarm), bool(hot), bool(aborted), int(released), int(last)))
        columns = ["stream_id", "k", "pos", "state", "p", "reasons", "classes", "onset", "released_chars", "done"]
        yield pd.DataFrame(out, columns=columns).astype({"stream_id": object, "state": object, "k": "Int32", "pos": "int32", "onset": "Int64", "released_chars": "int64", "done": "bool", "p": "float64"})

    def close(self) -> None:
        pass


def time_mode(idle_ms: int | None) -> str:
    return "None" if idle_ms is None else "ProcessingTime"


def checkpoint_features(chunks: DataFrame, hold: int = HOLD, every: int = EVERY, idle_ms: int | None = None) -> DataFrame:
    """stream_id, k, pos and features from a stream of stream_id, seq, chunk, last.

    Chunks are numbered from 1; with a column next_seq they are a chain from 0, in which each names the one after it.
    """
    chained = "next_seq" in chunks.columns
    chunks = chunks if chained else chunks.withColumn("next_seq", F.col("seq") + 1)
    kind = chunks.schema["stream_id"].dataType.simpleString()
    schema = f"stream_id {kind}, k int, pos int, {FEATURES}"
    return chunks.select("stream_id", "seq", "chunk", "last", "next_seq").groupBy("stream_id").transformWithStateInPandas(Checkpoints(hold, every, idle_ms, 0 if chained else 1), schema, "Append", time_mode(idle_ms))


def guard_stream(chunks: DataFrame, thresholds: Thresholds = Thresholds(), hold: int = HOLD, every: int = EVERY, idle_ms: int | None = None) -> DataFrame:
    """A verdict row for each checkpoint of each live stream: stream_id, k (null at the end), pos, state, p, reasons,
    classes, onset, released_chars (as of the last checkpoint), done. Needs the RocksDB state store. With ``idle_ms`` the
    state of a stream that is silent for so long is dropped; such a query never runs out of batches, so it can't be
    used with a trigger that stops when no data is left."""
    points = scored(checkpoint_features(chunks, hold, every, idle_ms), thresholds=thresholds)
    slim = points.select("stream_id", "k", "pos", "p", "reasons", "classes", "hard")
    kind = chunks.schema["stream_id"].dataType.simpleString()
    schema = f"stream_id {kind}, k int, pos int, state string, p double, reasons array<string>, classes array<string>, onset long, released_chars long, done boolean"
    return slim.groupBy("stream_id").transformWithStateInPandas(Protocol(thresholds, idle_ms), schema, "Append", time_mode(idle_ms))


def with_last(chunks: DataFrame) -> DataFrame:
    """Marks the last chunk of finished streams, to replay them as live ones."""
    ends = chunks.groupBy("stream_id").agg(F.max("seq").alias("end"))
    return chunks.join(ends, "stream_id").select("stream_id", F.col("seq").cast(T.LongType()).alias("seq"), "chunk", (F.col("seq") == F.col("end")).alias("last"))
