"""Learning from feedback as it arrives: a model for each key that scores a row, then learns from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weirstream.operators.learning import step


class Learner(StatefulProcessor):
    """Feedback (seq from 1 without gaps, label, x) to the probability before each step, the weights after it and metrics.

    State is the weights, the last ``last`` agreements and three counts, and rows that came early; a row that was seen is
    passed over, so input that comes again changes nothing.
    """

    def __init__(self, width: int, last: int = 50):
        self.width, self.last = width, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("model", "w array<double>, b double, agreed array<boolean>, likes long, dislikes long, next_seq long")
        self.early = handle.getMapState("early", "seq long", "label int, x array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        w, b, agreed, likes, dislikes, seq = self.state.get() if self.state.exists() else ([0.0] * self.width, 0.0, [], 0, 0, 1)
        w, agreed, out = np.array(w, float), list(agreed), []
        for frame in rows:
            for at, label, x in zip(frame["seq"], frame["label"], frame["x"], strict=True):
                if at >= seq:
                    self.early.updateValue((int(at),), (int(label), [float(v) for v in x]))
        while self.early.containsKey((seq,)):
            label, x = self.early.getValue((seq,))
            self.early.removeKey((seq,))
            w, b, p = step(w, b, np.asarray(x, float), float(label))
            agreed = [*agreed, bool((p >= 0.5) == (label == 1))][-self.last :]
            likes, dislikes = likes + (label == 0), dislikes + (label == 1)
            loss = -np.log(p + 1e-7) if label == 1 else -np.log(1 - p + 1e-7)
            out.append((key[0], seq, label, p, w.tolist(), b, float(agreed[-1]), float(loss), sum(agreed) / len(agreed), likes + dislikes, likes, dislikes))
            seq += 1
        self.state.update((w.tolist(), float(b), agreed, int(likes), int(dislikes), int(seq)))
        names = ["model", "seq", "label", "p", "w", "b", "agreed", "loss", "rolling_acc", "seen", "likes", "dislikes"]
        yield pd.DataFrame(out, columns=names).astype({"model": object, "seq": "int64", "label": "int32", "seen": "int64", "likes": "int64", "dislikes": "int64"})

    def close(self) -> None:
        pass


def learn_stream(feedback: DataFrame, width: int = 10, last: int = 50) -> DataFrame:
    """What ``learning.learn_online`` and ``rolling_metrics`` give for a finished table, row by row as feedback arrives.

    feedback: model, seq, label (1: disliked), x. Needs the RocksDB state store.
    """
    kind = feedback.schema["model"].dataType.simpleString()
    schema = f"model {kind}, seq long, label int, p double, w array<double>, b double, agreed double, loss double, rolling_acc double, seen long, likes long, dislikes long"
    return feedback.select("model", "seq", "label", "x").groupBy("model").transformWithStateInPandas(Learner(width, last), schema, "Append", "None")
