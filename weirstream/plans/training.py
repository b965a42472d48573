"""Training of the linear model in four phases: features, updates, thresholds, evaluation on streams not seen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstream.operators import detectors, fusion, kernel_tier, learning, metrics, protocol, synth
from weirstream.operators.streams import checkpoint_positions
from weirstream.sources.work import written

#: Characters of a chunk while training.
CHUNK = 300
#: What is known of a stream of the benchmark.
ABOUT = ("label", "onset_char", "corruption_class")


@dataclass(frozen=True)
class Trained:
    weights: list[float]
    bias: float
    seen: int
    thresholds: fusion.Thresholds
    #: One row for each corruption class of the held-out streams.
    evaluation: DataFrame

    def score(self) -> Column:
        """The model's probability of a feature vector."""
        return detectors.linear_score(self.weights, self.bias)


def labelled(rows: DataFrame) -> DataFrame:
    """Adds y and example_id to checkpoints (pos) of streams with label and onset_char; those between the labels go."""
    y = learning.checkpoint_labels(F.col("pos"), F.col("label"), F.col("onset_char"))
    return rows.withColumn("y", y).where("y is not null").withColumn("example_id", F.concat_ws(":", "stream_id", F.format_string("%08d", "pos")))


def places(streams: DataFrame, every: int = CHUNK, classes: tuple[str, ...] = synth.CLASSES) -> DataFrame:
    """What is known of each row of ``examples`` by the lengths of texts alone: stream_id, source_id, pos, ABOUT, y and example_id."""
    known = synth.benchmark(streams, texts=False, classes=classes)
    return labelled(known.select("stream_id", "source_id", *ABOUT, F.explode(checkpoint_positions(F.col("n_chars"), every, every, every)).alias("pos")))


def examples(streams: DataFrame, every: int = CHUNK, sample: int | None = None, classes: tuple[str, ...] = synth.CLASSES, whole: Column | None = None) -> DataFrame:
    """Labelled checkpoints of the benchmark made from ``streams``, ``every`` so many characters: the columns of
    ``kernel_tier.features``, ABOUT, y and example_id.

    With ``sample`` only the rows that ``learning.fit`` draws from all for a sample of that size: lengths of texts tell id and label of each, so these
    are drawn first, and then only texts of drawn ones are made, and scored at the drawn places. At most ``sample`` rows of
    each label are broadcast. whole: a condition on stream_id; streams that meet it are not drawn from, but give all their rows.
    """
    if sample is None:
        made = synth.benchmark(streams, classes=classes).where(F.lit(True) if whole is None else whole)
        return labelled(kernel_tier.features(made, every, every, every, final=False, keep=ABOUT))
    some = places(streams, every, classes).where(F.lit(True) if whole is None else ~whole)
    drawn = written(learning.drawn(some, "y", sample=sample), "drawn")
    sources = streams.join(F.broadcast(drawn.select(F.col("source_id").alias("stream_id")).distinct()), "stream_id", "left_semi")
    made = synth.benchmark(sources, only=drawn.groupBy("stream_id").agg(F.collect_set("pos").alias("places")), classes=classes)
    rows = kernel_tier.features(made.select("stream_id", "text", "places"), every, every, every, final=False, only="places")
    rows = rows.join(F.broadcast(drawn.drop("source_id")), ["stream_id", "pos"]).select(*rows.columns, *ABOUT, "y", "example_id")
    return rows if whole is None else rows.unionByName(examples(streams, every, classes=classes, whole=whole))


def train(streams: DataFrame, epochs: int = 6, sample: int | None = None) -> Trained:
    """Fit, calibrate and judge a model on corruptions made from clean ``streams`` (stream_id, text).

    It is fitted on all checkpoints of the training streams, or with ``sample`` on some of each label. Streams are divided by a hash of their id, so a text and its corruptions are on one side. Thresholds come from the
    scores of the clean training streams, fused with the model's; the evaluation reads the test streams in small chunks.
    """
    truth = synth.benchmark(streams, texts=False).withColumn("split", metrics.split_by_key(F.col("source_id")))
    texts = synth.benchmark(streams).select("stream_id", "source_id", "text", "label").withColumn("split", metrics.split_by_key(F.col("source_id")))
    clean, judge = (texts.where(c).select("stream_id", "text") for c in ("split = 'train' and label = 0", "split = 'test'"))
    about = truth.select("stream_id", *ABOUT)
    rows = examples(streams.where(metrics.split_by_key(F.col("stream_id")) == "train"), sample=sample)
    model = learning.fit(rows, label="y", epochs=epochs, sample=sample).first()
    weights, bias, seen = (list(model.w), model.b, model.seen) if model else ([0.0] * len(detectors.VECTOR), 0.0, 0)
    learned = detectors.linear_score(weights, bias)
    ends = protocol.scored(kernel_tier.features(clean, checkpoints=False), learned).select("p").persist()
    thresholds = fusion.calibrate(ends)
    ends.unpersist()
    found = protocol.verdicts(protocol.scored(kernel_tier.features(judge), learned, thresholds), thresholds)
    return Trained(weights, bias, seen, thresholds, metrics.stream_evaluation(found, about))
