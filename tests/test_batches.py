"""Many texts at once against one text at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_core import LOOP, ODD, PROSE
from weirstream.functions import batch_kernel, kernels, stream_kernel
from weirstream.functions.batch_kernel import TextBatch
from weirstream.functions.stream_kernel import TextFeatures
from weirstream.operators import detectors, healing, kernel_tier, learning, metrics, protocol, sequence_features, synth
from weirstream.operators import streams as st
from weirstream.plans import training

TEXTS = [t for t in ODD if t] + ["aaa", "aab", "abb", "aaab 🙂🙂 𝟘𝟙 é　x", LOOP * 30, "漢字かな交じり文" * 90, "a1_b2 " * 120, PROSE[:500].replace(" ", "🙂")]


@pytest.fixture(scope="module")
def streams(spark):
    return spark.createDataFrame([*enumerate(TEXTS), (900, ""), (901, None)], "stream_id long, text string")


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_batch_features_are_those_of_one_text(monkeypatch, cells):
    monkeypatch.setattr(batch_kernel, "CELLS", cells)
    r, of, pos, deflated, frozen, want = random.Random(3), [], [], [], [], []
    for i, t in enumerate(TEXTS):
        one = TextFeatures(t)
        for p in sorted({1, 2, 3, len(t), *(r.randint(1, len(t)) for _ in range(5)), *range(360, len(t), 400)} & set(range(1, len(t) + 1))):
            d, f = p // 200 * 200 or -1, 360 if p > 360 else -1
            of, pos, deflated, frozen = [*of, i], [*pos, p], [*deflated, d], [*frozen, f]
            want.append(one.at(p, d if d >= 0 else None, f if f >= 0 else None))
    found = TextBatch(TEXTS).at(*map(np.array, (of, pos, deflated, frozen)), detectors.VECTOR)
    for c in detectors.VECTOR:
        assert np.allclose(found[c], [w[c] for w in want], rtol=0, atol=1e-12), c


def test_totals_of_texts_are_those_of_character_rows(spark, streams):
    found = {r.stream_id: r for r in kernel_tier.of_texts(streams, ("n", "switches", "longest_run", "mean_bits", "most_bits", "mean", "mad")).collect()}
    assert sorted(found) == list(range(len(TEXTS)))
    chars = st.blocked_characters(streams)
    runs = sequence_features.char_runs(sequence_features.script_switches(chars)).groupBy("stream_id").agg(F.max("switches"), F.max("longest_run"))
    assert {tuple(r) for r in runs.collect()} == {(k, r.switches, r.longest_run) for k, r in found.items()}
    surprised = sequence_features.surprise(st.characters(streams)).persist()
    for r in surprised.groupBy("stream_id").agg(F.count("*").alias("n"), F.avg("surprise").alias("mean_bits"), F.max("surprise").alias("most_bits")).collect():
        assert np.allclose((r.n, r.mean_bits, r.most_bits), [found[r.stream_id][c] for c in ("n", "mean_bits", "most_bits")], atol=1e-9)
    for r in sequence_features.baselines(surprised).collect():
        assert np.allclose((r["mean"], r.mad), (found[r.stream_id]["mean"], found[r.stream_id].mad), atol=1e-9)
    surprised.unpersist()


def test_sketches_of_many_texts():
    assert batch_kernel.sketch_counts([*TEXTS, ""]).tolist() == [list(kernels.sketch_counts(t)) for t in [*TEXTS, ""]]
    assert batch_kernel.sketch_counts([]).tolist() == []


def test_windows_of_probes_score_as_they_do_one_by_one():
    def alone(part):
        state, size = healing.StreamState(), max(1, len(part) // 40)
        for i in range(0, len(part), size):
            state.feed(part[i : i + size])
        return state.fused()[0]

    parts = [t[-n:] for t in TEXTS for n in (60, 250, 600, 1200) if len(t) >= 60]
    assert healing.window_scores(parts) == pytest.approx([alone(p) for p in parts], abs=1e-12)
    assert healing.window_scores([]) == []


def test_verdicts_read_their_rows_once(spark, streams):
    """A text was scored twice: once for its checkpoints and once for its end."""
    plan = kernel_tier.guard(streams)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert [r.stream_id for r in kernel_tier.guard(streams).orderBy("stream_id").collect()] == list(range(len(TEXTS)))


def test_both_forms_of_features_and_ends_alone(spark, streams):
    key = lambda r: (r[0], r[2], r[1] is None)
    whole = sorted((tuple(r) for r in kernel_tier.features(streams).collect()), key=key)
    mixed = sorted((tuple(r) for r in protocol.features(streams, with_deflate=True, final=True, by_text=True).collect()), key=key)
    assert len(whole) == len(mixed)
    for a, b in zip(whole, mixed, strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], atol=1e-9), (a, b)
    ends = sorted((tuple(r) for r in kernel_tier.features(streams, checkpoints=False).collect()), key=key)
    assert ends == [r for r in whole if r[1] is None]


def test_chunks_of_any_text(spark, streams):
    found = {}
    for r in st.chunks(streams, 7).orderBy("stream_id", "seq").collect():
        found.setdefault(r.stream_id, []).append(r.chunk)
    assert found == {i: [t[j : j + 7] for j in range(0, len(t), 7)] for i, t in enumerate(TEXTS)}


def test_only_asked_places_are_scored_by_the_same_numbers(spark, streams):
    whole = {(r.stream_id, r.pos): r for r in kernel_tier.features(streams, 300, 300, 300, final=False).collect()}
    some = {i: sorted({p for s, p in whole if s == i})[:2] for i in range(0, len(TEXTS), 2)}
    asked = streams.join(spark.createDataFrame([*some.items(), (900, [1]), (901, [1])], "stream_id long, places array<int>"), "stream_id", "left")
    found = kernel_tier.features(asked, 300, 300, 300, final=False, only="places").collect()
    assert found and sorted(found) == sorted(whole[i, p] for i, at in some.items() for p in at)
    ends = kernel_tier.features(asked.where("size(places) > 0"), 300, 300, 300, only="places").where("k is null").collect()
    assert sorted((r.stream_id, r.pos) for r in ends) == [(i, len(TEXTS[i])) for i, at in some.items() if at]


def test_examples_are_drawn_before_they_are_scored(spark, monkeypatch):
    r, scored, features = random.Random(5), [], kernel_tier.features
    words = "the river bank moves slowly under bright morning skies while people walk 🙂 toward town".split()
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(20, 500)))) for i in range(60)]
    clean = spark.createDataFrame([*texts, (98, None), (99, ""), (None, "a text without an id " * 50)], "stream_id long, text string")
    every, drawn = training.examples(clean, 300), training.examples(clean, 300, sample=8)
    assert every.columns == drawn.columns and drawn.count() <= 16 < every.count()
    assert sorted(map(repr, drawn.collect())) == sorted(map(repr, learning.drawn(every, "y", sample=8).collect()))
    assert [tuple(m) for m in learning.fit(every, label="y", sample=8).collect()] == [tuple(m) for m in learning.fit(drawn, label="y", sample=8).collect()]
    monkeypatch.setattr(kernel_tier, "features", lambda streams, *a, **b: scored.append(streams.count()) or features(streams, *a, **b))
    training.train(clean, epochs=1, sample=8)
    assert scored[0] <= 16  # every text was made and scored, and all but these were left out afterwards


def test_a_detector_of_drawn_and_held_out_vectors(spark):
    r = random.Random(6)
    words = "the river bank moves slowly under bright morning skies while people walk 🙂 toward town".split()
    clean = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randint(150, 500)))) for i in range(80)], "stream_id long, text string")
    held = learning.held_out(F.col("stream_id"))
    every = training.examples(clean, 400).where(F.col("corruption_class").isin("clean", detectors.DRIFT)).persist()
    some = training.examples(clean, 400, 12, (detectors.DRIFT,), whole=held)
    wanted = every.where(held).unionByName(learning.drawn(every.where(~held), "y", sample=12))
    assert wanted.count() < every.count() and sorted(map(repr, some.collect())) == sorted(map(repr, wanted.collect()))
    assert training.places(clean, 400, (detectors.DRIFT,)).groupBy("y").count().exceptAll(every.groupBy("y").count()).isEmpty()
    as_labels = lambda rows: rows.drop("label").withColumnRenamed("y", "label")
    drawn = training.examples(clean, 400, learning.SAMPLE, (detectors.DRIFT,), whole=held)
    reports = [learning.fit_detector("drift", as_labels(rows), register=False, counted=n) for rows, n in ((every, None), (drawn, training.places(clean, 400, (detectors.DRIFT,)).select(F.col("y").alias("label"))))]
    assert reports[0][0] == reports[1][0]
    every.unpersist()


@pytest.mark.parametrize("block", [10_000, 130])
def test_a_model_is_fitted_on_all_rows_in_one_order(spark, block):
    """Each label gave at most ``SAMPLE`` rows, and of fewer rows those whose buckets met were left out."""
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 3)) * [1.0, 0.3, 2.0]
    y = (r.random(600) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5])))).astype(int)
    frame = spark.createDataFrame([(f"e{i:04d}", int(y[i]), *map(float, x[i])) for i in range(600)], "example_id string, y int, a double, b double, c double").repartition(3)
    model = learning.fit(frame, ("a", "b", "c"), "y", epochs=2, block=block).first()
    assert model.seen == 2 * 600
    blocks = -(-600 // block)
    of = np.array([k.b for k in frame.select(F.pmod(F.xxhash64("example_id"), F.lit(blocks)).alias("b"), "example_id").orderBy("example_id").collect()])
    w, b = np.zeros(3), 0.0
    for e in range(2):
        for k in np.random.default_rng([7, e]).permutation(blocks) if blocks > 1 else [None]:
            own = np.flatnonzero(of == k) if blocks > 1 else np.arange(600)
            for i in own[np.random.default_rng([7, e] if k is None else [7, e, k]).permutation(len(own))]:
                w, b, _ = learning.step(w, b, x[i], y[i])
    assert np.allclose(model.w, w, rtol=0, atol=1e-9) and abs(model.b - b) < 1e-9
    groups = frame.withColumn("g", F.when(F.col("a") > 1, "far").when(F.col("a") > -1, "near")).persist()
    found = {m.g: m for m in learning.fit(groups, ("a", "b", "c"), "y", "g", epochs=2, block=block).collect()}
    assert {g: m.seen for g, m in found.items()} == {g: 2 * n for g, n in groups.groupBy("g").count().collect()} and None in found
    groups.unpersist()


def test_vectors_of_all_streams_are_fitted(spark, monkeypatch, tmp_path):
    from weirstream.plans import catalog

    r = random.Random(8)
    texts = [(i, " ".join(r.choice(PROSE.split()) for _ in range(r.randint(150, 400)))) for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(learning, "SAMPLE", 8)  # no part in it
    places = training.places(catalog.documents(spark, str(tmp_path)), 300).count()
    assert places > 100 and catalog.sgd_fit(spark, str(tmp_path)).first().seen == 6 * places


def test_training_reads_all_streams_and_scores_ends_of_clean_ones(spark, monkeypatch):
    r, scored, features = random.Random(9), [], kernel_tier.features
    clean = spark.createDataFrame([(i, " ".join(r.choice(PROSE.split()) for _ in range(r.randint(150, 400)))) for i in range(60)], "stream_id long, text string")
    learn = clean.where(metrics.split_by_key(F.col("stream_id")) == "train")
    places = training.places(learn, training.CHUNK).count()
    monkeypatch.setattr(kernel_tier, "features", lambda streams, *a, **b: scored.append((b.get("checkpoints", True), streams.count())) or features(streams, *a, **b))
    done = training.train(clean, epochs=2)
    assert done.seen == 2 * places  # of examples whose buckets met one was taken
    made = synth.benchmark(learn, texts=False)
    assert scored[:2] == [(True, made.count()), (False, made.where("label = 0").count())]  # ends of corrupt texts were scored and left out


def broken_texts():
    r = random.Random(12)
    prose = lambda n: " ".join(r.choice(PROSE.split()) for _ in range(n))
    tails = ["昨天下午我们在河边看到三只白色的鸟" * 60, "0.00 -1.25 2.41 " * 80, LOOP * 30, "```\n#### ===== ________\n" * 40, "## Setup\n```\npip install example-tool\n```\n" * 20]
    return TEXTS + [prose(n) + " " + t + (prose(200) if n % 2 else "") for n in (0, 3, 61, 130, 301) for t in tails] + [prose(n) for n in (59, 62, 70, 400)]


def test_text_behind_an_abort_is_not_scored(spark):
    """A stream's verdict was made from the features of its whole text, however early it was aborted."""
    texts = broken_texts()
    streams = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(1000 + i, t, i * 97 % (len(t) + 300)) for i, t in enumerate(texts)] + [(9000, "", 1), (9001, None, None)], "stream_id long, text string, first int").repartition(3)
    guarded = kernel_tier.guard(streams.select("stream_id", "text"))
    columns = [c for c in guarded.columns if c not in ("reasons", "classes")]
    want = sorted(guarded.select(columns).collect())
    assert any(w.aborted for w in want) and any(w.state == "corrupt" and not w.aborted for w in want) and any(w.state == "clean" for w in want)
    assert sorted(kernel_tier.states(streams, first="first").select(columns).collect(), key=lambda r: r.stream_id) == sorted(want, key=lambda r: r.stream_id)
    assert sorted(map(tuple, kernel_tier.states(streams).select(columns).collect())) == sorted(map(tuple, want))
    ends = {w.stream_id: w.read_chars for w in want if w.aborted}
    rows = kernel_tier.probabilities(streams, first="first").where("k is not null").collect()
    assert rows and all(r.pos <= ends.get(r.stream_id, r.n_chars) for r in rows)


def test_scores_of_a_batch_are_the_fused_ones():
    texts = [t for t in broken_texts() if t]
    of, pos = np.arange(len(texts)), np.array([len(t) for t in texts])
    deflated, frozen = np.where(pos >= 200, pos, -1), np.where(pos > 360, 360, -1)
    found = TextBatch(texts).at(of, pos, deflated, frozen, detectors.VECTOR)
    p, rules = TextBatch(texts).fused(of, pos, deflated, frozen)
    assert p.tolist() == [stream_kernel.fused_probability({c: float(found[c][i]) for c in detectors.VECTOR}) for i in of]
    sure = TextBatch(texts).sure(of, pos, 0.85)
    assert sure.any() and (rules[sure] >= 0.85).all() and not sure.all()


def test_corrupt_ends_are_told_before_all_features_are_known(spark):
    """Every probe had all features of its windows computed, those without a part in the score as well."""
    def alone(part):
        state, size = healing.StreamState(), max(1, len(part) // 40)
        for i in range(0, len(part), size):
            state.feed(part[i : i + size])
        return state.fused()[0]

    def trimmed(text):
        clean = lambda at: all(min(at, n) < 60 or alone(text[max(0, at - n) : at]) < 0.7 for n in (250, 600, 1200))
        snap = lambda cut: text[: text.find(" ", cut, cut + 200) + 1 or cut] if cut < len(text) else text
        start = kernels.loop_start(text)
        if start is not None:
            return snap(start) if clean(start) else None
        if clean(len(text)):
            return text
        low, high = 0, len(text)
        while high - low > 100:
            middle = (low + high) // 2
            low, high = (middle, high) if clean(middle) else (low, middle)
        return snap(high // 100 * 100) if clean(high // 100 * 100) else None

    texts = broken_texts()
    parts = [t[-n:] for t in texts for n in (60, 250, 1200) if len(t) >= 60]
    least, scores = healing.least_scores(parts), healing.window_scores(parts)
    assert all(a <= b for a, b in zip(least, scores, strict=True)) and sum(a >= 0.7 for a in least) > sum(b >= 0.7 for b in scores) / 2
    assert healing.least_scores([]) == []
    found = {r.stream_id: r.trimmed for r in healing.trim_to_clean(spark.createDataFrame(list(enumerate(texts)), "stream_id long, text string")).collect()}
    assert found == {i: trimmed(t) for i, t in enumerate(texts)} and {t == texts[i] for i, t in found.items()} == {True, False}


def test_a_unit_of_a_corruption_is_computed_once(spark):
    made = synth.corruptions(spark.createDataFrame([(1, PROSE * 3)], "stream_id long, text string"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("#REF!") == 1  # length and repetition each computed it, and its words were split for each use
