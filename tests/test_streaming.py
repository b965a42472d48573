"""The live guard gives the verdicts of the batch guard, however chunks fall into micro-batches."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from weirstream.functions.stream_kernel import TextFeatures
from weirstream.functions.stream_state import MOST_BYTES, MOST_CONTEXTS, GrowingFeatures
from weirstream.operators import kernel_tier
from weirstream.operators.learning import learn_online, rolling_metrics
from weirstream.operators.streams import chunks
from weirstream.sources.sse_source import delta_stream
from weirstream.streaming.feedback import learn_stream
from weirstream.streaming.guard import guard_stream, with_last

PROSE = "The ferry left the harbour a little after nine, and by noon the fog had lifted from the islands. Two passengers stood at the rail and argued about the price of copper, while a third fed crumbs to the gulls that followed us. Nobody noticed when the engine changed its tone, because the band had begun to play an old waltz below deck. We landed late, tired, and pleased with the day. "
LOOP = "and then the same words came back once again so "


def texts():
    return [(1, PROSE * 3), (2, PROSE + LOOP * 40), (3, LOOP * 60), (4, PROSE + "#REF! 0.00 #DIV/0! 0.00 " * 30), (5, "short"), (6, PROSE[:350])]


def test_live_equals_batch(spark, tmp_path):
    streams = spark.createDataFrame(texts(), "stream_id long, text string")
    pieces = with_last(chunks(streams)).collect()
    random.Random(3).shuffle(pieces)
    schema = "stream_id long, seq long, chunk string, last boolean"
    source, cut = tmp_path / "in", len(pieces) // 3
    for i in range(3):
        part = pieces[i * cut : (i + 1) * cut if i < 2 else None] + pieces[:2]  # two chunks come again each time
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = guard_stream(live).writeStream.format("memory").queryName("verdict_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = {r.stream_id: r for r in spark.table("verdict_rows").where("done").collect()}
    batch = {r.stream_id: r for r in kernel_tier.guard(streams).collect()}
    assert rows.keys() == batch.keys()
    for i, b in batch.items():
        assert (rows[i].state, round(rows[i].p, 9), rows[i].onset, rows[i].reasons) == (b.state, round(b.p, 9), b.onset, b.reasons)
    assert {i: b.state for i, b in batch.items()} == {1: "clean", 2: "corrupt", 3: "corrupt", 4: "corrupt", 5: "clean", 6: "clean"}


def test_guard_promises(spark):
    streams = spark.createDataFrame(texts(), "stream_id long, text string")
    found = {r.stream_id: r for r in kernel_tier.guard(streams).collect()}
    assert found[1].p < 0.5 and found[1].released_chars == len(PROSE * 3)
    assert found[2].aborted and found[2].reasons and abs(found[2].onset - len(PROSE)) <= 800
    assert found[3].released_chars == 0
    for r in found.values():
        assert r.released_chars + r.blocked_chars == r.read_chars


def test_later_text_never_changes_earlier_checkpoints(spark):
    streams = spark.createDataFrame([(1, PROSE * 3), (2, PROSE * 3 + LOOP * 20)], "stream_id long, text string")
    rows = kernel_tier.features(streams, final=False).where(F.col("pos") <= 1000).drop("n_chars").collect()
    one, two = ([tuple(r)[1:] for r in rows if r.stream_id == i] for i in (1, 2))
    assert one and one == two[: len(one)]


def test_bounded_features_are_those_of_the_whole_text():
    texts = [t for _, t in texts_of_all_kinds()]
    draw = random.Random(1)
    for t in texts:
        whole, grown, pos, frozen = TextFeatures(t), GrowingFeatures(), 0, None
        while pos < len(t):
            piece = t[pos : pos + draw.choice([1, 2, 7, 40, 300, 5000])]
            if draw.random() < 0.3:
                grown = GrowingFeatures.load(grown.dump())
            grown.feed(piece)
            for at in {pos + 1, pos + len(piece)}:
                a, b = grown.at(at), whole.at(at, None, frozen)
                assert all(abs(a[k] - b[k]) < 1e-9 for k in a if k != "zlib_ratio"), (t[:40], at)
            pos += len(piece)
            if frozen is None and pos >= 350:
                frozen = pos
                grown.freeze(pos)


def texts_of_all_kinds():
    odd = ["a", "ab" * 300, "年月日" * 400 + " x", "\U00010330 1٣ Σας ΣΑΣ " * 60, "--- === " * 100, "x" * 900]
    return [*texts(), *enumerate(odd, 100)]


def test_state_is_bounded_and_work_linear():
    """Every character combination anew: counts reach their caps, time for the second half is that for the first."""
    draw = random.Random(5)
    letters = [chr(c) for c in range(0x3400, 0x4400)]
    text = "".join(draw.choices(letters, k=600_000)) + "word " * 20_000
    took, grown = [], GrowingFeatures()
    for half in (text[:350_000], text[350_000:]):
        began = time.process_time()
        for i in range(0, len(half), 10_000):
            grown = GrowingFeatures.load(grown.dump())
            grown.feed(half[i : i + 10_000])
        took.append(time.process_time() - began)
    size = sum(map(len, grown.dump().values()))
    assert 4_000_000 < size < MOST_BYTES
    assert len(grown.contexts[2].keys) == MOST_CONTEXTS and grown.sketch.rows.any()
    assert took[1] < 3 * took[0] + 0.5
    once = GrowingFeatures()
    for i in range(0, len(text), 65_536):
        once.feed(text[i : i + 65_536])
    assert once.at(len(text)) == grown.at(len(text))


def test_live_chunks_one_at_a_time(spark, tmp_path):
    """A long stream over many micro-batches, its last chunk empty: as in batch."""
    long = PROSE * 40 + LOOP * 3 + PROSE * 3
    streams = spark.createDataFrame([(9, long)], "stream_id long, text string")
    pieces = [(9, r.seq, r.chunk, False) for r in chunks(streams).orderBy("seq").collect()]
    pieces.append((9, len(pieces) + 1, "", True))
    schema = "stream_id long, seq long, chunk string, last boolean"
    source, cut = tmp_path / "in", -(-(len(pieces) - 1) // 3)
    for part in (*(pieces[i : i + cut] for i in range(0, len(pieces) - 1, cut)), pieces[-1:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = guard_stream(live).writeStream.format("memory").queryName("long_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    (row,) = spark.table("long_rows").where("done").collect()
    (batch,) = kernel_tier.guard(streams).collect()
    assert (row.state, round(row.p, 9), row.onset) == (batch.state, round(batch.p, 9), batch.onset)
    assert spark.table("long_rows").where("k is not null").count() == batch.checkpoints


def test_feedback_stream_equals_replay(spark, tmp_path):
    """Rows out of order, some twice, over a restart in the middle: as the replay of the finished table."""
    draw = random.Random(8)
    rows = [(m, i, draw.randrange(2), [draw.random() for _ in range(4)]) for m in ("a", "b") for i in range(1, 81)]
    schema = "model string, seq long, label int, x array<double>"
    want = rolling_metrics(learn_online(spark.createDataFrame(rows, schema), width=4))
    mixed = rows[:]
    draw.shuffle(mixed)
    source, found = tmp_path / "in", tmp_path / "out"
    for n, part in enumerate((mixed[:70], mixed[70:] + mixed[:9])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        live = spark.readStream.schema(schema).parquet(str(source))
        query = learn_stream(live, 4).writeStream.format("parquet").option("path", str(found)).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert n or 0 < spark.read.parquet(str(found)).count() < 160
    columns = ["model", "seq", "label", "p", "b", "w", "loss", "rolling_acc", "seen", "likes", "dislikes"]
    a, b = ({(r.model, r.seq): [np.round(r[c], 9).tolist() if c not in ("model",) else r[c] for c in columns] for r in f.select(columns).collect()} for f in (spark.read.parquet(str(found)), want))
    assert len(a) == 160 and a == b


def test_events_read_on_after_a_restart(spark, tmp_path):
    """Files that grow, cut anywhere, also within a line: no delta is lost or comes twice, and verdicts are those of the batch."""
    import json

    landed, streams = tmp_path / "landed", [t for t in texts() if len(t[1]) > 5]
    landed.mkdir()
    files = {}
    for i, text in streams:
        lines = [": ping"] + ["data: " + json.dumps({"choices": [{"delta": {"content": text[k : k + 40]}}]}) for k in range(0, len(text), 40)]
        lines.insert(3, "data: {broken")
        files[f"s{i}.sse"] = ("\r\n".join([*lines, "", "data: [DONE]", "data: {}"]) + "\n").encode()
    draw = random.Random(4)
    for n in range(4):
        for name, data in files.items():
            have = (landed / name).stat().st_size if (landed / name).exists() else 0
            more = len(data) if n == 3 else have + draw.randrange(0, max(1, len(data) // 2))
            with (landed / name).open("ab") as out:
                out.write(data[have:more])
        query = guard_stream(delta_stream(spark, str(landed))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == rows.dropDuplicates(["stream_id", "k"]).count()
    found = {r.stream_id: (r.state, round(r.p, 9), r.onset) for r in rows.where("done").collect()}
    batch = kernel_tier.guard(spark.createDataFrame(streams, "stream_id long, text string")).collect()
    assert found == {f"s{r.stream_id}": (r.state, round(r.p, 9), r.onset) for r in batch}
