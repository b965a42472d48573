"""Recurrences against naive loops, tiers against each other, and the behaviour of small operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirstream.functions.kernels import loop_start, sketch_counts
from weirstream.functions.stream_kernel import TextFeatures, class_table, fused_probability
from weirstream.functions.text import char_class
from weirstream.operators import detectors, factuality, fusion, grounding, healing, kernel_tier, learning, metrics, protocol, sequence_features, synth
from weirstream.operators import streams as st
from weirstream.sources import corpus, sessions, sse

PROSE = "The ferry left the harbour a little after nine, and by noon the fog had lifted from the islands. Two passengers stood at the rail and argued about the price of copper, while a third fed crumbs to the gulls that followed us. Nobody noticed when the engine changed its tone, because the band had begun to play an old waltz below deck. We landed late, tired, and pleased with the day. "
LOOP = "and then the same words came back once again so "
ODD = ["", "a", "ab", "abc", "x" * 45, "-" * 60, "²³½①   —•«»🙂é_", "ab" * 6, PROSE[:349], PROSE[:350], PROSE[:351], PROSE * 2, "Привет мир 漢字 abc سلام " * 30, PROSE[:300] + "0.00 #REF! " * 60, "_" * 30 + PROSE]


@pytest.fixture(scope="module")
def streams(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "stream_id long, text string")


def test_tiers_agree(spark, streams):
    rows = []
    for f in (protocol.features(streams, with_deflate=True, final=True), kernel_tier.features(streams)):
        rows.append(sorted((tuple(r) for r in f.collect()), key=lambda r: (r[0], r[2], r[1] is None)))
    assert len(rows[0]) == len(rows[1]) > 15
    for a, b in zip(*rows, strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], atol=1e-9), (a, b)


def test_surprise_against_a_loop():
    text = (PROSE + "аб漢" + PROSE)[:700]
    counts, totals, seen, history, want = [{} for _ in range(4)], [{} for _ in range(4)], set(), "", []
    for ch in text:
        v, p = max(30, len(seen) + 1), 0.0
        contexts = [history[len(history) - k :] if k else "" for k in range(4)]
        for k, w in zip((3, 2, 1, 0), (0.55, 0.28, 0.12, 0.05)):
            p += w * (counts[k].get((contexts[k], ch), 0) + 0.02) / (totals[k].get(contexts[k], 0) + 0.02 * v)
        want.append(-math.log2(min(1.0, max(1e-9, p))))
        for k in range(4):
            counts[k][contexts[k], ch] = counts[k].get((contexts[k], ch), 0) + 1
            totals[k][contexts[k]] = totals[k].get(contexts[k], 0) + 1
        seen.add(ch)
        history = (history + ch)[-3:]
    assert np.allclose(TextFeatures(text).surprise, want, atol=1e-12)


def test_char_classes(spark):
    sample = "a1²  #漢あ한سअกאαжé—🙂"
    found = spark.createDataFrame([(c,) for c in sample], "ch string").select(char_class(F.col("ch")).alias("c")).collect()
    assert [r.c for r in found] == ["latin", "digit", "digit", "space", "space", "symbol", "cjk", "kana", "hangul", "arabic", "devanagari", "thai", "hebrew", "greek", "cyrillic", "latin", "other", "other"]
    assert class_table()[ord("七")] == 3


def test_checkpoint_positions(spark):
    lengths = [0, 349, 350, 359, 360, 361, 759, 760, 1160]
    frame = spark.createDataFrame([(n,) for n in lengths], "n int").select("n", st.checkpoint_positions(F.col("n")).alias("p"))
    assert {r.n: r.p for r in frame.collect()} == {0: [], 349: [], 350: [350], 359: [359], 360: [360], 361: [360], 759: [360], 760: [360, 760], 1160: [360, 760, 1160]}


def test_chunks_reassemble(spark, streams):
    pieces = st.chunks(streams, 7)
    again = st.assembled(pieces.union(pieces.limit(5)))
    assert {r.stream_id: r.text for r in again.collect()} == {i: t for i, t in enumerate(ODD) if t}


def test_page_hinkley(spark):
    values = [0.1] * 5 + [0.9] * 4
    found = protocol.page_hinkley(spark.createDataFrame([(1, k, v) for k, v in enumerate(values, 1)], "stream_id int, k int, p double")).orderBy("k").collect()
    mean = cum = low = 0.0
    alarms = []
    for n, x in enumerate(values, 1):
        mean += (x - mean) / n
        cum += x - mean - 0.02
        low = min(low, cum)
        alarms.append(n > 3 and cum - low > 0.35)
        assert abs(found[n - 1].ph - (cum - low)) < 1e-12
    assert [r.alarm for r in found] == [a and not any(alarms[:i]) for i, a in enumerate(alarms)]


def scored(spark, rows):
    return spark.createDataFrame([(s, k, pos, 2000, p, [], [], h) for s, k, pos, p, h in rows], "stream_id int, k int, pos int, n_chars int, p double, reasons array<string>, classes array<string>, hard boolean")


def test_protocol_states(spark):
    rows = [(1, 1, 360, 0.2, False), (1, 2, 760, 0.8, False), (1, 3, 1160, 0.2, False), (1, None, 2000, 0.1, False)]  # hot, then cool
    rows += [(2, 1, 360, 0.2, False), (2, 2, 760, 0.8, False), (2, 3, 1160, 0.8, False), (2, 4, 1560, 0.1, False), (2, None, 2000, 0.1, False)]  # two in a row
    rows += [(3, 1, 360, 0.75, False), (3, None, 2000, 0.0, False), (4, 1, 360, 0.1, False), (4, 2, 760, 0.85, True), (4, None, 2000, 0.0, False)]  # hot in hold; hard alone
    rows += [(5, 1, 360, 0.1, False), (5, None, 2000, 0.9, False)]  # hot only at the end: no second hit is asked for
    found = {r.stream_id: r for r in protocol.verdicts(scored(spark, rows)).collect()}
    assert {i: (r.state, r.aborted, r.read_chars) for i, r in found.items()} == {1: ("clean", False, 2000), 2: ("corrupt", True, 1160), 3: ("corrupt", True, 360), 4: ("corrupt", True, 760), 5: ("corrupt", False, 2000)}
    assert (found[3].released_chars, found[4].released_chars, found[5].released_chars) == (0, 720, 2000)


def test_fusion(spark):
    def fused(*ps, learned=None):
        scores = F.array(*[detectors.score(f"d{i}", F.lit(p), F.array(F.lit(f"r{i}")), F.array(F.lit("c"))) for i, p in enumerate(ps)])
        return spark.range(1).select(fusion.fuse(scores, None if learned is None else F.lit(learned)).alias("f")).first().f
    assert (round(fused(0.6, 0.55).p, 9), fused(0.6, 0.55).reasons) == (0.72, ["r0", "r1"])
    assert (fused(0.4, 0.3).p, fused(0.4, 0.3).reasons, fused(0.4, 0.3).top) == (0.4, [], "d0")
    assert (fused(0.1, learned=0.9).top, round(fused(0.1, learned=0.9).p, 6)) == ("learned", 0.675)


def test_calibration(spark):
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "p double")
    assert fusion.calibrate(frame([0.9] * 4)) == fusion.Thresholds()
    t = fusion.calibrate(frame([i / 100 for i in range(80)]))
    assert abs(t.corrupt_at - 0.790001) < 1e-9 and abs(t.suspect_at - 0.72) < 1e-9
    xs = [random.Random(i).random() for i in range(200)] + [0.5] * 30
    assert [fusion.order_statistic(frame(xs), "p", k, bins=7) for k in (1, 60, 115, 230)] == [sorted(xs)[k - 1] for k in (1, 60, 115, 230)]


def test_metrics(spark):
    r = random.Random(2)
    rows = [(round(r.random(), 1), r.randrange(2)) for _ in range(200)]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z]
    frame = spark.createDataFrame(rows, "s double, y int")
    assert abs(metrics.auroc(frame, "s", "y").first().auroc - sum(pairs) / len(pairs)) < 1e-12
    assert metrics.auroc(frame.where("y = 1"), "s", "y").first().auroc is None
    negatives = [s for s, y in rows if not y]
    assert abs(metrics.tpr_at_fpr(frame, "s", "y", 0.2).first().threshold - np.quantile(negatives, 0.8)) < 1e-12


def test_synthesis_and_learning(spark):
    clean = spark.createDataFrame([(i, " ".join(random.Random(i).sample(PROSE.split() * 4, 200))) for i in range(60)], "stream_id long, text string")
    made = synth.corruptions(clean).collect()
    assert {r.corruption_class for r in made} == set(synth.CLASSES)
    texts = {r.stream_id: r.text for r in clean.collect()}
    for r in made:
        assert r.text[: r.onset_char] == texts[r.source_id][: r.onset_char] and len(r.text) - r.onset_char >= 400
    bench = synth.benchmark(clean)
    vectors = kernel_tier.features(bench.select("stream_id", "text"), chunk=300, hold=300, every=300, final=False).join(bench.select("stream_id", "label", "onset_char"), "stream_id")
    vectors = vectors.withColumn("label", learning.checkpoint_labels(F.col("pos"), F.col("label"), F.col("onset_char"))).where("label is not null").withColumn("example_id", F.concat_ws(":", "stream_id", F.format_string("%06d", "pos")))
    report, own = learning.fit_detector("collapse", vectors)
    assert report.auroc > 0.9 and "custom:collapse" in detectors.names()
    detectors.unregister("custom:collapse")
    assert learning.fit(vectors, epochs=1).first().w == learning.fit(vectors, epochs=1).first().w


def test_online_learning(spark):
    rows = [("m", i, i % 2, [float(i % 2), 1.0]) for i in range(40)]
    replay = learning.learn_online(spark.createDataFrame(rows, "model string, seq int, label int, x array<double>"), width=2)
    out = learning.rolling_metrics(replay).orderBy("seq").collect()
    assert out[-1].seen == 40 and out[-1].likes == out[-1].dislikes == 20 and out[-1].rolling_acc > out[3].rolling_acc - 0.5 and out[-1].loss < out[0].loss


def test_healing(spark):
    assert loop_start(PROSE + LOOP * 40) is not None and abs(loop_start(PROSE + LOOP * 40) - len(PROSE)) <= len(LOOP)
    assert loop_start(PROSE * 1) is None and loop_start("") is None
    frame = spark.createDataFrame([(1, PROSE + LOOP * 40), (2, PROSE), (3, LOOP * 60), (4, "")], "stream_id long, text string")
    trimmed = {r.stream_id: r.trimmed for r in healing.trim_to_clean(frame).collect()}
    assert trimmed[1] is None or (trimmed[1].count("came back") < 3 and trimmed[1].startswith(PROSE[:300]))
    assert trimmed[2] == PROSE and trimmed[3] == "and " and trimmed[4] is None  # a cut moves on to the next blank
    seam = spark.createDataFrame([("We went along the quiet river bank", "Along the QUIET river bank and home."), ("short", "other"), (None, "x")], "p string, c string")
    assert [r.s for r in seam.select(healing.stitched(F.col("p"), F.col("c")).alias("s")).collect()] == ["We went along the quiet river bank and home.", "shortother", "x"]
    plans = healing.plan(spark.createDataFrame([(["semantic drift hamming=0.5"], []), (["foreign-script frac=0.9"], []), ([], [])], "reasons array<string>, classes array<string>")).collect()
    assert [p.strategy for p in plans] == ["retry", "repair", "repair"] and "language" in plans[1].instruction and plans[0].instruction == ""
    log = spark.createDataFrame([(1, 1, "primary", False), (1, 2, "heal-1", True), (1, 3, "retry-1", True), (2, 1, "primary", False)], "request_id int, n int, label string, ok boolean")
    assert {r.request_id: (r.ok, r.label, r.healed) for r in healing.first_success(log).collect()} == {1: (True, "heal-1", True), 2: (False, "primary", False)}


def test_token_signals(spark):
    def tops(*pairs):
        return [{"token": t, "logprob": p} for t, p in pairs]
    rows = [(1, 0, "The", -0.1, tops(("The", -0.1), ("A", -3.0))), (1, 1, " 12", -0.7, tops((" 12", -0.8), (" 15", -0.7))), (1, 2, " Paris", -0.7, tops((" Paris", -0.6), (" Rome", -0.8))), (1, 3, ".", 0.0, tops((".", 0.0))), (1, 4, " Berlin", -0.7, tops((" Berlin", -0.7), (" Rome", -0.7))), (2, 0, "ok", -1.0, [])]
    schema = "answer_id int, pos int, token string, logprob double, top_logprobs array<struct<token: string, logprob: double>>"
    found = {(r.answer_id, r.pos): r for r in factuality.token_signals(spark.createDataFrame(rows, schema)).collect()}
    assert [found[1, i].kind for i in range(5)] == ["", "number", "entity", "", ""] and [found[1, i].flagged for i in range(5)] == [False, True, True, False, False]
    assert abs(found[1, 1].margin - 0.1) < 1e-9 and found[1, 3].margin == 10.0 and found[2, 0].entropy == 0.0
    totals = {r.answer_id: r for r in factuality.fact_uncertainty(factuality.token_signals(spark.createDataFrame(rows, schema))).collect()}
    assert (totals[1].fact_tokens, totals[1].flag_rate, totals[2].fact_tokens) == (2, 1.0, 0)


def test_answers(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    g = one(factuality.context_grounding(F.lit("It rose 3,5 to 120 and 7"), F.lit("from 3.52 up to 119")))
    assert (g.claims, g.grounded, g.ungrounded) == (3, 2, [7.0])
    assert one(factuality.claim_verdict(F.lit("in 1999"), F.lit("It was 1999."))) == "supported" and one(factuality.claim_verdict(F.lit("in 1899"), F.lit("1999"))) == "contradicted"
    assert one(factuality.claim_verdict(F.lit("x"), F.lit("unsure"))) == "unsupported" and one(factuality.claim_verdict(F.lit("the old stone bridge"), F.lit("a stone bridge there"))) == "supported"
    samples = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Paris is the capital", "the capital is Paris", "Lyon maybe", "Paris capital"])], "question_id int, n int, answer string")
    c = factuality.answer_clusters(samples).first()
    assert (c.n_clusters, c.agreement, c.n_samples) == (2, 0.75, 4)
    assert abs(one(factuality.abstention_risk(F.lit(0.5), F.lit(0.1), F.lit(None).cast("double"), F.lit(1.0))) - (0.2 + 0.035 + 0.1) / 0.85) < 1e-12
    votes = spark.createDataFrame([(1, "YES"), (1, "yes."), (1, "NO"), (2, "NO"), (2, "no"), (3, "YES"), (3, "hm")], "claim_id int, reply string")
    assert {r.claim_id: r.decision for r in factuality.verifier_votes(votes).collect()} == {1: "confident", 2: "abstain", 3: "hedge"}


def test_grounding(spark):
    results = spark.createDataFrame([("zephyr bridge", 1, "The zephyr", "a bridge"), ("zephyr bridge", 2, "zephyr", ""), ("golden harbour", 1, "other", "thing"), ("golden harbour", 2, "more", "things")], "query string, rank int, title string, snippet string")
    hits = spark.createDataFrame([("zephyr bridge", 9, "Zephyr")], "query string, hits int, title string")
    queries = spark.createDataFrame([("zephyr bridge",), ("golden harbour",), ("nothing known",)], "query string")
    found = {r.query: r for r in grounding.ground(queries, results, hits).collect()}
    assert {q: r.verdict for q, r in found.items()} == {"zephyr bridge": "attested", "golden harbour": "thin", "nothing known": "no_record"}
    assert found["zephyr bridge"].evidence == ["The zephyr — a bridge", "zephyr"] and found["zephyr bridge"].source == "web+wiki"
    answers = spark.createDataFrame([("It opened in May 1999.", ["Opened in June 1999", "x"], 9), ("In May 1999", ["opened May 1999"], 0), ("no date", [], 0), ("no date", ["a"], 1)], "answer string, evidence array<string>, wiki_hits int")
    assert [r.decision for r in grounding.date_check(answers).collect()] == ["abstain", "confident", "abstain", "hedge"]
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert [tuple(x) for x in one(grounding.month_years(F.lit("March, then on 3 May 2001 and june")))] == [("march", "?"), ("may", "2001"), ("june", "2001")]
    assert one(grounding.subject_query(F.lit("What is the height of Mount Example?"), F.lit(""))) == "height Mount Example"
    assert one(grounding.snippets_of(F.lit('<a class="result__snippet" x>a <b>b</b> &amp; c</a>'))) == ["a b & c"]


def test_sources(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"text": "' + "a" * 800 + '"}\nbroken\n{"text": "short"}\n{"other": 1}\n')
    seeds = spark.createDataFrame([("seed",)], "text string")
    assert sorted(len(r.text) for r in corpus.read_corpus(spark, str(path), fallback=seeds).collect()) == [4, 800]
    line = 'data: {"choices": [{"delta": {"content": "%s"}, "logprobs": {"content": [{"token": "%s", "logprob": -0.5, "top_logprobs": [{"token": "x", "logprob": -0.5}]}]}}]}'
    lines = spark.createDataFrame([(1, 1, line % ("Hel", "Hel")), (1, 2, ": ping"), (1, 3, line % ("lo", "<|im_end|>")), (1, 4, "data: {bad"), (1, 5, "data: [DONE]"), (1, 6, line % ("no", "no"))], "stream_id int, seq int, line string")
    assert [r.chunk for r in sse.deltas(lines).orderBy("seq").collect()] == ["Hel", "lo"]
    assert [(r.pos, r.token) for r in sse.tokens(lines).collect()] == [(0, "Hel")]
    frames = spark.createDataFrame([("0123456789ab", 20, 80, 0.9, "corrupt", None), ("0123456789ab", 10, 40, 0.1, "clean", "x" * 40)], "session_id string, t long, chars long, p double, state string, released string")
    ended = spark.createDataFrame([("0123456789ab", 1.0e9, "live", "corrupt", 0.9), ("bad id", 1.0e9, "live", "clean", 0.0)], "session_id string, created_at double, mode string, state string, p double")
    sessions.save(sessions.record(frames, ended), str(tmp_path / "s"))
    saved = spark.read.parquet(str(tmp_path / "s"))
    row = sessions.get(saved, "0123456789ab").first()
    assert saved.count() == 1 and (row.released_chars, row.blocked_chars) == (40, 40) and sessions.newest(saved).count() == 1
    assert [r.emit_ms for r in sessions.replay(saved, 2).orderBy("t").collect()] == [5.0, 10.0]
    sessions.write_thresholds(spark, fusion.Thresholds(0.6, 0.5, 0.9), str(tmp_path / "t"))
    assert sessions.read_thresholds(spark, str(tmp_path / "t")) == fusion.Thresholds(0.6, 0.5, 0.9)


def test_sketch_is_exact_until_it_saturates():
    text = PROSE + LOOP * 5
    seen, repeats, most = {}, 0, 0
    for i in range(12, len(text) + 1, 4):
        s = text[i - 12 : i]
        seen[s] = seen.get(s, 0) + 1
        repeats, most = repeats + (seen[s] > 1), max(most, seen[s])
    total, r, m = sketch_counts(text)
    assert total == sum(seen.values()) and r >= repeats and m >= most and r - repeats <= 2


def test_probe_score_is_the_fused_score(spark, streams):
    rows = protocol.scored(kernel_tier.features(streams)).collect()
    for r in rows:
        assert abs(fused_probability({c: r[c] for c in detectors.VECTOR}) - r.p) < 1e-9


@pytest.mark.parametrize(("ties", "share"), [("mid", 0.5), ("positive", 0.0), ("negative", 1.0)])
@pytest.mark.parametrize("blocks", [2, 7, 200])
def test_auroc_by_group_and_block(spark, monkeypatch, ties, share, blocks):
    monkeypatch.setattr(metrics, "SCORE_BLOCKS", blocks)
    r = random.Random(blocks)
    rows = [(g, round(r.random(), d), r.randrange(2)) for g, d in (("a", 1), ("b", 6), (None, 2)) for _ in range(150)] + [("c", 0.5, 1), ("c", None, 0)]
    frame = spark.createDataFrame(rows, "g string, s double, y int")
    found = {x.g: x for x in metrics.auroc(frame, "s", "y", ["g"], ties, one_class=0.5).collect()}
    for g in ("a", "b", None):
        pos, neg = ([s for h, s, y in rows if h == g and y == v] for v in (1, 0))
        want = sum(1.0 if p > q else share if p == q else 0.0 for p in pos for q in neg) / len(pos) / len(neg)
        assert abs(found[g].auroc - want) < 1e-12 and (found[g].positives, found[g].negatives) == (len(pos), len(neg))
    assert found["c"].auroc == 0.5 and found["c"].negatives == 0


def test_checkpoints_carry_bounded_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(5_000))
    rows = st.checkpoints(spark.createDataFrame([(1, text)], "stream_id int, text string")).collect()
    assert [x.k for x in rows] == list(range(1, len(rows) + 1)) and len(rows) == 12
    assert all(x.text == text[max(0, x.pos - st.REACH - st.CHUNK) : x.pos] and x.n_chars == 5_000 for x in rows)


def test_deflate_windows_of_any_chunk(spark):
    text = (PROSE + LOOP * 3) * 9
    frame = spark.createDataFrame([(1, text)], "stream_id int, text string")
    for chunk in (7, 40, 256, 300):
        got = {x.pos: x.zlib_ratio for x in protocol.features(frame, chunk, with_deflate=True, final=True).collect()}
        want = {x.pos: x.zlib_ratio for x in kernel_tier.features(frame, chunk).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_month_years_against_a_loop(spark):
    import re

    r = random.Random(4)
    words = ["May", "march", "JUNE", "1999", "2031", "in", "maybe", "x" * 20, "of the", "December", "19999", "y2020", "—"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 25))) for _ in range(60)] + ["", None, "MayMay May"]
    def brute(t):
        out = []
        for m in re.finditer("|".join(grounding.MONTHS), t or "", re.I):
            if re.match(r"\w", (t[m.start() - 1 : m.start()] or " ")) or re.match(r"\w", t[m.end() : m.end() + 1] or " "):
                continue
            around = t[max(0, m.start() - 15) : m.end() + 15]
            year = re.search(r"\b(?:19|20)[0-9]{2}\b", around)
            out.append((m.group().lower(), year.group() if year else "?"))
        return list(dict.fromkeys(out))
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", grounding.month_years(F.col("t")).alias("m")).collect()
    assert {x.i: [tuple(y) for y in x.m] for x in found} == {i: brute(t) for i, t in enumerate(texts)}


def test_echo_by_words_of_any_result(spark):
    asked = spark.createDataFrame([("harbour ferries copper",), ("islands gulls",), ("nothing",), ("a b",)], "query string")
    results = spark.createDataFrame([("harbour ferries copper", 1, "Harbour", "the ferries"), ("harbour ferries copper", 2, "", "COPPER prices"), ("islands gulls", 1, "islets", None), ("a b", 1, "x", "y"), ("a b", 2, "x", "z")], "query string, rank int, title string, snippet string")
    hits = spark.createDataFrame([("islands gulls", 9, "Of islands")], "query string, hits int, title string")
    found = {x.query: x for x in grounding.ground(asked, results, hits, most=1).collect()}
    assert {q: x.verdict for q, x in found.items()} == {"harbour ferries copper": "attested", "islands gulls": "attested", "nothing": "no_record", "a b": "attested"}
    assert found["harbour ferries copper"].evidence == ["Harbour — the ferries"] and found["a b"].hits == 2
    texts = spark.createDataFrame([("Harbour ferries and copper",), ("ferries",), ("",)], "text string")
    items = spark.createDataFrame([(i, q) for i, q in enumerate(["harbour copper", "ferries", "", "missing"])], "item_id int, query string")
    for most in (1, 500):
        assert {x.item_id: (x.documents, x.echoed) for x in grounding.echo_counts(items, texts, most).collect()} == {0: (3, 1), 1: (3, 2), 2: (3, 3), 3: (3, 0)}


def test_fit_on_a_bounded_sample(spark):
    r = random.Random(6)
    rows = [(i, float(i % 2), r.random() + i % 2, 1.0) for i in range(400)]
    frame = spark.createDataFrame(rows, "example_id int, label double, x double, one double")
    model = learning.fit(frame, ("x", "one"), sample=20).first()
    assert 20 < model.seen / 6 <= 40 and model.w[0] > 0
    again = learning.fit(frame.repartition(7), ("x", "one"), sample=20).first()
    assert again == model


def test_final_check(spark, streams):
    found = {x.stream_id: x for x in kernel_tier.verify_final(streams).collect()}
    want = {x.stream_id: x for x in kernel_tier.guard(streams, 256, partitions=3).collect()}
    assert {i: (x.state, x.p) for i, x in found.items()} == {i: (x.state, x.p) for i, x in want.items()}
    assert all(x.ok == (x.state != "corrupt") for x in found.values())


def test_text_pieces():
    import pyarrow as pa

    from weirstream.functions.arrow import pieces

    texts = ["a" * n for n in (3, 0, 10, 2, 2, 2)] + [None, "b"]
    batch = pa.RecordBatch.from_pydict({"i": list(range(8)), "t": pa.array(texts, pa.string())})
    cut = [p.column(1).to_pylist() for p in pieces(batch, 1, 5)]
    assert [x for p in cut for x in p] == texts and [len(p) for p in cut] == [2, 1, 2, 3]
    assert not list(pieces(batch.slice(0, 0), 1))


def test_stream_evaluation_against_a_loop(spark):
    rows = [(i, c, l, o, s, read, on, rel) for i, (c, l, o, s, read, on, rel) in enumerate([("clean", 0, None, "clean", 900, None, 900), ("loop", 1, 100, "corrupt", 360, 320, 0), ("loop", 1, 500, "corrupt", 360, 300, 0), ("loop", 1, 500, "corrupt", 900, 700, 860), ("loop", 1, 200, "clean", 900, None, 900)])]
    v = spark.createDataFrame([(r[0], r[4], r[5], r[6], r[7]) for r in rows], "stream_id int, state string, read_chars long, onset long, released_chars long")
    t = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in rows], "stream_id int, corruption_class string, label int, onset_char int")
    found = {x.corruption_class: x for x in metrics.stream_evaluation(v, t).collect()}
    x = found["loop"]
    assert (x.streams, x.flagged, x.early_alarms, x.rate, x.latency_median, x.onset_error_median, x.nothing_leaked, x.could_leak) == (4, 3, 1, 0.75, 330.0, 200.0, 1, 2)
    assert (found["clean"].flagged, found["clean"].read_chars) == (0, 900)


def test_finished_text_is_one_checkpoint(spark, streams):
    found = {x.stream_id: x for x in kernel_tier.check_finished(streams).collect()}
    for i, text in enumerate(ODD):
        if text:
            n = len(text)
            assert found[i].checkpoints == (n >= 350)
            f = TextFeatures(text).at(n, n if n >= 200 else None, None)
            assert abs(found[i].p - fused_probability(f)) < 1e-9 and found[i].ok == (found[i].state != "corrupt")


def test_training_in_four_phases(spark):
    from weirstream.plans import training

    clean = spark.createDataFrame([(i, " ".join(random.Random(i).choices(PROSE.split(), k=230))) for i in range(120)], "stream_id long, text string")
    done = training.train(clean)
    assert len(done.weights) == len(detectors.VECTOR) and done.seen > 100 and 0.55 <= done.thresholds.corrupt_at <= 0.95 and done.thresholds.suspect_at <= done.thresholds.corrupt_at - 0.05 + 1e-9
    report = {x.corruption_class: x for x in done.evaluation.collect()}
    tests = {x.stream_id for x in clean.withColumn("s", metrics.split_by_key(F.col("stream_id"))).where("s = 'test'").collect()}
    assert sum(x.streams for c, x in report.items() if c != "clean") == 4 * sum(1 for x in clean.where(metrics.bucket(F.col("stream_id"), 2) != 0).collect() if x.stream_id in tests)
    assert report[detectors.DRIFT].rate >= 0.9


def test_assessment(spark):
    v = spark.createDataFrame([(1, "clean", 0.1), (2, "corrupt", 0.2), (3, "clean", 0.6), (4, "clean", 0.0)], "answer_id int, state string, p double")
    facts = spark.createDataFrame([(1, 0.2), (2, 0.0), (3, 0.6)], "answer_id int, fact_uncertainty double")
    found = {x.answer_id: (round(x.risk, 6), x.decision) for x in factuality.assess(v, facts).collect()}
    assert found == {1: (round((0.04 + 0.07) / 0.75, 6), "confident"), 2: (round(0.08 / 0.75, 6), "abstain"), 3: (0.6, "abstain"), 4: (0.0, "confident")}


def test_fit_over_all_rows(spark):
    """The optimum of the penalised loss for each group, as plain Newton steps find it, and as good a ranking as the sequential fit."""
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 3)) * [1.0, 5.0, 0.1] + [0.0, 2.0, 7.0]
    y = (r.random(3000) < 1 / (1 + np.exp(-(x @ [1.0, -0.3, 4.0] - 27)))).astype(int)
    rows = [(i, "uv"[i % 2], int(y[i]), *map(float, x[i])) for i in range(3000)] + [(9000, "u", None, 1.0, 1.0, 1.0), (9001, "u", 1, None, 1.0, 1.0), (9002, None, 1, 1.0, 2.0, 3.0)]
    frame = spark.createDataFrame(rows, "example_id long, g string, label int, a double, b double, c double").repartition(5)
    found = {m.g: m for m in learning.fit_all(frame, ("a", "b", "c"), group="g").collect()}
    assert set(found) == {"u", "v", None} and found["u"].seen == found["v"].seen == 1500 and found["u"].steps < 30
    for k, g in enumerate("uv"):
        own, target = x[k::2], y[k::2]
        z = np.c_[(own - own.mean(0)) / own.std(0), np.ones(1500)]
        w, penalty = np.zeros(4), 1e-4 * np.array([1, 1, 1, 0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / 1500 + np.diag(penalty), z.T @ (p - target) / 1500 + penalty * w)
        assert np.allclose(found[g].w, w[:3] / own.std(0), atol=1e-5)
    whole = frame.where("g is not null and label is not null and a is not null")
    one, other = learning.fit_all(whole, ("a", "b", "c")).first(), learning.fit(whole, ("a", "b", "c"), sample=100_000).first()
    area = lambda m: metrics.auroc(whole.withColumn("p", learning.model_score(F.array("a", "b", "c"), F.lit(m.w), F.lit(m.b))), "p", "label").first().auroc
    assert area(one) >= area(other) - 0.01


def test_sketches_add_up(spark):
    from weirstream.operators import sketches

    r = random.Random(2)
    items = [r.choice("abcdefghij") * r.randrange(1, 40) for _ in range(4000)] + [None] * 3
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, item string").repartition(5)
    cells = lambda f: {(c.row, c.col): c.n for c in f.collect()}
    whole = sketches.count_min(frame, "item", width=64)
    parts = [sketches.count_min(frame.where(F.col("i") % 3 == k), "item", width=64) for k in range(3)]
    assert cells(whole) == cells(sketches.merged(*parts)) and sum(c.n for c in whole.collect()) == 4 * 4000
    found = {x.item: x.estimate for x in sketches.estimates(frame, "item", whole, width=64).collect()}
    true = {x: items.count(x) for x in set(items) if x is not None}
    assert found.keys() == true.keys() and all(found[x] >= n for x, n in true.items())
    assert sum(found[x] - n > math.e / 64 * 4000 for x, n in true.items()) <= len(true) * math.exp(-4) + 5
    exact = {x.item: x.estimate for x in sketches.estimates(frame, "item", sketches.count_min(frame, "item")).collect()}
    assert sum(exact[x] != n for x, n in true.items()) <= len(true) // 50
    assert sketches.count_min(frame.where("i < 0"), "item").count() == 0


def test_shingles_of_any_characters(spark):
    texts = ["", "short", "x" * 12, "ab\ncd\U00010330 年月日" * 9, PROSE]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "stream_id int, text string")
    rows = sequence_features.shingles(found).collect()
    for n, t in enumerate(texts):
        cut = [t[i - 12 : i] for i in range(12, len(t) + 1, 4)]
        repeats = [sum(cut.index(c) < j for j, c in enumerate(cut[: k + 1])) for k in range(len(cut))]
        most = [max(cut[: k + 1].count(c) for c in cut[: k + 1]) for k in range(len(cut))]
        own = sorted((r.i, r.total, r.repeats, r.most) for r in rows if r.stream_id == n)
        assert own == [(12 + 4 * k, k + 1, repeats[k], most[k]) for k in range(len(cut))]


def test_scans_by_blocks(spark):
    """Runs, switches, averages and change points are the same in blocks of a few characters as in one."""
    from weirstream.operators import blocks

    r = random.Random(3)
    text = "".join(r.choice("aab --жя年  \U00010330\n") for _ in range(700))
    one = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "aaaa")], "stream_id int, text string")
    cut = st.blocked_characters(one, size=70)
    assert [(c.i, c.ch) for c in cut.where("stream_id = 1").orderBy("i").collect()] == list(enumerate(text, 1))
    features = lambda f: [tuple(x) for x in sequence_features.char_runs(sequence_features.script_switches(f)).orderBy("stream_id", "i").select("stream_id", "i", "switches", "longest_run").collect()]
    assert features(cut) == features(st.characters(one))
    values = [(k % 3, i, r.random()) for i, k in enumerate(r.choices(range(9), k=500))]
    events = spark.createDataFrame(values, "u int, ts int, value double")
    placed = blocks.positions(events, "u", F.floor(F.col("ts") / 50), ["ts"], "k")
    for u in range(3):
        own = [v for k, _, v in values if k == u]
        assert [x.value for x in placed.where(F.col("u") == u).orderBy("k").collect()] == own and [x.k for x in placed.where(F.col("u") == u).orderBy("k").collect()] == list(range(1, len(own) + 1))
    for size in (7, 1000):
        found = {x.u: x for x in blocks.moving(blocks.block_lists(placed, "u", "k", "value", size), "u", 0.1).collect()}
        for u in range(3):
            mean = mad = None
            for v in [v for k, _, v in values if k == u]:
                mad = 0.0 if mean is None else mad + 0.1 * (abs(v - mean) - mad)
                mean = v if mean is None else mean + 0.1 * (v - mean)
            assert abs(found[u].mean - mean) < 1e-12 and abs(found[u].mad - mad) < 1e-12
    a, b = ({(x.u, x.k): (round(x.ph, 9), x.alarm) for x in protocol.page_hinkley(placed, "value", "u", block=n).collect()} for n in (None, 11))
    assert a == b and any(alarm for _, alarm in a.values())


def test_events_tell_every_character(spark, streams):
    """Released and blocked characters add up to what was read; nothing comes after a corrupt chunk; states follow the checkpoints."""
    rows = protocol.scored(kernel_tier.features(streams)).cache()
    told, verdicts = {}, {v.stream_id: v for v in protocol.verdicts(rows).collect()}
    for e in sorted(protocol.events(streams, rows).collect(), key=lambda e: (e.stream_id, e.seq)):
        told.setdefault(e.stream_id, []).append(e)
    texts = {x.stream_id: x.text for x in streams.collect() if x.text}
    assert told.keys() == texts.keys() == verdicts.keys()
    for i, own in told.items():
        v, released = verdicts[i], "".join(e.released for e in own)
        assert texts[i].startswith(released) and own[0].seq == 1
        assert [e.state for e in own].count("corrupt") == int(v.aborted)
        if v.aborted:
            assert own[-1].state == "corrupt" and own[-1].chars == v.read_chars and len(released) == v.released_chars and own[-1].onset == v.onset and own[-1].features is not None
        elif v.checkpoints:
            assert released == texts[i]
        else:
            assert released == ""
        assert all((e.features is not None) == (e.p > 0) for e in own)


def test_sessions_and_metrics_are_written_once(spark, tmp_path):
    frames = spark.createDataFrame([("0123456789ab", 10, 40, 0.1, "clean", "x" * 40, ["r"], None)], "session_id string, t long, chars long, p double, state string, released string, reasons array<string>, onset int")
    ended = spark.createDataFrame([("0123456789ab", 1.0e9, "live", "clean", 0.1, 90)], "session_id string, created_at double, mode string, state string, p double, chars long")
    batch, path = sessions.record(frames, ended), str(tmp_path / "s")
    write = sessions.sink(path)
    for number in (0, 1, 1, 0):
        write(batch, number)
    saved = spark.read.parquet(path).collect()
    assert sorted(r.batch for r in saved) == [0, 1] and saved[0].frames[0].reasons == ["r"] and (saved[0].chars, saved[0].blocked_chars) == (90, 50)
    target = str(tmp_path / "m.json")
    for n in range(3):
        sessions.write_metrics(spark, {"epoch": n, "name": "é"}, target)
        assert sessions.read_metrics(spark, target) == {"epoch": n, "name": "é"}
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc") and p.name != "s"] == ["m.json"]
    listener = sessions.MetricsListener(spark, target)
    spark.streams.addListener(listener)
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(i,) for i in range(5)], "v int").write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("v int").parquet(str(tmp_path / "in")).observe("sums", F.sum("v").alias("total"))
    live.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    import time

    for _ in range(50):
        if "observed" in sessions.read_metrics(spark, target):
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert sessions.read_metrics(spark, target)["observed"] == {"sums": {"total": 10}}


def test_released_characters_by_chunk(spark, streams):
    """An aborted text has released all whole chunks before the one of its abort."""
    for chunk in (40, 256, 1000):
        rows = protocol.scored(kernel_tier.features(streams, chunk))
        for v in protocol.verdicts(rows, chunk=chunk).collect():
            if v.aborted and v.checkpoints > 1:
                assert v.released_chars == (v.read_chars - 1) // chunk * chunk


def test_char_class_of_every_code_point(spark):
    """The classes by a plain loop over all code points, with ranges written down here."""
    ranges = {"cjk": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)], "kana": [(0x3040, 0x30FF)], "hangul": [(0xAC00, 0xD7AF), (0x1100, 0x11FF)], "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)], "devanagari": [(0x0900, 0x097F)], "thai": [(0x0E00, 0x0E7F)], "hebrew": [(0x0590, 0x05FF)], "greek": [(0x0370, 0x03FF)], "cyrillic": [(0x0400, 0x04FF)], "latin": [(0x0041, 0x024F)]}
    def of(c):
        if c.isdigit():
            return "digit"
        if c.isspace():
            return "space"
        if ord(c) < 128 and not c.isalnum():
            return "symbol"
        return next((n for n, own in ranges.items() if any(a <= ord(c) <= b for a, b in own)), "other")
    table = class_table()
    from weirstream.functions.stream_kernel import NAMES

    assert [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and NAMES[table[c]] != of(chr(c))] == []
    points = [c for c in range(1, 0x3500) if not 0xD800 <= c < 0xE000]
    found = spark.createDataFrame([(c, chr(c)) for c in points], "c int, ch string").select("c", char_class(F.col("ch")).alias("k")).collect()
    assert [(x.c, x.k, of(chr(x.c))) for x in found if x.k != of(chr(x.c))] == []
