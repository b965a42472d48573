"""The query catalogue over the driver's tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirstream.functions import kernels
from weirstream.functions.text import char_class, count_of
from weirstream.operators import blocks, detectors, factuality, fusion, grounding, healing, kernel_tier, learning, metrics, protocol, sequence_features, sketches, synth, window_features
from weirstream.operators import streams as st
from weirstream.plans import stream_sql as sql
from weirstream.plans import training
from weirstream.sources import corpus, sessions, sse
from weirstream.sources.work import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(scan: DataFrame) -> DataFrame:
    """A table file that is read in fewer partitions than there are cores, dealt out by stream; any other as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, "stream_id") if scan.rdd.getNumPartitions() < cores else scan  # of a bare scan: nothing runs


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), "text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def r6(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


def sql6(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


def at_positions(spark: SparkSession, sf_dir: str, *names: str, final: bool = True) -> DataFrame:
    """stream_id, pos and rounded features at every checkpoint and at the end of a text, where both are one place once."""
    found = kernel_tier.features(documents(spark, sf_dir), with_deflate=False, columns=names, final=final)
    if final:
        found = found.dropDuplicates(["stream_id", "pos"])
    return found.select("stream_id", "pos", *r6(*names))


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


# ---- streams and windows -------------------------------------------------------------------------------------------

@query("select doc_id as stream_id, (i // 40 + 1)::bigint as seq, substr(text, i + 1, 40) as chunk from (select doc_id, text, unnest(range(0, length(text), 40)) as i from documents)")
def chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.chunks(documents(spark, sf_dir))


@query("select doc_id as stream_id, text from documents where length(text) > 0")
def chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.assembled(st.chunks(documents(spark, sf_dir)))


@query(with_(sql.STREAMS, sql.POINTS) + "select stream_id, k::int as k, pos::int as pos from p")
def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.checkpoints(documents(spark, sf_dir)).select("stream_id", "k", "pos")


@query(with_(sql.STREAMS, sql.CHARS) + "select stream_id, cls, count(*)::bigint as n from c group by all")
def char_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = st.characters(documents(spark, sf_dir)).groupBy("stream_id", "ch").agg(F.count("*").alias("n"))
    return counted.groupBy("stream_id", char_class(F.col("ch")).alias("cls")).agg(F.sum("n").alias("n"))


@query(with_(sql.STREAMS, sql.POINTS, sql.windowed("p")) + f"select stream_id, pos::int as pos, {sql6('digit_frac', 'symbol_frac', 'space_frac', 'foreign_frac')} from wf")
def window_char_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_positions(spark, sf_dir, "digit_frac", "symbol_frac", "space_frac", "foreign_frac", final=False)


@query(with_(sql.STREAMS, sql.POINTS, sql.windowed("p")) + f"select stream_id, pos::int as pos, {sql6('ttr')} from wf")
def type_token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_positions(spark, sf_dir, "ttr", final=False)


@query("with s as (select page_id as stream_id, html as text, length(html) as n_chars from pages),\n" + ",\n".join([sql.POINTS, sql.windowed("p")]) + f"\nselect stream_id, pos::int as pos, {sql6('structural_density')} from wf")
def structural_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = dealt(table(spark, sf_dir, "pages").select(F.col("page_id").alias("stream_id"), F.col("html").alias("text")))
    return window_features.window_features(st.checkpoints(pages)).select("stream_id", "pos", *r6("structural_density"))


@query(with_(sql.STREAMS, sql.CHARS, sql.SWITCHES) + "select stream_id, max(switches)::bigint as switches from sc group by stream_id")
def script_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_tier.of_texts(documents(spark, sf_dir), ("switches",))


@query(with_(sql.STREAMS, sql.CHARS, sql.RUNS) + "select stream_id, max(longest_run)::bigint as longest_run from ru group by stream_id")
def char_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_tier.of_texts(documents(spark, sf_dir), ("longest_run",))


@query(with_(sql.STREAMS, sql.POINTS, sql.ENDS, sql.AT, sql.CHARS, sql.ENTROPY) + f"select stream_id, pos::int as pos, {sql6('entropy')} from en")
def char_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_positions(spark, sf_dir, "entropy")


@query(with_(sql.STREAMS, sql.CHARS, sql.SURPRISE) + "select stream_id, count(*)::bigint as n, round(avg(surprise), 6) as mean_bits, round(max(surprise), 6) as most_bits from su group by stream_id")
def ngram_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_tier.of_texts(documents(spark, sf_dir), ("n", "mean_bits", "most_bits")).select("stream_id", "n", *r6("mean_bits", "most_bits"))


@query(with_(sql.STREAMS, sql.CHARS, sql.SURPRISE, sql.BASE) + f"select stream_id, n::int as n, {sql6('mean', 'mad')} from ba")
def surprise_baseline_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline is that of a text's first characters, and theirs depends on nothing behind them."""
    heads = documents(spark, sf_dir).withColumn("text", F.left("text", F.lit(sequence_features.BASELINE)))
    return kernel_tier.of_texts(heads, ("n", "mean", "mad")).select("stream_id", F.col("n").cast("int").alias("n"), *r6("mean", "mad"))


@query(with_(sql.STREAMS, sql.POINTS, sql.ENDS, sql.AT, sql.CHARS, sql.SURPRISE, sql.BASE, sql.RECENTLY) + f"select stream_id, pos::int as pos, {sql6('surprise_z', 'surprise_low_frac')} from sz")
def surprise_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_positions(spark, sf_dir, "surprise_z", "surprise_low_frac")


@query(with_(sql.STREAMS, sql.POINTS, sql.ENDS, sql.AT, sql.SHINGLES) + f"select stream_id, pos::int as pos, {sql6('repeat_rate', 'max_shingle_count')} from re")
def shingle_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_positions(spark, sf_dir, "repeat_rate", "max_shingle_count")


@query(with_(sql.STREAMS, sql.POINTS, sql.ENDS, sql.AT, sql.CHARS, sql.DRIFT) + f"select stream_id, pos::int as pos, {sql6('simhash_drift')} from dr")
def simhash_drift_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_positions(spark, sf_dir, "simhash_drift")


# ---- detectors, fusion, protocol -----------------------------------------------------------------------------------

ALL = sql.ALL_FEATURES


def k_or_end() -> Column:
    """0 stands for the score at the end of a stream."""
    return F.coalesce("k", F.lit(0)).alias("k")


def onset_or_none() -> Column:
    """-1 stands for no onset."""
    return F.coalesce("onset", F.lit(-1)).alias("onset")


def all_features(spark: SparkSession, sf_dir: str, deflate: bool = False, **how) -> DataFrame:
    """By the map-only tier; the window-function tier gives the same numbers (``guard_verdicts_windows``)."""
    return kernel_tier.features(documents(spark, sf_dir), with_deflate=deflate, **how)


@query(with_(ALL) + f"select stream_id, coalesce(k, 0)::int as k, pos::int as pos, {sql6(*detectors.VECTOR)} from f")
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_features(spark, sf_dir).select("stream_id", k_or_end(), "pos", *r6(*detectors.VECTOR))


@query(with_(ALL, sql.SCORES) + "select stream_id, coalesce(k, 0)::int as k, pos::int as pos, round(rules, 6) as p from d")
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = ("digit_frac", "foreign_frac", "repeat_rate", "zlib_ratio", "max_char_run", "structural_density", "ttr", "symbol_frac")
    return all_features(spark, sf_dir, columns=read).select("stream_id", k_or_end(), "pos", F.round(detectors.rules()["p"], 6).alias("p"))


@query(with_(ALL, sql.SCORES) + f"select stream_id, coalesce(k, 0)::int as k, pos::int as pos, {sql6('rules', 'ngram', 'sketch', 'simhash', 'entropy')} from d")
def detector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["rules", "ngram", "sketch", "simhash", "entropy"]
    own = all_features(spark, sf_dir).withColumn("scores", detectors.build(names))
    return own.select("stream_id", k_or_end(), "pos", *[F.round(F.col("scores")[i]["p"], 6).alias(n) for i, n in enumerate(names)])


@query(with_(ALL, sql.SCORES) + "select stream_id, coalesce(k, 0)::int as k, pos::int as pos, round(p, 6) as p, hard from fu")
def fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.scored(all_features(spark, sf_dir)).select("stream_id", k_or_end(), "pos", F.round("p", 6).alias("p"), "hard")


@query(with_(ALL, sql.SCORES, sql.reasons_of()) + "select stream_id, coalesce(k, 0)::int as k, pos::int as pos, reasons, classes, top from rt")
def score_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fused score says of each checkpoint; numbers in the texts, which engines round apart, are left out."""
    own = protocol.scored(all_features(spark, sf_dir))
    told = F.array_join(F.transform("reasons", lambda r: F.regexp_replace(r, "=-?[0-9.]+", "=#")), "; ")
    return own.select("stream_id", k_or_end(), "pos", told.alias("reasons"), F.array_join("classes", ",").alias("classes"), "top")


MARKERS = [r"<\|im_(start|end)\|>", r"lorem ipsum", r"as an ai language model", r"!important", r"https?://"]


@query(with_(sql.STREAMS, sql.POINTS) + ", x as (select stream_id, pos, w, ".replace(", x", ",\nx", 1) + " + ".join(sql.count("(?i)" + m) for m in MARKERS) + """ as hits from (select *, substr(text, greatest(pos - 600, 0) + 1, least(pos, 600)) as w from p)),
y as (select *, hits / greatest(1.0, length(w) / 100) as density from x)
select stream_id, pos::int as pos, round(case when length(w) >= 80 and density >= 0.35 then least(1.0, 0.7 + 0.3 * density / 1.05) else 0 end, 6) as p from y""")
def lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = detectors.lexicon("markers", MARKERS)()
    return window_features.window_counts(st.checkpoints(documents(spark, sf_dir))).select("stream_id", "pos", F.round(own["p"], 6).alias("p"))


@query(with_(ALL, sql.SCORES, sql.HINKLEY, sql.STATES) + "select stream_id, k::int as k, pos::int as pos, round(p, 6) as p, state, coalesce(onset, -1)::int as onset from st")
def checkpoint_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = protocol.scored(all_features(spark, sf_dir)).where("k is not null")
    return protocol.states(rows).select("stream_id", "k", "pos", F.round("p", 6).alias("p"), "state", F.coalesce("onset", F.lit(-1)).alias("onset"))


VERDICT_COLUMNS = "stream_id, n_chars::int as n_chars, state, round(p, 6) as p, coalesce(onset, -1) as onset, checkpoints, read_chars, released_chars, aborted"


@query(with_(ALL, sql.SCORES, sql.HINKLEY, sql.STATES, sql.VERDICTS) + f"select {VERDICT_COLUMNS} from vd")
def guard_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protocol.verdicts(protocol.scored(all_features(spark, sf_dir)))
    return found.select("stream_id", "n_chars", "state", F.round("p", 6).alias("p"), onset_or_none(), "checkpoints", "read_chars", "released_chars", "aborted")


@query(SQL["guard_verdicts"])
def guard_verdicts_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.guard(documents(spark, sf_dir), by_text=True).select("stream_id", "n_chars", "state", F.round("p", 6).alias("p"), onset_or_none(), "checkpoints", "read_chars", "released_chars", "aborted")


@query(with_(ALL, sql.SCORES, sql.HINKLEY, sql.STATES, sql.VERDICTS) + "select vd.stream_id, substr(s.text, 1, released_chars) as released from vd join s using (stream_id)")
def released_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protocol.verdicts(protocol.scored(all_features(spark, sf_dir)))
    return protocol.released_text(documents(spark, sf_dir), found)


@query(with_(ALL, sql.SCORES, sql.HINKLEY) + "select stream_id, k::int as k, round(ph, 12) as ph, alarm from h4")
def onset_page_hinkley(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = protocol.scored(all_features(spark, sf_dir)).where("k is not null")
    return protocol.page_hinkley(rows).select("stream_id", "k", F.round("ph", 12).alias("ph"), "alarm")


@query(with_(ALL, sql.SCORES, sql.HINKLEY, sql.STATES, sql.VERDICTS) + "select state, count(*)::bigint as streams, sum(read_chars)::bigint as read_chars, sum(released_chars)::bigint as released_chars, sum(read_chars - released_chars)::bigint as blocked_chars from vd group by state")
def guard_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.verdicts(protocol.scored(all_features(spark, sf_dir))).groupBy("state").agg(F.count("*").alias("streams"), F.sum("read_chars").alias("read_chars"), F.sum("released_chars").alias("released_chars"), F.sum("blocked_chars").alias("blocked_chars"))


@query()
def guard_with_deflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_tier.guard(documents(spark, sf_dir), hashed_by="blake2b").select("stream_id", "state", "p", "onset", "released_chars", "reasons", "classes")


def all_of(chunk: int) -> str:
    """The features, scores and verdicts of texts that come in chunks of another length."""
    return with_(ALL.replace(sql.POINTS, sql.points_of(chunk)), sql.SCORES, sql.HINKLEY, sql.STATES, sql.verdicts_of(chunk))


def plain_verdicts(found: DataFrame) -> DataFrame:
    return found.select("stream_id", "n_chars", "state", F.round("p", 6).alias("p"), onset_or_none(), "checkpoints", "read_chars", "released_chars", "blocked_chars", "aborted", "ok")


OK_COLUMNS = VERDICT_COLUMNS + ", read_chars - released_chars as blocked_chars, state <> 'corrupt' as ok"


@query(all_of(256) + f"select {OK_COLUMNS} from vd")
def final_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``final_check`` without the deflate ratio, which SQL doesn't know."""
    return plain_verdicts(kernel_tier.verify_final(documents(spark, sf_dir), with_deflate=False))


@query(all_of(kernel_tier.WHOLE) + f"select {OK_COLUMNS} from vd")
def finished_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``finished_check`` without the deflate ratio."""
    return plain_verdicts(kernel_tier.check_finished(documents(spark, sf_dir), with_deflate=False))


def plain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.events(documents(spark, sf_dir), protocol.scored(all_features(spark, sf_dir)))


EVENTS = with_(ALL, sql.SCORES, sql.HINKLEY, sql.STATES, sql.VERDICTS, sql.EVENTS)


@query(EVENTS + "select ev.stream_id, seq::bigint as seq, chars::int as chars, p, state, released, coalesce(onset, -1) as onset, " + ", ".join(f"case when hot then round({c}, 5) end as {c}" for c in detectors.VECTOR) + " from ev left join f on f.stream_id = ev.stream_id and f.k = ev.k")
def guard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk by chunk what is released, with scores and features of checkpoints."""
    return plain_events(spark, sf_dir).select("stream_id", "seq", F.col("chars").cast("int").alias("chars"), "p", "state", "released", onset_or_none(), "features.*")


@query()
def final_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_tier.verify_final(documents(spark, sf_dir)).select("stream_id", "state", "p", "ok", "reasons")


@query()
def finished_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_tier.check_finished(documents(spark, sf_dir)).select("stream_id", "state", "p", "ok", "checkpoints")


# ---- calibration and metrics ---------------------------------------------------------------------------------------

CLEAN_P = with_(ALL, sql.SCORES) + ", x as (select round(p, 6) as p, row_number() over (order by round(p, 6)) as i, count(*) over () as n from fu join labels on doc_id = stream_id where k is null and quality = 1)".replace(", x", ",\nx", 1)


def clean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("stream_id"))
    ends = protocol.scored(all_features(spark, sf_dir, checkpoints=False))
    return ends.join(good, "stream_id").select("stream_id", F.round("p", 6).alias("p"))


@query(CLEAN_P + """, q as (select min(case when i = greatest(1, least(n, ceil(0.98 * (n + 1) - 1e-9))) then p end) as hi, min(case when i = greatest(1, least(n, ceil(0.9 * (n + 1) - 1e-9))) then p end) as lo from x),
c1 as (select greatest(0.55, least(0.95, hi + 1e-6)) as corrupt_at, lo from q)
select round(corrupt_at, 6) as corrupt_at, round(greatest(0.4, least(corrupt_at - 0.05, lo)), 6) as suspect_at from c1""")
def conformal_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = clean_scores(spark, sf_dir).persist()
    t = fusion.calibrate(clean)
    clean.unpersist()
    return spark.createDataFrame([(round(t.corrupt_at, 6), round(t.suspect_at, 6))], "corrupt_at double, suspect_at double")


@query(CLEAN_P + "select min(case when i = greatest(1, least(n, ceil(0.95 * (n + 1) - 1e-9))) then p end) as tau from x")
def abstention_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = clean_scores(spark, sf_dir).persist()
    tau = factuality.abstention_threshold(clean, "p")
    clean.unpersist()
    return spark.createDataFrame([(tau,)], "tau double")


#: A score of the label tables: share of symbol characters.
SCORED_LABELS = "x as (select d.doc_id, lang, toxic, quality, (1 - quality) as bad, round(" + sql.count("[#*$%&|<>]", "text") + " / greatest(1, length(text)), 6) as p from documents d join labels using (doc_id))"


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    p = F.round(count_of(F.col("text"), "[#*$%&|<>]") / F.greatest(F.lit(1), F.length("text")), 6)
    return docs.select("doc_id", "lang", "toxic", "quality", (1 - F.col("quality")).alias("bad"), p.alias("p"))


@query(with_(SCORED_LABELS) + """, r as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 as rk from x)
select round((sum(case when bad = 1 then rk end) - sum(bad) * (sum(bad) + 1) / 2) / (sum(bad) * sum(1 - bad)), 6) as auroc, sum(bad)::bigint as positives, sum(1 - bad)::bigint as negatives from r""")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(scored_labels(spark, sf_dir), "p", "bad").select(*r6("auroc"), "positives", "negatives")


@query(with_(SCORED_LABELS) + "select round(avg(case when bad = 1 then -ln(least(1 - 1e-7, greatest(1e-7, p))) else -ln(1 - least(1 - 1e-7, greatest(1e-7, p))) end), 6) as log_loss, round(avg(((p >= 0.5) = (bad = 1))::int), 6) as accuracy from x")
def log_loss_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = F.col("p"), F.col("bad")
    return scored_labels(spark, sf_dir).agg(F.round(metrics.log_loss(p, y), 6).alias("log_loss"), F.round(metrics.accuracy(p, y), 6).alias("accuracy"))


@query(with_(SCORED_LABELS) + """select lang, count(*)::bigint as n, sum(bad)::bigint as positives, sum((p >= 0.05)::int)::bigint as flagged, round(sum((p >= 0.05 and bad = 1)::int) / nullif(sum((p >= 0.05)::int), 0), 6) as precision,
  round(sum((p >= 0.05 and bad = 1)::int) / nullif(sum(bad), 0), 6) as recall, round(avg(((p >= 0.05) = (bad = 1))::int), 6) as accuracy from x group by lang""")
def precision_recall_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.precision_recall(scored_labels(spark, sf_dir), "p", "bad", ["lang"], 0.05).select("lang", "n", "positives", "flagged", *r6("precision", "recall", "accuracy"))


@query(with_(SCORED_LABELS) + ", t as (select quantile_cont(p, 0.99) as threshold from x where bad = 0) select round(threshold, 6) as threshold, round(avg((p > threshold)::int), 6) as tpr from x, t where bad = 1 group by threshold")
def tpr_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tpr_at_fpr(scored_labels(spark, sf_dir), "p", "bad").select(*r6("threshold", "tpr"))


@query("select case when ('0x' || substr(md5(source), 1, 7))::bigint % 1000 < 200 then 'test' else 'train' end as split, lang, count(*)::bigint as n, sum(n_chars)::bigint as chars from documents group by all")
def hash_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(metrics.split_by_key(F.col("source")).alias("split"), "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# ---- synthesis and evaluation --------------------------------------------------------------------------------------

@query(sql.SYNTH)
def synth_corruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.corruptions(documents(spark, sf_dir))


#: Characters behind an onset that are scored before all others.
SOON = 1000


@query()
def stream_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    made = synth.benchmark(docs).withColumn("first", F.col("onset_char") + SOON)
    found = kernel_tier.states(made, first="first")
    truth = synth.benchmark(docs, texts=False).select("stream_id", "label", "onset_char", "corruption_class")
    return metrics.stream_evaluation(found, truth)


def labelled_vectors(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    return training.examples(documents(spark, sf_dir), every)


@query()
def sgd_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.fit(labelled_vectors(spark, sf_dir, 300), label="y")


@query()
def custom_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector of drift alone, fitted and judged on streams that it has not seen."""
    docs, held = documents(spark, sf_dir), learning.held_out(F.col("stream_id"))
    rows = training.examples(docs, 400, learning.SAMPLE, (synth.DRIFT,), whole=held).drop("label").withColumnRenamed("y", "label").persist()
    counted = training.places(docs, 400, (synth.DRIFT,)).select(F.col("y").alias("label"))
    report, _ = learning.fit_detector("drift", rows, register=False, counted=counted)
    rows.unpersist()
    return spark.createDataFrame([(report.name, report.auroc, report.tpr_at_1pct_fpr, report.clean, report.corrupt, report.verdict)], "name string, auroc double, tpr_at_1pct_fpr double, clean long, corrupt long, verdict string")


@query()
def live_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = training.train(documents(spark, sf_dir))
    return done.evaluation.withColumns({"corrupt_at": F.lit(done.thresholds.corrupt_at), "suspect_at": F.lit(done.thresholds.suspect_at), "examples_seen": F.lit(done.seen)})


@query()
def online_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback on documents replayed in order, one model for each language, with its rolling figures."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("lang is not null")
    share = lambda p: F.coalesce(count_of(F.col("text"), p) / F.greatest(F.lit(1), F.length("text")), F.lit(0.0))
    x = F.array(share("[#*$%&|<>]") * 10, share("[0-9]") * 10, share(" "), F.least(F.lit(1.0), F.coalesce(F.length("text"), F.lit(0)) / 5000))
    feedback = docs.select(F.col("lang").alias("model"), F.col("doc_id").alias("seq"), (1 - F.col("quality")).alias("label"), x.alias("x"))
    found = learning.learn_online(feedback, width=4)
    return learning.rolling_metrics(found.drop("w", "b")).select("model", "seq", "label", *r6("p", "loss", "rolling_acc"), "seen", "likes", "dislikes")


@query("""select split, corruption_class, count(*)::bigint as n, sum(length(text))::bigint as chars from
  (select case when ('0x' || substr(md5(doc_id::varchar), 1, 7))::bigint % 1000 < 200 then 'test' else 'train' end as split, coalesce(source, 'none') as corruption_class, text from documents)
group by cube (split, corruption_class) having split is not null or corruption_class is null""")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(metrics.split_by_key(F.col("doc_id")).alias("split"), F.coalesce("source", F.lit("none")).alias("corruption_class"), "text")
    return corpus.dataset_statistics(docs)


# ---- healing -------------------------------------------------------------------------------------------------------

@query(with_(ALL, sql.SCORES, sql.HINKLEY, sql.STATES, sql.VERDICTS) + "select vd.stream_id, state, (simhash >= 0.5)::boolean as semantic, case when simhash >= 0.5 then 'retry' else 'repair' end as strategy from vd join fu on fu.stream_id = vd.stream_id and fu.k is not distinct from case when aborted then checkpoints end")
def heal_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = healing.plan(protocol.verdicts(protocol.scored(all_features(spark, sf_dir))))
    return found.select("stream_id", "state", F.array_contains("heal_classes", detectors.SEMANTIC).alias("semantic"), "strategy")


@query("""with t as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as prefix from conversations),
g as (select conv_id, turn, prefix, text, unnest(range(least(length(prefix), 240), 23, -4)) as k from t where prefix is not null),
m as (select conv_id, turn, max(k) as k from g where replace(lower(substr(text, 1, k)), ' ', '') = replace(lower(right(prefix, k)), ' ', '') group by all)
select t.conv_id, t.turn, coalesce(m.k, 0)::int as echo from t left join m using (conv_id, turn) where prefix is not null""")
def seam_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("prefix", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("prefix is not null")
    return t.select("conv_id", "turn", healing.echo_length(F.col("prefix"), F.col("text")).alias("echo"))


@query(sql.LOOPS)
def loop_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-1 stands for no loop."""
    return healing.loop_trimmed(documents(spark, sf_dir)).withColumn("loop_onset", F.coalesce("loop_onset", F.lit(-1)))


@query()
def trim_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return healing.trim_to_clean(synth.corruptions(documents(spark, sf_dir)))


# ---- factuality ----------------------------------------------------------------------------------------------------

NUMS = "list_distinct(list_transform(regexp_extract_all({}, '-?[0-9]+(?:[.,][0-9]+)?'), lambda n: round(replace(n, ',', '.')::double, 3)))"


@query(f"""with t as (select conv_id, turn, text, string_agg(text, ' ') over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as context, role from conversations),
n as (select conv_id, turn, {NUMS.format('text')} as a, {NUMS.format("coalesce(context, '')")} as c from t where role = 'assistant'),
g as (select conv_id, turn, len(a) as claims, len(list_filter(a, lambda v: len(list_filter(c, lambda s: abs(v - s) <= greatest(0.05, 0.02 * abs(s)))) > 0)) as grounded from n)
select conv_id, turn, claims::bigint as claims, grounded::bigint as grounded, case when claims = 0 then 1.0 else round(grounded / claims, 3) end as grounding from g""")
def context_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factuality.grounded_turns(turns(spark, sf_dir), "conv_id", "turn", claims=F.col("role") == "assistant")


@query(sql.CLUSTERS)
def answer_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = turns(spark, sf_dir).select(F.col("conv_id").alias("question_id"), F.col("turn").alias("n"), F.col("text").alias("answer"))
    return factuality.answer_clusters(samples)


@query(f"""with t as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as other from conversations),
n as (select conv_id, turn, trim(other) as other, {NUMS.format('text')} as a, {NUMS.format("trim(other)")} as b, list_distinct(regexp_extract_all(lower(text), '[a-zà-þ]{{4,}}')) as cw, list_distinct(regexp_extract_all(lower(trim(other)), '[a-zà-þ]{{4,}}')) as iw from t where other is not null)
select conv_id, turn, case when starts_with(upper(other), 'UNSURE') then 'unsupported' when len(a) > 0 and len(b) > 0 then case when len(list_filter(a, lambda x: len(list_filter(b, lambda y: abs(x - y) <= greatest(0.05, 0.02 * abs(y)))) > 0)) > 0 then 'supported' else 'contradicted' end
  when len(cw) > 0 and len(list_intersect(cw, iw)) / len(cw) >= 0.34 then 'supported' else 'weak' end as verdict from n""")
def numeric_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("other", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("other is not null")
    return t.select("conv_id", "turn", factuality.claim_verdict(F.col("text"), F.col("other")).alias("verdict"))


def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with made-up alternatives from the words of conversations: probabilities follow from hashes."""
    words = turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.posexplode(F.split("text", " ")).alias("pos", "token"))
    h = lambda s: F.conv(F.substring(F.md5(F.concat(F.col("token"), F.lit(s))), 1, 4), 16, 10).cast("double") / 65536
    alternatives = [F.struct(t.alias("token"), F.round(-F.lit(s) * h(f":{i}") - i, 4).alias("logprob")) for i, (t, s) in enumerate(((F.col("token"), 1.0), (F.concat(F.lit("7"), F.col("token")), 2.0), (F.reverse("token"), 3.0)))]
    return words.select("answer_id", "pos", "token", alternatives[0]["logprob"].alias("logprob"), F.array(*alternatives).alias("top_logprobs"))


_h = "(('0x' || substr(md5(token || ':{}'), 1, 4))::int::double / 65536)"
TOKENS = f"""w as (select conv_id * 1000 + turn as answer_id, unnest(string_split(text, ' ')) as token, generate_subscripts(string_split(text, ' '), 1) - 1 as pos from conversations),
tk as (select answer_id, pos, token, [round(-1.0 * {_h.format(0)} - 0, 4), round(-2.0 * {_h.format(1)} - 1, 4), round(-3.0 * {_h.format(2)} - 2, 4)] as lp from w),
te as materialized (select answer_id, pos, token, lp, list_transform(lp, lambda x: exp(x)) as ps, list_sum(list_transform(lp, lambda x: exp(x))) as z, list_reverse_sort(lp) as sl from tk)"""


@query(with_(TOKENS) + "select answer_id, pos::int as pos, round(-list_sum(list_transform(ps, lambda p: p / z * ln(p / z + 1e-12))), 6) as entropy, round(sl[1] - sl[2], 6) as margin from te")
def token_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = token_stream(spark, sf_dir)
    return t.select("answer_id", "pos", F.round(factuality.token_entropy(F.col("top_logprobs")), 6).alias("entropy"), F.round(factuality.token_margin(F.col("top_logprobs")), 6).alias("margin"))


@query(with_(TOKENS, sql.KINDS, sql.FACT_SIGNALS) + sql.FACT_EWMA)
def fact_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factuality.fact_uncertainty(factuality.token_signals(token_stream(spark, sf_dir)))


@query(with_(TOKENS, sql.KINDS, sql.FACT_ROWS) + "select answer_id, pos::int as pos, token, position, kind, entropy, norm_entropy, margin, top1_prob, chosen_prob, competing_numbers, competing_entities, array_to_string(top_alts, ' ') as top_alts, (answer_id % 2 = 0 and kind = 'number')::int as label from fr")
def fact_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factuality.fact_rows(token_stream(spark, sf_dir), F.col("answer_id") % 2 == 0).withColumn("top_alts", F.array_join("top_alts", " "))


def answer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.lit(0.0).alias("corruption"), F.length("text").alias("answer_len"))
    return factuality.answer_vectors(factuality.fact_rows(token_stream(spark, sf_dir)), answers)


@query(with_(TOKENS, sql.KINDS, sql.FACT_ROWS, sql.ANSWERS) + f"select answer_id, {sql6(*factuality.ANSWER, digits=12)} from av")
def answer_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_features(spark, sf_dir).select("answer_id", *r6(*factuality.ANSWER, digits=12))


@query()
def answer_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), "text")
    verdicts = kernel_tier.guard(dealt(texts)).withColumnRenamed("stream_id", "answer_id")
    return factuality.assess(verdicts, factuality.fact_uncertainty(factuality.token_signals(token_stream(spark, sf_dir))))


#: Weights of a linear model over the features of an answer, only to show its parts.
WEIGHTS = dict(zip(factuality.ANSWER, (0.4, 1.1, 0.7, 0.9, -0.8, -0.5, -1.2, 0.6, 1.5, 0.1), strict=True))


@query(with_(TOKENS, sql.KINDS, sql.FACT_ROWS, sql.ANSWERS) + "select answer_id, feature, round(part, 12) as part from (" + " union all ".join(f"select answer_id, '{k}' as feature, {k} * {w}::double as part from av" for k, w in WEIGHTS.items()) + ")")
def answer_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = learning.contributions(F.array(*WEIGHTS), F.array(*map(F.lit, WEIGHTS.values())))
    named = F.arrays_zip(F.array(*map(F.lit, WEIGHTS)).alias("feature"), parts.alias("part"))
    return answer_features(spark, sf_dir).select("answer_id", F.inline(named)).select("answer_id", "feature", *r6("part", digits=12))


REPLIES = ["Yes.", "no, it is not", "UNSURE", "I can't say"]


@query("""with v as (select conv_id as claim_id, upper(regexp_extract(['Yes.', 'no, it is not', 'UNSURE', 'I can''t say'][('0x' || substr(md5(text), 1, 7))::int % 4 + 1], '(?i)\\b(YES|NO|UNSURE)\\b', 1)) as vote from conversations where text is not null),
c as (select claim_id, sum((vote = 'YES')::int)::bigint as yes, sum((vote = 'NO')::int)::bigint as no, sum((vote = 'UNSURE')::int)::bigint as unsure from v group by claim_id)
select claim_id, yes, no, unsure, yes + no + unsure as n, case when yes + no + unsure < 2 then 'hedge' when no / (yes + no + unsure) >= 0.6 then 'abstain' when yes / (yes + no + unsure) >= 0.6 then 'confident' else 'hedge' end as decision, yes + no + unsure < 2 as inconclusive from c""")
def verifier_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.conv(F.substring(F.md5("text"), 1, 7), 16, 10).cast("int") % 4
    votes = turns(spark, sf_dir).where("text is not null").select(F.col("conv_id").alias("claim_id"), F.element_at(F.array(*map(F.lit, REPLIES)), n + 1).alias("reply"))
    return factuality.verifier_votes(votes)


@query("""select template_id, lang, n_name as entity, year, replace(replace(pattern, '{entity}', n_name), '{year}', year::varchar) as question from nation,
  (values (1, 'en', 'How many ferries ran in {entity} in {year}?'), (2, 'en', 'Name one mayor of {entity}, {year}.')) t(template_id, lang, pattern), (values (1987), (2031)) y(year)""")
def question_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame([(1, "en", "How many ferries ran in {entity} in {year}?"), (2, "en", "Name one mayor of {entity}, {year}.")], "template_id int, lang string, pattern string")
    entities = table(spark, sf_dir, "nation").select(F.lit("en").alias("lang"), F.col("n_name").alias("entity"))
    return factuality.question_bank(templates, entities, spark.createDataFrame([(1987,), (2031,)], "year int"))


@query(with_(ALL, sql.SCORES, SCORED_LABELS) + """, felt as (select doc_id, round(fu.p, 6) as c, x.p as f, case when toxic = 1 then 0.9 end as s, case when quality = 0 then 1.0 end as v from fu join x on doc_id = stream_id where k is null),
risks as (select doc_id, (0.40 * c + 0.35 * f + coalesce(0.15 * s, 0) + coalesce(0.10 * v, 0)) / (0.75 + case when s is not null then 0.15 else 0 end + case when v is not null then 0.10 else 0 end) as risk from felt)
select doc_id, round(risk, 6) as risk, case when round(risk, 6) >= 0.5 then 'abstain' when round(risk, 6) >= 0.35 then 'hedge' else 'confident' end as decision from risks""")
def abstain_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of labelled documents: corruption as the guard's last score, facts as the share of symbols."""
    ends = protocol.scored(all_features(spark, sf_dir, checkpoints=False)).select(F.col("stream_id").alias("doc_id"), F.round("p", 6).alias("c"))
    x = scored_labels(spark, sf_dir).join(ends, "doc_id")
    risk = F.round(factuality.abstention_risk(F.col("c"), F.col("p"), F.when(F.col("toxic") == 1, 0.9), F.when(F.col("quality") == 0, 1.0)), 6)
    return x.select("doc_id", risk.alias("risk"), factuality.abstention_decision(risk).alias("decision"))


# ---- grounding -----------------------------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in grounding.STOPWORDS)
CORE = "list_filter(regexp_extract_all(lower({}), '[a-z][a-z0-9''\\-]{{5,}}'), lambda w: not list_contains([" + STOP + "], w))"


@query(f"""with i as (select item_id, unnest(string_split(text, '.')) as q, generate_subscripts(string_split(text, '.'), 1) - 1 as n from benchmark), b as (select item_id::varchar || '/' || n as item_id, {CORE.format("q")} as words from i where trim(q) <> '')
select b.item_id, count(*)::bigint as documents, sum((len(list_filter(words, lambda w: not contains(lower(d.text), w))) = 0)::int)::bigint as echoed from b, (select text from documents where text is not null) d group by b.item_id""")
def evidence_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence of each item as a query."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\\.")).alias("n", "query")).where("trim(query) <> ''")
    return grounding.echo_counts(items.select(F.concat_ws("/", F.col("item_id").cast("string"), F.col("n").cast("string")).alias("item_id"), "query"), table(spark, sf_dir, "documents").where("text is not null"))


@query(f"""with p as (select page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, regexp_replace(html, '<[^>]+>', ' ', 'g') as snippet from pages),
s as (select *, array_to_string(string_split(title, ' ')[1:3], ' ') as query from p),
res as (select query, page_id as rank, title, snippet from s where contains(url, '?') union all select s.query, n.page_id, n.title, n.snippet from s join p n on n.page_id = s.page_id + 1 where starts_with(s.url, 'https')),
hits as (select query, max(case when contains(url, '#') then 7 else 2 end) as wiki_hits from s where contains(url, '#') or contains(url, 'blog') group by query),
q as (select distinct query, list_distinct({CORE.format("query")}) as words from s),
told as (select q.query, w, max(contains(lower(concat_ws(' ', nullif(title, ''), nullif(snippet, ''))), w)::int) as told from (select query, unnest(words) as w from q) q join res using (query) group by all),
echo as (select q.query, min(coalesce(told, 0)) as echo from (select query, unnest(words) as w from q) q left join told on told.query = q.query and told.w = q.w group by q.query),
n as (select query, count(*) as n, string_agg(nullif(concat_ws(' — ', nullif(title, ''), nullif(snippet, '')), ''), chr(10) order by rank, title, snippet) as evidence from res group by query),
g as (select q.query, coalesce(n, 0) as n, coalesce(wiki_hits, 0) as wiki_hits, coalesce(echo, 1) = 1 as echo, coalesce(evidence, '') as evidence from q left join n using (query) left join hits using (query) left join echo using (query))
select query, case when n = 0 and wiki_hits = 0 then 'no_record' when (n >= 2 or wiki_hits >= 5) and echo then 'attested' else 'thin' end as verdict,
  case when n = 0 and wiki_hits = 0 then 'no record' when (n >= 2 or wiki_hits >= 5) and echo then 'attested by results' when n > 0 and not echo then 'results do not name the subject' else 'single weak signal' end as reason,
  n::bigint as hits, wiki_hits::int as wiki_hits, case when n > 0 and wiki_hits > 0 then 'web+wiki' when n > 0 then 'web' when wiki_hits > 0 then 'wiki' else 'none' end as source, md5(evidence) as evidence from g""")
def grounding_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of pages against made-up result lists: whole pages, the subject's own only if its url has a query."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", title.alias("title"), F.regexp_replace("html", "<[^>]+>", " ").alias("snippet"))
    asked = pages.select("page_id", "url", F.array_join(F.slice(F.split("title", " "), 1, 3), " ").alias("query"))
    own = asked.where(F.contains("url", F.lit("?"))).select("query", F.col("page_id").alias("rank"))
    following = asked.where(F.startswith("url", F.lit("https"))).select("query", (F.col("page_id") + 1).alias("rank"))
    results = own.union(following).join(pages.select(F.col("page_id").alias("rank"), "title", "snippet"), "rank").select("query", "rank", "title", "snippet")
    anchored = F.contains("url", F.lit("#"))
    hits = asked.where(anchored | F.contains("url", F.lit("blog"))).select("query", F.when(anchored, 7).otherwise(2).alias("hits"), F.lit("").alias("title"))
    return grounding.ground(asked, results, hits).select("query", "verdict", "reason", F.col("hits").cast("long").alias("hits"), "wiki_hits", "source", F.md5(F.array_join("evidence", "\n")).alias("evidence"))


#: Orders as sentences with two months, of which the second has no year near it.
ORDER_TEXT = "'Ordered on ' || {} || ', then it was packed, checked and sent off again in ' || {} || ' by road'"


@query("with t as (select o_orderkey, " + ORDER_TEXT.format("strftime(o_orderdate, '%-d %B %Y')", "strftime(o_orderdate + interval 60 day, '%B')") + """ as text, o_orderdate as a, o_orderdate + interval 60 day as b from orders)
select distinct o_orderkey, lower(strftime(a, '%B')) as month, strftime(a, '%Y') as year from t union select o_orderkey, lower(strftime(b, '%B')), '?' from t""")
def month_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.date_format(F.col("o_orderdate") + F.expr("interval 60 day"), "MMMM")
    text = F.concat(F.lit("Ordered on "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(", then it was packed, checked and sent off again in "), later, F.lit(" by road"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(grounding.month_years(text)))


@query("""with c as (select o_orderkey, strftime(o_orderdate, '%m') as m, strftime(o_orderdate, '%Y') as y, o_orderpriority from orders),
e as (select l_orderkey as o_orderkey, count(*) as n, list(distinct strftime(l_shipdate, '%m%Y')) as d from lineitem group by 1),
x as (select c.*, coalesce(n, 0) as n, case when n is not null then list_contains(d, m || y) end as agree, case when starts_with(o_orderpriority, '1') then 9 else 0 end as wiki from c left join e using (o_orderkey))
select o_orderkey, case when n = 0 and wiki = 0 then 'abstain' when agree then 'confident' when n > 0 then 'abstain' when n >= 2 or wiki >= 5 then 'confident' else 'hedge' end as decision,
  case when n = 0 and wiki = 0 then 'no record' when agree then 'date matches the evidence' when n > 0 then 'date contradicts the evidence' when n >= 2 or wiki >= 5 then 'attested' else 'thin evidence' end as reason from x""")
def date_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that an order left in the month that it came in, against the dates of its shipments."""
    said = F.concat(F.lit("A part left on "), F.date_format("l_shipdate", "d MMMM yyyy"), F.lit(" from the quay"))
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(said).alias("evidence"))  # an order has few lines
    claim = F.concat(F.lit("It left in "), F.date_format("o_orderdate", "MMMM yyyy"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", claim.alias("answer"), F.when(F.startswith("o_orderpriority", F.lit("1")), 9).otherwise(0).alias("wiki_hits"))
    answers = orders.join(shipped, "o_orderkey", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    return grounding.date_check(answers).select("o_orderkey", "decision", "reason")


@query(f"""with w as (select conv_id, turn, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9''\\-]+'), lambda w: not list_contains([{', '.join(f"'{w}'" for w in grounding.QUESTION_WORDS)}], lower(w)))[1:6] as w from conversations where role = 'user')
select conv_id, turn, coalesce(array_to_string(w, ' '), '') as query from w""")
def subject_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", grounding.subject_query(F.col("text"), F.lit("")).alias("query"))


# ---- landed events and sessions --------------------------------------------------------------------------------------

def event_lines(words: DataFrame, event: Column) -> DataFrame:
    """stream_id, seq, line: events of each turn, a comment, the end mark, and one event too late."""
    data = words.select("stream_id", "seq", F.concat(F.lit("data: "), F.to_json(event)).alias("line"))
    last = words.groupBy("stream_id").agg(F.max("seq").alias("seq"))
    tail = last.select("stream_id", F.posexplode(F.array(*map(F.lit, (": ping", "data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}')))).alias("i", "line"), F.col("seq").alias("s"))
    return data.union(tail.select("stream_id", F.col("s") + F.col("i") + 1, "line"))


@query("select conv_id * 1000 + turn as stream_id, seq::int as seq, word as chunk from (select conv_id, turn, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as seq from conversations) where word <> ''")
def sse_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), F.posexplode(F.split("text", " ")).alias("seq", "word"))
    return sse.deltas(event_lines(words, F.struct(F.array(F.struct(F.struct(F.col("word").alias("content")).alias("delta"))).alias("choices"))))


@query(with_(TOKENS) + "select answer_id, pos::int as pos, 'content' as phase, token, round(lp[1], 4) + 0.0::double as logprob, 3 as alternatives from te where token not in (" + ", ".join(sql.quoted(t) for t in sse.TEMPLATE_TOKENS) + ")")
def sse_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = token_stream(spark, sf_dir).select(F.col("answer_id").alias("stream_id"), F.col("pos").alias("seq"), "token", "logprob", "top_logprobs")
    event = F.struct(F.array(F.struct(F.struct(F.lit(None).cast("string").alias("reasoning_content"), F.col("token").alias("content")).alias("delta"), F.struct(F.array(F.struct("token", "logprob", "top_logprobs")).alias("content")).alias("logprobs"))).alias("choices"))
    found = sse.tokens(event_lines(t, event))
    return found.select("answer_id", F.col("pos").cast("int").alias("pos"), "phase", "token", (F.round("logprob", 4) + 0.0).alias("logprob"), F.size("top_logprobs").alias("alternatives"))


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard's events over the documents as sessions, a character each millisecond."""
    session = F.substring(F.md5(F.col("stream_id").cast("string")), 1, 12).alias("session_id")
    rows = protocol.scored(written(all_features(spark, sf_dir), "features"))  # read twice
    frames = protocol.events(documents(spark, sf_dir), rows).select(session, F.col("chars").alias("t"), "chars", "p", "state", "released", "reasons", "onset", "features")
    ended = protocol.verdicts(rows).select(session, (F.col("stream_id") + 1_700_000_000).alias("created_at"), F.lit("analyze").alias("mode"), "state", F.round("p", 6).alias("p"), F.col("read_chars").alias("chars"))
    return sessions.record(frames, ended)


SESSIONS = EVENTS.rstrip() + ",\nse as (select stream_id, count(*) as frames, sum(length(released)) as released_chars, count(hot or null) as scored from ev group by stream_id)\n"


@query(SESSIONS + """select substr(md5(stream_id::varchar), 1, 12) as session_id, stream_id + 1700000000 as created_at, state, round(p, 6) as p, read_chars as chars, released_chars::bigint as released_chars, (read_chars - released_chars)::bigint as blocked_chars, frames::int as frames, scored::int as with_features
from vd join (select * exclude (released_chars), released_chars from se) se using (stream_id) order by created_at desc, session_id limit 50""".replace("read_chars - released_chars", "read_chars - se.released_chars").replace("chars, released_chars::", "chars, se.released_chars::"))
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest sessions, as the list shows them; scored frames have features."""
    found = recorded(spark, sf_dir)
    counted = found.withColumns({"n": F.size("frames"), "with_features": F.size(F.filter("frames", lambda f: f["features"].isNotNull()))})
    return sessions.newest(counted).select("session_id", "created_at", "state", "p", "chars", "released_chars", "blocked_chars", F.col("n").alias("frames"), "with_features")


@query(EVENTS + "select substr(md5(stream_id::varchar), 1, 12) as session_id, chars::int as t, chars::int as chars, p, state, length(released)::int as released, coalesce(onset, -1) as onset, chars / 4.0 as emit_ms from ev")
def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.replay(recorded(spark, sf_dir), 4.0)
    return found.select("session_id", F.col("t").cast("int").alias("t"), F.col("chars").cast("int").alias("chars"), "p", "state", F.length("released").alias("released"), onset_or_none(), "emit_ms")


# ---- events --------------------------------------------------------------------------------------------------------

def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a value and their place ``k`` among those of the user, put in order hour by hour."""
    e = table(spark, sf_dir, "events").where("value is not null and user_id is not null")
    return blocks.positions(e, "user_id", F.date_trunc("hour", "ts"), ["ts", "event_id"], "k")


@query(f"""with e as (select user_id, list({{'mean': value::double, 'mad': 0.0::double}} order by ts, event_id) as l, count(*) as n from events where value is not null group by user_id),
b as (select user_id, n, list_reduce(l, lambda a, x: {{'mean': a.mean + {sql.ALPHA}::double * (x.mean - a.mean), 'mad': a.mad + {sql.ALPHA}::double * (abs(x.mean - a.mean) - a.mad)}}) as b from e)
select user_id, n::bigint as n, round(b.mean, 6) as mean, round(b.mad, 6) as mad from b""")
def value_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks.moving(blocks.block_lists(user_events(spark, sf_dir), "user_id", "k", "value"), "user_id", sequence_features.ALPHA)
    return b.select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("mad", 6).alias("mad"))


@query("""with e as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as k, value / 100 as x from events where value is not null),
h1 as (select *, x - avg(x) over (partition by user_id order by k) - 0.02 as d from e), h2 as (select *, sum(d) over (partition by user_id order by k) as cum from h1),
h3 as (select *, cum - least(0.0, min(cum) over (partition by user_id order by k)) as ph from h2)
select event_id, round(ph, 10) as ph, ph > 0.35 and k > 3 and sum((ph > 0.35 and k > 3)::int) over (partition by user_id order by k) = 1 as alarm from h3""")
def value_changepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events(spark, sf_dir).withColumn("x", F.col("value") / 100)
    return protocol.page_hinkley(e, "x", "user_id", block=blocks.BLOCK).select("event_id", F.round("ph", 10).alias("ph"), "alarm")


@query("select event_id, len(json_keys(props))::int as n_keys, array_to_string(list_sort(json_keys(props)), ',') as keys from events where props is not null")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").where("props is not null").select("event_id", F.size(keys).alias("n_keys"), F.array_join(F.array_sort(keys), ",").alias("keys"))


# ---- kernels -------------------------------------------------------------------------------------------------------

@query()
def deflate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.deflate_at(st.checkpoints(documents(spark, sf_dir)))


@query()
def count_min_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("stream_id", kernels.count_min_repetition("text").alias("r")).select("stream_id", "r.*")


@query("""with t as (select text, length(text) as n from documents where length(text) >= 12),
s as (select substr(text, i, 12) as item from (select text, unnest(range(1, n - 10, 4)) as i from t))
select r as row, (('0x' || substr(md5(r::varchar || ':' || item), 1, 8))::bigint % 2048)::int as col, count(*)::bigint as n from s, range(4) t(r) group by all""".replace("select r as row", "select r::int as row"))
def count_min_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sketch of the shingles of all documents; tasks count their own, and cells add up."""
    items = table(spark, sf_dir, "documents").select(F.explode(sketches.shingles_of(F.col("text"))).alias("item"))
    return sketches.count_min(items, "item")


@query()
def fit_all_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear model on every labelled checkpoint, none left out."""
    return learning.fit_all(labelled_vectors(spark, sf_dir, 300), label="y")


@query()
def simhash_drift_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_tier.features(documents(spark, sf_dir), hashed_by="blake2b", with_deflate=False, columns=("simhash_drift",)).select("stream_id", "pos", "simhash_drift")


@query()
def trigram_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("stream_id", kernels.trigram_tokens("text").alias("tokens"))
