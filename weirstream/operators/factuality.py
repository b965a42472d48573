"""Uncertainty of facts from token log-probabilities, and checks of answers against each other and their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstream.functions.text import NUMBER, numbers_in
from weirstream.operators.blocks import block_lists, moving

#: Uncertain from this entropy (nats) on or up to this margin; rate of the moving risk; log-probability of a missing one.
ENTROPY_BAR, MARGIN_BAR, RATE, MISSING = 1.2, 0.6, 0.3, -20.0
#: Capitalised words that open sentences and are no entities.
OPENERS = """the a an this that these those under over in on at by for with and but or so as if when while however moreover therefore thus then
here there it its we you they he she i our their his her one some based using given overall importantly specifically finally first second third
additionally furthermore meanwhile instead short brief note yes no sure well now also both each""".split()
#: Forms of number tokens, units and capitalised words.
NUMERIC, UNIT, CAPITALISED = r"^[^\p{L}\p{N}_]*-?\p{Nd}", r"%|pp(?![\p{L}\p{N}_])|bp(?![\p{L}\p{N}_])|\$|€|₼|percent|faiz", r"^[^\p{L}\p{N}_]*[A-ZÀ-Þ][a-zà-þ]{2,}$"
#: Order of an answer's features.
ANSWER = ("n_fact", "mean_entropy", "max_entropy", "high_ent_frac", "mean_margin", "min_margin", "mean_top1", "competing", "corruption", "answer_len")


def probability(logprob: Column) -> Column:
    return F.exp(F.coalesce(logprob, F.lit(MISSING)))


def token_entropy(tops: Column) -> Column:
    """Entropy in nats of the listed alternatives, scaled to sum to one; 0 without any."""
    ps = F.transform(tops, lambda t: probability(t["logprob"]))
    total = F.aggregate(ps, F.lit(0.0), lambda s, p: s + p)
    z = F.when(total > 0, total).otherwise(F.lit(1.0))
    return F.coalesce(F.when(F.size(tops) > 0, -F.aggregate(ps, F.lit(0.0), lambda s, p: s + p / z * F.log(p / z + 1e-12))), F.lit(0.0))


def token_margin(tops: Column, as_listed: bool = False) -> Column:
    """Log-probability of the likeliest alternative less that of the second; 10 with fewer than two.

    ``as_listed`` takes the first two as they come, so the margin can be negative.
    """
    lps = F.transform(tops, lambda t: F.coalesce(t["logprob"], F.lit(MISSING)))
    lps = lps if as_listed else F.sort_array(lps, asc=False)
    return F.when(F.size(tops) >= 2, F.get(lps, F.lit(0)) - F.get(lps, F.lit(1))).otherwise(F.lit(10.0))


def bare(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, "[^A-Za-zÀ-þ]", ""))


def token_kind(token: Column, opens_sentence: Column) -> Column:
    """number, entity, or the empty string."""
    t = F.coalesce(token, F.lit(""))
    named = t.rlike(CAPITALISED) & ~bare(t).isin(*OPENERS) & ~opens_sentence
    return F.when(F.trim(F.regexp_replace(t, r"\s", " ")) == "", "").when(t.rlike(NUMERIC) | t.rlike(UNIT), "number").when(named, "entity").otherwise("")


def rivals(tops: Column, first: int = 5) -> Column:
    """Tokens among the first alternatives that have real mass."""
    return F.transform(F.filter(F.slice(tops, 1, first), lambda t: probability(t["logprob"]) >= 0.03), lambda t: F.coalesce(t["token"], F.lit("")))


def rival_numbers(tokens: Column) -> Column:
    found = F.transform(tokens, lambda a: F.replace(F.regexp_extract(a, NUMBER, 0), F.lit(","), F.lit(".")))
    return F.size(F.array_distinct(F.filter(found, lambda n: n != "")))


def rival_entities(tokens: Column, stop: bool = True) -> Column:
    named = F.filter(tokens, lambda a: a.rlike(CAPITALISED) & (~bare(a).isin(*OPENERS) if stop else F.lit(True)))
    return F.size(F.array_distinct(F.transform(named, bare)))


def token_signals(tokens: DataFrame, as_listed: bool = False) -> DataFrame:
    """Adds entropy, margin, kind, flagged and risk to tokens (answer_id, pos, token, logprob, top_logprobs).

    Flagged is a fact whose alternatives differ as facts while entropy is high or the margin small.
    """
    w = Window.partitionBy("answer_id").orderBy("pos")
    solid = F.trim(F.regexp_replace(F.col("token"), r"\s", " "))
    ends = F.when(solid != "", F.right(solid, F.lit(1)).isin(".", "!", "?", ":") | F.col("token").endswith("\n"))
    opens = F.coalesce(F.last(ends, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    out = tokens.withColumns({"entropy": token_entropy(F.col("top_logprobs")), "margin": token_margin(F.col("top_logprobs"), as_listed), "kind": token_kind(F.col("token"), opens)})
    near = rivals(F.col("top_logprobs"))
    compete = F.when(F.col("kind") == "number", rival_numbers(near) >= 2).when(F.col("kind") == "entity", rival_entities(near) >= 2).otherwise(F.lit(False))
    out = out.withColumn("flagged", compete & ((F.col("entropy") >= ENTROPY_BAR) | (F.col("margin") <= MARGIN_BAR)))
    close = F.when(F.col("margin") < MARGIN_BAR, F.least(MARGIN_BAR / (F.col("margin") + 1e-6) - 1, F.lit(1.0))).otherwise(F.lit(0.0))
    risk = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(F.col("entropy") / (2 * ENTROPY_BAR), F.lit(1.0)), close))
    return out.withColumn("risk", F.when(F.col("flagged"), risk).otherwise(F.lit(0.0)))


def fact_uncertainty(signals: DataFrame) -> DataFrame:
    """By answer: fact_uncertainty (a moving average over facts in order, by blocks of tokens), peak_fact_risk, counts and flag_rate."""
    told = signals.where("kind <> ''")
    facts = told.groupBy("answer_id").agg(F.max("risk").alias("peak"), F.count("*").alias("facts"), F.sum(F.col("flagged").cast("long")).alias("flags"))
    average = moving(block_lists(told.withColumn("__at", F.col("pos") + 1), "answer_id", "__at", "risk"), "answer_id", RATE, start=0.0)
    facts = facts.join(average.select("answer_id", "mean"), "answer_id")
    found = facts.select("answer_id", F.round("mean", 3).alias("fact_uncertainty"), F.round("peak", 3).alias("peak_fact_risk"), F.col("facts").alias("fact_tokens"), F.col("flags").alias("flagged_fact_tokens"), F.round(F.col("flags") / F.col("facts"), 3).alias("flag_rate"))
    every = signals.select("answer_id").distinct().join(found, "answer_id", "left")
    return every.na.fill(0.0, ["fact_uncertainty", "peak_fact_risk", "flag_rate"]).na.fill(0, ["fact_tokens", "flagged_fact_tokens"])


def fact_rows(tokens: DataFrame, fabricated: Column | None = None) -> DataFrame:
    """One row for each fact token with its features; label 1 for a number in an answer that can only be made up."""
    n = F.count("*").over(Window.partitionBy("answer_id"))
    near = rivals(F.col("top_logprobs"), 6)
    size = F.size("top_logprobs")
    most = F.when(size > 1, F.log(size.cast("double"))).otherwise(F.lit(1.0))
    out = tokens.withColumns({"position": F.round(F.col("pos") / n, 3), "kind": token_kind(F.col("token"), F.lit(False)), "entropy": token_entropy(F.col("top_logprobs")), "margin": token_margin(F.col("top_logprobs"))}).where("kind <> ''")
    label = F.lit(0) if fabricated is None else (fabricated & (F.col("kind") == "number")).cast("int")
    best = F.array_max(F.transform("top_logprobs", lambda t: probability(t["logprob"])))
    return out.select(
        "answer_id", "pos", "token", "position", "kind", F.round("entropy", 4).alias("entropy"), F.round(F.col("entropy") / most, 4).alias("norm_entropy"), F.round("margin", 4).alias("margin"),
        F.round(F.coalesce(best, F.lit(0.0)), 4).alias("top1_prob"), F.round(probability(F.col("logprob")), 4).alias("chosen_prob"), rival_numbers(near).cast("long").alias("competing_numbers"),
        rival_entities(near, stop=False).cast("long").alias("competing_entities"), F.slice(near, 1, 5).alias("top_alts"), label.alias("label"),
    )


def answer_vectors(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """answer_id and the ten features of ANSWER. answers: answer_id, corruption, answer_len; those without facts have defaults."""
    margin = F.least(F.col("margin"), F.lit(5.0)) / 5
    rival = F.least(F.col("competing_numbers") + F.col("competing_entities"), F.lit(4)) / 4
    found = facts.groupBy("answer_id").agg(
        (F.least(F.count("*"), F.lit(30)) / 30).alias("n_fact"), F.avg("norm_entropy").alias("mean_entropy"), F.max("norm_entropy").alias("max_entropy"), F.avg((F.col("norm_entropy") > 0.15).cast("double")).alias("high_ent_frac"),
        F.avg(margin).alias("mean_margin"), F.min(margin).alias("min_margin"), F.avg("top1_prob").alias("mean_top1"), F.avg(rival).alias("competing"),
    )
    none = dict(zip(ANSWER[:8], (0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0), strict=True))
    joined = answers.select("answer_id", "corruption", F.col("answer_len").alias("len")).join(found, "answer_id", "left")
    return joined.select("answer_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()], F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("corruption"))).alias("corruption"), (F.least(F.col("len"), F.lit(800)) / 800).alias("answer_len"))


def near(a: Column, b: Column, tol: float = 0.05) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tol), 0.02 * F.abs(b))


def context_grounding(answer: Column, context: Column, tol: float = 0.05) -> Column:
    """struct(grounding, claims, grounded, ungrounded): numbers of the answer that the context has, within rounding."""
    claims, source = numbers_in(answer), numbers_in(context)
    missing = F.filter(claims, lambda v: ~F.exists(source, lambda s: near(v, s, tol)))
    n, bad = F.size(claims), F.size(missing)
    return F.struct(F.when(n > 0, F.round((n - bad) / n, 3)).otherwise(F.lit(1.0)).alias("grounding"), n.cast("long").alias("claims"), (n - bad).cast("long").alias("grounded"), F.slice(F.array_sort(missing), 1, 12).alias("ungrounded"))


def _scaled(v: Column) -> Column:
    """A place on a line where numbers that agree within 0.05 or 2 % are less than one apart."""
    a = F.abs(v)
    place = F.when(a <= 2.5, a / 0.05).otherwise(50 + F.log(a / 2.5) / 0.0203)
    return F.when(v < 0, -place).otherwise(place)


def grounded_turns(turns: DataFrame, key: str, order: str, text: str = "text", claims: Column | None = None) -> DataFrame:
    """key, order, claims, grounded, grounding: distinct numbers of each turn, those that an earlier turn of the key has,
    within rounding, and their share (1 without numbers). ``claims``: which turns are asked about.

    Numbers are joined on key and place, each with its first turn; no turn gathers the texts before it, so a long
    conversation is many rows of many keys. Null texts have no numbers.
    """
    asked = F.lit(True) if claims is None else claims
    told = turns.select(key, order, asked.alias("__asked"), F.explode(numbers_in(F.col(text))).alias("v"))
    first = told.groupBy(key, "v").agg(F.min(order).alias("__first"))
    place = F.floor(_scaled(F.col("v")))
    known = first.select(F.col(key).alias("__key"), F.col("v").alias("__v"), "__first", F.explode(F.array(place - 1, place, place + 1)).alias("__place"))
    asking = told.where("__asked").select(key, order, "v", place.alias("__at"))
    met = asking.join(known, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__at") == F.col("__place")) & (F.col("__first") < F.col(order)) & near(F.col("v"), F.col("__v"), 0.05))
    hits = met.select(key, order, "v").distinct().withColumn("__hit", F.lit(1))
    counted = asking.select(key, order, "v").withColumn("__hit", F.lit(0)).unionByName(hits).groupBy(key, order).agg(F.count(F.when(F.col("__hit") == 0, 1)).alias("claims"), F.sum("__hit").alias("grounded"))
    every = turns.where(asked).select(F.col(key).alias("__key"), F.col(order).alias("__order"))
    found = every.join(counted, F.col(key).eqNullSafe(F.col("__key")) & F.col(order).eqNullSafe(F.col("__order")), "left")
    n, own = F.coalesce("claims", F.lit(0)), F.coalesce("grounded", F.lit(0))
    return found.select(F.col("__key").alias(key), F.col("__order").alias(order), n.alias("claims"), own.alias("grounded"), F.when(n > 0, F.round(own / n, 3)).otherwise(F.lit(1.0)).alias("grounding"))


def meaning_key(answer: Column) -> Column:
    """Distinct numbers and words of four letters or more."""
    text = F.coalesce(answer, F.lit(""))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(".")))
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-zà-þ0-9]+"), F.lit(0)), lambda w: F.length(w) > 3)
    return F.array_distinct(F.concat(numbers, words))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def answer_clusters(samples: DataFrame, similar: float = 0.5) -> DataFrame:
    """By question: semantic_entropy, normalized, n_clusters, n_samples, agreement of samples (question_id, n, answer).

    Samples join, in order, the first cluster whose first member is similar enough.
    """
    listed = samples.withColumn("key", meaning_key(F.col("answer"))).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("s"))
    kind = "array<struct<key:array<string>,size:int>>"
    new = lambda k: F.array(F.struct(k.alias("key"), F.lit(1).alias("size")))
    def place(clusters: Column, x: Column) -> Column:
        at = F.array_position(F.transform(clusters, lambda c: jaccard(x["key"], c["key"]) >= similar), True)
        grown = F.transform(clusters, lambda c, i: F.struct(c["key"].alias("key"), (c["size"] + (i + 1 == at).cast("int")).alias("size")))
        return F.when(at > 0, grown).otherwise(F.concat(clusters, new(x["key"])))
    sizes = F.transform(F.aggregate("s", F.array().cast(kind), place), lambda c: c["size"])
    out = listed.select("question_id", sizes.alias("c"), F.size("s").alias("n"))
    h = -F.aggregate("c", F.lit(0.0), lambda s, c: s + c / F.col("n") * F.log(c / F.col("n") + 1e-12))
    most = F.when(F.col("n") > 1, F.log(F.col("n").cast("double"))).otherwise(F.lit(1.0))
    return out.select("question_id", F.round(h, 3).alias("semantic_entropy"), F.round(h / most, 3).alias("normalized"), F.size("c").cast("long").alias("n_clusters"), F.col("n").cast("long").alias("n_samples"), F.round(F.array_max("c") / F.col("n"), 3).alias("agreement"))


def claim_verdict(claim: Column, independent: Column) -> Column:
    """unsupported if the second answer is unsure; with numbers on both sides supported or contradicted; else by shared words."""
    other = F.trim(F.coalesce(independent, F.lit("")))
    mine, theirs = numbers_in(claim), numbers_in(other)
    agree = F.exists(mine, lambda a: F.exists(theirs, lambda b: near(a, b)))
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-zà-þ]{4,}"), F.lit(0)))
    shared = F.size(F.array_intersect(words(claim), words(other))) / F.size(words(claim))
    return F.when(F.upper(other).startswith("UNSURE"), "unsupported").when((F.size(mine) > 0) & (F.size(theirs) > 0), F.when(agree, "supported").otherwise("contradicted")).when((F.size(words(claim)) > 0) & (shared >= 0.34), "supported").otherwise("weak")


def abstention_risk(corruption: Column, fact: Column, semantic: Column, verify_fail: Column) -> Column:
    """Weighted mean of the signals there are; semantic and verify_fail may be null."""
    parts = [(0.40, F.coalesce(corruption, F.lit(0.0))), (0.35, F.coalesce(fact, F.lit(0.0))), (0.15, semantic), (0.10, verify_fail)]
    total = sum((F.coalesce(w * c, F.lit(0.0)) for w, c in parts), F.lit(0.0))
    return total / sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, c in parts), F.lit(0.0))


def assess(verdicts: DataFrame, facts: DataFrame, tau: float = 0.5, band: float = 0.15) -> DataFrame:
    """answer_id, state, corruption, fact_uncertainty, risk and decision: the guard's verdict of an answer's text joined
    with the uncertainty of its facts. verdicts: answer_id, state, p; facts: as ``fact_uncertainty`` gives them."""
    both = verdicts.select("answer_id", "state", F.col("p").alias("corruption")).join(facts.select("answer_id", "fact_uncertainty"), "answer_id", "left")
    none = F.lit(None).cast("double")
    risk = abstention_risk(F.col("corruption"), F.col("fact_uncertainty"), none, none)
    return both.withColumn("risk", risk).withColumn("decision", F.when(F.col("state") == "corrupt", "abstain").otherwise(abstention_decision(F.col("risk"), tau, band)))


def abstention_decision(risk: Column, tau: float = 0.5, band: float = 0.15) -> Column:
    return F.when(risk >= tau, "abstain").when(risk >= tau - band, "hedge").otherwise("confident")


def abstention_threshold(clean: DataFrame, column: str = "risk", alpha: float = 0.05, start: float = 0.5) -> float:
    """The risk that at most a share ``alpha`` of clean claims passes."""
    from weirstream.operators.fusion import conformal_rank, order_statistic

    n = clean.where(F.col(column).isNotNull()).count()
    return order_statistic(clean, column, conformal_rank(n, alpha)) if n else start


def verifier_votes(votes: DataFrame) -> DataFrame:
    """By claim: counts of YES, NO and UNSURE replies and the decision; fewer than two votes are inconclusive."""
    vote = F.upper(F.regexp_extract("reply", r"(?i)\b(YES|NO|UNSURE)\b", 1))
    count = lambda v: F.sum((vote == v).cast("long")).alias(v.lower())
    c = votes.groupBy("claim_id").agg(count("YES"), count("NO"), count("UNSURE")).withColumn("n", F.col("yes") + F.col("no") + F.col("unsure"))
    no, yes = F.col("no") / F.col("n"), F.col("yes") / F.col("n")
    return c.withColumn("decision", F.when(F.col("n") < 2, "hedge").when(no >= 0.6, "abstain").when((yes >= 0.6) & (no <= 0.4), "confident").otherwise("hedge")).withColumn("inconclusive", F.col("n") < 2)


def question_bank(templates: DataFrame, entities: DataFrame, years: DataFrame) -> DataFrame:
    """Every template (template_id, lang, pattern with {entity} and {year}) for every entity and year: three small parameter tables."""
    text = F.replace(F.replace(F.col("pattern"), F.lit("{entity}"), F.col("entity")), F.lit("{year}"), F.col("year").cast("string"))
    return templates.join(entities, "lang").join(F.broadcast(years)).select("template_id", "lang", "entity", "year", text.alias("question"))
