"""Evidence from search results and page hits, as tables: is a subject on record, and do dates agree?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of questions that say nothing about their subject.
STOPWORDS = """what when where who whom why how which is are was were be been being the a an of in on at to for and or by with from as if then than
that this these those it its do does did not no yes give state answer only one single specific number date name year percentage exact please tell me about""".split()
#: Those and four more, left out of search queries.
QUESTION_WORDS = sorted({*STOPWORDS, "am", "refuse", "hedge", "approximate"})
MONTHS = "january february march april may june july august september october november december".split()
#: Characters of the runs under which core words (six characters or more) are listed.
GRAM = 4
#: Characters around a month in which its year is looked for.
REACH = 15


def evidence_line(title: Column, snippet: Column) -> Column:
    """Title and snippet, joined if both are there; null if neither."""
    line = F.concat_ws(" — ", F.nullif(title, F.lit("")), F.nullif(snippet, F.lit("")))
    return F.nullif(line, F.lit(""))


def core_tokens(query: Column) -> Column:
    """Words of six characters or more that aren't stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r"[a-z][a-z0-9'\-]{5,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*STOPWORDS))


def echoed(query: Column, evidence: Column) -> Column:
    """Whether all core words of a query are in the evidence; true if it has none."""
    return F.forall(core_tokens(query), lambda w: F.contains(F.lower(F.coalesce(evidence, F.lit(""))), w))


def postings(words: DataFrame) -> DataFrame:
    """gram, word: of each distinct word the run of GRAM characters that the fewest words share."""
    grams = words.select("word", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(rf"(?=(.{{{GRAM}}}))"), F.lit(1)))).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("n"))
    return grams.join(shared, "gram").groupBy("word").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))


def echo_counts(queries: DataFrame, texts: DataFrame, most: int = 1_000_000) -> DataFrame:
    """For each query (item_id, query): how many texts there are, and how many echo it.

    An inverted index of the queries' core words: each word is listed under one of its character runs, a text meets the
    words under its own runs, and ``contains`` decides. Of a text only the words found go on; a query is looked up by its
    longest word and counts if all its words are among them. One pass over the texts for all queries. The index is
    broadcast up to ``most`` words; beyond, runs are shuffled by themselves and texts fetched for the words they meet.
    A query without core words is echoed by every text; null texts don't count.
    """
    asked = queries.select("item_id", F.array_distinct(core_tokens(F.col("query"))).alias("words"))
    keyed = asked.where(F.size("words") > 0).withColumn("key", F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    index = postings(asked.select(F.explode("words").alias("word")).distinct())
    small = index.limit(most + 1).count() <= most
    low = texts.where("text is not null").select(F.monotonically_increasing_id().alias("tid"), F.lower("text").alias("text"))
    runs = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"(?=([a-z0-9'\-]{{{GRAM}}}))"), F.lit(1)))).alias("gram")
    if small:
        met = low.select("tid", "text", runs).join(F.broadcast(index), "gram")
    else:
        met = low.select("tid", runs).join(index, "gram").join(low, "tid")
    found = met.where(F.contains("text", F.col("word"))).groupBy("tid").agg(F.collect_set("word").alias("found"))
    named = found.select("found", F.explode("found").alias("key"))
    told = named.join(F.broadcast(keyed) if small else keyed, "key").where(F.size(F.array_except("words", "found")) == 0).groupBy("item_id").agg(F.count("*").alias("echoed"))
    total = low.agg(F.count("*").alias("documents"))
    counted = asked.select("item_id", (F.size("words") == 0).alias("open")).join(told, "item_id", "left")
    counted = counted.withColumn("documents", total.scalar())
    return counted.select("item_id", "documents", F.when(F.col("open"), F.col("documents")).otherwise(F.coalesce("echoed", F.lit(0))).alias("echoed"))


def ground(queries: DataFrame, results: DataFrame, hits: DataFrame, most: int | None = None) -> DataFrame:
    """attested, thin or no_record for each query, with the reason and the source.

    queries: query; results: query, rank, title, snippet (best first); hits: query, hits, title of page hits.
    All results count, and a core word may be in any of them; ``evidence`` lists them all, or with ``most`` the best so many.
    """
    asked = queries.select("query").distinct()
    counted = results.groupBy("query").agg(F.count("*").alias("n"))
    best = results.withColumn("__r", F.row_number().over(Window.partitionBy("query").orderBy("rank", "title", "snippet")))
    if most is not None:
        best = best.where(F.col("__r") <= most)
    listed = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("__r", evidence_line(F.col("title"), F.col("snippet")).alias("line")))).alias("e"))
    pages = hits.groupBy("query").agg(F.max("hits").alias("wiki_hits"), F.max_by("title", "hits").alias("wiki_title"))
    # each core word against each result and the page's title: rows of words, never one text of all results
    words = asked.select("query", F.explode(F.array_distinct(core_tokens(F.col("query")))).alias("word"))
    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    told = results.select("query", text.alias("text")).join(words, "query").groupBy("query", "word").agg(F.max(F.contains("text", F.col("word"))).alias("told"))
    named = words.join(told, ["query", "word"], "left").join(pages.select("query", F.lower("wiki_title").alias("title")), "query", "left")
    named = named.groupBy("query").agg(F.min(F.coalesce("told", F.lit(False)) | F.coalesce(F.contains("title", F.col("word")), F.lit(False))).alias("echo"))
    out = asked.join(counted, "query", "left").join(listed, "query", "left").join(pages, "query", "left").join(named, "query", "left")
    out = out.withColumns({"n": F.coalesce("n", F.lit(0)), "wiki_hits": F.coalesce("wiki_hits", F.lit(0)), "wiki_title": F.coalesce("wiki_title", F.lit(""))})
    echo = F.coalesce("echo", F.lit(True))
    none = (F.col("n") == 0) & (F.col("wiki_hits") == 0)
    strong = ((F.col("n") >= 2) | (F.col("wiki_hits") >= 5)) & echo
    verdict = F.when(none, "no_record").when(strong, "attested").otherwise("thin")
    reason = F.when(none, "no record").when(strong, "attested by results").when((F.col("n") > 0) & ~echo, "results do not name the subject").otherwise("single weak signal")
    source = F.when((F.col("n") > 0) & (F.col("wiki_hits") > 0), "web+wiki").when(F.col("n") > 0, "web").when(F.col("wiki_hits") > 0, "wiki").otherwise("none")
    lines = F.coalesce(F.array_compact(F.transform("e", lambda s: s["line"])), F.array().cast("array<string>"))
    return out.select("query", verdict.alias("verdict"), reason.alias("reason"), F.col("n").alias("hits"), "wiki_hits", "wiki_title", source.alias("source"), lines.alias("evidence"))


def subject_query(question: Column, answer: Column) -> Column:
    """The first six telling words of a question; if too short, the first capitalised name of the answer."""
    words = F.filter(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"[A-Za-z0-9'\-]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*QUESTION_WORDS))
    q = F.array_join(F.slice(words, 1, 6), " ")
    name = F.regexp_extract(F.coalesce(answer, F.lit("")), r"[A-Z][A-Za-z0-9\-]+(?:\s+[A-Z][A-Za-z0-9\-]+){0,3}", 0)
    return F.when((F.length(q) < 3) & (F.length(F.coalesce(answer, F.lit(""))) > 0), name).otherwise(q)


def month_years(text: Column) -> Column:
    """Distinct structs (month, year) of the months named in a text; year is ``?`` if none is near."""
    t = F.coalesce(text, F.lit(""))
    named = r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(MONTHS) + r")(?![\p{L}\p{N}_])"
    # pieces between the months; what is near a month lies in the few pieces next to it, as a month has three letters or more
    months = F.regexp_extract_all(t, F.lit(named), F.lit(0))
    pieces = F.transform(F.split(t, named), lambda p: F.concat(F.left(p, F.lit(REACH)), F.when(F.length(p) > 2 * REACH, F.lit("\n")).otherwise(F.lit("")), F.right(p, F.least(F.lit(REACH), F.greatest(F.lit(0), F.length(p) - REACH)))))
    near = REACH // 3 + 1
    part = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
    def one(s: Column, m: Column, i: Column) -> Column:
        left = F.concat(*[x for k in range(near, 0, -1) for x in (part(s["p"], i - k), part(s["m"], i - k))], part(s["p"], i))
        rest = F.concat(*[x for k in range(1, near + 1) for x in (part(s["p"], i + k), part(s["m"], i + k))])
        around = F.concat(F.right(left, F.lit(REACH)), m, F.left(rest, F.lit(REACH)))
        year = F.regexp_extract(around, r"(?<![\p{L}\p{N}_])(?:19|20)[0-9][0-9](?![\p{L}\p{N}_])", 0)
        return F.struct(F.lower(m).alias("month"), F.when(year == "", "?").otherwise(year).alias("year"))
    # the arrays are bound to a name, or every month would cut the text anew
    once = F.array(F.struct(months.alias("m"), pieces.alias("p")))
    return F.array_distinct(F.flatten(F.transform(once, lambda s: F.transform(s["m"], lambda m, i: one(s, m, i)))))


def dates_agree(claimed: Column, evident: Column) -> Column:
    """Whether any claimed date has an evident one of its month, and of its year where both are known."""
    return F.exists(claimed, lambda a: F.exists(evident, lambda e: (a["month"] == e["month"]) & ((a["year"] == "?") | (e["year"] == "?") | (a["year"] == e["year"]))))


def date_check(answers: DataFrame) -> DataFrame:
    """Adds decision and reason to answers (answer, evidence: array of snippets, wiki_hits): first the record, then dates."""
    out = answers.withColumns({"claim_dates": month_years(F.col("answer")), "evidence_dates": month_years(F.array_join("evidence", " "))})
    none = (F.size("evidence") == 0) & (F.col("wiki_hits") == 0)
    dated = (F.size("claim_dates") > 0) & (F.size("evidence_dates") > 0)
    agree = dates_agree(F.col("claim_dates"), F.col("evidence_dates"))
    there = (F.size("evidence") >= 2) | (F.col("wiki_hits") >= 5)
    decision = F.when(none, "abstain").when(dated, F.when(agree, "confident").otherwise("abstain")).when(there, "confident").otherwise("hedge")
    reason = F.when(none, "no record").when(dated, F.when(agree, "date matches the evidence").otherwise("date contradicts the evidence")).when(there, "attested").otherwise("thin evidence")
    return out.withColumns({"decision": decision, "reason": reason})


def snippets_of(html: Column, marker: str = "result__snippet", most: int = 6) -> Column:
    """Text of the first marked links of a results page."""
    found = F.regexp_extract_all(html, F.lit(rf"(?s){marker}[^>]*>(.*?)</a>"), F.lit(1))
    def plain(snippet: Column) -> Column:
        out = F.trim(F.regexp_replace(snippet, "<[^>]+>", ""))
        for entity, c in (("&quot;", '"'), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            out = F.replace(out, F.lit(entity), F.lit(c))
        return out
    return F.transform(F.slice(found, 1, most), plain)
