"""URL filter by character language models, with DataFrame expressions only.

Hand-written rules decide the URLs they fit. They also label the training data: one variable-order Markov
model is counted on accepted URLs and one on rejected URLs, interpolated from the longest context down to
the uniform distribution (Witten-Bell weights; contexts seen too rarely are skipped). Every other URL is
judged by the length-normalised difference of its log-likelihoods against a threshold that is calibrated
on a fold of labelled URLs which neither model has seen.

Rules read host and path; the models read whole URLs, scheme, query and fragment included. A distinct URL is counted
and scored once, whatever number of rows carry it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstream.llm.common import persisted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, host, path prefix)
DEFAULT_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Characters of context, least count of a context that is used, size of the alphabet for the uniform floor.
ORDER, MIN_CONTEXT, ALPHABET = 4, 2, 256
#: Log ratios are whole millionths, so sums are exact in any order; scores are compared in whole fiftieths.
SCALE, BIN = 1_000_000, 20_000
#: Share of accepted URLs of the calibration fold that may fall below the threshold; one URL in so many is in the fold.
FALSE_REJECTS, FOLDS = 0.01, 5
#: Grams whose ratios are broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 400_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (ASCII) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ordered(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(action, rule), else null."""
    out = F  # the first .when is that of the functions module
    for action, rule_host, rule_path in ordered(rules):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = out.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule_host + rule_path).alias("rule")))
    return out.otherwise(F.lit(None)) if rules else F.lit(None).cast("struct<action:string,rule:string>")


def grams(urls: DataFrame, order: int) -> DataFrame:
    """One row for each character (and the end) of each URL, with its context; URLs start in a context of their own."""
    padded = F.concat(F.lit("\x02" * order), "url", F.lit("\x03"))
    return urls.withColumn("__p", padded).withColumn("__i", F.explode(F.sequence(F.lit(1), F.length("__p") - order))).withColumn("gram", F.substring(F.col("__p"), F.col("__i"), F.lit(order + 1))).drop("__p", "__i")


def log_ratios(counted: DataFrame, order: int, min_context: int) -> DataFrame:
    """gram, ratio: log accepted minus log rejected probability of the last character, in whole 1/SCALE."""
    levels = {order: counted}
    for k in range(order - 1, -1, -1):
        levels[k] = levels[k + 1].groupBy(F.substring("gram", 2, k + 1).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    known: DataFrame | None = None
    for k in range(order + 1):
        context = F.substring("gram", 1, k)
        seen = [F.sum("a").alias("na"), F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum("b").alias("nb"), F.sum((F.col("b") > 0).cast("long")).alias("tb")]
        here = levels[k].withColumn("c", context)
        here = here.join(here.groupBy("c").agg(*seen), "c")
        if known is None:
            here = here.withColumns({"pa0": F.lit(1.0 / ALPHABET), "pb0": F.lit(1.0 / ALPHABET)})
        else:
            here = here.withColumn("shorter", F.substring("gram", 2, k)).join(known.select(F.col("gram").alias("shorter"), F.col("pa").alias("pa0"), F.col("pb").alias("pb0")), "shorter")
        def mixed(x: str) -> Column:
            n, t, low = F.col(f"n{x}"), F.col(f"t{x}"), F.col(f"p{x}0")
            return F.when(n >= (min_context if k else 1), (F.col(x) + t * low) / (n + t)).otherwise(low)
        known = here.select("gram", "a", "b", mixed("a").alias("pa"), mixed("b").alias("pb"))
    return known.select("gram", F.round((F.log("pa") - F.log("pb")) * SCALE).cast("long").alias("ratio"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, url: str = "url", keep: list[str] | None = None, order: int = ORDER, min_context: int = MIN_CONTEXT, false_rejects: float = FALSE_REJECTS) -> DataFrame:
    """Verdict for every row.

    Returns the ``keep`` columns (default ``page_id``) with host, path, rule (null if none fits), verdict
    (allow or block), score (mean log ratio of a character, positive for accepted-like), threshold and
    judged_by (rule or model). Without accepted URLs in the calibration fold nothing is rejected by the
    models; if a class has no training URLs its model is uniform. A null url or one without ``://`` has
    empty host and path, no rule, and is judged by the models like any other. Repeated rows repeat; an
    empty table gives an empty result; other columns are not read, and kept ones must not be named like results.
    """
    keep = keep or ["page_id"]
    if clash := set(keep) & {"host", "path", "rule", "verdict", "score", "threshold", "judged_by"}:
        raise ValueError(f"kept columns clash with results: {sorted(clash)}")
    rows, scored, edge = scored_urls(pages, DEFAULT_RULES if rules is None else rules, url, keep, order, min_context, false_rejects)
    judged = scored.withColumn("edge", edge).select("url", "host", "path", "rule", F.coalesce("action", verdict(F.col("bin"), F.col("edge"))).alias("verdict"), (F.col("mean") / SCALE).alias("score"), (F.col("edge") * BIN / SCALE).alias("threshold"), F.when(F.col("action").isNotNull(), "rule").otherwise("model").alias("judged_by"))
    return rows.join(judged.withColumnRenamed("url", "__url"), "__url").select(*keep, "host", "path", "rule", "verdict", "score", "threshold", "judged_by")


def verdict(score: Column, threshold: Column) -> Column:
    return F.when(score < threshold, "block").otherwise("allow")


def scored_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str, keep: list[str], order: int, min_context: int, false_rejects: float) -> tuple[DataFrame, DataFrame, Column]:
    """The rows with __url, the distinct URLs with rule, fold and score, and the threshold as a scalar."""
    rows = pages.select(*keep, F.coalesce(F.col(url), F.lit("")).alias("__url"))
    host, path = host_and_path(F.col("url"))
    urls = rows.select(F.col("__url").alias("url")).distinct().withColumns({"host": host, "path": path}).withColumn("__r", fitting_rule(F.col("host"), F.col("path"), rules))
    urls = persisted(urls.select("url", "host", "path", F.col("__r.action").alias("action"), F.col("__r.rule").alias("rule"), (F.conv(F.substring(F.md5("url"), 1, 4), 16, 10).cast("int") % FOLDS == 0).alias("fold")), "urls")
    each = grams(urls.select("url", "action", "fold"), order)
    trained = lambda action: F.sum(F.when(~F.col("fold") & (F.col("action") == action), 1).otherwise(0)).alias(action[0])
    counted = persisted(each.groupBy("gram").agg(trained("allow"), trained("block")), "url-grams")
    ratios = persisted(log_ratios(counted, order, min_context), "url-ratios")
    if ratios.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        ratios = F.broadcast(ratios)  # else a shuffle, in which grams of nearly all URLs are split where they are too many
    total = each.select("url", "gram").join(ratios, "gram").groupBy("url").agg(F.sum("ratio").alias("total"))
    scored = persisted(urls.join(total, "url").withColumn("mean", F.col("total") / (F.length("url") + 1)).withColumn("bin", F.floor(F.col("mean") / BIN)), "urls-scored")
    # the highest bin edge with few enough accepted URLs below it; bins are few, whatever the input's size
    bins = scored.where("fold and action = 'allow'").groupBy("bin").agg(F.count("*").alias("n"))
    below = bins.withColumn("below", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows, scored, below.where(F.col("below") <= bins.agg(F.sum("n") * false_rejects).scalar()).agg(F.max("bin")).scalar()


def error_rates(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, url: str = "url", order: int = ORDER, min_context: int = MIN_CONTEXT, false_rejects: float = FALSE_REJECTS) -> DataFrame:
    """What the models alone say of URLs that rules decide: action, fold (true: not learned from), urls, blocked (share)."""
    _, scored, edge = scored_urls(pages, DEFAULT_RULES if rules is None else rules, url, [], order, min_context, false_rejects)
    blocked = (verdict(F.col("bin"), F.col("edge")) == "block").cast("double")
    return scored.where("action is not null").withColumn("edge", edge).groupBy("action", "fold").agg(F.count("*").alias("urls"), F.avg(blocked).alias("blocked"))


def filter_sql(rules: list[tuple[str, str, str]] | None = None, order: int = ORDER, min_context: int = MIN_CONTEXT, false_rejects: float = FALSE_REJECTS) -> str:
    """The same over ``pages`` in DuckDB's SQL."""
    rules = ordered(DEFAULT_RULES if rules is None else rules)
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    action = "case " + " ".join(f"when {fits(h, p)} then '{a}'" for a, h, p in rules) + " end"
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in rules) + " end"
    parts = [f"""r as (select page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') as path
  from (select page_id, coalesce(url, '') as url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages))""",
        f"u as materialized (select url, host, path, {action} as action, {rule} as rule from (select distinct url, host, path from r))"]
    parts.append(f"f as materialized (select *, ('0x' || substr(md5(url), 1, 4))::int % {FOLDS} = 0 as fold from u)")
    parts.append(f"e as materialized (select url, action, fold, substr(p, i, {order + 1}) as gram from (select *, unnest(range(1, length(p) - {order} + 1)) as i from (select *, repeat(chr(2), {order}) || url || chr(3) as p from f)))")
    parts.append(f"l{order} as materialized (select gram, sum((not fold and action is not distinct from 'allow')::int)::bigint as a, sum((not fold and action is not distinct from 'block')::int)::bigint as b from e group by gram)")
    parts += [f"l{k} as materialized (select substr(gram, 2, {k + 1}) as gram, sum(a)::bigint as a, sum(b)::bigint as b from l{k + 1} group by 1)" for k in range(order - 1, -1, -1)]
    for k in range(order + 1):
        low = ("1.0::double / %d" % ALPHABET,) * 2 if not k else ("q.pa", "q.pb")
        mixed = [f"case when n{x} >= {min_context if k else 1} then ({x} + t{x} * {low[j]}) / (n{x} + t{x}) else {low[j]} end as p{x}" for j, x in enumerate("ab")]
        shorter = f"join p{k - 1} q on q.gram = substr(h.gram, 2, {k})" if k else ""
        parts.append(f"p{k} as materialized (select h.gram, {', '.join(mixed)} from l{k} h join (select substr(gram, 1, {k}) as c, sum(a)::bigint as na, sum((a > 0)::int)::bigint as ta, sum(b)::bigint as nb, sum((b > 0)::int)::bigint as tb from l{k} group by 1) on c = substr(h.gram, 1, {k}) {shorter})")
    parts.append(f"s as materialized (select *, mean, floor(mean / {BIN}) as bin from (select f.*, total::double / (length(f.url) + 1) as mean from f join (select url, sum(round((ln(pa) - ln(pb)) * {SCALE})::bigint)::bigint as total from e join p{order} using (gram) group by all) using (url)))".replace("select *, mean,", "select *,"))
    parts.append("n as (select bin, count(*) as n from s where fold and action = 'allow' group by bin)")
    parts.append(f"edge as (select max(bin) as edge from (select bin, coalesce(sum(n) over (order by bin rows between unbounded preceding and 1 preceding), 0) as below from n) where below <= (select sum(n) * {false_rejects} from n))")
    return "with " + ",\n".join(parts) + f"""
select page_id, r.host, r.path, rule, coalesce(action, case when bin < edge then 'block' else 'allow' end) as verdict, mean / {SCALE} as score, edge * {BIN} / {SCALE} as threshold,
  case when action is not null then 'rule' else 'model' end as judged_by
from r join s using (url) cross join edge"""
