"""Corruptions with known onset: a clean text up to a position that a hash draws, then a payload of one class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstream.operators.detectors import DRIFT, REGURGITATION, REPETITION, STRUCTURAL

CLASSES = (REPETITION, DRIFT, REGURGITATION, STRUCTURAL)
LEAST_TAIL, LEAST_CLEAN = 400, 700
#: Payloads, our own.
HAN = "昨天下午我们在河边看到三只白色的鸟飞过桥面然后慢慢消失在远处的山后孩子们一直站在那里等到天黑才回家"
ARAB = "كان الطريق طويلا وكانت السماء صافية فجلسنا قرب النهر نحكي عن المدن البعيدة حتى غابت الشمس خلف الجبال "
README = "## Setup\n1. Fetch the sources\n```\npip install example-tool\n```\n2. Put settings into .env and run main.py\n```\nnpm install\n```\nSee https://example.org/docs for more.\n"
NEWS = "2031年4月 report: https://example.org/news a new bridge opened today, and the mayor said that traffic will be lighter from now on. "
LABELS = ["Sales", "Cost", "Margin (lag)", "Index", "Residual", "Actual"]
SOUP = ["#### ", "``` ", "===== ", "________ ", "$## = 2 2 ", "{ # ,) $## 8 } ", "──────────────────── "]
SEPARATORS = ["\n", " ", " — ", "\n• "]


def draw(key: Column, salt: str, parts: int) -> Column:
    """A number from 0 to parts - 1 from the md5 of a key and a salt."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{salt}"))), 1, 7), 16, 10).cast("int") % parts


def pick(options: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), n + 1)


def filled(unit: Column, size: Column) -> Column:
    """A unit repeated up to a number of characters."""
    times = (F.floor(size / F.greatest(F.length(unit), F.lit(1))) + 1).cast("int")
    return F.substring(F.repeat(unit, times), F.lit(1), size)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f reads it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def corruptions(streams: DataFrame, replicates: int = 1, low: float = 0.0, high: float = 0.7, texts: bool = True, only: DataFrame | None = None, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """stream_id (source, class and replicate), source_id, text, label, onset_char, corruption_class.

    Texts under LEAST_CLEAN characters are left out. The payload replaces the rest of the text, but has at
    least LEAST_TAIL characters. Draws depend on id, class and replicate alone. Without ``texts`` only what is known of each, and
    its length n_chars. only: a row for each stream_id (of the result) that is asked for, and columns to add; it is broadcast,
    and the texts of other streams are not made.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(r).alias("r")) for c in classes for r in range(replicates)]))
    base = streams.where(F.length("text") >= LEAST_CLEAN).select("stream_id", "text", kinds.alias("k"))
    key = F.concat_ws("/", F.col("stream_id").cast("string"), "k.c", F.col("k.r").cast("string"))
    base = base.select(key.alias("key"), "stream_id", "text", F.col("k.c").alias("cls"), F.length("text").alias("n"))
    more = [c for c in only.columns if c != "stream_id"] if only is not None else []
    if only is not None:
        base = base.join(F.broadcast(only.withColumnRenamed("stream_id", "key")), "key")
    share = low + (high - low) * draw(F.col("key"), "onset", 10_000) / 10_000
    base = base.withColumn("onset", F.floor(F.col("n") * share).cast("int"))
    base = base.withColumn("size", F.greatest(F.lit(LEAST_TAIL), F.col("n") - F.col("onset")))
    head = F.substring(F.col("text"), F.lit(1), F.greatest(F.col("onset"), F.lit(200)))
    words = F.filter(F.split(head, "[ \t\n\r]+"), lambda w: F.length(w) > 3)
    start = lambda w: draw(F.col("key"), "words", 1_000) % F.greatest(F.size(w) - 3, F.lit(1))
    phrase = once(words, lambda w: F.when(F.size(w) >= 4, F.array_join(F.slice(w, start(w) + 1, 4), " ")).otherwise("over and over again"))
    loop = F.concat(phrase, pick(SEPARATORS, draw(F.col("key"), "separator", len(SEPARATORS))))
    alien = F.when(draw(F.col("key"), "script", 10) < 6, F.lit(HAN * 3)).otherwise(F.lit(ARAB * 3))
    other = F.when(draw(F.col("key"), "page", 10) < 6, F.lit(README)).otherwise(F.lit(NEWS))
    cell = lambda i: F.when(draw(F.concat(F.col("key"), i.cast("string")), "cell", 10) < 4, F.format_string("%.2f", draw(F.concat(F.col("key"), i.cast("string")), "value", 600) / 100 - 3)).otherwise("0.00")
    row = lambda i: F.concat(pick(LABELS, (i - 1) % len(LABELS)), F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(15)), lambda j: cell(i * 100 + j)), " "), F.lit(" "))
    echo = F.concat(F.lit("#REF! "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), row), ""))
    soup = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: pick(SOUP, draw(F.concat(F.col("key"), i.cast("string")), "soup", len(SOUP)))), "")
    broken = F.when(draw(F.col("key"), "kind", 2) == 0, echo).otherwise(soup)
    unit = F.when(F.col("cls") == REPETITION, loop).when(F.col("cls") == DRIFT, alien).when(F.col("cls") == REGURGITATION, other).otherwise(broken)
    text = F.concat(F.substring(F.col("text"), F.lit(1), F.col("onset")), once(unit, lambda u: filled(u, F.col("size"))))
    about = [F.col("key").alias("stream_id"), F.col("stream_id").alias("source_id")], [F.lit(1).alias("label"), F.col("onset").alias("onset_char"), F.col("cls").alias("corruption_class"), *more]
    if not texts:
        return base.select(*about[0], *about[1], (F.col("onset") + F.col("size")).alias("n_chars"))
    # a one-element explode: what reads the text later doesn't copy its expression
    return base.select(*about[0], F.explode(F.array(text)).alias("text"), *about[1])


def benchmark(streams: DataFrame, replicates: int = 1, texts: bool = True, only: DataFrame | None = None, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Clean streams (label 0, no onset) and corruptions of the other half, divided by a hash of the id; ``texts`` and ``only`` as above."""
    from weirstream.operators.metrics import bucket

    half = bucket(F.col("stream_id"), 2) == 0
    clean = streams.where(half & (F.length("text") >= LEAST_CLEAN)).select(F.col("stream_id").cast("string").alias("stream_id"), F.col("stream_id").alias("source_id"), "text", F.lit(0).alias("label"), F.lit(None).cast("int").alias("onset_char"), F.lit("clean").alias("corruption_class"))
    clean = clean if texts else clean.withColumn("n_chars", F.length("text")).drop("text")
    clean = clean if only is None else clean.join(F.broadcast(only), "stream_id")
    return clean.unionByName(corruptions(streams.where(~half), replicates, texts=texts, only=only, classes=classes))
