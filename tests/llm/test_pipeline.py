"""The pipeline: every stage keeps the columns, takes effect, and leaves clean documents alone."""

import corpus_pipeline

from tests.llm.test_operators import brute_components, brute_windows, sets_of


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [brute_windows(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[s : s + 10]) for w in items if len(w) >= 10 for s in range(len(w) - 9)}
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    quality, language, unique, clean = kept
    assert len(quality) >= 150 and len(language) >= 0.95 * len(quality)
    components = brute_components(sets_of(language))
    assert set(unique) == {i for i, c in components.items() if i == c}
    leaked = {i for i, t in unique.items() if any(tuple(w[s : s + 10]) in windows for w in [brute_windows(t)] for s in range(len(w) - 9))}
    assert set(clean) == set(unique) - leaked
    last = sorted(map(str, corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()))
    assert len(last) == len(clean) and sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == last


CLASHING = "doc_id long, text string, lang string, source string, kept boolean, n_words string, accepted string, contaminated int, `items` string, component_id long, __row0 int, __c0 string, id string"


def test_any_columns_and_rows(spark):
    """Columns of any name come through; nulls, blanks and repeated rows have a defined end; empty tables stay empty."""
    sf = "/root/testdata/sf0.001"
    good = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and length(text) between 600 and 1500").limit(4).collect()]
    texts = [(1, good[0]), (1, good[0]), (None, good[1]), (None, good[1]), (2, good[2]), (2, good[3]), (3, None), (None, ""), (4, " \n"), (None, None)]
    rows = [(i, t, None if k % 3 == 2 else "en", None, False, "x", "y", 7, "z", -1, k, "c", "i") for k, (i, t) in enumerate(texts)]
    docs, empty = spark.createDataFrame(rows, CLASHING), spark.createDataFrame([], CLASHING)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf).schema == empty.schema and not stage(spark, empty, sf).count(), name
    nothing = {(3, None), (None, ""), (4, " \n"), (None, None)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        left = [(r.doc_id, r.text) for r in got.collect()]
        blank = [x for x in left if x in nothing]
        assert len(blank) == (0 if name in ("quality rules", "language ID") else 4), name
        if name == "n-gram Jaccard join":
            assert sorted(map(str, (x for x in left if x not in nothing))) == sorted(map(str, dict.fromkeys(texts[:6])))
    last = corpus_pipeline.STAGES[-1][1]
    assert not last(spark, empty, sf).count() and {r.n_tokens for r in last(spark, docs.where("text is null"), sf).collect()} == {0}
