"""Cases of the review's findings: each would have failed before."""

import itertools
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weirstream.llm import license_rules
from weirstream.llm.common import pretoken_pattern, tokenizer_path
from weirstream.llm.fertility import BANDS, encoding_of, fertility, judge, measure, processor_of, repeated_words, token_counts

TWO_WORDS = {"latin": "qua rem", "greek": "και το", "cyrillic": "река дом", "cjk": "你 好", "other": "של את", "none": "## 11", "en": "the of", "de": "der und", "fr": "le des", "es": "el los"}
PROSE = {
    "en": "The old bridge over the river was closed in winter, and people from both towns had to take a small boat that left before sunrise.",
    "de": "Die alte Brücke über den Fluss war im Winter gesperrt, und die Leute aus beiden Städten mussten mit einem kleinen Boot fahren.",
    "fr": "Le vieux pont sur la rivière était fermé en hiver, et les habitants des deux villes prenaient un petit bateau avant le jour.",
    "es": "El viejo puente sobre el río estaba cerrado en invierno, y los vecinos de las dos villas tomaban una barca antes del alba.",
    "greek": "Η παλιά γέφυρα πάνω από το ποτάμι ήταν κλειστή τον χειμώνα και οι άνθρωποι έπαιρναν μια μικρή βάρκα.",
    "cyrillic": "Старый мост через реку был закрыт зимой, и люди из обоих городов садились в маленькую лодку до рассвета.",
}


def verdicts(texts):
    processor = processor_of(open(tokenizer_path("piece_bpe_32k.model"), "rb").read())
    m = measure(texts, processor, np.array([processor.is_byte(i) for i in range(processor.vocab_size())]), {}, encoding_of(open(tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb").read(), pretoken_pattern()))
    found = judge(m, BANDS)
    names = list(BANDS)
    return [(names[b], bool(base), str(reason)) for b, base, reason in zip(m["band"], found["base_failed"], found["reason"], strict=True)]


def every_window_once(words: str) -> str:
    """36 words of two kinds in which no five words come again."""
    two, bits = words.split(), [0] * 5
    seen = {tuple(bits)}
    while True:
        for b in (1, 0):
            if (*bits[-4:], b) not in seen:
                seen.add((*bits[-4:], b))
                bits.append(b)
                break
        else:
            return " ".join(two[b] for b in bits)


@pytest.mark.parametrize("band", BANDS)
def test_fertility_bands_reject(band):
    assert verdicts([every_window_once(TWO_WORDS[band])]) == [(band, False, "low entropy")]


def test_fertility_reasons():
    rare = "\U00010330"
    texts = [" ".join(f"{i * 7919:x}{i * 104729:o}{i * 31:b} the" for i in range(50, 90)), " ".join("-" * 16 + "=" * n for n in range(8, 24)), " ".join(w + rare * (i % 4 == 0) for i, w in enumerate(PROSE["en"].split()))]
    found = verdicts(texts)
    assert [r for _, _, r in found] == ["many tokens", "few tokens", "byte fallback"] and not any(b for _, b, _ in found)
    assert verdicts(list(PROSE.values())) == [(k, False, "") for k in PROSE]


def test_second_vocabulary_rejects():
    """Words that only the first vocabulary fits; the bound is held against tokens beyond the spare ones."""
    m = {"n_words": np.array([60]), "n_repeat_words": np.array([0]), "word_chars": np.array([400]), "n_tokens": np.array([150]), "n_second": np.array([300]), "chars_per_token": np.array([2.7]), "byte_share": np.array([0.0]), "token_entropy": np.array([6.8]), "band": np.array([list(BANDS).index("en")])}
    assert judge(m, BANDS)["reason"].tolist() == ["many second tokens"]
    assert judge(m | {"n_second": np.array([200])}, BANDS)["reason"].tolist() == [""]


def test_token_counts_of_words():
    encoding = encoding_of(open(tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb").read(), pretoken_pattern())
    words = ["plain", "don't", "a\u00a0b", "\u00a0", "\u2003x", "漢字かな", "🙂🙂", "'s", "12,5%", "###", "x" * 300, "\x1c", "é", "—–", "end"]
    assert token_counts(words, encoding) == [len(encoding.encode_ordinary(w)) for w in words] and token_counts([], encoding) == []


def test_repeated_words_against_counting(monkeypatch):
    r = np.random.default_rng(1)
    code, doc = r.integers(0, 3, 2_000), np.sort(r.integers(0, 20, 2_000))
    want = np.zeros(21, np.int64)
    for d in range(20):
        own = code[doc == d].tolist()
        windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
        want[d] = len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)})
    assert repeated_words(code, doc, 21).tolist() == want.tolist()
    monkeypatch.setattr("weirstream.llm.fertility.WINDOW_ODD", np.ones(64, np.uint64))  # sums don't tell orders apart
    assert repeated_words(code, doc, 21).tolist() == want.tolist()
    assert repeated_words(code[:3], doc[:3], 21).sum() == repeated_words(code[:0], doc[:0], 21).sum() == 0


def test_fertility_labels(spark):
    """Junk that passes the base rule breaks a band in every language; clean texts stay."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = fertility(docs, keep=["doc_id", "lang"]).where("not base_failed").join(labels, "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept"))
    share = {(r.lang, r.quality): (r.kept, r.n) for r in found.collect()}
    for lang, quality in itertools.product(["de", "en", "es", "fr"], [0, 1]):
        kept, n = share[lang, quality]
        assert n and (kept <= 0.1 * n if quality == 0 else kept >= 0.97 * n)


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
}
FULL_RULES = {"MIT": "mit-text", "BSD-3-Clause": "bsd-3-text", "GPL-3.0-or-later": "gpl-header"}


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// ", "    "])
def test_license_wrapped(spark, prefix):
    head = ["Some tool", "Copyright (c) 2020 A. Body"]
    want, texts = [], []
    for (name, text), width, end in itertools.product(WRAPPED.items(), (30, 72, 80), ("\n", "\r\n")):
        lines = [x for p in text.split("\n\n") for x in [*textwrap.wrap(p, width), ""]]
        texts.append(end.join((prefix + x).rstrip() for x in [*head, *lines]))
        want.append((FULL_RULES[name], name))
    found = license_rules.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.rules, r.license) for r in found] == want


def test_license_readings(spark):
    texts = [
        "Notes\nReleased under the\nMIT License\nand more",
        "Released under the MIT. License",
        "Released under the MIT.\nLicense",
        "Released under the\n\nMIT License",
        "Released under the\n *\n * MIT License",
        "All rights reserved.\nThis work is\nlicensed under CC BY 4.0\nReleased under the MIT License",
        "It is not released under the\nMIT License",
    ]
    found = license_rules.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_sentences, r.sentence_ids) for r in found] == [(3, ""), (2, ""), (2, ""), (2, ""), (2, ""), (3, "reserved,ccby4.notice,mit.notice"), (2, "")]


def test_near_duplicate_rows(spark):
    """Null ids and repeated rows don't save copies, and a shared id doesn't cost the other text."""
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta", "gamma"))
    rows = [(None, one), (None, one), (7, one), (9, one), (8, two), (8, two), (9, three), (None, None), (None, None), (3, ""), (None, "delta only here " + two[::-1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, __row0 int")
    kept = corpus_pipeline.near_duplicate(spark, docs, "")
    assert kept.columns == docs.columns
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted([(7, one), (8, two), (9, three), *rows[7:]], key=key)
    copies = spark.createDataFrame([(None, one), (None, one)], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate(spark, copies, "").collect()] == [(None, one)]
