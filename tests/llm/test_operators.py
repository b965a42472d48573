"""Each operator against a brute-force version, with null, empty, long, tied and repeated rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirstream.llm import flow_reshard, license_rules, prefix_decontam, url_markov
from weirstream.llm.bpe_codec import BytePairTable, encode_decode
from weirstream.llm.common import tokenizer_path
from weirstream.llm.fertility import fertility
from weirstream.llm.flow_reshard import min_cost_flow, plan_transfers, reshard, shard_documents
from weirstream.llm.partition_jaccard import near_duplicates
from weirstream.llm.prefix_decontam import decontaminate
from weirstream.llm.token_attribution import attribute
from weirstream.llm.warc_members import archive_pages, inflate, parse, record, records
from weirstream.llm.zstd_langid import held_out, identify, learn_dictionaries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_tokens string, __s int"
WORDS = {"en": "the river and a boat with some people under old bridges near town".split(), "de": "der fluss und ein boot mit vielen leuten unter alten brücken nahe stadt".split()}


def sentence(r: random.Random, lang: str, n: int) -> str:
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", ",", "s"]) for _ in range(n))


def rows():
    r = random.Random(5)
    texts = [None, "", " \n\t ", "one", "a b c d", "a b c d e", "!!! 123 ??", "x" * 30_000, "Ünïcode — 漢字 🙂 text\u00a0here", "<|endoftext|> and <|endoftext|>"]
    texts += ["same words here for you " * 40, "same words here for you " * 40]
    long = sentence(r, "en", 6_000)
    texts += [long, long + " and a tail", long]
    base = sentence(r, "en", 120).split()
    for k in (0, 1, 3, 8, 20):
        w = list(base)
        for _ in range(k):
            w[r.randrange(len(w))] = f"edit{r.randrange(99)}"
        texts.append(" ".join(w))
    texts += [sentence(r, lang, r.randrange(5, 90)) + ".\nReleased under the MIT License.\n" for lang in ("en", "de") for _ in range(15)]
    out = [(i, t, None if i % 7 == 0 else ("de" if t and "der" in t.split() else "en"), None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), "clash", "clash", 1) for i, t in enumerate(texts)]
    return out + [out[16], out[16], (None, texts[16], "en", "s1", 1, "clash", "clash", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def test_empty_tables(spark, empty):
    assert not fertility(empty).count() and not encode_decode(empty).count() and not license_rules.scan(empty).count()
    assert not identify(empty, learn_dictionaries(empty)).count() and not near_duplicates(empty).count()
    assert not shard_documents(empty).count() and not attribute(empty, ["source", "text"]).count()
    items = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate(empty, items).count()
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert not archive_pages(pages).count() and not url_markov.filter_urls(pages).count()


def test_fertility_counts(docs):
    found = fertility(docs)
    assert found.count() == len(rows())
    for i, r in by_id(found).items():
        t = rows()[i][1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        inside = {j + k for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w)) and (not r.kept or not r.base_failed)


def test_fertility_measures(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for i, r in by_id(fertility(docs)).items():
        ids = [t for w in re.findall(r"[^\x20\x09-\x0D]+", rows()[i][1] or "") for t in sp.encode(w)]
        counts = np.array(list(collections.Counter(ids).values()), float)
        entropy = -(counts / counts.sum() * np.log2(counts / counts.sum())).sum() if len(ids) else 0.0
        assert r.n_tokens == len(ids) and abs(r.token_entropy - entropy) < 1e-9
        assert abs(r.byte_share - (sum(map(sp.is_byte, ids)) / len(ids) if ids else 0)) < 1e-12


def test_bpe_matches_library(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for i, r in by_id(encode_decode(docs, with_ids=True)).items():
        t = rows()[i][1] or ""
        ids = lib.encode(t, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids, skip_special_tokens=False) == t
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_random_words():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), BytePairTable(open(path, "rb").read())
    r = random.Random(1)
    words = ["".join(r.choice("aeinst é漢!") for _ in range(r.randrange(1, 30))) for _ in range(300)]
    for w in words:
        pieces = own.pretokens(w)
        assert [i for p in pieces for i in next(own.ids_of([p]))] == lib.encode(w, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_attribution(docs, rule):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for i, r in by_id(attribute(docs, ["source", "lang", "text"], rule=rule, separator=" ")).items():
        parts = [rows()[i][k] or "" for k in (3, 2, 1)]
        owner, spans = [], []
        for k, p in enumerate(parts):
            owner += [3] * bool(k) + [k] * len(p)
        want = [0] * 4
        enc = lib.encode(" ".join(parts), add_special_tokens=False)
        for a, b in enc.offsets:
            own = owner[a:b]
            # runs of equal owners are sections, so a tie goes to the earlier run
            runs = [own[0]], [1]
            for x in own[1:]:
                if x == runs[0][-1]:
                    runs[1][-1] += 1
                else:
                    runs[0].append(x)
                    runs[1].append(1)
            want[own[0] if rule == "first" else own[-1] if rule == "last" else runs[0][int(np.argmax(runs[1]))]] += 1
        assert [r.source_tokens, r.lang_tokens, r.text_tokens, r.separator_tokens] == want and r.n_tokens == len(enc.ids)


def test_language_id(docs):
    known = learn_dictionaries(docs)
    assert set(known) == {"en", "de"}
    found = identify(docs, known, keep=["doc_id", "text", "lang"]).where("lang_pred <> 'und'")
    judged = found.where(held_out("doc_id") & F.col("lang").isNotNull() & (F.length("text") > 60) & (F.length("text") < 2000))
    assert judged.where("lang = lang_pred").count() >= 0.9 * judged.count() > 0
    undecided = {i for i, r in by_id(identify(docs, known)).items() if r.lang_pred == "und"}
    assert undecided == {i for i, r in enumerate(rows()[:-3]) if not any(c.isalpha() for c in r[1] or "")}
    assert identify(docs, {}).where("lang_pred <> 'und' or accepted or score <> 0").count() == 0


def brute_windows(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize(("block_bytes", "patch"), [(8_000_000, {}), (200, {"HELD_CHARS": 50_000}), (60_000, {"PIECE_WORDS": 7, "PROPOSED": 3}), (8_000_000, {"COUNTED": 4, "SLICE_CHARS": 1_000})])
def test_decontamination(spark, docs, monkeypatch, block_bytes, patch):
    for name, value in patch.items():
        monkeypatch.setattr(prefix_decontam, name, value)
    texts = {i: r[1] for i, r in enumerate(rows()[:-3])}
    items = [(1, " ".join(texts[15].split()[20:45])), (2, "ONE"), (3, None), (4, ""), (20, "a b c"), (21, " ".join(texts[12].split()[-10:])), (22, "漢字 🙂"), (23, texts[30]), (23, "a second text of one id"), (24, texts[30]), (25, "x " + texts[30] + " y"), (26, texts[12]), (27, texts[12])]
    found = by_id(decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes))
    for i, t in texts.items():
        w, hit, own = brute_windows(t), set(), set()
        for k, item in items:
            v = brute_windows(item)
            n = min(10, len(v))
            wins = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if v else set()
            for s in range(len(w) - n + 1 if wins else 0):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    own.add(str(k))
        r = found[i]
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == (len(w), len(hit), sorted(own), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/\r\nX: y", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 5), (6, "u", "z" * 200_000), (7, "u", "x"), (7, "u", "x"), (None, "u", "only")]
    found = archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path))
    rows = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()), key=str)
    top = {}
    for p, _, h in pages:
        top[h or ""] = max(top.get(h or "", 0), p or 0)
    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        first = (p or 0) == top[h or ""] and not any(x[0] == (p or 0) and x[3] == "response" for x in want)
        want.append((p or 0, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else top[h or ""]))
    assert rows == sorted(want, key=str)
    assert len(list((tmp_path / "members").glob("*.idx.json"))) == len(list((tmp_path / "members").glob("*.warc.gz"))) >= 1


def test_warc_streams_are_inflated_once(tmp_path):
    import io

    plain = b"".join(record(i, "u", b"p" * i * 1000, "D", i * 1000) for i in range(50))
    for packed in (zlib.compressobj(9, wbits=31), None):
        data = packed.compress(plain) + packed.flush() if packed else b"".join(zlib.compress(plain[i : i + 7_000], wbits=31) for i in range(0, len(plain), 7_000))
        got = list(records(inflate(io.BytesIO(data))))
        assert b"".join(got) == plain and [len(parse(g)[1]) for g in got] == [i * 1000 for i in range(50)]
    with pytest.raises(ValueError):
        list(records(inflate(io.BytesIO(zlib.compress(plain[:-10], wbits=31)))))


def brute_flow_cost(supply, capacity):
    return int(sum(max(0, s - c) for s, c in zip(supply, capacity)) if len(supply) == len(capacity) else 0)


def test_flow_moves_the_fewest_bytes():
    r = np.random.default_rng(3)
    for _ in range(50):
        n = int(r.integers(2, 7))
        supply = r.integers(0, 50, n)
        capacity = np.full(n, -(-int(supply.sum()) // n))
        flow = min_cost_flow(supply, capacity, 1.0 - np.eye(n))
        assert (flow.sum(1) == supply).all() and (flow.sum(0) <= capacity).all() and flow.sum() - np.trace(flow) == brute_flow_cost(supply, capacity)
    with pytest.raises(ValueError):
        min_cost_flow(np.array([5]), np.array([4]), np.zeros((1, 1)))


def test_general_costs_against_enumeration():
    import itertools

    r = np.random.default_rng(4)
    for _ in range(20):
        supply, capacity, cost = r.integers(0, 4, 2), np.array([3, 3, 3]), r.integers(0, 5, (2, 3)).astype(float)
        best = min(sum(f[i][j] * cost[i, j] for i in range(2) for j in range(3)) for f in itertools.product(*[[c for c in itertools.product(range(4), repeat=3) if sum(c) == s] for s in supply]) if all(f[0][j] + f[1][j] <= 3 for j in range(3)))
        assert (min_cost_flow(supply, capacity, cost) * cost).sum() == best


def test_blocks_are_near_equal():
    r = np.random.default_rng(5)
    blocks = [(int(o), k, int(s), 1) for k, (o, s) in enumerate(zip(r.choice(8, 4000, p=[0.37, *[0.09] * 7]), r.integers(1, 9000, 4000)))]
    plan = plan_transfers(blocks, 8, [1.0] * 8)
    size = np.bincount([b[4] for b in plan.blocks], weights=[b[2] for b in plan.blocks], minlength=8)
    assert size.max() - size.min() <= 100  # of 2.2 million each


def test_sharding(docs, tmp_path):
    found = shard_documents(docs, 4, str(tmp_path / "shards")).collect()
    assert len(found) == len(rows())
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        if r.doc_id is not None:
            t = (rows()[r.doc_id][1] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_reshard_keeps_columns(docs, tmp_path):
    out, plan = reshard(docs.select("doc_id", "text", "lang"), F.lit(0), 1, [1.0, 2.0], str(tmp_path / "shards"))
    assert out.columns == ["doc_id", "text", "lang", "__old", "__block", "__shard", "__base"] and plan.moved_bytes > 0
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))


@pytest.mark.parametrize("file_bytes", [128_000_000, 20_000])
def test_affected_shards_are_whole_on_disk(spark, tmp_path, monkeypatch, file_bytes):
    """The law holds, the fewest bytes move, and each shard that changes is a folder with all of its rows."""
    monkeypatch.setattr(flow_reshard, "FILE_BYTES", file_bytes)
    r = random.Random(9)
    texts = [sentence(r, "en", r.randrange(1, 60)) for _ in range(3_000)]
    old = [r.choices(range(4), [5, 1, 1, 1])[0] for _ in texts]
    # the last shard has its capacity already, so it stays in place
    frame = spark.createDataFrame([(i, t, o) for i, (t, o) in enumerate(zip(texts, old, strict=True))], "doc_id long, text string, old int")
    size = np.bincount(old, weights=[len(t) + 1 for t in texts], minlength=4).astype(np.int64)
    weights = [*[(int(size.sum()) - int(size[3])) / 3] * 3, float(size[3])]
    path = str(tmp_path / "shards")
    out, plan = reshard(frame, F.col("old"), 4, weights, path)
    capacity = np.array(plan.capacity)
    got = {x.doc_id: x["__shard"] for x in out.collect()}
    assert sorted(got) == list(range(3_000))
    new = np.bincount([got[i] for i in range(3_000)], weights=[len(t) + 1 for t in texts], minlength=4)
    assert (abs(new - capacity) <= 200).all()
    bound = int(np.maximum(size - capacity, 0).sum())
    assert bound <= plan.moved_bytes <= bound + 400
    assert sum(len(t) + 1 for i, t in enumerate(texts) if got[i] != old[i]) == plan.moved_bytes
    assert plan.affected == {int(p.name.removeprefix("shard=")) for p in (tmp_path / "shards").glob("shard=*")}
    for shard in plan.affected:
        files = list((tmp_path / "shards" / f"shard={shard}").glob("*.parquet"))
        assert {x.doc_id for x in spark.read.parquet(*map(str, files)).collect()} == {i for i, s in got.items() if s == shard}
        assert len(files) == -(-int(new[shard]) // file_bytes) or file_bytes == 20_000 < new[shard] <= 20_200 * len(files)


def test_law_of_documents(spark, tmp_path):
    found = shard_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), folder=str(tmp_path / "shards")).groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    sizes = [r["size"] for r in found]
    assert len(found) == 16 and max(sizes) - min(sizes) <= 0.002 * max(sizes) and all(r.n == r.last + 1 for r in found)


def sets_of(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            n = len(sets[i] & sets[j])
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates(docs):
    sets = sets_of({i: r[1] for i, r in enumerate(rows()[:-3])})
    want = brute_components(sets)
    found = near_duplicates(docs).collect()
    assert len(found) == len(rows())
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])


def test_near_duplicates_of_many_edits(spark):
    """A family around one text at all distances, chains, passages, and the smallest sets."""
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for n in (60, 300, 900):
        base = [r.choice(vocabulary) for _ in range(n)]
        for k in range(60):
            w = list(base)
            for _ in range(r.randrange(0, n // 12)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
        for k in range(15):  # a chain that slides along
            texts.append(" ".join((base + base[:200])[k * n // 40 : k * n // 40 + n]))
        texts += [" ".join([r.choice(vocabulary) for _ in range(n)] + base[:55]) for _ in range(20)]
    for n in range(1, 14):
        base = [r.choice(vocabulary) for _ in range(n + 4)]
        texts += [" ".join(base), " ".join(base + [r.choice(vocabulary)]), " ".join(base + [r.choice(vocabulary), "x"]), " ".join(base[:-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components(sets_of(dict(enumerate(texts))))
    assert {x.doc_id: x.component_id for x in near_duplicates(docs).collect()} == want


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/x?q#f", "https://example.com/en/", "http://shop.example.com/en/a", "http://example.com/de/", "ftp://a.net/es/1", "http://net/fr/", "http://notnet/fr/", "x.com/a", None, "http://example.com", "http://b.org?x=/en/", "http://a.com//en/", "a://b://c.com/x"]
    found = {r.page_id: r for r in url_markov.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    want = [("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("example.com", "/en/", "example.com/en/", "block"), ("shop.example.com", "/en/a", "example.com/en/", "block"), ("example.com", "/de/", "com/", "allow"), ("a.net", "/es/1", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"), ("notnet", "/fr/", None, None), ("", "", None, None), ("", "", None, None), ("example.com", "", None, None), ("b.org", "", None, None), ("a.com", "//en/", "com/", "allow"), ("b:", "//c.com/x", None, None)]
    for i, (host, path, rule, verdict) in enumerate(want):
        r = found[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ((verdict,) if verdict else ("allow", "block"))


def test_licenses(docs):
    found = by_id(license_rules.scan(docs))
    for i, r in enumerate(rows()[:-3]):
        assert found[i].license == ("MIT" if r[1] and "MIT License" in r[1] else None)


def test_license_sequences(spark):
    s = {k: v[0] for k, v in license_rules.SENTENCES.items()}
    texts = [f"{s['mit.grant']}.\nSome other words.\n{s['mit.condition']}. {s['asis.warranty']}.", f"{s['asis.warranty']}. {s['mit.grant']}.", "Licensed under the Apache License, Version 2.0.", "All rights reserved. Released under the MIT License!", "MIT License released"]
    found = {r.doc_id: (r.rules, r.license) for r in license_rules.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {0: ("mit-text", "MIT"), 1: ("mit-grant", "MIT"), 2: ("apache-notice", "Apache-2.0"), 3: ("mit-notice", "MIT"), 4: ("", None)}
