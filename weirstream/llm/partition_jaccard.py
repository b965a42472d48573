"""Exact Jaccard join of word 5-gram sets by universe partition and the pigeonhole principle.

**Classes.** Documents with equal sets are one class, found from 128-bit digests; one member stands for it. Words and
shingles have two independent hashes of 64 bits (tables of random words for each byte at each place, long words by
blake2b); the digest is a blake2b of both for the whole set. A class is named by one long; classes whose longs are equal are told apart and get names of their own.

**Segments.** Sizes fall into bands. A band hashes the universe of shingles into ``m`` segments; a set is
then one content for each segment. Two sets at Hamming distance D differ in at most D segments, and a
Jaccard similarity of at least t bounds D by U = (1 - t) / (1 + t) * (a + b). So of the non-empty segment
contents of a set, in any fixed global order, the first U + 1 include one that the partner has among its
own first U + 1: only those are indexed (a pair is found in the band of its smaller set, so a set near the
lower edge of its band is indexed in the band below as well). Sizes count both hashes, so shingles of equal first
hashes only bring sets nearer to each other: they may add candidates and lose none.

**Slack.** In a band with slack l, sets index U + l contents, so partners share at least l of them. Contents are
counted, a set drops its l - 1 most frequent ones, and one that shares fewer than l drops all: the least frequent
content that two partners share is never among those dropped by either.

**Allocation.** Which U + l segments are used is free as long as the order is a function of the content.
It is by expected posting length: the count of the content's rarest shingle among all documents (in powers of two;
those not counted as frequent come first), then more shingles before fewer, then by hash. Passages that many documents
share are thus left out wherever a document has enough else. Whether a band takes segment subsets or one-deletion
neighbourhoods is a fixed rule: sets of up to 5 shingles (U <= 1) are one segment with its neighbourhood, all others
subsets. If hashing ever leaves a set fewer than U + l contents, all is hashed anew.

**Hot contents.** Contents expected in very many sets are dealt over several groups by class while they are counted;
their counts are then added up. No content, family or class is ever one task's work as a whole.

**Verification.** Texts are compared exactly: shingles of equal hashes are compared word by word. A class is compared
with the leader that it meets most often (the leader of a content is the class whose contents are met most); if they
link, that is its centre. Classes that hang together by their leaders are a family: near copies of a text that don't
all link to it, or texts around a passage.
Families that aren't one component are cut into blocks of like sizes, a big component in blocks of its own, and blocks
of fitting sizes and different components are compared as tiles, so their pairs are never rows. Last come contents on
which different families and components meet: where few do, their centres are compared, and as Jaccard distance is a
metric, members a and b of centres at distance D only if d(a) + d(b) >= D - (1 - t); where many do, they are a family
of their own. Every pair left out is linked already or provably below t.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstream.llm.common import Lexicon, discard, output_schema, persisted, shared_folder, slices, with_columns

#: Words of a shingle; links have 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 75
#: Largest sizes of the bands, each four times the one before; the first is the deletion band (U <= 1).
TOPS = [5, 31, 127, 511, 2047, 8191, 32767, 131071, 524287, 2097151, 8388607, 1 << 40]
#: A shingle is frequent if so many different texts hold it, counted where a lot of LOT shingles holds it IN_LOT
#: times. At most MAX_FREQUENT are broadcast; they only order segments, results don't depend on them.
FREQUENT, IN_LOT, LOT, MAX_FREQUENT = 8, 2, 1_000_000, 400_000
#: A content expected in 2 ** (SPLIT + k) texts is dealt over 2 ** k groups while it is counted.
SPLIT = 13
#: One more content for so many shingles of the band's smallest set as slack.
SLACK = 16
#: Shingles in a block of a family; a text counts as TEXT_WEIGHT more, so blocks of short texts are bounded as well.
BLOCK, TEXT_WEIGHT = 200_000, 100
#: Texts that are compared with another one by one; of more, the shared hashes are counted first.
FEW_TEXTS = 3
#: Centres on one content that are compared in pairs; more are a family of their own.
FEW_CENTRES = 50
#: Pairs that are broadcast instead of shuffled when texts are fetched.
BROADCAST_PAIRS = 300_000
#: Characters of text that are hashed at once: small arrays stay in the processor's cache.
PIECE = 300_000
#: Words that a worker remembers, and shingles of texts that it keeps for comparison.
CACHE_WORDS, CACHE_SHINGLES = 200_000, 1_500_000
#: Classes that share their long with another one and are renamed; n classes hold about n ** 2 / 2 ** 64 of them.
MAX_RENAMED = 100_000
FOLD = bytes((b | 32) if 65 <= b <= 90 else b for b in range(256))
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: Multipliers of the words of a shingle, for each of its two hashes; a random word for each byte at each place of a word.
LANES = np.random.default_rng(20_200_101).integers(0, 1 << 64, (WORDS, 2, 1), np.uint64) | np.uint64(1)
PLACES = 64
TABLES = np.random.default_rng(20_200_102).integers(0, 1 << 64, (2, PLACES * 256), np.uint64)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
ONE = np.ones(1, bool)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * K2
    return h ^ (h >> np.uint64(29))


ONE = np.ones(1, bool)


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Both hashes of all words of some texts (2 x words), and the number of words of each text.

    A word's hash is the sum of the random words of its bytes, mixed with its length; of a long one, blake2b.
    """
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([np.zeros(1, np.int64), edge])
    begin, end = edge[::2], edge[1::2]
    length = end - begin
    if len(begin):
        at = np.flatnonzero(~blank)
        place = (at - np.repeat(begin, length)) & (PLACES - 1)
        entry = place << 8 | data[at]
        starts = np.cumsum(length) - length
        hashes = mix(np.stack([np.add.reduceat(t[entry], starts) for t in TABLES]) + length.astype(np.uint64) * K3)
        for i in np.flatnonzero(length > PLACES):
            hashes[:, i] = np.frombuffer(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=16).digest(), np.uint64)
    else:
        hashes = np.zeros((2, 0), np.uint64)
    starts = np.cumsum([0, *[len(r) + 1 for r in raw]])
    return hashes, np.diff(np.searchsorted(begin, starts)).tolist()


@dataclass
class Shingles:
    """The distinct shingles of a text, in order of their first hash."""

    hash: np.ndarray
    lane: np.ndarray  # second hash
    n: int  # how many there are, by both hashes
    first: np.ndarray  # where in ``words`` each one begins
    words: np.ndarray | None = None  # numbers of the words; -1 behind those of a text shorter than a shingle
    clash: bool = False  # different shingles have equal first hashes

    def tuples(self) -> set[tuple[int, ...]]:
        """All shingles by their words."""
        return set(zip(*(self.words[j : len(self.words) - WORDS + 1 + j].tolist() for j in range(WORDS)), strict=True)) if self.n else set()


def shingle_sets(texts: list[str | None], lexicon: Lexicon | None = None) -> list[Shingles]:
    """The shingles of each text, with their words if a lexicon numbers these. Fewer than WORDS words, but some, are one."""
    raw = [(t or "").encode().translate(FOLD) for t in texts]
    hashes, size = word_hashes(raw)
    m = max(0, hashes.shape[1] - WORDS + 1)
    window = hashes[:, :m] * LANES[0]
    for j in range(1, WORDS):
        window += hashes[:, j : j + m] * LANES[j]
    window = mix(window)
    sets, at = [], 0
    for r, k in zip(raw, size, strict=True):
        if k >= WORDS:
            own, lane = window[0, at : at + k - WORDS + 1], window[1, at : at + k - WORDS + 1]
            order = np.argsort(own)
            own, lane = own[order], lane[order]
            new = np.concatenate([ONE, own[1:] != own[:-1]])
            n, clash = int(new.sum()), False
            again = np.flatnonzero(~new)
            if len(again) and (lane[again] != lane[again - 1]).any():
                clash, n = True, len(set(zip(own.tolist(), lane.tolist(), strict=True)))
            found = Shingles(own[new], lane[new], n, order[new].astype(np.int32), clash=clash)
        elif k:
            short = np.full((2, 1), k, np.uint64)
            for j in range(k):
                short = mix(short * LANES[j] + hashes[:, at + j : at + j + 1])
            found = Shingles(short[0], short[1], 1, np.zeros(1, np.int32))
        else:
            none = np.zeros(0, np.uint64)
            found = Shingles(none, none, 0, np.zeros(0, np.int32))
        if lexicon is not None:
            found.words = lexicon.numbers(r.split()).astype(np.int32)  # bytes split at ASCII blanks only
            if 0 < k < WORDS:
                found.words = np.concatenate([found.words, np.full(WORDS - k, -1, np.int32)])
        sets.append(found)
        at += k
    return sets


def common_shingles(x: Shingles, y: Shingles) -> int:
    """How many shingles two texts of one lexicon share: found by hash, then compared word by word."""
    if x.clash or y.clash:
        return len(x.tuples() & y.tuples())
    if x.n > y.n:
        x, y = y, x
    if not x.n:
        return 0
    at = np.minimum(np.searchsorted(y.hash, x.hash), len(y.hash) - 1)
    met = np.flatnonzero(y.hash[at] == x.hash)
    p, q = x.first[met], y.first[at[met]]
    same = np.ones(len(met), bool)
    for j in range(WORDS):
        same &= x.words[p + j] == y.words[q + j]
    return int(same.sum())


def digest(s: Shingles) -> tuple[int, int]:
    """128 bits of a set as two signed longs; the first is the name of its class unless others have it too."""
    d = hashlib.blake2b(s.hash.tobytes() + s.lane.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def name_of(s: Shingles, renamed: dict[tuple[int, int], int]) -> int:
    own = digest(s)
    return renamed.get(own, own[0])


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each hash's low bits, at least six bits for each."""
    bits = np.zeros(1 << max(6, (6 * len(s)).bit_length()), bool)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_common(a: bytes, b: bytes, na: int, nb: int) -> int:
    """Upper bound of the common shingles of two sets: each bit that differs is a shingle that they don't share."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    differ = int(np.bitwise_count(x ^ y).sum())
    return min(na, nb, (na + nb - differ) // 2)


def segments_of(band: int) -> int:
    top = TOPS[band]
    return 4096 if top <= 31 else 4 * top if top <= 127 else 3 * top // 2 if top <= 511 else min(7 * top // 10, 1 << 30)


def slack_of(band: int) -> int:
    """Contents that partners of this band share at least; the same for all sets of the band."""
    return 1 if TOPS[band] <= 31 else 2 + TOPS[band - 1] // SLACK


def roles(size: int) -> list[tuple[int, int]]:
    """(band, U) in which a set of this size is indexed: its own band, and the one below if a smaller partner may be there."""
    if not size:
        return []
    band = int(np.searchsorted(TOPS, size))
    t = PERCENT / 100
    out = [(band, int(size * (1 - t) / t + 1e-9))]
    if band and t * size <= TOPS[band - 1]:
        out.append((band - 1, int((TOPS[band - 1] + size) * (1 - t) / (1 + t) + 1e-9)))
    return out


def contents(s: np.ndarray, band: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the set by segment, where each non-empty segment begins in it, and the segments."""
    segment = (mix(s * K3 + np.uint64(seed)) >> np.uint64(20)) % np.uint64(segments_of(band))
    packed = segment << np.uint64(32) | np.arange(len(s), dtype=np.uint64)  # segment and place as one number
    packed.sort()
    order, segment = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64), packed >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([ONE, segment[1:] != segment[:-1]]))
    return order, first, segment[first]


def signatures(own: Shingles, level: np.ndarray, seed: int) -> list[tuple[np.ndarray, np.ndarray, int, int]] | None:
    """Index keys, their levels, band and slack of a set by role; None if hashing left a role fewer than U + slack contents.

    level: powers of two of how many texts hold each shingle, 0 if it isn't known as frequent. The order of contents
    is a function of the content: least level of its shingles, fewer shingles, its key, its segment.
    """
    out, s = [], own.hash
    for band, u in roles(own.n):
        salt = np.uint64((band * int(K1) + seed) % (1 << 64))
        if band == 0:
            whole = s.sum(dtype=np.uint64)
            key = mix((np.r_[whole, whole - s] if own.n > 2 else np.array([whole])) * K1 + salt)
            out.append((key, np.full(len(key), level.min()), band, 1))
            continue
        order, first, segment = contents(s, band, seed)
        slack = slack_of(band)
        if len(first) < u + slack:
            return None
        key = mix(mix(np.add.reduceat(s[order], first) * K1 + salt) + segment)
        ends = np.append(first[1:], len(s))
        many = np.minimum(ends - first, 127).astype(np.uint64)
        least = np.minimum.reduceat(level[order], first)
        rank = least.astype(np.uint64) << np.uint64(57) | (np.uint64(127) - many) << np.uint64(50) | key >> np.uint64(14)
        k = u + slack
        # contents of equal rank at the edge are all taken
        best = np.flatnonzero(rank <= np.partition(rank, k - 1)[k - 1]) if k < len(rank) else np.arange(len(rank))
        out.append((key[best], least[best], band, slack))
    return out


def digests(docs: DataFrame, text: str) -> DataFrame:
    """n_shingles, class digest (h1, h2), bitmap; rows with n_shingles -1 stand for no document but list frequent shingles."""
    keep = [c for c in docs.columns if c != text]
    new = {"n_shingles": "long", "h1": "long", "h2": "long", "bits": "binary", "frequent": "array<struct<shingle:long,n:long>>"}
    kind = pa.list_(pa.struct({"shingle": pa.int64(), "n": pa.int64()}))

    def run(batches):
        gathered: dict[tuple[int, int], np.ndarray] = {}
        held = 0

        def counted(like: pa.Schema) -> pa.RecordBatch:
            shingle, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *gathered.values()]), return_counts=True)
            gathered.clear()
            listed = [{"shingle": a, "n": b} for a, b in zip(shingle[n >= IN_LOT].view(np.int64).tolist(), n[n >= IN_LOT].tolist(), strict=True)]
            none = {k: pa.nulls(1, like.field(k).type) for k in keep}
            return pa.RecordBatch.from_pydict(none | {"n_shingles": pa.array([-1], pa.int64()), "h1": pa.array([0], pa.int64()), "h2": pa.array([0], pa.int64()), "bits": pa.nulls(1, pa.binary()), "frequent": pa.array([listed], kind)})

        schema = None
        for batch in batches:
            schema = batch.schema
            for start, length, texts in slices(batch, text, PIECE):
                sets = shingle_sets(texts)
                both = [digest(s) for s in sets]
                gathered.update((b, s.hash) for b, s in zip(both, sets, strict=True))  # copies count once
                held += sum([s.n for s in sets])
                yield with_columns(batch, keep, start, length, {
                    "n_shingles": pa.array([s.n for s in sets], pa.int64()), "h1": pa.array([b[0] for b in both], pa.int64()), "h2": pa.array([b[1] for b in both], pa.int64()),
                    "bits": pa.array([bitmap(s.hash) for s in sets], pa.binary()), "frequent": pa.nulls(length, kind),
                })
                if held > LOT:
                    yield counted(schema)
                    held = 0
        if gathered:
            yield counted(schema)

    return docs.mapInArrow(run, output_schema(docs, keep, new))


def frequent_shingles(rows: DataFrame, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles counted as frequent and the powers of two of their counts, as many of the most frequent as fit the bound."""
    level = F.floor(F.log2("n")).cast("int")
    counted = rows.where("n_shingles = -1").select(F.explode("frequent").alias("f")).groupBy("f.shingle").agg(F.sum("f.n").alias("n")).where(F.col("n") >= FREQUENT)
    counted = persisted(counted.select("shingle", level.alias("level")), "shingles", folder)
    total, least = 0, None
    for r in counted.groupBy("level").count().orderBy(F.desc("level")).collect():  # 63 rows at most
        total += r["count"]
        if total > MAX_FREQUENT:
            break
        least = r.level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counted.where(F.col("level") >= least).toPandas()
    shingle, levels = found["shingle"].to_numpy(np.int64).view(np.uint64), found["level"].to_numpy(np.int64)
    order = np.argsort(shingle)
    return shingle[order], levels[order]


def renamed_classes(classes: DataFrame) -> dict[tuple[int, int], int]:
    """New longs for the classes (h1, h2) whose h1 is not theirs alone; no class has one of them."""
    twice = classes.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1")
    rows = sorted((r.h1, r.h2) for r in classes.join(twice, "h1").select("h1", "h2").limit(MAX_RENAMED + 1).collect())
    if len(rows) > MAX_RENAMED:
        raise ValueError(f"more than {MAX_RENAMED} classes share their first 64 bits with another one")
    attempt = 0
    while rows:
        new = [int.from_bytes(hashlib.blake2b(repr((attempt, r)).encode(), digest_size=8).digest(), "big", signed=True) for r in rows]
        taken = classes.join(F.broadcast(classes.sparkSession.createDataFrame([(n,) for n in new], "h1 long")), "h1")
        if len(set(new)) == len(new) and not taken.limit(1).count():
            return dict(zip(rows, new, strict=True))
        attempt += 1
    return {}


def index(docs: DataFrame, text: str, frequent: tuple[np.ndarray, np.ndarray], renamed: dict, seed: int) -> DataFrame:
    """key, sid (the class), tag (slack and band), part for all documents; a task leaves out classes that it has just indexed.

    part: 0, or for contents expected in very many texts one of several groups, by class.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent, renamed))

    def run(batches):
        (common, levels), names = shared.value
        seen = set()
        for batch in batches:
            for _, _, texts in slices(batch, text, PIECE):
                keys, parts, sids, tags, short = [], [], [], [], []
                for s in shingle_sets(texts):
                    if not s.n or (sid := name_of(s, names)) in seen:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(sid)
                    level = np.zeros(len(s.hash), np.int64)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s.hash), len(common) - 1)
                        level = np.where(common[at] == s.hash, levels[at], 0)
                    own = signatures(s, level, seed)
                    if own is None:
                        short.append(sid)
                        continue
                    for k, power, band, slack in own:
                        keys.append(k)
                        parts.append(np.where(power > SPLIT, 1 + (sid & ((1 << np.maximum(power - SPLIT, 0)) - 1)), 0).astype(np.int32))
                        sids.append(np.full(len(k), sid, np.int64))
                        tags.append(np.full(len(k), slack << 4 | band, np.int32))
                if keys:
                    yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys).view(np.int64)), "sid": pa.array(np.concatenate(sids)), "tag": pa.array(np.concatenate(tags)), "part": pa.array(np.concatenate(parts))})
                if short:
                    yield pa.RecordBatch.from_pydict({"key": pa.nulls(len(short), pa.int64()), "sid": pa.array(short, pa.int64()), "tag": pa.nulls(len(short), pa.int32()), "part": pa.nulls(len(short), pa.int32())})

    return docs.select(text).mapInArrow(run, "key long, sid long, tag int, part int")  # alike columns last: rows shuffle smaller


def shared_contents(indexed: DataFrame, folder: str) -> DataFrame | None:
    """key, sid, tag and n (how often the content comes) of contents that different classes have; None if a set came out short.

    Contents with a part are counted by part first; only their counts meet by key.
    """
    group = Window.partitionBy("key", "part")
    met = indexed.withColumns({"first": F.min("sid").over(group), "last": F.max("sid").over(group), "n": F.count("*").over(group)})
    common = persisted(met.where("first < last or part > 0 or key is null").select("key", "sid", "tag", "n", "part").distinct(), "common", folder)
    if common.where("key is null").limit(1).count():
        return None
    hot = common.where("part > 0")
    cold = common.where("part = 0").select("key", "sid", "tag", "n")
    if not hot.limit(1).count():
        return cold
    total = hot.groupBy("key").agg(F.min("sid").alias("first"), F.max("sid").alias("last"), F.count("*").alias("n")).where("first < last")
    return persisted(cold.union(hot.drop("n").join(total, "key").select("key", "sid", "tag", "n")), "common-hot", folder)


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, need) that sizes and bitmaps allow to reach a similarity of ``need``, with their documents."""
    for p in "ab":
        pairs = pairs.join(classes.select(F.col("sid").alias(p), F.col("n_shingles").alias(f"{p}_n")), p)
    sized = pairs.where(F.least("a_n", "b_n") >= F.col("need") * F.greatest("a_n", "b_n") - 1e-9)
    for p in "ab":
        own = classes.select(F.col("sid").alias(p), F.col("n_shingles").alias(f"{p}_n"), F.col("rep").alias(f"{p}_id"), F.col("bits").alias(f"{p}_bits"))
        sized = sized.join(own, [p, f"{p}_n"])

    def run(batches):
        for batch in batches:
            need, na, nb, x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("need", "a_n", "b_n", "a_bits", "b_bits"))
            most = np.array([most_common(*p) for p in zip(x, y, na, nb, strict=True)], np.int64)
            united = np.array(na, np.int64) + np.array(nb, np.int64) - most
            fits = pa.array(most >= np.array(need) * united - 1e-9)
            yield batch.select(["a", "b", "a_id", "b_id"]).filter(fits)

    out = sized.select("a", "b", "need", "a_n", "b_n", "a_bits", "b_bits", "a_id", "b_id")
    return out.mapInArrow(run, output_schema(out, ["a", "b", "a_id", "b_id"], {}))


def compare(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shared, folder: str) -> DataFrame:
    """a, b (classes), similarity as common and united shingles, from the words of whole texts, where ``need`` can be reached.

    docs: id, text. shared: the broadcast names of renamed classes.
    """
    named = persisted(possible(pairs, classes), "pairs", folder)
    small = named.count() <= BROADCAST_PAIRS  # else texts are shuffled
    hint = F.broadcast if small else lambda x: x
    left = docs.withColumnsRenamed({"id": "a_id", "text": "a_text"}).join(hint(named), "a_id").select("a", "b", "b_id", "a_text")
    right = docs.withColumnsRenamed({"id": "b_id", "text": "b_text"}).join(hint(named.select("b_id").distinct()), "b_id")

    def run(batches):
        known: dict[str, tuple[Shingles, int]] = {}
        lexicon, held = Lexicon(), 0
        for batch in batches:
            for start, length, own in slices(batch, "a_text", PIECE):
                a, b = (batch.column(batch.schema.get_field_index(c)).slice(start, length).to_pylist() for c in ("a", "b"))
                others = batch.column(batch.schema.get_field_index("b_text")).slice(start, length).to_pylist()
                rows = []
                if held > CACHE_SHINGLES or len(lexicon) > CACHE_WORDS:
                    known, lexicon, held = {}, Lexicon(), 0
                for x, y, mine, other in zip(a, b, own, others, strict=True):
                    if other not in known:
                        t = shingle_sets([other], lexicon)[0]
                        known[other] = t, name_of(t, shared.value)
                        held += t.n
                    t, number = known[other]
                    if number == y:
                        s = shingle_sets([mine], lexicon)[0]
                        if name_of(s, shared.value) == x:
                            common = common_shingles(s, t)
                            rows.append((x, y, common, s.n + t.n - common))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["a", "b", "common", "united"])

    found = left.join(right, "b_id").select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long, common long, united long")
    return persisted(found.groupBy("a", "b").agg(F.max("common").alias("common"), F.max("united").alias("united")), "compared", folder)


def tile_links(sids: np.ndarray, component: np.ndarray, side: np.ndarray, texts: list[str | None], renamed: dict) -> list[tuple[int, int]]:
    """Links between classes of different components: of a block with itself (side 2), or of side 0 with side 1.

    Components that a link has joined are one from then on, so no more links are found than join components.
    """
    sets = shingle_sets(texts, Lexicon())
    n = np.array([s.n for s in sets], np.int64)
    fits = np.array([name_of(s, renamed) == sid for s, sid in zip(sets, sids, strict=True)], bool)
    maps = np.zeros((len(sets), 1 << max(6, (6 * int(n.max(initial=1))).bit_length())), bool)
    for row, s in zip(maps, sets, strict=True):
        row[(s.hash & np.uint64(maps.shape[1] - 1)).astype(np.int64)] = True
    packed = np.packbits(maps, axis=1).view(np.uint64)
    # where each hash comes, to count what a text shares with all others at once
    owner = np.repeat(np.arange(len(sets)), [len(s.hash) for s in sets])
    every = np.concatenate([np.zeros(0, np.uint64), *[s.hash for s in sets]])
    order = np.argsort(every)
    every, owner = every[order], owner[order]
    component, out = component.copy(), []
    for i in np.flatnonzero(fits):
        other = fits & (np.arange(len(sets)) > i) & (component != component[i]) & ((side == 2) | (side != side[i]))
        j = np.flatnonzero(other & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])))
        most = (n[i] + n[j] - np.bitwise_count(packed[j] ^ packed[i]).sum(axis=1).astype(np.int64)) // 2
        j = j[100 * most >= PERCENT * (n[i] + n[j] - most)]
        if len(j) > FEW_TEXTS:
            low, high = np.searchsorted(every, sets[i].hash), np.searchsorted(every, sets[i].hash, side="right")
            size = high - low
            met = owner[np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
            most = np.bincount(met, minlength=len(sets))[j] + (n - np.array([len(s.hash) for s in sets]))[j]
            j = j[100 * most >= PERCENT * (n[i] + n[j] - most)]
        for k in j:
            if component[k] != component[i]:
                common = common_shingles(sets[i], sets[k])
                if 100 * common >= PERCENT * (n[i] + n[k] - common):
                    out.append((int(sids[i]), int(sids[k])))
                    component[component == component[k]] = component[i]
    return out


def family_links(families: DataFrame, docs: DataFrame, shared, folder: str) -> DataFrame:
    """a, b that link within families (family, sid, component, id, n_shingles) and are of different components.

    A family is cut into blocks of like sizes of about BLOCK shingles: each component that fills a block has blocks of
    its own, which are never compared with each other, and the others share blocks. Two blocks make a tile if their
    sizes can reach the threshold. A tile is a bounded group; its pairs are compared by bitmaps first.
    """
    weight = F.col("n_shingles") + TEXT_WEIGHT
    parts = persisted(families.groupBy("family", "component").agg(F.sum(weight).alias("weight")), "family-parts", folder)
    several = parts.groupBy("family").agg(F.count("*").alias("parts")).where("parts > 1").select("family")
    own = F.col("weight") >= BLOCK
    homes = parts.join(several, "family").select("family", "component", own.alias("own"), F.when(own, F.col("component")).otherwise(0).alias("home"))
    homes = persisted(homes, "family-homes", folder)
    if not homes.limit(1).count():
        return docs.sparkSession.createDataFrame([], "a long, b long")
    members = f"{folder}/members-{uuid.uuid4().hex}"
    placed = persisted(families.join(homes, ["family", "component"]), "family-members", members)
    sizes = placed.groupBy("family", "own", "home", "n_shingles").agg(F.sum(weight).alias("weight"))
    smaller = Window.partitionBy("family", "own", "home").orderBy("n_shingles")  # a row for each size, not for each text
    upto = sizes.withColumn("upto", F.sum("weight").over(smaller))
    spans = upto.select("family", "own", "home", "n_shingles", F.floor((F.col("upto") - F.col("weight")) / BLOCK).alias("low"), F.floor((F.col("upto") - 1) / BLOCK).alias("high"))
    block = F.col("low") + F.pmod(F.xxhash64("sid"), F.col("high") - F.col("low") + 1)
    blocked = persisted(placed.join(spans, ["family", "own", "home", "n_shingles"]).select("family", F.struct("own", "home", block.alias("block")).alias("block"), "sid", "component", "id", "n_shingles"), "families", folder)
    discard(docs.sparkSession, members)
    blocks = blocked.groupBy("family", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    met = blocks.alias("p").join(blocks.alias("q"), "family").where("p.block <= q.block and not (p.block.own and q.block.own and p.block.home = q.block.home)")
    met = met.where(100 * F.col("p.high") >= PERCENT * F.col("q.low")).where(100 * F.col("q.high") >= PERCENT * F.col("p.low"))
    tiles = met.select("family", F.col("p.block").alias("p"), F.col("q.block").alias("q"))
    same = F.col("p") == F.col("q")
    sides = [F.struct(F.col("p").alias("block"), F.when(same, 2).otherwise(0).alias("side")), F.struct(F.col("q").alias("block"), F.lit(1).alias("side"))]
    each = tiles.select("family", "p", "q", F.explode(F.when(same, F.array(sides[0])).otherwise(F.array(*sides))).alias("s")).select("family", "p", "q", "s.block", "s.side")
    rows = each.join(blocked, ["family", "block"])
    ids = blocked.select("id").distinct()
    if ids.count() <= BROADCAST_PAIRS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, "id")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["sid", "text"])
        found = tile_links(part["sid"].to_numpy(), part["component"].to_numpy(), part["side"].to_numpy(), part["text"].tolist(), shared.value)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    tile = F.xxhash64("p", "q")  # only a name: block pairs of equal hashes would be one larger tile
    dealt = rows.join(texts, "id").select("family", tile.alias("tile"), "sid", "component", "side", "text")
    return persisted(dealt.groupBy("family", "tile").applyInPandas(run, "a long, b long"), "tiles", folder)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, component (least node reachable) of every node of a, b edges; labels spread and jump until none changes."""
    spark, rounds = edges.sparkSession, f"{folder}/rounds-{uuid.uuid4().hex}"
    both = persisted(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("node", "other"), "edges", f"{rounds}/edges")
    labels = persisted(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels", f"{rounds}/0")
    n = 0
    while True:
        heard = both.join(labels.toDF("other", "heard"), "other").groupBy("node").agg(F.min("heard").alias("heard"))
        least = labels.join(heard, "node").select("node", F.least("component", "heard").alias("component"), F.col("component").alias("before"))
        jump = labels.toDF("component", "jump")
        moved = persisted(least.join(jump, "component").select("node", F.least("component", "jump").alias("component"), "before"), "labels", f"{rounds}/{n + 1}")
        discard(spark, f"{rounds}/{n}")
        labels = moved.select("node", "component")
        if not moved.where("component <> before").limit(1).count():
            discard(spark, f"{rounds}/edges")
            return labels
        n += 1


def linked(common: Column, united: Column) -> Column:
    return 100 * common >= PERCENT * united


def spread(rows: DataFrame, labels: DataFrame, at: str) -> DataFrame:
    """component of each row: that of its node, else the node itself."""
    return rows.join(labels.toDF(at, "component"), at, "left").withColumn("component", F.coalesce("component", F.col(at)))


def meeting_links(mixed: DataFrame, stars: DataFrame, about: DataFrame, docs: DataFrame, classes: DataFrame, shared, folder: str) -> DataFrame:
    """a, b that link across families, of contents (key, sid, component, family, centre, radius) on which several meet.

    Where up to FEW_CENTRES centres meet, these are compared, and members only where their centres are near enough;
    the members of any other content are compared as a family.
    """
    least, link = PERCENT / 100, linked(F.col("common"), F.col("united"))
    distance = 1 - F.col("common") / F.col("united")
    reach = stars.groupBy("b").agg(F.max(distance).alias("reach"))
    mixed = persisted(mixed, "mixed", folder)
    standing = mixed.select("key", "component", "family", "centre").distinct()
    crowded = persisted(standing.groupBy("key").agg(F.count("*").alias("n")).select("key", (F.col("n") > FEW_CENTRES).alias("crowd")), "crowds", folder)
    few, many = crowded.where("not crowd").select("key"), crowded.where("crowd").select("key")
    standing = persisted(standing.join(few, "key"), "standing", folder)
    one, other = (standing.select("key", F.col("component").alias(f"{p}_component"), F.col("family").alias(f"{p}_family"), F.col("centre").alias(p)) for p in "ab")
    apart = one.join(other, "key").where("a_component < b_component and a_family <> b_family").select("a", "b").distinct()
    for p in "ab":
        apart = apart.join(reach.select(F.col("b").alias(p), F.col("reach").alias(f"{p}_reach")), p, "left")
    # members link only if their centres are at most so far apart
    need = least - F.coalesce("a_reach", F.lit(0.0)) - F.coalesce("b_reach", F.lit(0.0))
    centres = compare(apart.select("a", "b", need.alias("need")), docs, classes, shared, folder)
    open_ = centres.where(~link & (distance <= 3 * (1 - least) + 1e-9)).select("a", "b", (distance - (1 - least)).alias("gap"))
    inside = mixed.join(few, "key")
    x = inside.select("key", F.col("sid").alias("x"), F.col("centre").alias("a"), F.col("radius").alias("rx"))
    y = inside.select("key", F.col("sid").alias("y"), F.col("centre").alias("b"), F.col("radius").alias("ry"))
    inner = x.join(open_, "a").join(y, ["key", "b"]).where("rx + ry >= gap - 1e-9 and (x <> a or y <> b)").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(least).alias("need")).distinct()
    found = centres.where(link).select("a", "b").union(compare(inner, docs, classes, shared, folder).where(link).select("a", "b"))
    if not many.limit(1).count():
        return found
    crowd = mixed.join(many, "key").select(F.col("key").alias("family"), "sid", "component").distinct()
    return found.union(family_links(crowd.join(about, "sid"), docs, shared, folder))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The component of every document under links of at least PERCENT % Jaccard similarity.

    Words are runs other than ASCII blanks, A-Z in lower case; a set is the distinct shingles of WORDS words
    (all words, if fewer). Returns doc_id, n_shingles and component_id, the least doc_id reachable by links,
    one row for each row. Null and blank texts have the empty set, link with nothing and are their own
    component, also if they are many. Repeated rows repeat with equal results. A null doc_id is larger than any other: its
    rows link by their texts like all others, and a component without another id has a null one. Rows of one id with
    different texts are documents of their own. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    digested = persisted(digests(slim, "text"), "jaccard-digests")
    several = digested.where("n_shingles >= 0").groupBy("id").agg((F.coalesce(F.min("h1") != F.max("h1"), F.lit(False)) | ((F.count("h1") > 0) & (F.count("h1") < F.count("*")))).alias("several")).where("id is null or several")
    if not several.limit(1).count():
        return by_unique_id(slim, digested).withColumnRenamed("id", doc_id)
    # texts are fetched by id, so ids that can't tell rows apart give way to numbers of rows; written, so they are fixed
    keyed = persisted(slim.withColumn("row", F.monotonically_increasing_id()), "jaccard-rows")
    numbered = keyed.select(F.col("row").alias("id"), "text")
    found = by_unique_id(numbered, persisted(digests(numbered, "text"), "jaccard-digests"))
    found = persisted(found.withColumnRenamed("id", "row").join(keyed.select("row", "id"), "row"), "jaccard-numbered")
    # partial minima, so a component of any size is no group
    names = found.groupBy("component_id").agg(F.min("id").alias("name"))
    return found.join(names, "component_id").select(F.col("id").alias(doc_id), "n_shingles", F.col("name").alias("component_id"))


def by_unique_id(slim: DataFrame, digested: DataFrame) -> DataFrame:
    """``near_duplicates`` of (id, text) whose ids are not null and stand for one text each; digested: their ``digests``."""
    spark = slim.sparkSession
    work = shared_folder(spark, "jaccard-work")  # all that the result doesn't read
    least = PERCENT / 100
    rows = digested.where("n_shingles >= 0")
    classes = persisted(rows.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits")), "classes", work)
    renamed = renamed_classes(classes)
    shared = spark.sparkContext.broadcast(renamed)
    if renamed:
        new = spark.createDataFrame([(*k, v) for k, v in renamed.items()], "h1 long, h2 long, new long")
        classes = classes.join(F.broadcast(new), ["h1", "h2"], "left").withColumn("sid", F.coalesce("new", "h1")).drop("new")
    else:
        classes = classes.withColumn("sid", F.col("h1"))
    frequent = frequent_shingles(digested, work)
    seed = 0
    while (common := shared_contents(index(slim, "text", frequent, renamed, seed), f"{work}/contents")) is None:
        seed += 1
    own = Window.partitionBy("sid", "tag")
    place = F.row_number().over(own.orderBy(F.desc("n"), "key"))
    left = common.withColumns({"place": place, "own": F.count("*").over(own), "slack": F.shiftright("tag", 4)}).where("own >= slack and place >= slack")
    left = persisted(left.withColumn("met", F.sum("n").over(Window.partitionBy("sid"))).select("key", "sid", "met"), "left", f"{work}/left")
    discard(spark, f"{work}/contents")
    # the order of leaders: how much a class meets, ties by name
    order = F.shiftleft(F.least("met", F.lit((1 << 31) - 1)), 32).bitwiseOR(F.col("sid").bitwiseAND(F.lit(0xFFFFFFFF)))
    leaders = left.groupBy("key").agg(F.min("sid").alias("first"), F.max("sid").alias("last"), F.max_by("sid", order).alias("leader")).where("first < last").select("key", "leader")
    shared_keys = persisted(left.join(leaders, "key").select("key", "sid", "leader"), "shared", work)
    discard(spark, f"{work}/left")
    # the leader that each one meets most often
    often = shared_keys.where("sid <> leader").groupBy("sid", "leader").agg(F.count("*").alias("n"))
    best = persisted(often.groupBy("sid").agg(F.max(F.struct("n", "leader"))["leader"].alias("leader")), "best", work)
    link = linked(F.col("common"), F.col("united"))
    distance = 1 - F.col("common") / F.col("united")
    stars = compare(best.select(F.col("sid").alias("a"), F.col("leader").alias("b"), F.lit(least).alias("need")), slim, classes, shared, work).where(link)
    labels = components(stars, work)
    # all pairs of a family whose members aren't one component yet
    families = components(best.select(F.col("sid").alias("a"), F.col("leader").alias("b")), work).toDF("sid", "family")
    about = classes.select("sid", F.col("rep").alias("id"), "n_shingles")
    kin = family_links(spread(families, labels, "sid").join(about, "sid"), slim, shared, work)
    labels = components(stars.select("a", "b").union(kin), work)
    centre = stars.select(F.col("a").alias("sid"), F.col("b").alias("centre"), distance.alias("radius"))
    # contents on which different components of different families still meet
    placed = spread(shared_keys.select("key", "sid").join(families, "sid", "left").withColumn("family", F.coalesce("family", "sid")), labels, "sid")
    placed = persisted(placed.join(centre, "sid", "left").select("key", "sid", "component", "family", F.coalesce("centre", "sid").alias("centre"), F.coalesce("radius", F.lit(0.0)).alias("radius")), "placed", work)
    spans = [f(c).alias(n) for n, f, c in (("x", F.min, "component"), ("y", F.max, "component"), ("u", F.min, "family"), ("v", F.max, "family"))]
    open_keys = persisted(placed.groupBy("key").agg(*spans).where("x < y and u < v").select("key"), "open", work)
    edges = stars.select("a", "b").union(kin)
    if open_keys.limit(1).count():
        labels = components(edges.union(meeting_links(placed.join(open_keys, "key"), stars, about, slim, classes, shared, work)), work)
    # classes to documents: the least id of all classes of a component
    named = spread(classes.select(F.col("sid").alias("node"), "h1", "h2", "rep"), labels, "node")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = persisted(named.join(smallest, "component").select("h1", "h2", "component_id"), "jaccard-components")
    discard(spark, work)
    found = rows.select("id", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    return found.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def near_duplicates_sql() -> str:
    """The rows over ``documents`` in DuckDB's SQL: shingles joined by their words, components by recursion."""
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    return f"""
with recursive d as (select doc_id, {words} as w from documents),
s as materialized (select doc_id, list_sort(list_distinct(list_transform(range(1, greatest(2, len(w) - {WORDS} + 2)), lambda i: array_to_string(list_slice(w, i, i + {WORDS} - 1), ' ')))) as s from d where len(w) > 0),
classes as materialized (select min(doc_id) as c, s from s group by s),
e as materialized (select c, len(s) as n, unnest(s) as g from classes),
pairs as (select x.c as a, y.c as b, x.n + y.n - count(*) as united, count(*) as common from e x join e y on x.g = y.g and x.c < y.c and 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n) group by x.c, y.c, x.n, y.n),
edges as materialized (select a, b from pairs where 100 * common >= {PERCENT} * united),
ways as materialized (select a, b from edges union select b, a from edges),
reach(a, b) as (select c, c from classes union select r.a, e.b from reach r join ways e on e.a = r.b),
least as (select a as c, min(b) as component from reach group by a)
select d.doc_id, coalesce(len(s.s), 0)::bigint as n_shingles, coalesce(component, d.doc_id) as component_id
from d left join s using (doc_id) left join classes using (s) left join least using (c)"""
