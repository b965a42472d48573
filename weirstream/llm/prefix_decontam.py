"""Benchmark decontamination as a prefix-filtered set join with exact windows.

A window is ``n`` consecutive words of an item (a shorter item is one window). Its tokens are its
two-word shingles (the word itself, if it has one word), ordered by how rare they are in the documents.
Containment of a whole window needs all of its tokens, so the necessary prefix is its rarest token
alone. A document position that holds such a token proposes a window whose start follows from the
token's place in it; the start must leave room for the whole window inside the document, and the words
are then compared one by one.

The benchmark is the stated query set: it is dealt into blocks of bounded size. Equal windows of a block are one,
with a list of their items. All blocks' tokens are counted in one pass over the documents; a second pass joins each
document with one block after the other. Documents are never shuffled. A single block is broadcast, several are read
from the shared folder, one at a time for each stretch of documents that a task holds.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstream.llm.common import SLICE_CHARS, Lexicon, discard, file_system, output_schema, persisted, shared_folder, slices, with_columns

#: Bytes of item text in a block, about; words of an item that stay in one piece.
BLOCK_BYTES, PIECE_WORDS = 4_000_000, 100_000
#: Tokens that are counted one by one; of more, those of equal first bits are counted together.
COUNTED = 1 << 22
#: Characters of documents that a task holds while it goes through several blocks.
HELD_CHARS = 32_000_000
#: Proposals that are verified at once, and words that a worker remembers.
PROPOSED, CACHE_WORDS = 1_000_000, 200_000
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: ASCII bytes: letters in lower case, digits as they are, anything else a blank. Other bytes belong to words.
FOLD = bytes((b | 32) if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def token_hashes(words: np.ndarray, following: np.ndarray | None = None) -> np.ndarray:
    """Hashes of tokens from those of their words: of pairs, or of single words."""
    h = words * K1 if following is None else (words * K1) ^ ((following * K2) << np.uint64(1)) ^ following
    return (h ^ (h >> np.uint64(31))) * K2


@dataclass
class Counts:
    """How often tokens come in the documents, by hash or, where there are very many, by the hash's first bits."""

    keys: np.ndarray
    counts: np.ndarray
    shift: np.uint64

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64)
        wanted = hashes >> self.shift
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.counts[at], 0)


@dataclass
class Block:
    """Distinct windows of some items over a vocabulary of their own words."""

    items: list[str]
    vocabulary: dict[bytes, int]
    window: np.ndarray  # word ids, padded with -2
    length: np.ndarray
    owned: np.ndarray  # where the items of a window begin in ``item``
    item: np.ndarray
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # where the proposals of a token begin
    proposed: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int32))  # window, offset of the token in it

    def all_tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, offset and code of every token of every window."""
        pairs = (self.window[:, 1:] >= 0) if self.window.shape[1] > 1 else np.zeros((len(self.window), 0), bool)
        w, o = np.nonzero(pairs)
        code = self.window[w, o].astype(np.int64) * len(self.vocabulary) + self.window[w, o + 1]
        single = np.flatnonzero(self.length == 1)
        return np.r_[w, single], np.r_[o, np.zeros(len(single), np.int64)], np.r_[code, -1 - self.window[single, 0].astype(np.int64)]

    def hashes_of(self, codes: np.ndarray) -> np.ndarray:
        words = Lexicon()
        words.numbers(list(self.vocabulary))  # in the order of their ids
        h = words.hashes()
        out = np.zeros(len(codes), np.uint64)
        pair = codes >= 0
        a, b = np.divmod(codes[pair], max(1, len(self.vocabulary)))
        out[pair] = token_hashes(h[a], h[b])
        out[~pair] = token_hashes(h[-1 - codes[~pair]])
        return out

    def order_by_rarity(self, counts: Counts) -> None:
        """Keep of each window the rarest token, the first of them in a tie."""
        w, o, code = self.all_tokens()
        distinct, back = np.unique(code, return_inverse=True)
        count = counts.of(self.hashes_of(distinct))[back]
        order = np.lexsort((o, count, w))
        order = order[np.r_[True, np.diff(w[order]) != 0][: len(order)]]
        order = order[np.argsort(code[order], kind="stable")]
        self.tokens, self.first = np.unique(code[order], return_index=True)
        self.first = np.r_[self.first, len(order)]
        self.proposed = np.stack([w[order], o[order]], axis=1).astype(np.int32)

    def items_of(self, windows: np.ndarray) -> set[str]:
        """All items that have one of these windows."""
        return {self.items[i] for w in windows.tolist() for i in self.item[self.owned[w] : self.owned[w + 1]].tolist()}


def make_block(rows: list[tuple[str, str]], n: int) -> Block:
    """rows: item ids and texts."""
    names = sorted({i for i, _ in rows})
    number = {i: k for k, i in enumerate(names)}
    vocabulary: dict[bytes, int] = {}
    parts, owners = [np.zeros((0, n), np.int32)], [np.zeros(0, np.int64)]
    for i, text in rows:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int32)
        if len(ids) >= n:
            own = np.lib.stride_tricks.sliding_window_view(ids, n)
        elif len(ids):
            own = np.r_[ids, np.full(n - len(ids), -2, np.int32)][None, :]
        else:
            continue
        parts.append(own)
        owners.append(np.full(len(own), number[i]))
    window, back = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
    owned = np.unique(np.stack([back.ravel(), np.concatenate(owners)], axis=1), axis=0)
    begins = np.searchsorted(owned[:, 0], np.arange(len(window) + 1))
    return Block(names, vocabulary, window, (window >= 0).sum(axis=1), begins, owned[:, 1].astype(np.int32))


def coded(texts: list[str | None], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of all texts in one array (-1: not in the block), their document, and words of each document."""
    words = [words_of(t) for t in texts]
    get = block.vocabulary.get
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter((get(w, -1) for own in words for w in own), np.int64, int(n_words.sum()))
    return ids, np.repeat(np.arange(len(texts)), n_words), n_words


def tokens_in(ids: np.ndarray, doc: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Position and code of the documents' tokens that the block's vocabulary can spell."""
    known = ids >= 0
    pair = np.flatnonzero(known[:-1] & known[1:] & (doc[:-1] == doc[1:])) if len(ids) else np.zeros(0, np.int64)
    codes = ids[pair] * len(block.vocabulary) + ids[pair + 1]
    if (block.length == 1).any():
        single = np.flatnonzero(known)
        return np.r_[pair, single], np.r_[codes, -1 - ids[single]]
    return pair, codes


def occurrences(ids: np.ndarray, doc: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts and windows of all exact occurrences."""
    none = np.zeros(0, np.int64)
    if not len(block.tokens) or not len(ids):
        return none, none
    at, codes = tokens_in(ids, doc, block)
    found = np.minimum(np.searchsorted(block.tokens, codes), len(block.tokens) - 1)
    hit = block.tokens[found] == codes
    at, found = at[hit], found[hit]
    size = block.first[found + 1] - block.first[found]
    upto = np.cumsum(size)
    starts, windows, begin = [none], [none], 0
    while begin < len(at):  # bounded stretches of proposals
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - size[begin] + PROPOSED, side="right")))
        start, window = verified(ids, doc, block, at[begin:end], found[begin:end], size[begin:end])
        starts.append(start)
        windows.append(window)
        begin = end
    return np.concatenate(starts), np.concatenate(windows)


def verified(ids: np.ndarray, doc: np.ndarray, block: Block, at: np.ndarray, found: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and windows of the proposals of some tokens that hold word by word."""
    which = np.repeat(block.first[found], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    window, offset = block.proposed[which].T.astype(np.int64)
    start = np.repeat(at, size) - offset
    length = block.length[window]
    inside = (start >= 0) & (start + length <= len(ids))
    start, window, length = start[inside], window[inside], length[inside]
    whole = doc[start] == doc[start + length - 1]
    start, window, length = start[whole], window[whole], length[whole]
    for j in range(block.window.shape[1]):
        same = (length <= j) | (ids[np.minimum(start + j, len(ids) - 1)] == block.window[window, j])
        start, window, length = start[same], window[same], length[same]
    return start, window


def pieces_of(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """i, t: item ids and their words, those of long items in pieces that share ``n`` - 1 words, so no window is lost."""

    def run(batches):
        for batch in batches:
            for start, length, texts in slices(batch, "t"):
                ids, out = [], []
                for i, t in zip(batch.column(0).slice(start, length).to_pylist(), texts, strict=True):
                    words = words_of(t)
                    for k in range(0, max(1, len(words) - n + 1), PIECE_WORDS) if words else ():
                        ids.append(i)
                        out.append(b" ".join(words[k : k + PIECE_WORDS + n - 1]).decode())
                yield pa.RecordBatch.from_pydict({"i": pa.array(ids, pa.string()), "t": pa.array(out, pa.string())})

    return items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").mapInArrow(run, "i string, t string")


def token_counts(docs: DataFrame, pieces: DataFrame, text: str, n: int, folder: str) -> Counts:
    """How often each token of the items comes in all documents: one pass over items, one over documents."""

    def tokens(batches):
        for batch in batches:
            for start, length, texts in slices(batch, "t"):
                block = make_block(list(zip(batch.column(0).slice(start, length).to_pylist(), texts, strict=True)), n)
                code = np.unique(block.all_tokens()[2])
                yield pa.RecordBatch.from_pydict({"token": pa.array(block.hashes_of(code).view(np.int64)), "single": pa.array(code < 0)})

    distinct = persisted(pieces.mapInArrow(tokens, "token long, single boolean").distinct(), "tokens", folder)
    size = distinct.count()
    shift = np.uint64(0 if size <= COUNTED else 64 - (COUNTED.bit_length() - 1))
    token = F.shiftrightunsigned("token", int(shift)) if shift else F.col("token")
    wanted = np.sort(distinct.select(token.alias("token")).distinct().toPandas()["token"].to_numpy(np.int64).view(np.uint64))
    singles = bool(distinct.where("single").limit(1).count())
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        keys, lexicon = shared.value, Lexicon()
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, _, texts in slices(batch, text):
                if len(lexicon) > CACHE_WORDS:
                    lexicon = Lexicon()
                words = [words_of(t) for t in texts]
                number = lexicon.numbers([w for own in words for w in own])
                h, doc = lexicon.hashes()[number], np.repeat(np.arange(len(words)), [len(w) for w in words])
                found = [token_hashes(h[:-1], h[1:])[doc[:-1] == doc[1:]]] + ([token_hashes(h)] if singles else [])
                for f in found:
                    at = np.minimum(np.searchsorted(keys, f >> shift), max(0, len(keys) - 1))
                    if len(keys) and len(f):
                        total += np.bincount(at[keys[at] == f >> shift], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": pa.array(keys[some].view(np.int64)), "n": pa.array(total[some])})

    counted = docs.select(text).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    keys = counted["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Counts(keys[order], counted["n"].to_numpy(np.int64)[order], shift)


class Blocks:
    """The blocks of a benchmark: a single one is broadcast, several lie in the shared folder and are read one at a time."""

    def __init__(self, spark: SparkSession, pieces: DataFrame, n: int, block_bytes: int, counts: Counts):
        size = pieces.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        self.number = max(1, -(-size // block_bytes))
        self.folder = None if self.number == 1 else shared_folder(spark, "benchmark-blocks")
        for k in range(self.number):  # one block at a time on the driver
            part = pieces if self.number == 1 else pieces.where(F.pmod(F.xxhash64("i", "t"), F.lit(self.number)) == k)
            block = make_block([(r.i, r.t) for r in part.collect()], n)
            block.order_by_rarity(counts)
            if self.folder is None:
                self.shared = spark.sparkContext.broadcast(block)
            else:
                fs, root = file_system(self.folder)
                fs.create_dir(root, recursive=True)
                with fs.open_output_stream(f"{root}/{k}", compression=None) as out:
                    pickle.dump(block, out, protocol=5)

    def __iter__(self):
        if self.folder is None:
            yield self.shared.value
            return
        fs, root = file_system(self.folder)
        for k in range(self.number):
            with fs.open_input_stream(f"{root}/{k}", compression=None) as source:
                block = pickle.loads(source.read())
            yield block


def hits(texts: list[str | None], blocks: Blocks) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Words of each text, how many of them are hit, and the items found, in slices of bounded size under each block."""
    cuts, size = [0], 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > SLICE_CHARS:
            cuts.append(i)
            size = 0
        size += len(t or "")
    cuts.append(len(texts))
    n_words = np.zeros(len(texts), np.int64)
    hit: list[np.ndarray | None] = [None] * (len(cuts) - 1)
    found: list[set[str]] = [set() for _ in texts]
    for block in blocks:
        for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            ids, doc, n_words[a:b] = coded(texts[a:b], block)
            at, window = occurrences(ids, doc, block)
            if hit[s] is None:
                hit[s] = np.zeros(len(ids), bool)
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + block.length[window], -1)
            hit[s] |= np.cumsum(change[:-1]) > 0
            order = np.argsort(doc[at], kind="stable")
            owner = doc[at][order]
            for part in np.split(order, np.flatnonzero(np.diff(owner)) + 1) if len(order) else ():
                found[a + int(doc[at[part[0]]])] |= block.items_of(np.unique(window[part]))
    n_hit = np.zeros(len(texts), np.int64)
    for own, (a, b) in zip(hit, zip(cuts, cuts[1:], strict=False), strict=True):
        if own is not None:
            n_hit[a:b] = np.bincount(np.repeat(np.arange(b - a), n_words[a:b])[own], minlength=b - a)
    return n_words, n_hit, [sorted(x) for x in found]


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Which words of each document lie inside windows of which items.

    Returns the ``keep`` columns (default ``doc_id``) with n_words, n_hit, n_items (long), items_sha256 (of
    the items' ids, sorted as strings and joined by commas), contaminated (n_hit > 0) and items (the ids).
    Null and empty texts have no words and are clean; items without words, text or id have no window; equal
    ids are one item. An empty benchmark leaves every document clean. Repeated documents repeat; other
    columns are not read. Items beyond ``block_bytes`` are joined block after block.
    """
    keep = keep or ["doc_id"]
    final = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean", "items": "array<string>"}
    work = shared_folder(docs.sparkSession, "benchmark-work")
    pieces = persisted(pieces_of(items, item_id, item_text, n), "pieces", work)
    blocks = Blocks(docs.sparkSession, pieces, n, block_bytes, token_counts(docs, pieces, text, n, work))
    discard(docs.sparkSession, work)
    held_chars = SLICE_CHARS if blocks.number == 1 else HELD_CHARS

    def run(batches):
        for batch in batches:
            for start, length, texts in slices(batch, text, held_chars):
                n_words, n_hit, found = hits(texts, blocks)
                new = {"n_words": pa.array(n_words), "n_hit": pa.array(n_hit), "n_items": pa.array([len(x) for x in found], pa.int64())}
                new |= {"items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found], pa.string())}
                new |= {"contaminated": pa.array(n_hit > 0), "items": pa.array(found, pa.list_(pa.string()))}
                yield with_columns(batch, keep, start, length, new)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, output_schema(docs, keep, final))


def decontaminate_sql(n: int = 10) -> str:
    """The digest columns over ``documents`` and ``benchmark`` in DuckDB's SQL, all windows joined by their text."""
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return f"""
with d as (select doc_id, {words} as w from documents), b as (select item_id, {words} as w from benchmark),
item as (select distinct item_id, array_to_string(list_slice(w, s, s + least({n}, len(w)) - 1), ' ') as win, least({n}, len(w)) as k
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - {n} + 2))) as s from b where len(w) > 0)),
hits as (select doc_id, s, item_id, x.k from
  (select doc_id, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') as win from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as s from d cross join (select distinct k from item) where len(w) >= k)) x
  join item on item.k = x.k and item.win = x.win),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + k)) as p from hits) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join found using (doc_id)"""
