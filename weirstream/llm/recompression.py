"""Removal of passages that repeat across documents, found by recompression.

Texts become chunks: word numbers of some documents in the order of their ids, with the chunk's words. Each round joins
maximal runs of one symbol and then pairs of neighbours (the left one's name hashes to one side, the right one's to the
other). The name of what is joined depends on its parts alone, so equal strings of words get equal names in all chunks,
whatever stands around them; only symbols at the rim of a passage depend on its surroundings. Each window of words
carries the part of itself that doesn't (its interior). Spark gathers the round's new names of all chunks and tells which
are shared by two documents. A symbol that is not is dead, and so are windows with a dead symbol in their interior: each
round leaves fewer windows, and longer symbols. Windows that are left are told apart by 128 bits of their words.

Names have 64 bits; two strings of one name make a window a candidate, never a repetition. A chunk sends each distinct name
once, sorted, in a block for each range of names, and gets a bit for each back. Blocks of a range are one group; their
number follows the words of the corpus. Between rounds a chunk keeps only the words of windows that are left.
"""

from __future__ import annotations

import gc
import hashlib
import json
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstream.llm.common import Lexicon, discard, persisted, shared_folder

#: Words of a repeated window, rounds of naming, words of a chunk, words of the corpus for each range of names.
WINDOW, ROUNDS, CHUNK_WORDS, RANGE_WORDS = 50, 4, 1_000_000, 2_000_000


def pack(*arrays: np.ndarray) -> bytes:
    head = ",".join(f"{a.dtype.str}:{len(a)}" for a in arrays)
    return zstandard.compress(b"\n".join([head.encode(), b"".join(a.tobytes() for a in arrays)]), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    head, _, body = zstandard.decompress(data).partition(b"\n")
    found, at = [], 0
    for part in head.decode().split(","):
        kind, n = part.split(":")
        found.append(np.frombuffer(body, kind, int(n), at))
        at += found[-1].nbytes
    return found


def _mixed(a: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit numbers."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


#: A chunk's row; {} is the type of ids.
CHUNK_COLUMNS = "chunk long, ids array<{}>, n_words long, words binary, data binary"


def to_chunks(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, text) as rows chunk, ids, n_words, words (of the chunk, in one text), data (word counts of documents; word numbers)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, words = TaskContext.get().partitionId(), 0, [], 0
        lexicon = Lexicon()

        def chunk() -> pa.RecordBatch:
            nonlocal number, held, words, lexicon
            held.sort(key=lambda d: (d[0] is None, d[0]))
            lengths, ids = np.array([len(d[1]) for d in held], np.int32), np.concatenate([d[1] for d in held])
            row = {
                "chunk": pa.array([(part << 32) + number], pa.int64()), "ids": pa.array([[d[0] for d in held]], pa.list_(kind)), "n_words": pa.array([len(ids)], pa.int64()),
                "words": pa.array([zstandard.compress(b" ".join(lexicon), 1)], pa.binary()), "data": pa.array([pack(lengths, ids)], pa.binary()),
            }
            number, held, words, lexicon = number + 1, [], 0, Lexicon()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            kind = batch.schema.field(0).type
            for i in range(batch.num_rows):
                own = lexicon.numbers((batch.column(1)[i].as_py() or "").encode().split()).astype(np.int32)
                held.append((batch.column(0)[i].as_py(), own))
                words += len(own)
                if words >= chunk_words:
                    yield chunk()
        if held:
            yield chunk()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(gather, CHUNK_COLUMNS.format(kind))


class Chunk:
    """Documents of a chunk: their ids in order (nulls last), the first word of each, the document of each word, the
    words and the number of each one's word (-1: no longer of interest)."""

    def __init__(self, row: dict):
        self.ids, self.words = row["ids"], zstandard.decompress(row["words"]).split()
        self.lengths, self.numbers = unpack(row["data"])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        self.size = int(self.starts[-1])
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lengths)

    def windows(self, window: int) -> np.ndarray:
        place = np.arange(self.size)
        return place[place + window <= self.starts[1:][self.doc]]

    def reduced(self, windows: np.ndarray, window: int) -> dict:
        """Columns words and data with only what the windows hold."""
        held = covered(self.size, windows, windows + window)
        used, own = np.unique(self.numbers[held], return_inverse=True)
        numbers = np.full(self.size, -1, np.int32)
        numbers[held] = own
        return {"words": zstandard.compress(b" ".join([self.words[w] for w in used.tolist()]), 1), "data": pack(self.lengths, numbers)}


def _interior(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Empty interiors begin and end at one place."""
    return begin, np.maximum(begin, end)


class Parse:
    """The symbols of a chunk after some rounds, and of each window the interior.

    start, length, name, doc: of symbols in order (words at first); begin, end: of the windows' interiors, at bounds of
    symbols. ``advance`` makes a round; ``new`` then marks the symbols that it has made.
    """

    def __init__(self, chunk: Chunk, windows: np.ndarray, window: int):
        self.size, self.windows = chunk.size, windows
        self.begin, self.end = windows, windows + window
        self.start = np.flatnonzero(covered(chunk.size, self.begin, self.end))
        self.length, self.doc = np.ones(len(self.start), np.int64), chunk.doc[self.start]
        names = np.fromiter(map(xxhash.xxh3_64_intdigest, chunk.words), np.uint64, len(chunk.words))
        self.name = names[chunk.numbers[self.start]]
        self.new = np.ones(len(self.start), bool)

    def advance(self, turn: int) -> None:
        n, start, name = len(self.start), self.start, self.name
        stop = start + self.length
        beside = (stop[:-1] == start[1:]) & (self.doc[:-1] == self.doc[1:])
        head = np.ones(n, bool)
        head[1:] = ~(beside & (name[:-1] == name[1:]))
        run, first = np.cumsum(head) - 1, np.flatnonzero(head)
        after = np.append(first[1:], n)[: len(first)]
        count, from_, to = (after - first).astype(np.uint64), start[first], stop[after - 1]
        starting, ending = np.zeros(self.size + 1, np.int64), np.zeros(self.size + 1, np.int64)
        starting[start], ending[stop] = run, run
        # the first and the last run may go on beyond the window
        begin, end = self.begin.copy(), self.end.copy()
        some = np.flatnonzero(begin < end)
        begin[some], end[some] = to[starting[begin[some]]], from_[ending[end[some]]]
        begin, end = _interior(begin, end)
        name = name[first]
        side = ((_mixed(name + np.uint64(turn * 0x9E3779B9)) >> np.uint64(40)) & np.uint64(1)).astype(bool)
        named = np.where(count > 1, _mixed(name * np.uint64(0x9FB21C651E98DF25) + count), name)
        pair = np.zeros(len(first), bool)
        pair[:-1] = side[:-1] & ~side[1:] & beside[first[1:] - 1]
        # a right one may belong to a left one before the window, a left one to a right one behind it
        starting[from_], ending[to] = np.arange(len(first)), np.arange(len(first))
        some = np.flatnonzero(begin < end)
        q, r = starting[begin[some]], ending[end[some]]
        begin[some], end[some] = np.where(side[q], begin[some], to[q]), np.where(side[r], from_[r], end[some])
        self.begin, self.end = _interior(begin, end)
        second = np.zeros(len(first), bool)
        second[1:] = pair[:-1]
        # symbols inside no window are of no further use
        left = np.flatnonzero(~second)
        left = left[covered(self.size, self.begin, self.end)[from_[left]]]
        paired = pair[left]
        right = np.minimum(left + 1, len(first) - 1)
        self.start, self.doc = from_[left], self.doc[first[left]]
        self.length = np.where(paired, to[right], to[left]) - self.start
        self.name = np.where(paired, _mixed(named[left] * np.uint64(0xD6E8FEB86659FD93) + _mixed(named[right] + np.uint64(turn))), named[left])
        self.new = paired | (count[left] > 1)

    @cached_property
    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct new names, sorted, and whether two documents of the chunk have each."""
        name, doc = self.name[self.new], self.doc[self.new]
        order = np.argsort(name)
        name, doc = name[order], doc[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(name)), bool), name[1:] != name[:-1]]))
        if not len(first):
            return name, np.zeros(0, bool)
        return name[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)

    def live(self, shared: np.ndarray) -> np.ndarray:
        """Windows without a dead symbol inside; ``shared``: of the distinct new names."""
        dead = np.zeros(self.size + 1, np.int32)
        if self.new.any():
            at = np.searchsorted(self.names[0], self.name[self.new])
            dead[self.start[self.new][~shared[at]] + 1] = 1
        before = np.cumsum(dead)
        return self.windows[before[self.end] == before[self.begin]]


def covered(size: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word whether one of the intervals holds it."""
    return np.cumsum(np.bincount(begin, minlength=size + 1) - np.bincount(end, minlength=size + 1))[:size] > 0


def window_keys(numbers: np.ndarray, words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the words from each place on, by doubling."""
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    found = []
    for lane, factor in enumerate((0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)):
        power, done, length, key = _mixed(digests[numbers, lane] + np.uint64(1)), None, 0, None
        size = 1
        while size <= window:
            if window & size:
                key = power if key is None else _mixed(key[: max(0, len(numbers) - length - size + 1)] * np.uint64(factor) + power[length:])
                length += size
            size *= 2
            power = _mixed(power[: max(0, len(power) - size // 2)] * np.uint64(factor) + power[size // 2 :])
        found.append(key)
    return found[0], found[1]


class Finals:
    """Distinct keys of a chunk's windows, in order of the first half; ``group``: of each window; ``low``: the first document."""

    def __init__(self, chunk: Chunk, windows: np.ndarray, window: int):
        one, other = (k[windows] for k in window_keys(np.maximum(chunk.numbers, 0), chunk.words, window)) if len(windows) else (np.zeros(0, np.uint64),) * 2
        order = np.argsort(one)
        a, b = one[order], other[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.group = np.zeros(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        doc = chunk.doc[windows][order]
        self.one, self.other, self.low = a[new], b[new], np.minimum.reduceat(doc, np.flatnonzero(new)) if len(doc) else doc


def in_ranges(names: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of sorted 64-bit names, cut evenly into ranges by their upper bits."""
    of = ((names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return [(int(of[f]), int(f), int(e)) for f, e in zip(first, np.append(first[1:], len(of)), strict=False)]


def _steps(sorted_names: np.ndarray) -> np.ndarray:
    return np.diff(sorted_names, prepend=np.uint64(0))


def shared_names(requests: pa.Table) -> pa.Table:
    """Blocks of one range of names (name steps; bits of those that a chunk has twice): bits of shared ones for each chunk."""
    parts = [unpack(x) for x in requests["names"].to_pylist()]
    names = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    twice = [np.unpackbits(p[1], count=len(p[0])) for p in parts]
    values, at = np.unique(np.concatenate(names), return_inverse=True)
    shared = np.bincount(at, weights=1 + np.concatenate(twice)) > 1
    ends = np.cumsum([len(n) for n in names])[:-1]
    return pa.table({"chunk": requests["chunk"], "range": requests["range"], "bits": pa.array([np.packbits(x).tobytes() for x in np.split(shared[at], ends)], pa.binary())})


def earlier_windows(requests: pa.Table) -> pa.Table:
    """Blocks of one range of windows (steps of the key's first half; second half; ids): bits of those in a smaller document."""
    parts = [unpack(x) for x in requests["names"].to_pylist()]
    sizes = [len(p[0]) for p in parts]
    one, other = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), np.concatenate([p[1] for p in parts])
    ids = [i for x in requests["ids"].to_pylist() for i in json.loads(zstandard.decompress(x))]
    known = sorted({i for i in ids if i is not None})
    place = {i: n for n, i in enumerate(known)} | {None: len(known)}  # nulls come last
    rank = np.fromiter(map(place.__getitem__, ids), np.int64, len(ids))
    order = np.lexsort((other, one))
    a, b = one[order], other[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = np.minimum.reduceat(rank[order], np.flatnonzero(new))
    earlier = np.zeros(len(order), bool)
    earlier[order] = least[np.cumsum(new) - 1] < rank[order]
    return pa.table({"chunk": requests["chunk"], "range": requests["range"], "bits": pa.array([np.packbits(x).tobytes() for x in np.split(earlier, np.cumsum(sizes)[:-1])], pa.binary())})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _answered(names: np.ndarray, ranges: int, answers: pa.Table) -> np.ndarray:
    """The bits of all ranges, put in the order of the sorted names."""
    bits = dict(zip(answers["range"].to_pylist(), answers["bits"].to_pylist(), strict=True))
    found = [np.unpackbits(np.frombuffer(bits[r], np.uint8), count=e - f) for r, f, e in in_ranges(names, ranges)]
    return np.concatenate(found).astype(bool) if found else np.zeros(0, bool)


def forget(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def substring_dedup(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text", texts: bool = False, chunk_words: int = CHUNK_WORDS, range_words: int = RANGE_WORDS) -> DataFrame:
    """Remove words of windows that also start in a document with a smaller id.

    Returns a row for each of ``docs``: the id (as doc_id), n_words, n_removed, kept_sha256 (of the kept words joined by a
    space), spans (first and end of the removed words, from 0) and, if asked for, kept. Windows are judged on the
    texts as given. A null or empty text has no words. Rows with a null id come last: they lose what any
    document with an id has, and nothing to each other; nor do rows of equal ids to each other, or a document to itself.
    Documents shorter than a window keep everything; an empty table gives no rows; other columns are not read. Ids are
    integers or texts. Needs at least one round.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "recompression")
    kind = docs.schema[doc_id].dataType.simpleString()
    chunks = persisted(to_chunks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), chunk_words), "chunks", folder)
    ranges = max(1, -(-(chunks.agg(F.sum("n_words")).first()[0] or 0) // range_words))
    state_columns = CHUNK_COLUMNS.format(kind) + ", windows binary"

    def windows_of(row: dict, chunk: Chunk) -> np.ndarray:
        return chunk.windows(window) if row.get("windows") is None else np.cumsum(unpack(row["windows"])[0], dtype=np.int64)

    def parsed(row: dict, turn: int) -> tuple[Chunk, Parse]:
        chunk = Chunk(row)
        parse = Parse(chunk, windows_of(row, chunk), window)
        for k in range(1, turn + 1):
            parse.advance(k)
        return chunk, parse

    def ask(turn: int) -> Callable:
        def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                names, twice = parsed(row, turn)[1].names
                for r, f, e in in_ranges(names, ranges):
                    yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "chunk": pa.array([row["chunk"]], pa.int64()), "names": pa.array([pack(_steps(names[f:e]), np.packbits(twice[f:e]))], pa.binary())})

        return requests

    def step(turn: int) -> Callable:
        def of(own: pa.Table, answers: pa.Table) -> pa.Table:
            row = {c: own[c][0].as_py() for c in own.column_names}
            chunk, parse = parsed(row, turn)
            left = parse.live(_answered(parse.names[0], ranges, answers))
            columns = chunk.reduced(left, window) | {"windows": pack(np.diff(left, prepend=0).astype(np.int32))}
            return pa.table({c: own[c] for c in ("chunk", "ids", "n_words")} | {c: pa.array([v], pa.binary()) for c, v in columns.items()})

        return of

    state = chunks
    for turn in range(1, rounds + 1):
        requests = state.mapInArrow(ask(turn), "range int, chunk long, names binary")
        answers = requests.groupBy("range").applyInArrow(shared_names, "chunk long, range int, bits binary")
        found = state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(step(turn), state_columns)
        state = persisted(found, "state", f"{folder}/round-{turn}")
        if turn > 1:
            discard(spark, f"{folder}/round-{turn - 1}")
        del requests, answers, found
        forget(spark)

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            last = Finals(chunk, windows_of(row, chunk), window)
            for r, f, e in in_ranges(last.one, ranges):
                ids = zstandard.compress(json.dumps([chunk.ids[d] for d in last.low[f:e].tolist()]).encode(), 1)
                yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "chunk": pa.array([row["chunk"]], pa.int64()), "names": pa.array([pack(_steps(last.one[f:e]), last.other[f:e])], pa.binary()), "ids": pa.array([ids], pa.binary())})

    def mark(own: pa.Table, answers: pa.Table) -> pa.Table:
        """Words of windows that a document with a smaller id has: another chunk's, or one of this chunk."""
        row = {c: own[c][0].as_py() for c in own.column_names}
        chunk = Chunk(row)
        windows = windows_of(row, chunk)
        last = Finals(chunk, windows, window)
        earlier = _answered(last.one, ranges, answers)
        # documents of equal ids have equal rank; nulls come after all ids, and lose nothing to each other
        known = [i for i in chunk.ids if i is not None]
        rank = np.array([len(known) if i is None else bisect_left(known, i) for i in chunk.ids], np.int64)
        hit = earlier[last.group] | (rank[chunk.doc[windows]] > rank[last.low[last.group]])
        edge = np.flatnonzero(np.diff(covered(chunk.size, windows[hit], windows[hit] + window), prepend=False, append=False))
        return pa.table({"chunk": own["chunk"], "gone": pa.array([pack(np.diff(edge, prepend=0).astype(np.int32))], pa.binary())})

    def finish(own: pa.Table, gone: pa.Table) -> pa.Table:
        row = {c: own[c][0].as_py() for c in own.column_names}
        chunk = Chunk(row)
        edge = np.cumsum(unpack(gone["gone"][0].as_py())[0], dtype=np.int64)
        out_of = covered(chunk.size, edge[0::2], edge[1::2])
        removed, digests, spans, kept_texts = [], [], [], []
        for k in range(len(chunk.ids)):
            a, b = int(chunk.starts[k]), int(chunk.starts[k + 1])
            out = out_of[a:b]
            kept = b" ".join([chunk.words[w] for w in chunk.numbers[a:b][~out].tolist()])
            own_edge = np.flatnonzero(np.diff(out, prepend=False, append=False))
            removed.append(int(out.sum()))
            digests.append(hashlib.sha256(kept).hexdigest())
            spans.append([{"first": f, "end": e} for f, e in own_edge.reshape(-1, 2).tolist()])
            kept_texts.append(kept.decode() if texts else None)
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": own["ids"].combine_chunks().flatten(), "n_words": pa.array(chunk.lengths, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, span), "kept": pa.array(kept_texts, pa.string())})

    requests = state.mapInArrow(ask_windows, "range int, chunk long, names binary, ids binary")
    answers = requests.groupBy("range").applyInArrow(earlier_windows, "chunk long, range int, bits binary")
    gone = persisted(state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(mark, "chunk long, gone binary"), "gone", folder)
    del requests, answers, state
    discard(spark, f"{folder}/round-{rounds}")
    forget(spark)
    done = chunks.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,end:long>>, kept string")
    return done if texts else done.drop("kept")


def dedup_sql(window: int = WINDOW) -> str:
    """DuckDB: all windows as texts, each with the least id that has it."""
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT rn, doc_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS k FROM (SELECT rn, doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM docs)
), least AS (SELECT k, min(doc_id) AS low FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT rn, unnest(range(i, i + {window})) AS j FROM windows JOIN least USING (k) WHERE low < doc_id OR (doc_id IS NULL AND low IS NOT NULL)
), words AS (SELECT rn, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM docs
), kept AS (SELECT rn, string_agg(word, ' ' ORDER BY j) AS s FROM words ANTI JOIN gone USING (rn, j) GROUP BY rn
), counted AS (SELECT rn, count(*) AS n FROM gone GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rn) LEFT JOIN counted USING (rn)"""
