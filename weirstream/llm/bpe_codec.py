"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The distinct pre-tokens of a slice of texts lie in one flat array of symbols. A round looks up every
adjacent pair by binary search over the sorted pair keys, takes the lowest rank of each word, and
merges all its occurrences from left to right; words without a known pair leave the array. A round costs
as much as the array, so words of very many symbols are merged by a heap over linked symbols instead.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weirstream.llm.common import broadcast_file, output_schema, slices, tokenizer_path, with_columns

#: Fixed value: the published pre-token pattern of byte-level BPE.
PRETOKENS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
NO_RANK = np.int64(1) << 40
#: Distinct pre-tokens that a worker remembers between slices, and bytes from which a pre-token is not remembered.
CACHE_WORDS, LONG = 150_000, 256
#: Bits of a symbol in a pair key, and of a place in the heap.
SYMBOL_BITS, PLACE_BITS = 31, 40


def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes: themselves if printable in Latin-1, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BytePairTable:
    """Vocabulary and merges of a ``tokenizers`` JSON file as numpy tables."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.byte_ids = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << SYMBOL_BITS | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        self.split_specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and where each word begins (one more entry than words)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            at = np.flatnonzero(word[:-1] == word[1:])
            keys = symbols[at] << SYMBOL_BITS | symbols[at + 1]
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.where(self.keys[found] == keys, self.ranks[found], NO_RANK)
            lowest = np.full(len(words), NO_RANK)
            if len(at):
                first = np.flatnonzero(np.r_[True, word[at[1:]] != word[at[:-1]]])
                lowest[word[at[first]]] = np.minimum.reduceat(rank, first)
            ended = lowest[word] == NO_RANK
            if ended.any():
                done_symbols.append(symbols[ended])
                done_words.append(word[ended])
            chosen = (rank < NO_RANK) & (rank == lowest[word[at]])
            at, rank = at[chosen], rank[chosen]
            # overlapping occurrences of a pair of equal symbols: every other one of a run, from the left
            index = np.arange(len(at))
            begins = np.r_[True, np.diff(at) != 1][: len(at)]
            keep = (index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0
            at, rank = at[keep], rank[keep]
            symbols[at] = self.merged[rank]
            ended[at + 1] = True
            symbols, word = symbols[~ended], word[~ended]
        if not done_words:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        all_words = np.concatenate(done_words)
        order = np.argsort(all_words, kind="stable")
        counts = np.bincount(all_words, minlength=len(words))
        return np.concatenate(done_symbols)[order], np.r_[0, np.cumsum(counts)]

    def encode_long(self, word: bytes) -> list[int]:
        """Token ids of one word, merged pair by pair: lowest rank first, from the left among equal ranks."""
        symbols, rank_of = self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), self.rank_of.get
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = map(rank_of, [a << SYMBOL_BITS | b for a, b in zip(symbols, symbols[1:], strict=False)])
        heap = [r << PLACE_BITS | i for i, r in enumerate(ranks) if r is not None]
        heapq.heapify(heap)
        while heap:
            item = heapq.heappop(heap)
            rank, i = item >> PLACE_BITS, item & ((1 << PLACE_BITS) - 1)
            j = after[i]
            # a rank names its pair, so an entry holds as long as its place still has that rank
            if j == n or symbols[i] < 0 or rank_of(symbols[i] << SYMBOL_BITS | symbols[j]) != rank:
                continue
            own = symbols[i] = int(self.merged[rank])
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(own << SYMBOL_BITS | symbols[k])) is not None:
                    heapq.heappush(heap, r << PLACE_BITS | i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbols[h] << SYMBOL_BITS | own)) is not None:
                heapq.heappush(heap, r << PLACE_BITS | h)
        return [s for s in symbols if s >= 0]

    def pretokens(self, text: str) -> list[str]:
        """Pieces that tile the text; a special token is a piece of its own."""
        if self.split_specials is None or not any(s in text for s in self.specials):
            return PRETOKENS.findall(text)
        pieces: list[str] = []
        for part in self.split_specials.split(text):
            pieces += [part] if part in self.specials else PRETOKENS.findall(part)
        return pieces

    def ids_of(self, pieces: list[str]) -> Iterator[list[int]]:
        """Token ids of each distinct piece."""
        raw = [p.encode() for p in pieces]
        ids, at = self.encode_words([w if len(w) < LONG else b"" for w in raw])
        ids = ids.tolist()
        for p, w, a, b in zip(pieces, raw, at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield [self.specials[p]] if p in self.specials else ids[a:b] if len(w) < LONG else self.encode_long(w)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


_tables: dict[bytes, BytePairTable] = {}


def table_of(shared) -> BytePairTable:
    """The tables of a broadcast file, built once in each Python worker."""
    if shared.value not in _tables:
        _tables.clear()
        _tables[shared.value] = BytePairTable(shared.value)
    return _tables[shared.value]


def encode_decode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encode whole texts and decode them again, map-only.

    Returns the ``keep`` columns (default ``doc_id``) with n_tokens, ids_sha256 (decimal ids joined by
    commas), decoded_sha256, and with ``with_ids`` the ids and the decoded text themselves. Null text is
    encoded as the empty text: no tokens, hashes of the empty string. Rows stand for themselves: repeated
    rows repeat, an empty table gives an empty result, and columns not in ``keep`` are never read.
    Special tokens of the file are recognised in texts, as the file's library does.
    """
    keep = keep or ["doc_id"]
    shared = broadcast_file(docs.sparkSession, vocabulary or tokenizer_path("byte_bpe_50k.json"))
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    if with_ids:
        new |= {"ids": "array<int>", "decoded": "string"}

    def run(batches):
        tables, cache = table_of(shared), {}
        for batch in batches:
            for start, length, texts in slices(batch, text):
                pieces = [tables.pretokens(t or "") for t in texts]
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                missing = list({p for own in pieces for p in own} - cache.keys())
                for p, ids in zip(missing, tables.ids_of(missing), strict=True):
                    cache[p] = (len(ids), ",".join(map(str, ids)), tables.decode(ids), ids if with_ids else None)
                counts, hashes, decoded, all_ids, plain = [], [], [], [], []
                for own in pieces:
                    rows = [cache[p] for p in own]
                    counts.append(sum([r[0] for r in rows]))
                    hashes.append(hashlib.sha256(",".join([r[1] for r in rows]).encode()).hexdigest())
                    # bytes that are no UTF-8 become U+FFFD, as the library's lossy decoding has it
                    out = b"".join([r[2] for r in rows]).decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(out.encode()).hexdigest())
                    if with_ids:
                        all_ids.append([i for r in rows for i in r[3]])
                        plain.append(out)
                out = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                if with_ids:
                    out |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(plain, pa.string())}
                for p in missing:
                    if len(p) >= LONG:
                        del cache[p]
                yield with_columns(batch, keep, start, length, out)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, output_schema(docs, keep, new))
