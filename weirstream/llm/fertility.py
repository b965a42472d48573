"""Quality rules on tokeniser fertility: how public vocabularies fit a text.

The words of a text are encoded by a sentence-piece vocabulary with byte fallback, each word by itself
(its pieces never cross a space), and by a byte-level vocabulary of many languages. Measured are characters per
token of both, and of the first one the share of byte-fallback tokens and the entropy of the tokens; bands by
script, and by language in Latin script, say what is rejected. Some plain counts come with them.
"""

from __future__ import annotations

import base64
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weirstream.llm.common import broadcast_file, output_schema, pretoken_pattern, slices, tokenizer_path, with_columns

SYMBOLS = b"#*$%&|<>"
BLANKS = b"\t\n\x0b\x0c\r "
CACHE_WORDS = 100_000
#: Odd multipliers of the words of a window.
WINDOW_ODD = np.random.default_rng(5).integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


class Band(NamedTuple):
    """What a script's or language's texts must keep to. Entropy is relative to that of as many different tokens."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    #: Tokens for a word at most.
    most_tokens: float = 1e9
    #: Least entropy in bits at 8, 16, 32, ... tokens, straight lines between; as at the ends beyond them.
    curve: tuple[float, ...] = ()
    #: Characters for a token of the second vocabulary at least.
    least_second: float = 0.0


#: Tokens of a text that may be numbers or keys: the bands of characters and words are held against the others.
SPARE = 40
#: By script of most word characters, in Latin script by language where function words tell it. Scripts that the
#: vocabulary covers by bytes have bands to match. The languages' lower bounds are fitted on the labelled texts of
#: sf0.1 (3,330 good, 301 bad that pass the base rule); entropy grows with length, so its bound does too. The
#: upper bounds of characters leave room for ordinary prose, which this vocabulary fits better than those texts. The
#: second vocabulary's bounds lie 2 % under the least good text of each language.
BANDS = {
    "latin": Band(1.65, 6.0, 0.05, 0.45, 3.30, (1.93, 3.07, 3.98, 4.80, 5.49, 5.85, 6.09, 6.24, 6.33, 6.38, 6.41), 1.50),
    "greek": Band(0.9, 8.0, 0.35, 0.40, least_second=0.8),
    "cyrillic": Band(1.0, 10.0, 0.15, 0.45, least_second=1.0),
    "cjk": Band(0.3, 6.0, 0.85, 0.35, least_second=0.25),
    "other": Band(0.25, 8.0, 0.97, 0.35, least_second=0.25),
    "none": Band(0.9, 6.0, 0.10, 0.70, least_second=0.7),
}
SCRIPTS = list(BANDS)
BANDS |= {
    "en": Band(2.08, 6.0, 0.05, 0.45, 2.75, (1.99, 3.12, 4.03, 4.84, 5.54, 5.94, 6.22, 6.42, 6.54, 6.62, 6.69), 1.83),
    "de": Band(2.13, 6.0, 0.05, 0.45, 2.75, (1.95, 3.11, 4.02, 4.83, 5.50, 5.87, 6.11, 6.27, 6.37, 6.44, 6.51), 1.86),
    "fr": Band(1.83, 6.0, 0.05, 0.45, 2.95, (2.28, 3.30, 4.12, 4.86, 5.50, 5.85, 6.09, 6.24, 6.33, 6.38, 6.41), 1.77),
    "es": Band(1.80, 6.0, 0.05, 0.45, 3.05, (1.93, 3.07, 3.98, 4.80, 5.49, 5.88, 6.15, 6.33, 6.43, 6.49, 6.53), 1.73),
}
#: Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on with as are be this by at from or an have not which but",
    "de": "der die das und ist nicht mit sich ein eine den dem zu von für auf im des auch wie bei oder dass wird",
    "fr": "le la les des et une un du dans pour que qui en est pas au par sur avec ce il elle sont ou plus",
    "es": "el la los las que y en un una por con del se para es su al lo como más pero sus no son",
}
LANGUAGES = list(FUNCTION_WORDS)
EDGES = "#*$%&|<>.,;:!?()[]{}\"'`-_=+/\\~@^«»„“”‚‘’…¿¡–—"
#: Function word -> bits of the languages that have it.
LANGUAGE_BITS: dict[str, int] = {}
for _i, _own in enumerate(FUNCTION_WORDS.values()):
    for _w in _own.split():
        LANGUAGE_BITS[_w] = LANGUAGE_BITS.get(_w, 0) | 1 << _i


def script_of(word: str) -> int:
    """Index into SCRIPTS, by the first letter of the word; a word without letters has none."""
    for c in word:
        if c.isalpha():
            o = ord(c)
            if o < 0x250 or 0x1E00 <= o < 0x1F00:
                return 0
            if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
                return 1
            if 0x400 <= o < 0x530:
                return 2
            if 0x2E80 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0 or 0xF900 <= o < 0xFB00 or 0x20000 <= o < 0x32000:
                return 3
            return 4
    return 5


_processors: dict[bytes, object] = {}


def processor_of(data: bytes):
    """The vocabulary, loaded once in each Python worker."""
    if data not in _processors:
        import sentencepiece

        _processors.clear()
        _processors[data] = sentencepiece.SentencePieceProcessor(model_proto=data)
    return _processors[data]


_encodings: dict[bytes, object] = {}


def encoding_of(data: bytes, pattern: str):
    """The second vocabulary (a file of ranks), loaded once in each Python worker."""
    if data not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        _encodings.clear()
        _encodings[data] = tiktoken.Encoding("second", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[data]


def repeated_words(code: np.ndarray, doc: np.ndarray, n_docs: int, n: int = 5) -> np.ndarray:
    """Of each document, words inside windows of ``n`` words that occur twice or more in it (compared exactly)."""
    m = len(code) - n + 1
    if m < 1:
        return np.zeros(n_docs, np.int64)
    start = np.flatnonzero(doc[:m] == doc[n - 1 :])
    if not len(start):
        return np.zeros(n_docs, np.int64)
    # equal windows of a document have equal sums; neighbours in their order are then compared word by word
    h = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    total = doc[start].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(n):
        total += h[start + j] * WINDOW_ODD[j]
    order = np.argsort(total, kind="stable")
    total, start = total[order], start[order]
    same = total[1:] == total[:-1]
    met = np.flatnonzero(same)
    equal = doc[start[met]] == doc[start[met + 1]]
    for j in range(n):
        equal &= code[start[met] + j] == code[start[met + 1] + j]
    if not equal.all():  # different windows of equal sums: put all of them in order by their words instead
        order = np.lexsort([code[start + j] for j in range(n)] + [doc[start]])
        start = start[order]
        same = doc[start[1:]] == doc[start[:-1]]
        for j in range(n):
            same &= code[start[1:] + j] == code[start[:-1] + j]
    start = start[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    change = np.zeros(len(code) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + n, -1)
    inside = np.cumsum(change[:-1]) > 0
    return np.bincount(doc[inside], minlength=n_docs)


def token_entropy(token: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Shannon entropy in bits of each document's tokens."""
    size = np.bincount(doc, minlength=n_docs)
    key = doc.astype(np.int64) << 20 | token
    key.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    counts = np.diff(first, append=len(key))
    spread = np.bincount(key[first] >> 20, weights=counts * np.log2(counts), minlength=n_docs)
    return np.where(size > 0, np.log2(np.maximum(size, 1)) - spread / np.maximum(size, 1), 0.0)


def token_counts(words: list[str], encoding) -> list[int]:
    """Tokens of each word. Words are encoded as lines of one text; if blanks in them touch line ends, one by one."""
    ids = np.array(encoding.encode_ordinary("\n".join(words)), np.int64)
    ends = np.append(np.flatnonzero(ids == encoding.encode_single_token("\n")), len(ids))
    if len(ends) != len(words):
        return [len(encoding.encode_ordinary(w)) for w in words]
    return (np.diff(ends, prepend=-1) - 1).tolist()


def measure(texts: list[str | None], processor, is_byte: np.ndarray, cache: dict, encoding) -> dict[str, np.ndarray]:
    """Counts and fertility measures of some texts."""
    n = len(texts)
    raw = [(t or "").encode() for t in texts]
    words = [r.split() for r in raw]  # bytes split at ASCII blanks only
    index = {w: i for i, w in enumerate(dict.fromkeys(w for own in words for w in own))}
    if len(cache) > CACHE_WORDS:
        cache.clear()
    missing = [w for w in index if w not in cache]
    plain = [w.decode() for w in missing]
    ids = processor.encode(plain, num_threads=1)
    ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))).tolist()
    flat, begin = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1] if ends else 0).tobytes(), 0
    for w, p, end, k in zip(missing, plain, ends, token_counts(plain, encoding), strict=True):
        cache[w] = (flat[4 * begin : 4 * end], len(p), script_of(p), LANGUAGE_BITS.get(p.lower().strip(EDGES), 0), k)
        begin = end
    known = [cache[w] for w in index]
    flat = np.frombuffer(b"".join([k[0] for k in known]), np.int32)
    size = np.array([len(k[0]) // 4 for k in known], np.int64)
    at = np.cumsum(size) - size
    chars = np.array([k[1] for k in known], np.int64)
    script = np.array([k[2] for k in known], np.int64)
    bits = np.array([k[3] for k in known], np.int64)
    second = np.array([k[4] for k in known], np.int64)
    n_words = np.fromiter(map(len, words), np.int64, n)
    code = np.fromiter((index[w] for own in words for w in own), np.int64, int(n_words.sum()))
    doc = np.repeat(np.arange(n), n_words)
    out = {"n_words": n_words}
    total = lambda x: np.bincount(doc, weights=x[code], minlength=n).astype(np.int64) if len(code) else np.zeros(n, np.int64)
    out["word_chars"] = total(chars)
    out["n_second"] = total(second)
    out["second_chars_per_token"] = out["word_chars"] / np.maximum(out["n_second"], 1)
    out["n_symbols"] = np.array([len(r) - len(r.translate(None, SYMBOLS)) for r in raw], np.int64)
    lines = [[x for x in r.split(b"\n") if x.strip(BLANKS)] for r in raw]
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    out["n_repeat_words"] = repeated_words(code, doc, n)
    # tokens of all words in order
    taken = size[code] if len(code) else np.zeros(0, np.int64)
    token_doc = np.repeat(doc, taken)
    place = np.arange(int(taken.sum())) - np.repeat(np.cumsum(taken) - taken, taken) + np.repeat(at[code] if len(code) else taken, taken)
    token = flat[place].astype(np.int64)
    out["n_tokens"] = np.bincount(token_doc, minlength=n)
    fallback = np.bincount(token_doc[is_byte[token]], minlength=n)
    per = np.maximum(out["n_tokens"], 1)
    out["chars_per_token"] = out["word_chars"] / per
    out["byte_share"] = fallback / per
    out["token_entropy"] = token_entropy(token, token_doc, n)
    votes = np.zeros((n, len(SCRIPTS)))
    if len(code):
        np.add.at(votes, (doc, script[code]), chars[code])
    votes[:, -1] = np.where(votes[:, :-1].any(axis=1), 0, 1)
    out["script"] = votes.argmax(axis=1)
    out["band"] = out["script"].copy()
    if len(code):
        said = np.zeros((n, len(LANGUAGES)), np.int64)
        for i in range(len(LANGUAGES)):
            said[:, i] = total(bits >> i & 1)
        most = said.max(axis=1)
        told = (out["script"] == 0) & (most > 0) & ((said == most[:, None]).sum(axis=1) == 1)
        out["band"][told] = len(SCRIPTS) + said.argmax(axis=1)[told]
    return out


def judge(m: dict[str, np.ndarray], bands: dict[str, Band], min_words: int = 10, max_repeat: int = 20) -> dict[str, np.ndarray]:
    """Base failure, verdict, and the first band that a text breaks."""
    own = [bands[s] for s in SCRIPTS + LANGUAGES]
    limit = np.array([b[:5] for b in own])[m["band"]]
    size = np.log2(np.maximum(m["n_tokens"], 2))
    least = limit[:, 3] * size
    for i, b in enumerate(own):
        if b.curve and (at := m["band"] == i).any():
            least[at] = np.maximum(least[at], np.interp(size[at], np.arange(3, 3 + len(b.curve)), b.curve))
    base = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat * m["n_words"])
    rest = m["n_tokens"] - SPARE
    many = (m["word_chars"] < limit[:, 0] * rest) | (rest > limit[:, 4] * m["n_words"])
    second = m["word_chars"] < np.array([b.least_second for b in own])[m["band"]] * (m["n_second"] - SPARE)
    broken = [many, second, m["chars_per_token"] > limit[:, 1], m["byte_share"] > limit[:, 2], m["token_entropy"] < least]
    reason = np.select([base, *broken], ["base", "many tokens", "many second tokens", "few tokens", "byte fallback", "low entropy"], "")
    return {"base_failed": base, "kept": reason == "", "reason": reason}


def fertility(docs: DataFrame, vocabulary: str | None = None, second: str | None = None, bands: dict[str, Band] | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Fertility measures and a verdict for each text, map-only.

    Words are runs of characters other than ASCII blanks. Returns the ``keep`` columns (default ``doc_id``)
    with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_tokens,
    chars_per_token, byte_share, token_entropy (bits), second_chars_per_token, script and reason (null if kept). Null and empty
    texts have no words, zero measures, script ``none``, and fail the base rule. Texts are read whole;
    repeated rows repeat; an empty table gives an empty result; other columns are never read.
    """
    keep = keep or ["doc_id"]
    bands = BANDS | (bands or {})
    shared = broadcast_file(docs.sparkSession, vocabulary or tokenizer_path("piece_bpe_32k.model"))
    pattern = pretoken_pattern()
    other = broadcast_file(docs.sparkSession, second or tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    longs, doubles = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens"], ["chars_per_token", "byte_share", "token_entropy", "second_chars_per_token"]
    new = dict.fromkeys(longs, "long") | dict.fromkeys(doubles, "double") | {"base_failed": "boolean", "kept": "boolean", "script": "string", "reason": "string"}

    def run(batches):
        processor, encoding = processor_of(shared.value), encoding_of(other.value, pattern)
        is_byte = np.array([processor.is_byte(i) for i in range(processor.vocab_size())])
        cache: dict = {}
        for batch in batches:
            for start, length, texts in slices(batch, text):
                m = measure(texts, processor, is_byte, cache, encoding)
                m |= judge(m, bands)
                out = {k: pa.array(m[k], pa.int64()) for k in longs} | {k: pa.array(m[k], pa.float64()) for k in doubles}
                out |= {k: pa.array(m[k], pa.bool_()) for k in ("base_failed", "kept")}
                out |= {"script": pa.array([SCRIPTS[i] for i in m["script"]]), "reason": pa.array([str(r) or None for r in m["reason"]], pa.string())}
                yield with_columns(batch, keep, start, length, out)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, output_schema(docs, keep, new))
