"""All features of one text at given positions, by numpy: the map-only counterpart of the window-function operators.

Char-level windows blow a text up to a row for each character; this keeps it one row. Both give the same numbers.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np

from weirstream.functions.kernels import blake64
from weirstream.functions.text import ARTEFACTS, EXPECTED, RUN_EXCLUDED, SCRIPTS
from weirstream.operators.sequence_features import ALPHA, BASELINE, FINGERPRINT_WORDS, LEAST_ALPHABET, LEAST_WORDS, LONGEST_RUN, MOST_SHINGLES, RECENT, SHINGLE, SMOOTHING, STRIDE, WEIGHTS
from weirstream.operators.streams import WINDOW

NAMES = ["digit", "space", "symbol", *SCRIPTS, "other"]
FIRST_SCRIPT, OTHER = 3, len(NAMES) - 1
#: Of each artefact, texts one of which it can't do without: most windows have none, and searching for them is cheap.
NEEDED = [("###",), ("```",), ("pip install",), ("npm install",), ("#REF!",), ("#DIV/0!",), ("#VALUE!",), ("http",), (":\\\\",), (".py", ".env", ".json"), ("年",), ("====",), ("────",), ("______",)]
TRACES = list(zip(NEEDED, [re.compile(p) for p in ARTEFACTS], strict=True))
#: Words whose hashes a worker remembers.
CACHE_WORDS = 200_000
WORDS = re.compile(r"[^\W\d_]{2,}")


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every character of the basic plane."""
    ranges = [(name, [tuple(int(x, 16) for x in pair) for pair in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", spec)]) for name, spec in SCRIPTS.items()]
    table = np.full(0x10000, OTHER, np.uint8)
    for name, own in reversed(ranges):
        for low, high in own:
            table[low : high + 1] = NAMES.index(name)
    for o in range(0x10000):
        c = chr(o)
        if c.isdigit():
            table[o] = 0
        elif c.isspace():
            table[o] = 1
        elif o < 128:
            table[o] = NAMES.index("latin") if c.isalpha() else 2
    return table


def earlier(groups: np.ndarray) -> np.ndarray:
    """How often each value (none negative) came before, at each place."""
    n = len(groups)
    if not n:
        return np.zeros(0, np.int64)
    bits = int(n - 1).bit_length()
    place = np.arange(n)
    if int(groups.max()) < 1 << (63 - bits):
        packed = groups.astype(np.int64) << bits | place  # value and place as one number: a plain sort is stable
        packed.sort()
        order, own = packed & ((1 << bits) - 1), packed >> bits
    else:
        order = np.argsort(groups, kind="stable")
        own = groups[order]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(own[1:], own[:-1], out=first[1:])
    count = np.empty(n, np.int64)
    count[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return count


def numbered(codes: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the distinct characters of a text, at each place."""
    if not len(codes):
        return np.zeros(0, np.int64)
    table = np.zeros(int(codes.max()) + 1, np.int64)
    table[codes] = 1
    return (np.cumsum(table) - 1)[codes]


def surprises(ids: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Bits of each character under the interpolated online model of those before it.

    ids: numbers of the characters; before: how often each one came before. The context of a character is a run of
    characters that ends in front of it, so how often a context came before is how often that run did, one place on.
    """
    n = len(ids)
    size = int(ids.max(initial=0)) + 1
    seen = np.cumsum(before == 0) - (before == 0)
    v = SMOOTHING * np.maximum(LEAST_ALPHABET, seen + 1)
    p = np.zeros(n)
    contexts, grams, runs = np.arange(n), before, ids
    for k, weight in enumerate(reversed(WEIGHTS)):
        if k:  # runs of k + 1 characters
            last = grams
            step = np.zeros(n, np.int64)
            step[k:] = runs[k - 1 : n - 1] * size + ids[k:]
            if size ** (k + 1) >= 1 << 62:
                _, step = np.unique(step, return_inverse=True)
            runs = step
            contexts, grams = np.zeros(n, np.int64), np.zeros(n, np.int64)
            grams[k:] = earlier(runs[k:])
            contexts[k:] = last[k - 1 : n - 1]
            # short history: the last min(i, k - i) characters, never met by whole contexts
            short: list[tuple] = []
            for i in range(min(k, n)):
                own = tuple(ids[i - min(i, k - i) : i].tolist()), int(ids[i])
                contexts[i], grams[i] = sum(c == own[0] for c, _ in short), short.count(own)
                short.append(own)
        p += weight * (grams + SMOOTHING) / (contexts + v)
    return -np.log2(np.clip(p, 1e-9, 1.0))


def hash64(word: str, kind: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big") if kind == "md5" else blake64(word)


_hashes: dict[str, dict[str, int | None]] = {}


def word_hash(piece: str, kind: str) -> int | None:
    """The hash of the letters and digits of a piece in lower case, None if it has none; remembered in the worker."""
    known = _hashes.setdefault(kind, {})
    if len(known) > CACHE_WORDS:
        known.clear()
    word = piece.lower() if piece.isalnum() else "".join(filter(str.isalnum, piece)).lower()
    known[piece] = own = hash64(word, kind) if word else None
    return own


class TextFeatures:
    """Features of the prefixes of one text."""

    def __init__(self, text: str, expected: tuple[str, ...] = EXPECTED, hashed_by: str = "md5"):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes, n = codes, len(codes)
        self.cls = np.where(codes < 0x10000, class_table()[np.minimum(codes, 0xFFFF)], OTHER)
        for i in np.flatnonzero(codes >= 0x10000):
            self.cls[i] = 0 if text[i].isdigit() else OTHER
        self.expected = np.isin(np.arange(len(NAMES)), [NAMES.index(e) for e in expected])
        letter = (self.cls >= FIRST_SCRIPT) & (self.cls < OTHER)
        at = np.flatnonzero(letter)
        switched = np.zeros(n, np.int64)
        switched[at[1:][self.cls[at[1:]] != self.cls[at[:-1]]]] = 1
        self.switches = np.cumsum(switched)
        excluded = np.isin(codes, [ord(c) for c in RUN_EXCLUDED])
        breaks = np.r_[True, codes[1:] != codes[:-1]][:n] | excluded
        place = np.arange(n)
        self.longest = np.maximum.accumulate(place - np.maximum.accumulate(np.where(breaks, place, 0)) + 1) if n else place
        self.ids = numbered(codes)
        before = earlier(self.ids)
        self.surprise = surprises(self.ids, before)
        mean = mad = 0.0
        self.bases = [(0.0, 0.0)]  # after each of the first characters
        head = self.surprise[:BASELINE].tolist()
        for i, x in enumerate(head):
            if i:
                mad += ALPHA * (abs(x - mean) - mad)
            mean += (ALPHA if i else 1.0) * (x - mean)
            self.bases.append((mean, mad))
        self.new = np.cumsum(before == 0)
        counts: dict[str, int] = {}
        nth = np.zeros(max(0, (n - SHINGLE) // STRIDE + 1), np.int64)
        for j in range(len(nth)):
            s = text[STRIDE * j : STRIDE * j + SHINGLE]
            nth[j] = counts[s] = counts.get(s, 0) + 1
        self.repeats, self.most = np.cumsum(nth > 1), np.maximum.accumulate(nth) if len(nth) else nth
        stops = np.flatnonzero((self.cls == 1) | (self.cls == 2))
        begins = np.concatenate([np.zeros(1, np.int64), stops + 1])[: len(stops)]
        some = stops > begins
        ends, bits, known = [], [], _hashes.setdefault(hashed_by, {})
        for begin, e in zip(begins[some].tolist(), stops[some].tolist(), strict=True):
            piece = text[begin:e]
            own = known[piece] if piece in known else word_hash(piece, hashed_by)
            if own is not None:
                ends.append(e + 1)
                bits.append(own)
        self.word_ends = np.array(ends, np.int64)
        self.bits = np.array(bits, ">u8").view(np.uint8).reshape(-1, 8)

    def fingerprint(self, pos: int) -> tuple[np.ndarray, int]:
        k = int(np.searchsorted(self.word_ends, pos, side="right"))
        n = min(k, FINGERPRINT_WORDS)
        ones = np.unpackbits(self.bits[k - n : k], axis=1).sum(axis=0, dtype=np.int64)
        return 2 * ones > n, n

    def at(self, pos: int, deflate_pos: int | None = None, baseline_pos: int | None = None) -> dict[str, float]:
        """The feature vector of the first ``pos`` characters.

        deflate_pos: where the deflate ratio was last renewed (None: never); baseline_pos: where the
        fingerprint was frozen (None: not yet).
        """
        low = max(0, pos - WINDOW)
        window, n = self.text[low:pos], max(1, pos - low)
        of = np.bincount(self.cls[low:pos], minlength=len(NAMES))
        letters = of[FIRST_SCRIPT:OTHER].sum()
        alien = of[FIRST_SCRIPT:OTHER][~self.expected[FIRST_SCRIPT:OTHER]].sum()
        words = WORDS.findall(window)
        recent = self.surprise[max(0, pos - RECENT) : pos]
        now = float(recent.mean()) if len(recent) else 0.0
        mean, mad = self.bases[min(pos, BASELINE)]
        shingles = max(0, (pos - SHINGLE) // STRIDE + 1) if pos >= SHINGLE else 0
        counts = np.bincount(self.ids[low:pos])
        counts = counts[counts > 0]
        entropy = 1.0
        if counts.sum() >= 2:
            share = counts / counts.sum()
            entropy = float(-(share * np.log2(share)).sum() / np.log2(max(2, int(self.new[pos - 1]))))
        ratio = 1.0
        if deflate_pos is not None:
            raw = self.text[max(0, deflate_pos - WINDOW) : deflate_pos]
            if len(raw) >= 120:
                ratio = len(zlib.compress(raw.encode("utf-8", "ignore"), 6)) / len(raw.encode("utf-8", "ignore"))
        drift = 0.0
        if baseline_pos is not None and baseline_pos < pos:
            (a, na), (b, nb) = self.fingerprint(baseline_pos), self.fingerprint(pos)
            drift = float((a != b).mean()) if min(na, nb) >= LEAST_WORDS else 0.0
        return {
            "digit_frac": of[0] / n, "foreign_frac": alien / letters if letters else 0.0, "repeat_rate": float(self.repeats[shingles - 1] / shingles) if shingles else 0.0,
            "zlib_ratio": ratio, "ttr": len(set(words)) / len(words) if words else 1.0, "script_switch_rate": float(self.switches[pos - 1]) / pos * 100 if pos else 0.0,
            "structural_density": sum(len(p.findall(window)) for needed, p in TRACES if any(x in window for x in needed)) / max(1.0, n / 100), "symbol_frac": of[2] / n, "max_char_run": min(int(self.longest[pos - 1]), LONGEST_RUN) / LONGEST_RUN if pos else 0.0,
            "space_frac": of[1] / n, "surprise_z": (now - mean) / (1.4826 * mad + 1e-6) if pos >= 3 else 0.0,
            "surprise_low_frac": float((recent < max(0.5, mean - mad)).mean()) if len(recent) else 0.0, "simhash_drift": drift, "entropy": entropy,
            "max_shingle_count": min(int(self.most[shingles - 1]), MOST_SHINGLES) / MOST_SHINGLES if shingles else 0.0,
        }


def ramp(x: float, low: float, high: float) -> float:
    return min(1.0, max(0.0, (x - low) / (high - low)))


def fused_probability(f: dict[str, float]) -> float:
    """The fused score of a feature vector by the standard detectors, for probes inside a task."""
    rate = f["repeat_rate"]
    loop = rate > 0.55 and f["zlib_ratio"] < 0.32
    branches = [(f["digit_frac"] > 0.28, 0.7 + 0.3 * min(1.0, (f["digit_frac"] - 0.28) / 0.2)), (f["foreign_frac"] > 0.05, 0.7 + 0.3 * min(1.0, (f["foreign_frac"] - 0.05) / 0.25)), (loop, 0.85), (not loop and rate > 0.72, 0.75), (f["max_char_run"] >= 0.5, 0.7), (f["structural_density"] > 1.2, 0.75), (f["ttr"] < 0.22 and rate > 0.45, 0.7)]
    rules = max([p for on, p in branches if on], default=0.0)
    signs = sum(f[k] > v for k, v in (("digit_frac", 0.10), ("foreign_frac", 0.02), ("repeat_rate", 0.5), ("structural_density", 0.6), ("symbol_frac", 0.18)))
    if signs >= 3 and rules < 0.6:
        rules = 0.6
    ngram = max(ramp(f["surprise_z"], 3, 9), ramp(f["surprise_low_frac"], 0.85, 0.97) if rate > 0.4 else 0.0)
    sketch = min(1.0, ramp(rate, 0.55, 0.9) + (0.3 * ramp(f["max_shingle_count"], 0.3, 0.8) if rate > 0.5 else 0.0))
    flat = f["entropy"] < 0.45 and (f["digit_frac"] > 0.25 or rate > 0.5)
    scores = [rules, ngram, sketch, 0.6 * ramp(f["simhash_drift"], 0.42, 0.52), ramp(0.45 - f["entropy"], 0, 0.25) * 0.9 + 0.1 if flat else 0.0]
    return min(1.0, max(scores) + 0.12) if sum(s >= 0.5 for s in scores) >= 2 else max(scores)
