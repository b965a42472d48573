"""Features of a text that grows, in a state of bounded size.

What ``stream_kernel`` computes from a whole text is carried here from piece to piece: the last characters, the last
surprises, counts of contexts and shingles, a ring of word hashes. Counts are sorted arrays with a cap; a piece is
counted by sorting it once, so work follows the piece and the caps, never the text before it. Up to the caps the numbers are
those of the whole text. Beyond them a new context or gram counts as never seen, and a new shingle is counted by a
sketch that may overestimate.
"""

from __future__ import annotations

import json
import zlib

import numpy as np

from weirstream.functions.kernels import DEPTH, WIDTH
from weirstream.functions.stream_kernel import FIRST_SCRIPT, NAMES, OTHER, TRACES, WORDS, class_table, earlier, hash64
from weirstream.functions.text import EXPECTED, RUN_EXCLUDED
from weirstream.operators.sequence_features import ALPHA, BASELINE, FINGERPRINT_WORDS, LEAST_ALPHABET, LEAST_WORDS, LONGEST_RUN, MOST_SHINGLES, RECENT, SHINGLE, SMOOTHING, STRIDE, WEIGHTS
from weirstream.operators.streams import WINDOW

#: Contexts and grams of one order, shingles, characters told apart, letters of a word.
MOST_CONTEXTS, MOST_GRAMS, MOST_DISTINCT_SHINGLES, MOST_CHARACTERS, LONGEST_WORD = 60_000, 120_000, 65_536, 65_534, 4_096
#: No state is larger: twelve bytes for each count, the sketch, and the rest.
MOST_BYTES = 12 * (3 * (MOST_CONTEXTS + MOST_GRAMS) + MOST_DISTINCT_SHINGLES + MOST_CHARACTERS) + 4 * DEPTH * WIDTH + 4 * (WINDOW + LONGEST_WORD) + 8 * (RECENT + FINGERPRINT_WORDS) + 4_096
ORDERS = len(WEIGHTS) - 1


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return a ^ (a >> np.uint64(33))


class Counts:
    """Counts of at most ``most`` distinct 64-bit keys: the first that came."""

    def __init__(self, most: int, keys: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.most = most
        self.keys = np.zeros(0, np.uint64) if keys is None else keys
        self.counts = np.zeros(0, np.uint32) if counts is None else counts

    def add(self, keys: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """How often each key came before (0 if it isn't held), and whether it is held now. ``allowed``: may be taken in."""
        unique, first, of = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if allowed is not None:
            new = new[allowed[first[new]]]
        new = np.sort(new[np.argsort(first[new], kind="stable")][: max(0, self.most - len(self.keys))])
        held = known.copy()
        held[new] = True
        base, times = np.zeros(len(unique), np.int64), np.bincount(of, minlength=len(unique))
        base[known] = self.counts[at[known]]
        before = np.where(held[of], base[of] + earlier(of), 0)
        counts = self.counts.copy()
        counts[at[known]] += times[known].astype(np.uint32)
        self.keys = np.insert(self.keys, at[new], unique[new])
        self.counts = np.insert(counts, at[new], times[new].astype(np.uint32))
        return before, held[of]

    def pack(self) -> bytes:
        return self.keys.tobytes() + self.counts.tobytes()

    @classmethod
    def unpack(cls, most: int, data: bytes) -> Counts:
        n = len(data) // 12
        return cls(most, np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint32, n, 8 * n))


class Sketch:
    """Count-min counts of 64-bit keys, which add across pieces and streams."""

    def __init__(self, data: bytes | None = None):
        self.rows = np.zeros((DEPTH, WIDTH), np.uint32) if not data else np.frombuffer(data, np.uint32).reshape(DEPTH, WIDTH).copy()

    def add(self, keys: np.ndarray) -> np.ndarray:
        """The estimate of each key, itself included, as it is added."""
        found = np.full(len(keys), np.iinfo(np.int64).max)
        for r in range(DEPTH):
            column = (_mixed(keys + np.uint64((0x9E3779B97F4A7C15 * (r + 1)) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(WIDTH)).astype(np.int64)
            found = np.minimum(found, self.rows[r, column] + earlier(column) + 1)
            self.rows[r] += np.bincount(column, minlength=WIDTH).astype(np.uint32)
        return found

    def pack(self) -> bytes:
        return self.rows.tobytes() if self.rows.any() else b""


class GrowingFeatures:
    """``feed`` a piece, then ask ``at`` for features at its places; ``dump`` and ``load`` carry the state."""

    def __init__(self, expected: tuple[str, ...] = EXPECTED, hashed_by: str = "md5"):
        self.expected = np.isin(np.arange(len(NAMES)), [NAMES.index(e) for e in expected])
        self.hashed_by = hashed_by
        self.n = self.switches = self.run = self.longest = self.shingles = self.repeats = self.most = self.frozen_words = 0
        self.script, self.last, self.mean, self.mad, self.ratio = -1, -1, 0.0, 0.0, 1.0
        self.tail = self.word = ""
        self.recent, self.ring, self.frozen = np.zeros(0), np.zeros(0, np.uint64), None
        self.history = np.zeros(0, np.uint64)
        self.alphabet = Counts(MOST_CHARACTERS)
        self.ids = np.zeros(0, np.uint32)  # numbers of the alphabet's characters, by first use
        self.contexts = [Counts(MOST_CONTEXTS) for _ in range(ORDERS)]
        self.grams = [Counts(MOST_GRAMS) for _ in range(ORDERS)]
        self.counted, self.sketch = Counts(MOST_DISTINCT_SHINGLES), Sketch()
        self._new("")

    # ---- state ----

    NUMBERS = ("n", "switches", "run", "longest", "shingles", "repeats", "most", "frozen_words", "script", "last", "mean", "mad", "ratio", "tail", "word")

    def dump(self) -> dict[str, bytes]:
        """Parts of the state; those that a piece leaves alone stay as they were."""
        parts = {"numbers": json.dumps({k: getattr(self, k) for k in self.NUMBERS}, ensure_ascii=False).encode("utf-8", "surrogatepass")}
        parts |= {"recent": self.recent.tobytes(), "ring": self.ring.tobytes(), "history": self.history.tobytes(), "ids": self.ids.tobytes(), "frozen": b"" if self.frozen is None else np.packbits(self.frozen).tobytes()}
        parts |= {"alphabet": self.alphabet.pack(), "shingles": self.counted.pack(), "sketch": self.sketch.pack()}
        for k in range(ORDERS):
            parts |= {f"contexts{k + 1}": self.contexts[k].pack(), f"grams{k + 1}": self.grams[k].pack()}
        return parts

    @classmethod
    def load(cls, parts: dict[str, bytes], expected: tuple[str, ...] = EXPECTED, hashed_by: str = "md5") -> GrowingFeatures:
        out = cls(expected, hashed_by)
        for k, v in json.loads(parts["numbers"].decode("utf-8", "surrogatepass")).items():
            setattr(out, k, v)
        out.recent, out.ring, out.history, out.ids = np.frombuffer(parts["recent"]), np.frombuffer(parts["ring"], np.uint64), np.frombuffer(parts["history"], np.uint64), np.frombuffer(parts["ids"], np.uint32)
        out.frozen = np.unpackbits(np.frombuffer(parts["frozen"], np.uint8)).astype(bool) if parts["frozen"] else None
        out.alphabet, out.counted, out.sketch = Counts.unpack(MOST_CHARACTERS, parts["alphabet"]), Counts.unpack(MOST_DISTINCT_SHINGLES, parts["shingles"]), Sketch(parts["sketch"])
        out.contexts = [Counts.unpack(MOST_CONTEXTS, parts[f"contexts{k + 1}"]) for k in range(ORDERS)]
        out.grams = [Counts.unpack(MOST_GRAMS, parts[f"grams{k + 1}"]) for k in range(ORDERS)]
        out._new("")
        return out

    # ---- a piece ----

    def _new(self, piece: str) -> None:
        """The text in reach, and where the piece begins in it."""
        self.text, self.offset, self.begun = self.tail + piece, self.n - len(self.tail), self.n

    def feed(self, piece: str) -> None:
        self._new(piece)
        self.before = {k: getattr(self, k) for k in ("switches", "longest", "repeats", "most")}
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.cls = np.where(codes < 0x10000, class_table()[np.minimum(codes, 0xFFFF)], OTHER)
        for i in np.flatnonzero(codes >= 0x10000):
            self.cls[i] = 0 if self.text[i].isdigit() else OTHER
        own = len(self.tail)
        self.codes = codes
        self._letters(self.cls[own:])
        self._runs(codes[own:])
        self._surprises(codes[own:])
        self._shingles(codes)
        self._words(piece, self.cls[own:])
        self.n += len(piece)
        self.tail = self.text[-WINDOW:]

    def _letters(self, cls: np.ndarray) -> None:
        at = np.flatnonzero((cls >= FIRST_SCRIPT) & (cls < OTHER))
        switched = np.zeros(len(cls), np.int64)
        if len(at):
            previous = np.concatenate([[self.script], cls[at[:-1]]])
            switched[at[(previous != cls[at]) & (previous >= 0)]] = 1
            self.script = int(cls[at[-1]])
        self.switched = self.switches + np.cumsum(switched)
        self.switches += int(switched.sum())

    def _runs(self, codes: np.ndarray) -> None:
        n = len(codes)
        self.longest_at = np.zeros(0, np.int64)
        if not n:
            return
        excluded = np.isin(codes, [ord(c) for c in RUN_EXCLUDED])
        breaks = np.concatenate([[codes[0] != self.last], codes[1:] != codes[:-1]]) | excluded
        place = np.arange(n)
        length = place - np.maximum.accumulate(np.where(breaks, place, -self.run)) + 1
        self.longest_at = np.maximum(np.maximum.accumulate(length), self.longest)
        self.run, self.longest, self.last = int(length[-1]), int(self.longest_at[-1]), int(codes[-1])

    def _surprises(self, codes: np.ndarray) -> None:
        n = len(codes)
        distinct = self.known = len(self.alphabet.keys)
        before, held = self.alphabet.add(codes.astype(np.uint64))
        fresh = held & (before == 0)
        if len(self.alphabet.keys) > distinct:  # numbers by first use, kept beside the sorted characters
            number = distinct + np.cumsum(fresh) - 1
            new = codes[fresh]
            at = np.searchsorted(self.alphabet.keys, new.astype(np.uint64))
            ids = np.zeros(len(self.alphabet.keys), np.uint32)
            old = np.ones(len(ids), bool)
            old[at] = False
            ids[old], ids[at] = self.ids, number[fresh]
            self.ids = ids
        self.distinct = distinct + np.cumsum(fresh)
        # one number for all characters beyond the cap; 0 stands for no character
        symbol = np.full(n, MOST_CHARACTERS + 1, np.uint64)
        symbol[held] = self.ids[np.searchsorted(self.alphabet.keys, codes[held].astype(np.uint64))].astype(np.uint64) + np.uint64(1)
        v = SMOOTHING * np.maximum(LEAST_ALPHABET, self.distinct - fresh + 1)
        line = np.concatenate([self.history, symbol])
        start, p = len(self.history), WEIGHTS[ORDERS] * (before + SMOOTHING) / (np.arange(self.n, self.n + n) + v)
        place = np.arange(start, start + n)
        for k in range(1, ORDERS + 1):
            context = np.zeros(n, np.uint64)
            for j in range(k, 0, -1):
                there = place >= j
                context = context << np.uint64(16)
                context[there] |= line[place[there] - j]
            for i in range(max(0, min(n, k - self.n))):  # short history: the last min(i, k - i) characters
                at = self.n + i
                context[i] = 0
                for c in line[at - min(at, k - at) : at]:
                    context[i] = (context[i] << np.uint64(16)) | c
            total, recorded = self.contexts[k - 1].add(context)
            # a context of three and its character fill 64 bits
            count, _ = self.grams[k - 1].add((context << np.uint64(16)) | symbol, recorded)
            p += WEIGHTS[ORDERS - k] * (count + SMOOTHING) / (total + v)
        new = -np.log2(np.clip(p, 1e-9, 1.0))
        self.bases = []
        for i, x in enumerate(new[: max(0, BASELINE - self.n)].tolist(), self.n):
            if i:
                self.mad += ALPHA * (abs(x - self.mean) - self.mad)
            self.mean += (ALPHA if i else 1.0) * (x - self.mean)
            self.bases.append((self.mean, self.mad))
        self.surprise, self.surprise_from = np.concatenate([self.recent, new]), self.n - len(self.recent)
        self.recent, self.history = self.surprise[-RECENT:], line[-ORDERS:]

    def _shingles(self, codes: np.ndarray) -> None:
        """Those that end in the piece; ``codes`` go back far enough."""
        ends = np.arange(max(SHINGLE, self.n + 1), self.n + len(codes) - len(self.tail) + 1)
        ends = ends[(ends - SHINGLE) % STRIDE == 0]
        begin = ends - SHINGLE - self.offset
        key = np.zeros(len(ends), np.uint64)
        for j in range(SHINGLE):
            key = _mixed(key * np.uint64(0x100000001B3) + codes[begin + j].astype(np.uint64) + np.uint64(1))
        before, held = self.counted.add(key)
        nth = before + 1
        if not held.all():
            nth[~held] = self.sketch.add(key[~held])
        self.shingle_from = self.shingles
        self.repeats_at, self.most_at = self.repeats + np.cumsum(nth > 1), np.maximum(np.maximum.accumulate(nth), self.most) if len(nth) else nth
        self.shingles += len(nth)
        self.repeats, self.most = (int(self.repeats_at[-1]), int(self.most_at[-1])) if len(nth) else (self.repeats, self.most)

    def _words(self, piece: str, cls: np.ndarray) -> None:
        ends, hashes, begin, known = [], [], 0, {}
        for stop in np.flatnonzero((cls == 1) | (cls == 2)).tolist():
            letters = "".join(filter(str.isalnum, piece[begin:stop]))
            word = (self.word + letters)[:LONGEST_WORD].lower()
            if word:
                if word not in known:
                    known[word] = hash64(word, self.hashed_by)
                ends.append(self.n + stop + 1)
                hashes.append(known[word])
            self.word, begin = "", stop + 1
        self.word = (self.word + "".join(filter(str.isalnum, piece[begin:])))[:LONGEST_WORD]
        self.word_ends = np.array(ends, np.int64)
        self.words = np.concatenate([self.ring, np.array(hashes, np.uint64)])
        self.words_before = len(self.ring)
        self.ring = self.words[-FINGERPRINT_WORDS:]

    # ---- features ----

    def fingerprint(self, pos: int) -> tuple[np.ndarray, int]:
        k = self.words_before + int(np.searchsorted(self.word_ends, pos, side="right"))
        own = self.words[max(0, k - FINGERPRINT_WORDS) : k]
        ones = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        return 2 * ones > len(own), len(own)

    def freeze(self, pos: int) -> None:
        """The fingerprint at a place of the piece is what later ones are held against."""
        self.frozen, self.frozen_words = self.fingerprint(pos)

    def renew(self, pos: int) -> None:
        """The deflate ratio of the window before a place of the piece."""
        end = pos - self.offset
        raw = self.text[max(0, end - WINDOW) : end]
        if len(raw) >= 120:
            raw = raw.encode("utf-8", "ignore")
            self.ratio = len(zlib.compress(raw, 6)) / len(raw)

    def at(self, pos: int) -> dict[str, float]:
        """The feature vector of the first ``pos`` characters, a place in the last piece or its begin, by the ratio and the
        frozen fingerprint as they are."""
        end, own = pos - self.offset, pos - self.begun - 1
        low = max(0, end - WINDOW)
        window, n = self.text[low:end], max(1, end - low)
        of = np.bincount(self.cls[low:end], minlength=len(NAMES))
        letters = of[FIRST_SCRIPT:OTHER].sum()
        alien = of[FIRST_SCRIPT:OTHER][~self.expected[FIRST_SCRIPT:OTHER]].sum()
        words = WORDS.findall(window)
        last = pos - self.surprise_from
        recent = self.surprise[max(0, last - RECENT) : last]
        now = float(recent.mean()) if len(recent) else 0.0
        shingles = (pos - SHINGLE) // STRIDE + 1 if pos >= SHINGLE else 0
        j = shingles - 1 - self.shingle_from
        distinct, switches, longest = (int(self.distinct[own]), int(self.switched[own]), int(self.longest_at[own])) if own >= 0 else (self.known, self.before["switches"], self.before["longest"])
        mean, mad = self.bases[pos - 1 - self.begun] if 0 <= own < len(self.bases) else (self.mean, self.mad)
        repeats, most = (int(self.repeats_at[j]), int(self.most_at[j])) if shingles and j >= 0 else (self.before["repeats"], self.before["most"])
        counts = np.unique(self.codes[low:end], return_counts=True)[1]
        entropy = 1.0
        if counts.sum() >= 2:
            share = counts / counts.sum()
            entropy = float(-(share * np.log2(share)).sum() / np.log2(max(2, distinct)))
        drift = 0.0
        if self.frozen is not None:
            bits, count = self.fingerprint(pos)
            drift = float((bits != self.frozen).mean()) if min(count, self.frozen_words) >= LEAST_WORDS else 0.0
        return {
            "digit_frac": of[0] / n, "foreign_frac": alien / letters if letters else 0.0, "repeat_rate": repeats / shingles if shingles else 0.0,
            "zlib_ratio": self.ratio, "ttr": len(set(words)) / len(words) if words else 1.0, "script_switch_rate": switches / pos * 100,
            "structural_density": sum(len(p.findall(window)) for needed, p in TRACES if any(x in window for x in needed)) / max(1.0, n / 100), "symbol_frac": of[2] / n,
            "max_char_run": min(longest, LONGEST_RUN) / LONGEST_RUN, "space_frac": of[1] / n,
            "surprise_z": (now - mean) / (1.4826 * mad + 1e-6) if pos >= 3 else 0.0,
            "surprise_low_frac": float((recent < max(0.5, mean - mad)).mean()) if len(recent) else 0.0, "simhash_drift": drift, "entropy": entropy,
            "max_shingle_count": min(most, MOST_SHINGLES) / MOST_SHINGLES if shingles else 0.0,
        }
