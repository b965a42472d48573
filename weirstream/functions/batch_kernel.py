"""The features of many texts at many positions at once, by numpy: what ``stream_kernel`` gives for one text.

Texts lie end to end in one array and every key carries the number of its text, so a sort or a running sum is one call for
all texts of an Arrow piece. Only what is asked for is computed.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cached_property, lru_cache

import numpy as np

from weirstream.functions import stream_kernel as one
from weirstream.functions.kernels import DEPTH, SEED, WIDTH
from weirstream.functions.stream_kernel import FIRST_SCRIPT, NAMES, OTHER, TRACES, class_table, numbered, word_hash
from weirstream.functions.text import EXPECTED, RUN_EXCLUDED
from weirstream.operators.sequence_features import ALPHA, BASELINE, FINGERPRINT_WORDS, LEAST_ALPHABET, LEAST_WORDS, LONGEST_RUN, MOST_SHINGLES, RECENT, SHINGLE, SMOOTHING, STRIDE, WEIGHTS
from weirstream.operators.streams import WINDOW

#: Bytes of the texts that are scored together, unless one is longer; cells of a table of character counts.
PIECE_BYTES, CELLS = 75_000, 1 << 20


def is_letter(ch: str) -> bool:
    return ch.isalnum() and not ch.isdecimal()


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether a character of the basic plane is one of a word."""
    return np.array([is_letter(chr(o)) for o in range(0x10000)])


def ranked(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each place, how often its value (none negative) came before, and a number below their count for each value, in order."""
    n = len(groups)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits, place = max(1, int(n - 1).bit_length()), np.arange(n)
    if int(groups.max()) < 1 << (63 - bits):
        packed = groups << bits  # value and place as one number: a plain sort is stable
        packed |= place
        packed.sort()
        order = packed & ((1 << bits) - 1)
        packed >>= bits
    else:
        order = np.argsort(groups, kind="stable")
        packed = groups[order]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(packed[1:], packed[:-1], out=first[1:])
    begins = np.maximum.accumulate(place * first)  # where a value begins in the order
    count, number = np.empty(n, np.int64), np.empty(n, np.int64)
    number[order] = begins
    count[order] = place - begins
    return count, number


def summed(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def ramp(x: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.minimum(1.0, np.maximum(0.0, (x - low) / (high - low)))


def shares(digit: np.ndarray, foreign: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The branches of the rules that shares of digits and of foreign letters decide: whether and how strong."""
    return [(x > bar, np.where(x > bar, 0.7 + 0.3 * np.minimum(1.0, (x - bar) / width), 0.0)) for x, bar, width in ((digit, 0.28, 0.2), (foreign, 0.05, 0.25))]


class TextBatch:
    """Texts, none of them empty."""

    def __init__(self, texts: list[str], expected: tuple[str, ...] = EXPECTED, hashed_by: str = "md5"):
        self.texts, self.expected, self.hashed_by = texts, expected, hashed_by
        self.whole = "".join(texts)
        self.codes = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.own = np.repeat(np.arange(len(texts)), self.size)

    @cached_property
    def local(self) -> np.ndarray:
        return np.arange(len(self.codes)) - self.start[self.own]

    @cached_property
    def cls(self) -> np.ndarray:
        out = class_table()[np.minimum(self.codes, 0xFFFF)]
        high = np.flatnonzero(self.codes >= 0x10000)
        if len(high):
            distinct, at = np.unique(self.codes[high], return_inverse=True)
            out[high] = np.array([0 if chr(c).isdigit() else OTHER for c in distinct.tolist()], np.uint8)[at]
        return out

    def most_so_far(self, values: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The largest value of a text up to each place."""
        top = int(values.max(initial=0)) + 1
        return np.maximum.accumulate(own * top + values) - own * top

    @cached_property
    def switched(self) -> np.ndarray:
        """Sums of changes of script between successive letters."""
        at = np.flatnonzero((self.cls >= FIRST_SCRIPT) & (self.cls < OTHER))
        out = np.zeros(len(self.codes), np.int64)
        out[at[1:][(self.cls[at[1:]] != self.cls[at[:-1]]) & (self.own[at[1:]] == self.own[at[:-1]])]] = 1
        return summed(out)

    @cached_property
    def longest(self) -> np.ndarray:
        """The longest run of one character so far."""
        excluded = np.isin(self.codes, np.array([ord(c) for c in RUN_EXCLUDED], np.uint32))
        breaks = np.r_[True, self.codes[1:] != self.codes[:-1]] | excluded
        breaks[self.start] = True
        place = np.arange(len(self.codes))
        return self.most_so_far(place - np.maximum.accumulate(np.where(breaks, place, 0)) + 1, self.own)

    @cached_property
    def ids(self) -> np.ndarray:
        return numbered(self.codes)

    @cached_property
    def alone(self) -> tuple[np.ndarray, np.ndarray]:
        return ranked(self.own * (int(self.ids.max()) + 1) + self.ids)

    @cached_property
    def seen(self) -> np.ndarray:
        """Distinct characters of a text up to each place."""
        total = summed(self.alone[0] == 0)
        return total[1:] - total[self.start][self.own]

    @cached_property
    def runs(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For runs of 2, 3, ... characters: how often the run that ends at a place came before, and its number.

        A run's number and the next character name the run that is one longer. A run that began before its text would be
        another's, so it has a name of its own and never came before.
        """
        out, number, size, n = [], self.alone[1], int(self.ids.max()) + 1, len(self.codes)
        for k in range(1, len(WEIGHTS)):
            name = self.ids.copy()
            name[1:] += number[:-1] * size
            at = np.flatnonzero(self.local < k)
            name[at] = n * size + at
            count, number = ranked(name)
            out.append((count, number))
        return out

    @cached_property
    def surprise(self) -> np.ndarray:
        """Bits of each character under the interpolated online model of those before it in its text."""
        before = self.alone[0]
        v = SMOOTHING * np.maximum(LEAST_ALPHABET, self.seen - (before == 0) + 1)
        p = WEIGHTS[-1] * (before + SMOOTHING) / (self.local + v)
        last = before
        for k, (weight, (grams, _)) in enumerate(zip(list(reversed(WEIGHTS))[1:], self.runs, strict=True), 1):
            contexts = np.zeros(len(p), np.int64)
            contexts[1:] = last[:-1]  # how often the run that ends in front of a character came before
            contexts[self.local < k] = 0
            last = grams
            # with fewer characters than k in front, the context is the last min(i, k - i) of them: only the third character
            # of a text can meet that of the second again
            if k == 3:
                at = self.start[self.size > 2] + 2
                same = self.codes[at - 1] == self.codes[at - 2]
                grams = grams.copy()
                contexts[at], grams[at] = same, same & (self.codes[at] == self.codes[at - 1])
            p += weight * (grams + SMOOTHING) / (contexts + v)
        return -np.log2(np.clip(p, 1e-9, 1.0))

    def baselines(self, of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Moving mean and deviation after the first ``n`` (at most BASELINE) characters of the texts ``of``."""
        by_size = np.argsort(-self.size, kind="stable")
        row = np.empty(len(by_size), np.int64)
        row[by_size] = np.arange(len(by_size))
        starts, sizes = self.start[by_size], self.size[by_size]
        mean, mad = np.zeros(len(starts)), np.zeros(len(starts))
        found = np.zeros(len(n)), np.zeros(len(n))
        asked, order = np.minimum(n, BASELINE), np.argsort(np.minimum(n, BASELINE), kind="stable")
        cuts = np.searchsorted(asked[order], np.arange(BASELINE + 2)).tolist()
        place = np.arange(int(asked.max(initial=0)))
        living = np.searchsorted(-sizes, -place).tolist()  # texts with more than i characters
        heads = self.surprise[np.minimum(starts + place[:, None], len(self.surprise) - 1)]
        off, far = np.empty(len(starts)), np.empty(len(starts))
        for i, live in enumerate(living):
            x, m, d, t, u = heads[i, :live], mean[:live], mad[:live], off[:live], far[:live]
            np.subtract(x, m, out=t)
            if i:
                np.abs(t, out=u)
                u -= d
                u *= ALPHA
                d += u
                t *= ALPHA
            m += t
            if cuts[i + 1] < cuts[i + 2]:
                here = order[cuts[i + 1] : cuts[i + 2]]
                found[0][here], found[1][here] = mean[row[of[here]]], mad[row[of[here]]]
        return found

    @cached_property
    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a text's shingles begin in the list of all, sums of repeated ones, the highest count so far.

        A shingle is three runs of four characters that lie end to end; their numbers are compared, no hash.
        """
        assert SHINGLE == 3 * len(WEIGHTS)
        many = np.maximum(0, (self.size - SHINGLE) // STRIDE + 1)
        of = np.repeat(np.arange(len(many)), many)
        first = np.cumsum(many) - many
        at = self.start[of] + STRIDE * (np.arange(len(of)) - first[of])
        fours, n = self.runs[-1][1], len(self.codes)
        _, eights = ranked(fours[at + 3] * n + fours[at + 7])
        nth = ranked(eights * n + fours[at + 11])[0] + 1
        return first, summed(nth > 1), self.most_so_far(nth, of)

    def blanked(self, keep: np.ndarray) -> str:
        """All texts with a blank for each character that is not kept."""
        return np.where(keep, self.codes, np.uint32(32)).tobytes().decode("utf-32-le", "surrogatepass")

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Where words end, and sums (modulo 256) of the bits of their hashes."""
        stop = (self.cls == 1) | (self.cls == 2)
        stops = np.flatnonzero(stop)
        of = self.own[stops]
        begins = np.maximum(np.r_[0, stops[:-1] + 1][: len(stops)], self.start[of])
        some = stops > begins
        many = np.bincount(of[some], minlength=len(self.size)).tolist()  # a text's last word may lack a separator behind it
        plain, pieces = self.blanked(~stop), []
        for n, a, e in zip(many, self.start.tolist(), self.end.tolist(), strict=True):
            pieces += plain[a:e].split()[:n]
        known = one._hashes.setdefault(self.hashed_by, {})
        hashes = [known[p] if p in known else word_hash(p, self.hashed_by) for p in pieces]
        good = np.ones(len(hashes), bool)
        if None in hashes:
            good = np.array([h is not None for h in hashes], bool)
            hashes = [h for h in hashes if h is not None]
        sums = np.zeros((len(hashes) + 1, 64), np.uint8)
        np.cumsum(np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint8, out=sums[1:])
        return stops[some][good] + 1, sums

    def token_ratios(self, of: np.ndarray, low: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Distinct among all words, of two letters and more, of each window."""
        letter = letter_table()[np.minimum(self.codes, 0xFFFF)]
        high = np.flatnonzero(self.codes >= 0x10000)
        if len(high):
            distinct, at = np.unique(self.codes[high], return_inverse=True)
            letter[high] = np.array([is_letter(chr(c)) for c in distinct.tolist()], bool)[at]
        plain, out = self.blanked(letter), np.ones(len(of))
        for i, (a, e) in enumerate(zip((self.start[of] + low).tolist(), (self.start[of] + pos).tolist(), strict=True)):
            words = [w for w in plain[a:e].split() if len(w) > 1]
            if words:
                out[i] = len(set(words)) / len(words)
        return out

    def fingerprints(self, of: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of the majority of the last words before each position, and how many words these are."""
        ends, sums = self.words
        k = np.searchsorted(ends, self.start[of] + pos, side="right")
        n = np.minimum(k - np.searchsorted(ends, self.start[of], side="right"), FINGERPRINT_WORDS)
        ones = (sums[k] - sums[k - n]).astype(np.int64)  # fewer than 256 words
        return 2 * ones > n[:, None], n

    def entropies(self, of: np.ndarray, low: np.ndarray, pos: np.ndarray) -> np.ndarray:
        n, count = pos - low, self.seen
        # a character is numbered by when it was first seen in its text
        at_first = np.flatnonzero(self.alone[0] == 0)
        by_number = np.zeros(len(self.codes), np.int64)
        by_number[self.alone[1][at_first]] = count[at_first] - 1
        own = by_number[self.alone[1]]
        size = int(own.max()) + 1
        out = np.ones(len(of))
        step = max(1, CELLS // max(size, WINDOW))
        for a in range(0, len(of), step):
            m = n[a : a + step]
            begins = np.cumsum(m) - m
            at = np.repeat(self.start[of[a : a + step]] + low[a : a + step] - begins, m) + np.arange(int(m.sum()))
            counts = np.bincount(own[at] + np.repeat(np.arange(len(m)) * size, m), minlength=len(m) * size)
            some = np.flatnonzero(counts)
            share = counts[some] / m[some // size]
            out[a : a + step] = -np.bincount(some // size, share * np.log2(share), len(m))
        alphabet = self.seen[self.start[of] + pos - 1]
        return np.where(n < 2, 1.0, out / np.log2(np.maximum(2, alphabet)))

    def recent(self, of: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean of the last surprises, and the share of them that is low against the baseline."""
        mean, mad = self.baselines(of, pos)
        bar, now, low = np.maximum(0.5, mean - mad), np.zeros(len(of)), np.zeros(len(of))
        full = np.flatnonzero(pos >= RECENT)
        for at in np.array_split(full, max(1, len(full) * RECENT // CELLS)):
            if len(at):
                x = np.lib.stride_tricks.sliding_window_view(self.surprise, RECENT)[self.start[of[at]] + pos[at] - RECENT]
                now[at], low[at] = x.mean(axis=1), (x < bar[at, None]).mean(axis=1)
        for i in np.flatnonzero(pos < RECENT).tolist():
            x = self.surprise[self.start[of[i]] : self.start[of[i]] + pos[i]]
            if len(x):
                now[i], low[i] = x.mean(), (x < bar[i]).mean()
        z = np.where(pos >= 3, (now - mean) / (1.4826 * mad + 1e-6), 0.0)
        return z, low

    def at(self, of: np.ndarray, pos: np.ndarray, deflated: np.ndarray | None, frozen: np.ndarray, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
        """Feature columns of the first ``pos`` (1 or more) characters of the texts number ``of``, in order of ``of``.

        deflated: where the deflate ratio was last renewed (-1: never; None: no ratios are asked for); frozen: where the
        fingerprint was frozen (-1: not yet).
        """
        asked, out, texts = set(columns), {}, self.texts
        low = np.maximum(0, pos - WINDOW)
        a, e, n = self.start[of] + low, self.start[of] + pos, pos - low
        in_window = lambda mask: (lambda s: s[e] - s[a])(summed(mask))
        for name, number in (("digit_frac", 0), ("space_frac", 1), ("symbol_frac", 2)):
            if name in asked:
                out[name] = in_window(self.cls == number) / n
        if "foreign_frac" in asked:
            alien = np.array([i >= FIRST_SCRIPT and i < OTHER and name not in self.expected for i, name in enumerate(NAMES)])
            letters = in_window((self.cls >= FIRST_SCRIPT) & (self.cls < OTHER))
            out["foreign_frac"] = in_window(alien[self.cls]) / np.maximum(1, letters)
        if "script_switch_rate" in asked:
            out["script_switch_rate"] = (self.switched[e] - self.switched[self.start[of]]) / pos * 100
        if "max_char_run" in asked:
            out["max_char_run"] = np.minimum(self.longest[e - 1], LONGEST_RUN) / LONGEST_RUN
        if asked & {"repeat_rate", "max_shingle_count"}:
            first, repeats, most = self.shingles
            many = np.maximum(0, (pos - SHINGLE) // STRIDE + 1)
            out["repeat_rate"] = (repeats[first[of] + many] - repeats[first[of]]) / np.maximum(1, many)
            top = np.r_[most, 0][first[of] + many - 1]
            out["max_shingle_count"] = np.where(many > 0, np.minimum(top, MOST_SHINGLES) / MOST_SHINGLES, 0.0)
        if asked & {"surprise_z", "surprise_low_frac"}:
            out["surprise_z"], out["surprise_low_frac"] = self.recent(of, pos)
        if "entropy" in asked:
            out["entropy"] = self.entropies(of, low, pos)
        if "simhash_drift" in asked:
            later = np.flatnonzero((frozen >= 0) & (frozen < pos))
            out["simhash_drift"] = np.zeros(len(of))
            if len(later):
                (x, nx), (y, ny) = self.fingerprints(of[later], frozen[later]), self.fingerprints(of[later], pos[later])
                out["simhash_drift"][later] = np.where(np.minimum(nx, ny) >= LEAST_WORDS, (x != y).mean(axis=1), 0.0)
        if "ttr" in asked:
            out["ttr"] = self.token_ratios(of, low, pos)
        if "structural_density" in asked:
            present = [([x for x in needed if x in self.whole], p) for needed, p in TRACES]
            present = [(needed, p) for needed, p in present if needed]
            found = [[p for needed, p in present if any(x in t for x in needed)] for t in texts]
            traces = np.zeros(len(of))
            for i in np.flatnonzero(np.array([bool(f) for f in found], bool)[of]).tolist():
                window = texts[of[i]][low[i] : pos[i]]
                traces[i] = sum(len(p.findall(window)) for p in found[of[i]])
            out["structural_density"] = traces / np.maximum(1.0, n / 100)
        if "zlib_ratio" in asked:
            out["zlib_ratio"] = np.ones(len(of))
            for i, (t, d) in enumerate(zip(of.tolist(), deflated.tolist(), strict=True) if deflated is not None else ()):
                raw = texts[t][max(0, d - WINDOW) : d] if d >= 0 else ""
                if len(raw) >= 120:
                    raw = raw.encode("utf-8", "ignore")
                    out["zlib_ratio"][i] = len(zlib.compress(raw, 6)) / len(raw)
        return {c: out[c] for c in columns}

    def sure(self, of: np.ndarray, pos: np.ndarray, at_least: float) -> np.ndarray:
        """Whether digits or foreign letters alone give the rules a score of ``at_least`` or more."""
        f = self.at(of, pos, None, np.full(len(of), -1), ("digit_frac", "foreign_frac"))
        return np.maximum(*(strength for _, strength in shares(f["digit_frac"], f["foreign_frac"]))) >= at_least

    def at_least(self, of: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """What the fused score is at least, by features that no character far before has a part in."""
        f = self.at(of, pos, None, np.full(len(of), -1), ("digit_frac", "foreign_frac", "structural_density", "max_char_run"))
        return np.max([*(p for _, p in shares(f["digit_frac"], f["foreign_frac"])), np.where(f["max_char_run"] >= 0.5, 0.7, 0.0), np.where(f["structural_density"] > 1.2, 0.75, 0.0)], axis=0)

    def fused(self, of: np.ndarray, pos: np.ndarray, deflated: np.ndarray, frozen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The fused score and that of the rules, as the standard detectors give them for the features of ``at``.

        Deflate ratio, words and entropy count only beside repeats (or digits), so they are computed where these are found.
        """
        f = self.at(of, pos, None, frozen, ("digit_frac", "foreign_frac", "repeat_rate", "structural_density", "symbol_frac", "max_char_run", "surprise_z", "surprise_low_frac", "simhash_drift", "max_shingle_count"))
        digit, foreign, rate, density = (f[c] for c in ("digit_frac", "foreign_frac", "repeat_rate", "structural_density"))

        def where(on: np.ndarray, column: str) -> np.ndarray:
            out, at = np.ones(len(of)), np.flatnonzero(on)
            if len(at):
                out[at] = self.at(of[at], pos[at], deflated[at], frozen[at], (column,))[column]
            return out

        loop = (rate > 0.55) & (where(rate > 0.55, "zlib_ratio") < 0.32)
        branches = [*shares(digit, foreign), (loop, 0.85), (~loop & (rate > 0.72), 0.75), (f["max_char_run"] >= 0.5, 0.7), (density > 1.2, 0.75), ((rate > 0.45) & (where(rate > 0.45, "ttr") < 0.22), 0.7)]
        rules = np.max([np.where(on, p, 0.0) for on, p in branches], axis=0)
        signs = sum((x > bar).astype(int) for x, bar in ((digit, 0.10), (foreign, 0.02), (rate, 0.5), (density, 0.6), (f["symbol_frac"], 0.18)))
        rules = np.where((signs >= 3) & (rules < 0.6), 0.6, rules)
        ngram = np.maximum(ramp(f["surprise_z"], 3, 9), np.where(rate > 0.4, ramp(f["surprise_low_frac"], 0.85, 0.97), 0.0))
        sketch = np.minimum(1.0, ramp(rate, 0.55, 0.9) + np.where(rate > 0.5, 0.3 * ramp(f["max_shingle_count"], 0.3, 0.8), 0.0))
        few = (digit > 0.25) | (rate > 0.5)
        entropy = where(few, "entropy")
        flat = np.where(few & (entropy < 0.45), ramp(0.45 - entropy, 0, 0.25) * 0.9 + 0.1, 0.0)
        scores = np.stack([rules, ngram, sketch, 0.6 * ramp(f["simhash_drift"], 0.42, 0.52), flat])
        best = scores.max(axis=0)
        return np.where((scores >= 0.5).sum(axis=0) >= 2, np.minimum(1.0, best + 0.12), best), rules

    def totals(self, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
        """Of whole texts: n, switches, longest_run, mean_bits, most_bits; mean and mad of the first surprises."""
        asked, out = set(columns), {"n": self.size}
        if "switches" in asked:
            out["switches"] = self.switched[self.end] - self.switched[self.start]
        if "longest_run" in asked:
            out["longest_run"] = self.longest[self.end - 1]
        if "mean_bits" in asked:
            out["mean_bits"] = np.add.reduceat(self.surprise, self.start) / self.size
        if "most_bits" in asked:
            out["most_bits"] = np.maximum.reduceat(self.surprise, self.start)
        if asked & {"mean", "mad"}:
            out["mean"], out["mad"] = self.baselines(np.arange(len(self.size)), self.size)
        return {c: out[c] for c in columns}


def keyed_hashes(items: list[bytes], seed: int) -> np.ndarray:
    """``kernels.blake64`` of many under one seed that is not 0."""
    copy, out = hashlib.blake2b(digest_size=8, key=seed.to_bytes(8, "little")).copy, []
    for item in items:
        own = copy()
        own.update(item)
        out.append(own.digest())
    return np.frombuffer(b"".join(out), "<u8")


def sketch_counts(texts: list[str]) -> np.ndarray:
    """``kernels.sketch_counts`` of each text (total, repeats, most), of many at once.

    A cell's count when a shingle comes is how often its row and column came before in the text.
    """
    many = [max(0, (len(t) - SHINGLE) // STRIDE + 1) for t in texts]
    each = [t[i : i + SHINGLE] for t, n in zip(texts, many, strict=True) for i in range(0, STRIDE * n, STRIDE)]
    numbers: dict[str, int] = {}
    at = np.array([numbers.setdefault(s, len(numbers)) for s in each], np.int64)
    of, estimate, items = np.repeat(np.arange(len(texts)), many), None, [s.encode() for s in numbers]
    for r in range(DEPTH):
        cols = (keyed_hashes(items, SEED * (r + 1) & 0xFFFFFFFF) % WIDTH).astype(np.int64)
        count = ranked(of * WIDTH + cols[at])[0] + 1 if len(at) else at
        estimate = count if estimate is None else np.minimum(estimate, count)
    out = np.zeros((len(texts), 3), np.int64)
    out[:, 0] = many
    np.add.at(out[:, 1], of, estimate >= 2)
    np.maximum.at(out[:, 2], of, estimate)
    return out
