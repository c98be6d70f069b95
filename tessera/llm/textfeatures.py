"""Hashed word and character n-gram features of whole texts, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from tessera.llm.common import U64, Rolling, byte_values, mix, word_spans

#: Slots of the two feature spaces (words and word pairs; characters).
WORD_SLOTS = 1 << 18
CHAR_SLOTS = 1 << 16
CHAR_GRAM = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hashed(raw: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(text, slot) of each distinct word and word pair, the slots of all character
    4-grams with the number before each text, and the number of words."""
    starts, ends, before = word_spans(raw, offsets)
    low = _LOWER[raw]
    strip = np.isin(low, np.frombuffer(b".,;:!?\"'()", np.uint8))
    s, e = starts.copy(), ends.copy()
    for _ in range(2):  # punctuation at either end of a word is no part of its feature
        cut = (s < e) & strip[np.minimum(s, len(raw) - 1)] if len(raw) else np.zeros(0, bool)
        s[cut] += 1
        cut = (s < e) & strip[e - 1]
        e[cut] -= 1
    roll = Rolling(byte_values(low))
    h = roll.of(s, e)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    pair = mix(h[:-1] * U64(31) + h[1:])[text[:-1] == text[1:]] if len(h) > 1 else h[:0]
    owner = np.concatenate([text, text[:-1][text[:-1] == text[1:]]]) if len(h) > 1 else text
    slots = np.concatenate([h, pair]) >> U64(64 - 18)
    code = np.unique(owner.astype(np.int64) * WORD_SLOTS + slots.astype(np.int64))
    word = (code // WORD_SLOTS, code % WORD_SLOTS)
    n = len(raw)
    if n < CHAR_GRAM:
        return word, (np.empty(0, np.int64), np.zeros(len(offsets), np.int64)), np.diff(before)
    value = raw.astype(np.uint32)
    gram = value[: n - 3].copy()
    for k in range(1, CHAR_GRAM):
        gram = gram * np.uint32(0x01000193) ^ value[k : n - 3 + k]
    gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(16)
    counts = np.maximum(np.diff(offsets) - (CHAR_GRAM - 1), 0)
    first = np.cumsum(counts) - counts
    index = np.repeat(offsets[:-1] - first, counts) + np.arange(counts.sum())
    return word, (gram[index].astype(np.int64), np.r_[first, counts.sum()]), np.diff(before)


def dot(features, word_weights: np.ndarray, char_weights: np.ndarray) -> np.ndarray:
    """Score of each text: the weights of its distinct words and word pairs, plus
    the mean weight of its character n-grams."""
    (owner, slot), (gram, at), words = features
    n = len(words)
    score = np.bincount(owner, word_weights[slot], n)
    per = np.diff(at)
    total = np.bincount(np.repeat(np.arange(n), per), char_weights[gram], n)
    return score + total / np.maximum(per, 1)


#: Documents of a sample that must have a word or pair for it to get a weight.
LEAST_DOCS = 5


class Sample:
    """Features of a bounded sample of texts, for fitting.  Words and pairs in
    fewer than ``LEAST_DOCS`` of its texts are left out: they would be learnt by heart."""

    def __init__(self, texts: Iterable[tuple[np.ndarray, np.ndarray]], step: int = 1 << 20):
        # (bytes, offsets) of the texts come in parts, and go in slices of about ``step`` bytes: no array has an entry for each n-gram of the sample
        self.parts, self.n = [], 0
        used, c_used = np.zeros(WORD_SLOTS, np.int64), np.zeros(CHAR_SLOTS, np.int64)
        for raw, offsets in texts:
            lo, n = 0, len(offsets) - 1
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step, "right")) - 1)
                (owner, slot), (gram, at), _ = hashed(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                per = np.diff(at)
                code, count = np.unique(np.repeat(np.arange(hi - lo), per) * CHAR_SLOTS + gram, return_counts=True)
                of, c_slot = code // CHAR_SLOTS, code % CHAR_SLOTS
                used += np.bincount(slot, minlength=WORD_SLOTS)
                c_used += np.bincount(c_slot, minlength=CHAR_SLOTS)
                self.parts.append((self.n, hi - lo, owner.astype(np.int32), slot.astype(np.int32), of.astype(np.int32), c_slot.astype(np.uint16), (count / np.maximum(per, 1)[of]).astype(np.float32)))
                self.n += hi - lo
                lo = hi
        self.most_weight = 1 / max(1, self.n)
        self.word_slots, lookup = self._common(used)
        self.char_slots, c_lookup = self._common(c_used)
        for k, (first, n, owner, slot, of, c_slot, value) in enumerate(self.parts):
            keep, c_keep = lookup[slot] >= 0, c_lookup[c_slot] >= 0
            self.parts[k] = (first, n, owner[keep], lookup[slot[keep]], of[c_keep], c_lookup[c_slot[c_keep]].astype(np.uint16), value[c_keep])

    @staticmethod
    def _common(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots in enough texts, and the place of each slot among them, or -1."""
        used = np.flatnonzero(count >= LEAST_DOCS)
        lookup = np.full(len(count), -1, np.int32)
        lookup[used] = np.arange(len(used))
        return used, lookup

    def score(self, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        parts = [np.bincount(o, w[s], n) + np.bincount(co, c[cs] * v, n) for _, n, o, s, co, cs, v in self.parts]
        return np.concatenate(parts) if parts else np.zeros(0)

    def gradient(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dw, dc = np.zeros(len(self.word_slots)), np.zeros(len(self.char_slots))
        for first, n, o, s, co, cs, v in self.parts:
            own = g[first : first + n]
            dw += np.bincount(s, own[o], len(dw))
            dc += np.bincount(cs, own[co] * v, len(dc))
        return dw, dc

    def spread(self, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of all slots from those of the slots in use."""
        word, char = np.zeros(WORD_SLOTS, np.float32), np.zeros(CHAR_SLOTS, np.float32)
        word[self.word_slots], char[self.char_slots] = w, c
        return word, char


#: Character frequencies are far below one; their weights act on this multiple.
CHAR_SCALE = 20.0


def fit_sparse(sample: Sample, slope, extra: np.ndarray, rounds: int = 100, l1: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word weights, character weights and ``extra`` parameters that minimise a
    loss with an l1 penalty on the weights, by accelerated proximal gradient.

    ``slope(score, extra) -> (d loss / d score, d loss / d extra)``; the step is the
    inverse of a bound on the curvature, found by power iteration.
    """
    n = len(sample.word_slots)
    x = np.zeros(n + len(sample.char_slots) + len(extra))
    x[len(x) - len(extra) :] = extra

    def gradient(x):
        d, de = slope(sample.score(x[:n], x[n : len(x) - len(extra)] * CHAR_SCALE), x[len(x) - len(extra) :])
        dw, dc = sample.gradient(d)
        return np.concatenate([dw, dc * CHAR_SCALE, de])

    v = np.ones(len(x))
    for _ in range(12):  # power iteration on X'X / (4 n): the curvature of the logistic loss
        v /= np.linalg.norm(v)
        sw, sc = sample.gradient(sample.score(v[:n], v[n : len(x) - len(extra)] * CHAR_SCALE) + v[-len(extra) :].sum())
        v = np.concatenate([sw, sc * CHAR_SCALE, np.full(len(extra), sample.score(v[:n], v[n : len(x) - len(extra)] * CHAR_SCALE).sum())])
    step = 1 / (0.25 * np.linalg.norm(v) * sample.most_weight)
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        new = y - step * gradient(y)
        body = slice(0, len(x) - len(extra))
        new[body] = np.sign(new[body]) * np.maximum(np.abs(new[body]) - step * l1, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x[:n], x[n : len(x) - len(extra)] * CHAR_SCALE, x[len(x) - len(extra) :]
