"""Hashed n-gram indicators of whole texts: words, byte 3-grams and 6-grams, how large a
share of the word pairs repeat one word, and, where asked for, how often words begin alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from fluvion.llm.arrays import LOWER, SPACE, U64, Words, buffers, slices

#: Hashed features are numbered below 2**BITS; those of repeated words follow.
BITS = 20
SHARES = np.array([0.0, 0.05, 0.1, 0.2, 0.4, 0.6])
SIZE = (1 << BITS) + len(SHARES)


class Indicators:
    """Distinct features of each text of a batch; ``lower`` folds A-Z first. ``beginnings``
    adds the first 6 bytes of words that have as many, and of these whether 2, 3, 4 or 6 words
    of the text begin so."""

    def __init__(self, lower: bool = False, beginnings: bool = False):
        self.lower, self.beginnings = lower, beginnings
        self.place = np.zeros(SIZE, np.int32)
        self.count = np.arange(1 << 16, dtype=np.int32)

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        data, offsets = buffers(column)
        if self.lower:
            data = LOWER[data]
        words = Words(data, offsets)
        prints = words.prints
        by_word = (prints >> U64(64 - BITS)).astype(np.int32)
        again = np.concatenate(([0, 0], np.cumsum(prints[1:] == prints[:-1])))[: len(prints) + 1]
        repeats = again[words.first[1:]] - again[np.minimum(words.first[:-1] + 1, words.first[1:])]
        passed = (repeats / np.maximum(words.counts - 1, 1))[:, None] > SHARES
        by_share = np.arange(1 << BITS, SIZE, dtype=np.int32)
        x = data.astype(np.uint32)
        three = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16) if len(x) > 2 else x[:0]
        by_three = (three * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int32)
        six = three[:-3] * np.uint32(0x85EBCA77)
        six ^= six >> np.uint32(15)
        six += three[3:]
        six *= np.uint32(0xC2B2AE3D)
        by_six = (six >> np.uint32(32 - BITS)).astype(np.int32)
        more, upto = self._begun(data, offsets, six) if self.beginnings else (by_six[:0], np.zeros(len(offsets), np.int64))
        for k in range(len(offsets) - 1):
            at, end = offsets[k], offsets[k + 1]
            f = np.concatenate((more[upto[k] : upto[k + 1]], by_word[words.first[k] : words.first[k + 1]], by_three[at : max(at, end - 2)], by_six[at : max(at, end - 5)], by_share[passed[k]]))
            if len(f) > len(self.count):
                self.count = np.arange(2 * len(f), dtype=np.int32)
            count = self.count[: len(f)]
            self.place[f] = count
            yield f[self.place[f] == count]  # of equal features the last stays

    @staticmethod
    def _begun(data: np.ndarray, offsets: np.ndarray, six: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of words' beginnings, by text, and where each text's are."""
        inside = np.append(~SPACE[data], False)
        begins = inside[:-1].copy()
        begins[1:] &= ~inside[:-2]
        opens = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[opens] = inside[opens]
        starts = np.flatnonzero(begins)
        text = np.searchsorted(offsets, starts, "right") - 1
        ok = starts + 6 <= offsets[text + 1]
        for k in range(1, 6):
            ok[ok] &= inside[starts[ok] + k]
        keys = np.sort(text[ok].astype(U64) << U64(32) | six[starts[ok]].astype(U64))
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        many, keys = np.diff(np.append(at, len(keys))), keys[at]
        out = [(keys >> U64(32), keys, 0)] + [(keys[many >= n] >> U64(32), keys[many >= n], n) for n in (2, 3, 4, 6)]
        owner = np.concatenate([t for t, _, _ in out]).astype(np.int64)
        made = np.concatenate([(x & U64(0xFFFFFFFF)).astype(np.uint32) * np.uint32(0x9E3779B1) ^ np.uint32(0x7F4A7C15 * (n + 1) & 0xFFFFFFFF) for _, x, n in out])
        made = (made * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS)).astype(np.int32)
        order = np.argsort(owner, kind="stable")
        return made[order], np.searchsorted(owner[order], np.arange(len(offsets)))

    def each(self, texts: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
        """The same for any number of texts, of which a bounded part is in work."""
        for part in slices(pa.table({"t": texts}), "t"):
            yield from self.of(part.column("t"))

    def counts(self, texts: pa.Array | pa.ChunkedArray, y: np.ndarray) -> np.ndarray:
        """In how many texts of class 0 and of class 1 each feature is."""
        out = np.zeros((2, SIZE), np.int32)
        for f, k in zip(self.each(texts), y):
            out[int(k), f] += 1
        return out


def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows, and where each row begins (one entry more)."""
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    return (np.concatenate(rows) if rows else np.zeros(0, np.int32)), starts


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for a row without any."""
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return sums[starts[1:]] - sums[starts[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by Newton's method on the
    smoothed log loss. Without two classes or any spread: slope 0 and the smoothed rate."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    rate = float(np.log((pos + 1) / (neg + 1)))
    scale = float(np.std(margins)) if len(margins) else 0.0
    if not pos or not neg or scale == 0:
        return 0.0, rate
    m, t = margins / scale, np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, rate
    for _ in range(steps):
        p = sigmoid(a * m + b)
        w = p * (1 - p)
        ga, gb = ((p - t) * m).sum() + 1e-3 * a, (p - t).sum()
        haa, hab, hbb = (w * m * m).sum() + 1e-3, (w * m).sum(), w.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db = (ga * hbb - gb * hab) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a / scale), float(b)
