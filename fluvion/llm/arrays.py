"""Vectorised text primitives on Arrow buffers: byte slices, words, fingerprints.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. No byte of a multi-byte
UTF-8 character lies there, so byte runs and character runs are the same.
A word's fingerprint is a 128-bit hash of its bytes, computed once for each distinct
word of a slice; runs of words get theirs by joining halves, with an avalanche at each
step, so no sums of powers stand behind any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Text bytes handled at once: temporaries take about thirty times as much memory.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values; overwrites and returns ``x``."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """One array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunk, or several
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins; the last entry is the end."""
    a = strings(column)
    n = len(a)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, text: str, most: int = SLICE_BYTES) -> Iterator:
    """Consecutive parts with about ``most`` bytes of text; a longer text is a part alone."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(pc.binary_length(strings(batch.column(text))).to_numpy(zero_copy_only=False))
    at, done = 0, 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, upto - at)
        at, done = upto, int(ends[upto - 1])


def _blocks(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive bytes, about ``most`` each, that cut no word: also the
    inside of a long text is handled in parts."""
    at, n = 0, len(data)
    while at < n:
        upto = min(n, at + most)
        border = offsets[np.searchsorted(offsets, upto)]
        while upto < border and not SPACE[data[upto - 1]]:
            step = np.flatnonzero(SPACE[data[upto : min(border, upto + 4096)]])
            upto = upto + int(step[0]) + 1 if len(step) else min(int(border), upto + 4096)
        yield at, upto
        at = upto


class Words:
    """The words of a batch of texts: fingerprints, and with ``wide`` second ones
    (both 64 bits); counts: words of each text; first: index of each text's first word,
    one entry more."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, wide: bool = False):
        prints, more, starts = [], [], []
        for a, b in _blocks(data, offsets, SLICE_BYTES):
            at, h, second = self._block(data[a:b], offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a, lower, wide)
            starts.append(at + a)
            prints.append(h)
            more.append(second)
        none = [np.zeros(0, U64)]
        self.prints = np.concatenate(prints or none)
        self.seconds = np.concatenate(more or none) if wide else None
        starts = np.concatenate(starts or [np.zeros(0, np.int64)])
        self.first = np.searchsorted(starts, offsets)
        self.counts = np.diff(self.first)

    @staticmethod
    def _block(data: np.ndarray, borders: np.ndarray, lower: bool, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Where words begin, and their fingerprints. borders: where texts begin inside."""
        inside = ~SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[borders] = inside[borders]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return starts, np.zeros(0, U64), np.zeros(0, U64)
        letters = data[inside]  # words stand gapless here
        if lower:
            letters = LOWER[letters]
        upto = np.cumsum(inside)
        ends = np.append(upto[starts[1:]] - 1, len(letters))
        bounds = np.concatenate(([0], ends)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        _, at, held = coded.dictionary.buffers()
        held, at = held.to_pybytes(), np.frombuffer(at, np.int64)[: len(coded.dictionary) + 1].tolist()
        distinct = [held[i:j] for i, j in zip(at, at[1:])]
        which = coded.indices.to_numpy()
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), ">u8").astype(U64).reshape(-1, 2)
        return starts, both[which, 0], both[which, 1] if wide else None


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of what ``a`` and then ``b`` stand for."""
    return mix(a * U64(0xD6E8FEB86659FD93) + b)


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of the ``length`` words from each position on, over text borders too;
    positions with fewer words after them are missing. Runs of 2, 4, 8... words are
    joined from halves, and ``length`` from these."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, power, width = None, 0, words, 1
    while True:
        if length & width:
            part = power[done : done + n]
            out = mix(part + U64(length)) if out is None else joined(out, part)
            done += width
        if 2 * width > length:
            return out
        power = joined(power[:-width], power[width:])
        width *= 2


def whole(first: np.ndarray, n_runs: int, length: int) -> np.ndarray:
    """Which of ``n_runs`` runs of ``length`` words stay within one text."""
    ok = np.zeros(n_runs + 1, np.int64)
    begin, end = first[:-1], first[1:] - length + 1
    keep = end > begin
    np.add.at(ok, begin[keep], 1)
    np.add.at(ok, end[keep], -1)
    return np.cumsum(ok)[:n_runs] > 0


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex that each of ``n`` vertices reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
    return label
