"""Language ID: a convolutional network over bytes, trained in numpy.

Bytes are embedded; filters of several widths run over fixed-length windows; each
filter's largest response in a window goes to a softmax over the languages. A text is
cut into windows that cover all of it, and its languages' probabilities are the windows'
means, weighted by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvion.llm.arrays import buffers
from fluvion.llm.samples import bounded, doubles, fitted, remainder, scored, with_texts

#: Bounds of the rows, and of the bytes of text, that the fit reads: all windows of these.
TRAIN_ROWS, TRAIN_BYTES = 3000, 12 << 20
WINDOW, DIMENSIONS, WIDTHS, FILTERS = 128, 6, (2, 3, 4), 10
#: Answer for texts without letters.
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Net:
    languages: list[str]
    embedding: np.ndarray  # 256 x DIMENSIONS
    filters: np.ndarray  # widest x DIMENSIONS by filter; zero beyond a filter's width
    filter_bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns (window, position, bytes x dimensions) and what the filters make of them."""
        x = self.embedding[windows]
        n, length, d = x.shape
        wide = max(WIDTHS)
        seen = np.lib.stride_tricks.as_strided(x, (n, length - wide + 1, wide * d), x.strides)
        columns = np.ascontiguousarray(seen)
        return columns, columns @ self.filters

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), 256):
            _, r = self.responses(windows[at : at + 256])
            pooled = np.maximum(r.max(axis=1) + self.filter_bias, 0)
            z = pooled @ self.dense + self.dense_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + 256] = z / z.sum(axis=1, keepdims=True)
        return out


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of all texts where each begins, its text, and its bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][text] + number * WINDOW
    return start, text, np.minimum(WINDOW, offsets[1:][text] - start)


def filled(data: np.ndarray, start: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The bytes of windows, padded with zeros."""
    w = np.zeros((len(start), WINDOW), np.uint8)
    for at in range(0, len(start), 4096):
        s, n = start[at : at + 4096, None] + np.arange(WINDOW), used[at : at + 4096, None]
        w[at : at + 4096] = np.where(np.arange(WINDOW) < n, data[np.minimum(s, len(data) - 1)], 0)
    return w


def loss_and_gradient(net: Net, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted log loss of the windows ``x`` of languages ``y``, divided by their number, and
    its gradient by each of the network's arrays."""
    n, (total, wide) = len(x), (FILTERS * len(WIDTHS), max(WIDTHS))
    columns, r = net.responses(x)
    where = r.argmax(axis=1)  # window by filter
    top = np.take_along_axis(r, where[:, None, :], 1)[:, 0] + net.filter_bias
    pooled = np.maximum(top, 0)
    z = pooled @ net.dense + net.dense_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    loss = float(-(weight * np.log(np.maximum(z[np.arange(n), y], 1e-30))).sum() / n)
    z[np.arange(n), y] -= 1
    z *= (weight / n)[:, None]
    down = (z @ net.dense.T) * (top > 0)
    # Only the position with the largest response has a gradient.
    best = columns[np.arange(n)[:, None], where]  # window, filter, bytes x dimensions
    g = {"dense": pooled.T @ z, "dense_bias": z.sum(0), "filter_bias": down.sum(0), "filters": np.einsum("nf,nfc->cf", down, best) * filter_mask()}
    back = (down[:, :, None] * net.filters.T).reshape(n, total, wide, DIMENSIONS)
    byte = x[np.arange(n)[:, None, None], where[:, :, None] + np.arange(wide)]
    g["embedding"] = np.zeros_like(net.embedding)
    np.add.at(g["embedding"], byte.ravel(), back.reshape(-1, DIMENSIONS))
    return loss, g


def filter_mask() -> np.ndarray:
    """Which weights each filter has: those of its width."""
    mask = np.zeros((max(WIDTHS) * DIMENSIONS, FILTERS * len(WIDTHS)), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * DIMENSIONS, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask


def fit(texts: pa.Array, languages: list[str], epochs: int = 2, batch: int = 128, rate: float = 0.004, seed: int = 5) -> Net:
    """Train by Adam on all windows of all texts, also those that a short text fills in part.
    Languages weigh alike however much text they have."""
    rng = np.random.default_rng(seed)
    known = sorted(set(languages))
    mask = filter_mask()
    total = mask.shape[1]
    p = {
        "embedding": rng.normal(0, 0.5, (256, DIMENSIONS)),
        "filters": rng.normal(0, 0.35, mask.shape) * mask,
        "filter_bias": np.zeros(total),
        "dense": rng.normal(0, 0.2, (total, max(len(known), 1))),
        "dense_bias": np.zeros(max(len(known), 1)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    net = Net(known, **p)
    if len(known) < 2:
        return net
    data, offsets = buffers(texts)
    start, text, used = windows_of(data, offsets)
    w = filled(data, start, used)
    y = np.array([known.index(v) for v in languages])[text]
    weight = (1 / np.maximum(np.bincount(y, minlength=len(known)), 1))[y]
    weight = (weight / weight.mean()).astype(np.float32)
    moment = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(w))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            _, g = loss_and_gradient(net, w[rows], y[rows], weight[rows])
            t += 1
            for k, v in p.items():
                moment[k] = 0.9 * moment[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                v -= rate * (moment[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)
    return net


def predict(df: DataFrame, net: Net, text_col: str = "text") -> DataFrame:
    """All columns but the text, plus lang_pred and score (the language's probability).

    A text that is null or has no letter is ``und`` with score 0, as is every text when
    nothing was learned. Existing columns of these names are replaced; one row out for
    each row in. Equal probabilities go to the language that sorts first. Texts of any length
    are read whole, in blocks of 4096 windows.
    """

    def make():
        def answer(column: pa.Array) -> dict[str, pa.Array]:
            data, offsets = buffers(column)
            start, text, used = windows_of(data, offsets)
            n = len(offsets) - 1
            sums = np.zeros((n, max(len(net.languages), 1)))
            for at in range(0, len(start) if net.languages else 0, 4096):
                part = slice(at, at + 4096)
                np.add.at(sums, text[part], net.probabilities(filled(data, start[part], used[part])) * used[part, None])
            sums /= np.maximum(np.diff(offsets), 1)[:, None]
            best = sums.argmax(1)
            letters = [bool(t) and _LETTER.search(t) is not None and bool(net.languages) for t in column.to_pylist()]
            names = [net.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
            return {"lang_pred": pa.array(names, pa.string()), "score": doubles(np.where(letters, np.minimum(sums[np.arange(n), best], 1.0), 0.0))}

        return answer

    return scored(df, text_col, make, "lang_pred string, score double")


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1, most: int = TRAIN_ROWS) -> Net:
    """Train on at most ``most`` rows with a language and an id outside the held-out fold, in
    at most TRAIN_BYTES of text, in one task. An id with several languages counts with the
    first of them, one with several texts likewise."""
    ids = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(id_col, folds) != held_out)).groupBy(id_col).agg(F.min(lang_col).alias("__lang"))
    sample = with_texts(docs, bounded(ids, id_col, most), id_col, text_col, most_bytes=TRAIN_BYTES)
    return fitted(sample, id_col, lambda t: fit(t.column("__text"), t.column("__lang").to_pylist()))
