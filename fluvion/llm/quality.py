"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by their log-count ratio between the classes; a
linear hinge-loss model is fitted to them by dual coordinate descent. Margins of rows
kept out of the fit set the scale of the scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvion.llm.ngrams import SIZE, Indicators, platt, sigmoid
from fluvion.llm.samples import bounded, doubles, fitted, remainder, scored, with_texts

#: Bound of the labelled rows that the fit reads.
TRAIN_ROWS = 4000


@dataclass
class Model:
    features: np.ndarray  # int32, the numbers of the features in use
    weights: np.ndarray  # float32: model weight times log-count ratio
    bias: float
    slope: float
    offset: float

    def table(self) -> np.ndarray:
        table = np.zeros(SIZE, np.float32)
        table[self.features] = self.weights
        return table

    def margins(self, column: pa.Array, indicators: Indicators, table: np.ndarray) -> np.ndarray:
        return np.array([table[f].sum(dtype=np.float64) + self.bias for f in indicators.of(column)])


def log_count_ratios(counts: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Of each feature, from its counts in the two classes."""
    q, p = alpha + counts
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a hinge-loss model with L2 penalty over rows of indicators
    times ``scale``. Each step solves for one row's multiplier, which stays between 0
    and ``cost`` over the size of its class's share."""
    n = len(y)
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, (y > 0).mean(), (y == 0).mean())
    upper = cost * 0.5 / np.maximum(share, 1e-9)
    norms = np.array([(scale[f] ** 2).sum() for f in rows]) + 1.0
    w, bias, dual = np.zeros(len(scale)), 0.0, np.zeros(n)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            f = rows[i]
            s = scale[f]
            gradient = sign[i] * (w[f] @ s + bias) - 1
            new = min(max(dual[i] - gradient / norms[i], 0.0), upper[i])
            step = (new - dual[i]) * sign[i]
            if step:
                w[f] += step * s
                bias += step
                dual[i] = new
                moved = max(moved, abs(step) * norms[i])
        if moved < 1e-3:
            break
    return w, bias


def fit(texts: pa.Array | pa.ChunkedArray, y: np.ndarray, cost: float = 0.01, rounds: int = 15, least: int = 3, seed: int = 7) -> Model:
    """Fit in memory of some kB a text. Features in fewer than ``least``
    texts are left out. Every fifth row sets the scores' scale instead of the weights."""
    y = np.asarray(y)
    order = np.random.default_rng(seed).permutation(len(y))
    fits = np.ones(len(y), bool)
    fits[order[: len(order) // 5]] = False
    if len(set(y[fits].tolist())) < 2:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0, *platt(np.zeros(len(y)), y))
    indicators = Indicators()
    counts = indicators.counts(pa.chunked_array([texts]).filter(pa.array(fits)) if isinstance(texts, pa.Array) else texts.filter(pa.array(fits)), y[fits])
    common = np.flatnonzero(counts.sum(axis=0) >= least)
    ratios = log_count_ratios(counts)[common]
    number = np.full(SIZE, -1, np.int32)
    number[common] = np.arange(len(common))
    rows = [f[f >= 0] for f in (number[f] for f in indicators.each(texts))]
    w, bias = dual_descent([r for r, k in zip(rows, fits) if k], ratios, y[fits], cost, rounds, seed)
    margins = np.array([(w[r] * ratios[r]).sum() + bias for r, k in zip(rows, fits) if not k])
    used = w != 0
    return Model(common[used].astype(np.int32), (w * ratios)[used].astype(np.float32), float(bias), *platt(margins, y[~fits]))


def score(df: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False, out_col: str = "score") -> DataFrame:
    """All columns (the text only with ``keep_text``), plus ``out_col`` (double, 0 to 1). A null
    text counts as empty and scores as the model's bias; null ids and repeated rows pass
    through, one row out for each row in; equal texts score alike; an existing column of that
    name is replaced. A text of any length is read whole; a task needs some 40 bytes for each
    byte of its longest text."""

    def make():
        indicators, table = Indicators(), model.table()
        return lambda column: {out_col: doubles(sigmoid(model.slope * model.margins(column, indicators, table) + model.offset))}

    return scored(df, text_col, make, f"`{out_col}` double", keep_text)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0, most: int = TRAIN_ROWS) -> Model:
    """Fit to at most ``most`` labelled rows outside the held-out fold, in one task. Null labels
    and ids are not rows to learn from; an id labelled twice counts once, with its highest
    label, and one with several texts once, with the first in the order of strings.
    Null texts are empty ones. Without two classes every text scores the smoothed rate.
    The bytes that are read are bounded too (samples.with_texts)."""
    known = labels.where(F.col(label_col).isin(0, 1) & (remainder(id_col, folds) != held_out)).groupBy(id_col).agg(F.max(label_col).alias("__y"))
    sample = with_texts(docs, bounded(known, id_col, most), id_col, text_col)
    return fitted(sample, id_col, lambda t: fit(t.column("__text"), np.array(t.column("__y").to_pylist(), np.int64)))
