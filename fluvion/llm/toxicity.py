"""Toxicity: non-negative positive-unlabelled learning.

A linear model over n-gram indicators is trained in numpy from confirmed toxic texts
and unlabelled ones. The risk of calling unlabelled texts clean is corrected by the
class prior for the toxic ones among them, and held at zero from below, so that the
model can't win by learning the confirmed examples by heart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvion.llm.ngrams import SIZE, Indicators, row_sums, sigmoid, sparse
from fluvion.llm.samples import bounded, doubles, fitted, remainder, scored, with_texts

#: Bounds of the confirmed and of the unlabelled rows that the fit reads, and of features; the
#: parts of the rows that are kept out of a fit in turn to set the scores' scale.
TOXIC_ROWS, UNLABELLED_ROWS, FEATURES, PARTS = 3000, 5000, 1000, 4
#: The steepest that the scores may be made.
SLOPE_MOST = 2.0


@dataclass
class Model:
    features: np.ndarray  # int32, the numbers of the features in use
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        table = np.zeros(SIZE, np.float32)
        table[self.features] = self.weights
        return table


def telling(counts: np.ndarray, n: int, m: int, most: int, least: int = 4) -> np.ndarray:
    """Features whose rates among n toxic and m unlabelled texts differ most for their
    counts (two-sample z), at most ``most``; those in few texts are left out."""
    cu, cp = counts
    pooled = (cp + cu) / (n + m)
    z = np.abs(cp / n - cu / m) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n + 1 / m))
    z[cp + cu < least] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] > 2.5]).astype(np.int32)


def calibrated(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 200) -> tuple[float, float]:
    """Slope and offset for margins, by the same risk over rows kept out of the fit. With
    log loss it is mean softplus(z) over unlabelled less prior times mean z over toxic
    rows, which is convex in both; Newton's method. The slope is SLOPE_MOST at most: few
    rows that happen to be parted well are no ground for more certainty."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        s = sigmoid(a * u + b)
        v = s * (1 - s)
        ga, gb = (s * u).mean() - prior * p.mean() + 1e-2 * (a - 1), s.mean() - prior
        haa, hab, hbb = (v * u * u).mean() + 1e-2, (v * u).mean(), v.mean() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (ga * hbb - gb * hab) / det, (haa * gb - hab * ga) / det
        if a == SLOPE_MOST and da < 0:  # held there: the offset alone
            da, db = 0.0, gb / hbb
        step = min(1.0, 0.5 / max(abs(da), abs(db), 1e-12))
        a, b = min(max(a - step * da, 0.05), SLOPE_MOST), b - step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def descend(rows_p: list[np.ndarray], rows_u: list[np.ndarray], d: int, prior: float, steps: int, rate: float, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam over all rows at once."""
    (fp, sp), (fu, su) = sparse(rows_p), sparse(rows_u)
    n, m = len(rows_p), len(rows_u)
    w, bias = np.zeros(d), float(np.log(prior / (1 - prior)))
    moment, second = np.zeros(d + 1), np.zeros(d + 1)
    rep_p, rep_u = np.diff(sp), np.diff(su)
    for t in range(1, steps + 1):
        a, b = sigmoid(row_sums(w[fp], sp) + bias), sigmoid(row_sums(w[fu], su) + bias)
        # Log loss: of calling x toxic -log s(x), of calling it clean -log(1 - s(x)).
        clean = -np.log1p(-np.minimum(b, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(a, 1 - 1e-12)).mean()
        if clean >= 0:
            gp, gu = prior / n * (a - 1) - prior / n * a, b / m
        else:  # step back along the part that has fallen below zero
            gp, gu = prior / n * a, -b / m
        gw = np.bincount(fp, np.repeat(gp, rep_p), minlength=d) + np.bincount(fu, np.repeat(gu, rep_u), minlength=d) + penalty * w
        g = np.append(gw, gp.sum() + gu.sum())
        moment = 0.9 * moment + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        step = rate * (moment / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return w, float(bias)


def fit(toxic: pa.ChunkedArray, unlabelled: pa.ChunkedArray, prior: float, most: int = FEATURES, steps: int = 400, rate: float = 0.05, penalty: float = 1e-5, seed: int = 11) -> Model:
    """Fit in memory of some kB a text. ``prior`` is the share of toxic texts among the
    unlabelled. Without toxic texts the score of every text is the prior. Each of PARTS
    parts of the rows is scored by a fit to the others; these margins set the scores'
    scale. The weights are then fitted to all rows."""
    prior = float(min(max(prior, 1e-4), 0.9))
    n, m = len(toxic), len(unlabelled)
    if not n or not m:
        return Model(np.zeros(0, np.int32), np.zeros(0), float(np.log(prior / (1 - prior))))
    indicators, rng = Indicators(lower=True, beginnings=True), np.random.default_rng(seed)
    parts = min(PARTS, n, m)
    part_p, part_u = rng.permutation(n) % parts, rng.permutation(m) % parts
    counts = np.zeros((parts, 2, SIZE), np.int32)
    for texts, part, k in ((toxic, part_p, 1), (unlabelled, part_u, 0)):
        for f, p in zip(indicators.each(texts), part):
            counts[p, k, f] += 1
    total = counts.sum(axis=0)
    held = [*range(parts), None] if parts > 1 else [None]
    chosen = [telling(total - (0 if k is None else counts[k]), int((part_p != k).sum()), int((part_u != k).sum()), most) for k in held]
    del counts
    used = np.unique(np.concatenate(chosen))
    number = np.full(SIZE, -1, np.int32)
    number[used] = np.arange(len(used))
    rows_p, rows_u = ([x[x >= 0] for x in (number[f] for f in indicators.each(texts))] for texts in (toxic, unlabelled))
    left_p, left_u = [], []
    for k, features in zip(held, chosen):
        place = np.full(len(used) + 1, -1, np.int32)
        place[np.searchsorted(used, features)] = np.arange(len(features))
        p, u = ([x[x >= 0] for x in (place[r] for r in rows)] for rows in (rows_p, rows_u))
        w, bias = descend([r for r, x in zip(p, part_p) if x != k], [r for r, x in zip(u, part_u) if x != k], len(features), prior, steps, rate, penalty)
        if k is not None:
            left_p += [w[r].sum() + bias for r, x in zip(p, part_p) if x == k]
            left_u += [w[r].sum() + bias for r, x in zip(u, part_u) if x == k]
    slope, offset = calibrated(np.array(left_p), np.array(left_u), prior) if left_p and left_u else (1.0, 0.0)
    return Model(features, slope * w, slope * bias + offset)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns but the text, plus score (double, 0 to 1). A null text counts as
    empty and scores as the bias; null ids and repeated rows pass through, one row out for
    each row in; equal texts score alike; an existing score column is replaced. A text of any
    length is read whole; a task needs some 50 bytes for each byte of its longest text."""

    def make():
        indicators, table = Indicators(lower=True, beginnings=True), model.table()
        return lambda column: {"score": doubles(sigmoid(np.array([table[f].sum(dtype=np.float64) for f in indicators.of(column)]) + model.bias))}

    return scored(df, text_col, make, "score double")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2, prior: float | None = None, toxic_rows: int = TOXIC_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model:
    """Fit to at most ``toxic_rows`` confirmed and ``unlabelled_rows`` other rows, all
    outside the held-out fold, in one task. The prior is the share of toxic rows among all
    labelled ones there, unless it is given. Null labels and ids are no labels; an id labelled
    twice counts once, as toxic if either says so; one with several texts counts with the
    first in the order of strings. Null texts are empty ones. The bytes that are read are
    bounded too (samples.with_texts)."""
    known = labels.where(F.col(label_col).isin(0, 1) & (remainder(id_col, folds) != held_out)).groupBy(id_col).agg(F.max(label_col).alias("__y"))
    if prior is None:
        prior = known.agg(F.avg("__y")).first()[0] or 0.0
    ids = docs.where(remainder(id_col, folds) != held_out).select(id_col).distinct()
    toxic, other = bounded(known.where("__y = 1").select(id_col), id_col, toxic_rows), bounded(ids, id_col, unlabelled_rows)
    # One sample, in which an id of both says so.
    chosen = toxic.withColumn("__p", F.lit(1)).unionByName(other.withColumn("__p", F.lit(2))).groupBy(id_col).agg(F.sum("__p").alias("__p"))

    def run(table: pa.Table) -> Model:
        p, texts = np.array(table.column("__p").to_pylist(), np.int64), table.column("__text")
        return fit(texts.filter(pa.array(p & 1 > 0)), texts.filter(pa.array(p & 2 > 0)), prior)

    return fitted(with_texts(docs, chosen, id_col, text_col), id_col, run)
