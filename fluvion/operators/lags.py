"""Correlations at all lags by Fourier transforms, many series in one batch.

A sum over months of one series times another so many months before is a convolution, so the sums at all
lags cost n log n. Missing months are zeros under a mask: the number of months in common, both sums, both
sums of squares and the sum of products at each lag are convolutions of masked series. Each series
is taken less its mean first, which changes no correlation and keeps the sums small.
"""

from __future__ import annotations

import numpy as np

#: What is smaller than this share of a series' size is the transforms' rounding, and counts as none.
FLAT = 1e-12


def grid(months: list[np.ndarray], values: list[np.ndarray], start: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (rows, size), 0 where missing, and the mask, of series on a grid of months from ``start`` on."""
    out, mask = np.zeros((len(months), size)), np.zeros((len(months), size))
    for k, (at, v) in enumerate(zip(months, values)):
        ok = np.isfinite(v)
        out[k, at[ok] - start] = v[ok]
        mask[k, at[ok] - start] = 1.0
    return out, mask


def sums_at_lags(later: np.ndarray, earlier: np.ndarray, most: int) -> np.ndarray:
    """sum over t of later[t] * earlier[t - lag], for lags 0 to ``most`` and each row."""
    n = later.shape[1]
    size = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(later, size) * np.conj(np.fft.rfft(earlier, size))
    made = np.fft.irfft(spectrum, size)[:, : min(most, n - 1) + 1]
    return np.pad(made, ((0, 0), (0, most + 1 - made.shape[1])))


def correlations(y: np.ndarray, y_mask: np.ndarray, x: np.ndarray, x_mask: np.ndarray, most: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Pearson's correlation, with ``ridge`` added to both variances, of y with x ``lag`` months before over the months that have
    both, and how many these are, for lags 0 to ``most`` and each row. NaN without months in common."""
    def centred(v: np.ndarray, mask: np.ndarray) -> np.ndarray:
        mean = v.sum(axis=1, keepdims=True) / np.maximum(mask.sum(axis=1, keepdims=True), 1)
        off = (v - mean) * mask
        return np.where(np.abs(off) <= FLAT * np.abs(mean), 0.0, off)

    def variance(v: np.ndarray, squares: np.ndarray, sums: np.ndarray) -> np.ndarray:
        made = squares / at - sums**2
        return np.where(made <= FLAT * (v * v).max(axis=1, keepdims=True), 0.0, made)

    y, x = centred(y, y_mask), centred(x, x_mask)
    n = np.rint(sums_at_lags(y_mask, x_mask, most))
    at = np.maximum(n, 1)
    sum_y, sum_x = sums_at_lags(y, x_mask, most) / at, sums_at_lags(y_mask, x, most) / at
    var_y, var_x = variance(y, sums_at_lags(y * y, x_mask, most), sum_y), variance(x, sums_at_lags(y_mask, x * x, most), sum_x)
    both = np.where((var_y > 0) & (var_x > 0), sums_at_lags(y, x, most) / at - sum_y * sum_x, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = both / np.sqrt((var_y + ridge) * (var_x + ridge))
    return np.where(n > 0, r, np.nan), n.astype(np.int64)


def best(r: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the lag from low to high with the highest correlation among those with ``least`` months, the first of those
    that agree to ten digits; its correlation and months. -1, NaN and 0 where there is none."""
    lag = np.arange(r.shape[1])
    ok = (lag >= low[:, None]) & (lag <= high[:, None]) & (n >= max(least, 1)) & np.isfinite(r)
    score = np.where(ok, np.round(r, 10), -np.inf)
    at = score.argmax(axis=1)
    found = ok.any(axis=1)
    rows = np.arange(len(r))
    return np.where(found, at, -1), np.where(found, r[rows, at], np.nan), np.where(found, n[rows, at], 0)


def response_lag(y: np.ndarray, x: np.ndarray, digits: int = 3) -> int:
    """The lag from 0 on of the largest sum of products of y with x before it, both less their means; the first of
    those that are equal when rounded. -1 for an empty series."""
    if not len(y):
        return -1
    sums = sums_at_lags((y - y.mean())[None], (x - x.mean())[None], len(y) - 1)[0]
    return int(np.round(sums, digits).argmax())
