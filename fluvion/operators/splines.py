"""Natural cubic smoothing splines by banded systems, linear in a series' length.

The spline that bends least while its squared residuals sum to a bound is natural cubic with knots at
the points. With h the gaps between points, R the tridiagonal matrix of the second derivatives' inner
products and Q that of second differences, the second derivatives g at the inner points
solve (R + a Q'Q) g = Q'y, five diagonals wide, and the spline's values there are y - a Q g.
The sum of squared residuals rises with a, so a is found between two bounds.
"""

from __future__ import annotations

import numpy as np

#: Powers of ten, in units of the cube of the mean gap, between which a is looked for.
MOST_POWER = 30


def _solve(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of a symmetric positive matrix with diagonals d0, d1, d2, by its factors L D L'. In plain
    floats, as each row hangs on the two before it."""
    n = len(d0)
    a, b, c, r = d0.tolist(), [*d1.tolist(), 0.0], [*d2.tolist(), 0.0, 0.0], right.tolist()
    low, far, pivot = [0.0] * n, [0.0] * n, [0.0] * n
    for k in range(n):
        p = a[k]
        if k > 0:
            p -= low[k - 1] ** 2 * pivot[k - 1]
        if k > 1:
            p -= far[k - 2] ** 2 * pivot[k - 2]
        pivot[k] = p
        low[k] = ((b[k] if k < n - 1 else 0.0) - (low[k - 1] * far[k - 1] * pivot[k - 1] if k > 0 else 0.0)) / p
        far[k] = (c[k] if k < n - 2 else 0.0) / p
    for k in range(n):
        if k > 0:
            r[k] -= low[k - 1] * r[k - 1]
        if k > 1:
            r[k] -= far[k - 2] * r[k - 2]
    for k in range(n - 1, -1, -1):
        r[k] /= pivot[k]
        if k < n - 1:
            r[k] -= low[k] * r[k + 1]
        if k < n - 2:
            r[k] -= far[k] * r[k + 2]
    return np.array(r)


def fit(x: np.ndarray, y: np.ndarray, residual: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Values and second derivatives at the points x (rising, three at least) of the least bent natural cubic spline
    with a sum of squared residuals of ``residual``; of the interpolating one for 0, and of the least-squares line where
    that leaves no more."""
    n = len(x)
    h = np.diff(x)
    line = np.polyval(np.polyfit(x - x[0], y, 1), x - x[0])
    if residual > 0 and float(((y - line) ** 2).sum()) <= residual:
        return line, np.zeros(n)
    r0, r1 = (h[:-1] + h[1:]) / 3, h[1:-1] / 6
    # Columns of Q: 1 / h before, less both, 1 / h behind.
    q0, q2 = 1 / h[:-1], 1 / h[1:]
    q1 = -q0 - q2
    s0, s1, s2 = q0**2 + q1**2 + q2**2, q1[:-1] * q0[1:] + q2[:-1] * q1[1:], q2[:-2] * q0[2:]
    second = q0 * y[:-2] + q1 * y[1:-1] + q2 * y[2:]

    def at(a: float) -> tuple[np.ndarray, np.ndarray]:
        g = _solve(r0 + a * s0, r1 + a * s1, a * s2, second)
        off = np.zeros(n)
        off[:-2] += q0 * g
        off[1:-1] += q1 * g
        off[2:] += q2 * g
        return a * off, g

    def done(a: float) -> tuple[np.ndarray, np.ndarray]:
        off, g = at(a)
        return y - off, np.concatenate(([0.0], g, [0.0]))

    if residual <= 0:
        return done(0.0)
    unit = float(np.mean(h)) ** 3

    def over(power: float) -> float:
        """The logarithm of how far the residual is above the bound."""
        off = at(unit * 10**power)[0]
        return float(np.log10(max(float(off @ off), 1e-300) / residual))

    # The residual rises with a: a bracket first, then false position with one end's height halved.
    low = high = 0.0
    below = above = over(0.0)
    while above < 0 and high < MOST_POWER:
        low, below, high = high, above, high + 2
        above = over(high)
    while below > 0 and low > -MOST_POWER:
        high, above, low = low, below, low - 2
        below = over(low)
    power, side = (low if abs(below) < abs(above) else high), 0
    for _ in range(60):
        if below >= 0 or above <= 0 or high - low < 1e-13:
            break
        power = (low * above - high * below) / (above - below)
        now = over(power)
        if abs(now) < 1e-11:
            break
        if now < 0:
            low, below = power, now
            above = above / 2 if side < 0 else above
            side = -1
        else:
            high, above = power, now
            below = below / 2 if side > 0 else below
            side = 1
    return done(unit * 10**power)


def value(x: np.ndarray, f: np.ndarray, g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The spline with values f and second derivatives g at x; a line beyond the ends."""
    h = np.diff(x)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(h) - 1)
    u, w = at - x[k], x[k + 1] - at
    out = (g[k] * w**3 + g[k + 1] * u**3) / (6 * h[k]) + (f[k] / h[k] - g[k] * h[k] / 6) * w + (f[k + 1] / h[k] - g[k + 1] * h[k] / 6) * u
    slope = np.diff(f) / h
    before, after = at < x[0], at > x[-1]
    out[before] = f[0] + (slope[0] - h[0] * g[1] / 6) * (at[before] - x[0])
    out[after] = f[-1] + (slope[-1] + h[-1] * g[-2] / 6) * (at[after] - x[-1])
    return out
