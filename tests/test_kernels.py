"""Numeric kernels against dense and plain versions, and at sizes where those would not do."""

import datetime
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvion.operators import graph, lags, pairs, reservoir, spectra, splines
from fluvion.operators import statistics as st


# Splines


def dense(x, y):
    n, h = len(x), np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = h[j] / 6
    return q @ np.linalg.solve(r, q.T)


@pytest.mark.parametrize("n,scale", [(4, 1.0), (9, 30.0), (60, 1.0), (200, 365.0)])
def test_spline_reaches_its_residual_and_bends_least(n, scale):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.uniform(0.2, 2, n)) * scale
    y = 100 + 20 * np.sin(np.arange(n) / 4) + rng.normal(0, 3, n)
    for bound in (0.01 * n, 2.0 * n):
        f, g = splines.fit(x, y, bound)
        off = y - f
        line = y - np.polyval(np.polyfit(x, y, 1), x)
        if line @ line <= bound:
            np.testing.assert_allclose(off, line, atol=1e-6)
            continue
        assert off @ off == pytest.approx(bound, rel=1e-6)
        # Least bending: what is left over is a multiple of the bending's gradient.
        bend = dense(x, y) @ f
        a = (off @ bend) / (bend @ bend)
        assert a > 0
        np.testing.assert_allclose(off, a * bend, atol=1e-5 * np.abs(off).max())
        np.testing.assert_allclose(splines.value(x, f, g, x), f, atol=1e-8)
    f, g = splines.fit(x, y)
    np.testing.assert_allclose(f, y)
    # Natural: second derivatives vanish at the ends, and the curve has none beyond.
    assert g[0] == g[-1] == 0
    out = splines.value(x, f, g, np.array([x[0] - 3 * scale, x[0] - 2 * scale, x[0] - scale]))
    assert out[0] - 2 * out[1] + out[2] == pytest.approx(0, abs=1e-6)


def test_spline_of_a_long_series_is_quick():
    rng = np.random.default_rng(0)
    t = np.arange(20_000.0)
    v = 50 + rng.normal(0, 5, len(t))
    v[rng.random(len(t)) < 0.2] = np.nan
    known = np.isfinite(v)
    began = time.perf_counter()
    out = st.cubic_fill(t, v)
    assert time.perf_counter() - began < 60
    tracemalloc.start()
    st.cubic_fill(t[:4000], v[:4000])
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()
    assert np.isfinite(out).all() and (out[known] == v[known]).all() and (out >= 0).all()
    assert st.cubic_fill(np.arange(4.0), np.array([5.0, np.nan, 5.0, np.nan]))[1:].tolist() == [5.0, 5.0, 5.0]


# Lags


def test_masked_correlations_at_all_lags():
    rng = np.random.default_rng(2)
    rows, size, most = 7, 40, 45
    y, x = rng.normal(100, 20, (rows, size)), rng.normal(300, 50, (rows, size))
    ym, xm = rng.random((rows, size)) < 0.8, rng.random((rows, size)) < 0.7
    ym[5], x[6] = False, 5.0
    r, n = lags.correlations(np.where(ym, y, 0), ym.astype(float), np.where(xm, x, 0), xm.astype(float), most, 1e-6)
    for k in range(rows):
        for lag in range(most + 1):
            both = [(y[k, t], x[k, t - lag]) for t in range(lag, size) if ym[k, t] and xm[k, t - lag]]
            assert n[k, lag] == len(both)
            if not both:
                assert np.isnan(r[k, lag])
                continue
            a, b = np.array(both).T
            want = ((a - a.mean()) * (b - b.mean())).mean() / np.sqrt((a.var() + 1e-6) * (b.var() + 1e-6))
            assert r[k, lag] == pytest.approx(want, abs=1e-8)
    lag, score, overlap = lags.best(r, n, np.array([1] * rows), np.array([9] * rows), 6)
    for k in range(rows):
        ok = [j for j in range(1, 10) if n[k, j] >= 6]
        assert lag[k] == (max(ok, key=lambda j: (round(r[k, j], 10), -j)) if ok else -1)
    assert lag[5] == -1 and overlap[5] == 0 and lag[6] == 1 and score[6] == 0


def test_best_lag_with_gaps_and_without_rows(spark):
    month = lambda k: datetime.date(2000 + k // 12, 1 + k % 12, 1)
    rng = np.random.default_rng(1)
    x = rng.normal(size=40)
    y = np.concatenate((rng.normal(size=3), x[:-3])) + 0.1 * rng.normal(size=40)
    target = spark.createDataFrame([("p", month(k), float(y[k])) for k in range(40) if k != 20] + [("p", month(20), None)], "well string, ds date, y double")
    source = spark.createDataFrame([("i", month(k), float(x[k])) for k in range(40) if k % 9], "well string, ds date, x double")
    windows = spark.createDataFrame([("p", "i", 1, 8, 5.0), ("p", "none", 2, 4, 6.0), ("none", "i", 1, 1, 7.0), ("p", "i2", 900, 901, 1.0)], "prod_id string, inj_id string, lower_bound long, upper_bound long, d double")
    got = {(r["prod_id"], r["inj_id"]): r for r in pairs.best_lag(windows, target, source, month(35)).collect()}
    ok = [k for k in range(3, 36) if k != 20 and (k - 3) % 9]
    a, b = y[ok], x[[k - 3 for k in ok]]
    found = got["p", "i"]
    assert (found["lag"], found["tau"], found["overlap"], found["d"]) == (3, 3, len(ok), 5.0)
    assert found["corr"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-5)
    for key, low in ((("p", "none"), 2), (("none", "i"), 1), (("p", "i2"), 900)):
        assert (got[key]["lag"], got[key]["corr"], got[key]["overlap"], got[key]["tau"]) == (low, 0.0, 0, low)


def test_response_lag_is_that_of_the_plain_sums(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 101):
        y, x = rng.normal(100, 9, n), rng.normal(50, 9, n)
        sums = [round(float(((y - y.mean())[lag:] * (x - x.mean())[: n - lag]).sum()), 3) for lag in range(n)]
        assert lags.response_lag(y, x) == int(np.argmax(sums))
    assert lags.response_lag(np.ones(12), np.ones(12)) == 0
    rows = [("a", t, float(100 + t % 5), float(99 + t % 4), float((t + 2) % 5)) for t in range(20)] + [("b", t, 1.0, 1.0, 1.0) for t in range(4)]
    df = spark.createDataFrame(rows, "well string, t int, y double, y_hat double, x double").repartition(3)
    got = {r["well"]: r for r in reservoir.injection(df, "well").collect()}
    assert got["a"]["response_lag_true"] == lags.response_lag(*(np.array([r[c] for r in rows if r[0] == "a"]) for c in (2, 4)))
    assert got["b"]["response_lag_true"] is None


# Neighbours


def plain_information(x, y, k):
    n, scaled = len(x), []
    for v, irrational in ((x, 0.6180339887498949), (y, 0.41421356237309515)):
        v = v / (v.std() or 1.0)
        scaled.append(v + 1e-10 * max(1.0, np.abs(v).mean()) * (np.arange(1, n + 1) * irrational % 1.0))
    dx, dy = (np.abs(v[:, None] - v) for v in scaled)
    both = np.maximum(dx, dy)
    np.fill_diagonal(both, np.inf)
    radius = np.nextafter(np.partition(both, k - 1, axis=1)[:, k - 1], 0)
    near = [(d <= radius[:, None]).sum(1) for d in (dx, dy)]
    psi = lambda m: sum(1 / j for j in range(1, m)) - 0.5772156649015329
    value = psi(n) + psi(k) - np.mean([psi(m) for m in near[0]]) - np.mean([psi(m) for m in near[1]])
    return float(np.clip(max(value, 0) / np.log(n + 1), 0, 1))


def test_information_is_that_of_all_distances():
    rng = np.random.default_rng(4)
    for n in (8, 9, 50, 300):
        for k in (1, 3, 5):
            base = rng.normal(size=n)
            for x, y in ((base, base + rng.normal(size=n)), (np.round(base), np.round(rng.normal(size=n))), (np.zeros(n), base), (np.where(base > 0, base, 0), np.where(base > 0.5, 1.0, 0.0))):
                assert st.mutual_information(x, y, k) == pytest.approx(plain_information(x, y, k), abs=1e-9)


def test_information_of_a_long_series():
    rng = np.random.default_rng(5)
    x = rng.normal(size=20_000)
    tracemalloc.start()
    found = st.mutual_information(x, 0.8 * x + 0.6 * rng.normal(size=len(x)))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert found * np.log(len(x) + 1) == pytest.approx(-0.5 * np.log(1 - 0.64), abs=0.05)


# Triangles


def test_triangles_around_a_hub(spark):
    rng = np.random.default_rng(6)
    edges = {tuple(sorted((f"w{a}", f"w{b}"))) for a, b in rng.integers(0, 14, (45, 2)) if a != b}
    rows = [(a, b, float(rng.uniform(1, 9))) for a, b in sorted(edges)]
    wells = spark.createDataFrame([(f"w{k}",) for k in range(16)], "well string")
    got = {r["well"]: r["clustering"] for r in graph.clustering(wells, spark.createDataFrame(rows, "src string, dst string, d double")).collect()}
    w = {(a, b): 1 / d for a, b, d in rows}
    w |= {(b, a): v for (a, b), v in w.items()}
    top = max(w.values())
    for k in range(16):
        mine = sorted(b for a, b in w if a == f"w{k}")
        total = sum((w[f"w{k}", u] * w[f"w{k}", v] * w[u, v] / top**3) ** (1 / 3) for i, u in enumerate(mine) for v in mine[i + 1 :] if (u, v) in w)
        want = 2 * total / (len(mine) * (len(mine) - 1)) if len(mine) > 1 else 0.0
        assert got[f"w{k}"] == pytest.approx(want, abs=1e-12)
    star = spark.range(100_000).select(F.lit("hub").alias("src"), F.concat(F.lit("leaf"), F.col("id")).alias("dst"), F.lit(2.0).alias("d"))
    hub = spark.createDataFrame([("hub",), ("leaf7",)], "well string")
    assert {r["clustering"] for r in graph.clustering(hub, star).collect()} == {0.0}


# Spectra


@pytest.mark.parametrize("seed,n,isolated", [(2, 24, 2), (3, 3, 0)])
def test_spectra_are_those_of_dense_matrices(spark, seed, n, isolated):
    rng = np.random.default_rng(seed)
    names = [f"w{k:02d}" for k in range(n + isolated)]
    rows = [(names[a], names[b], float(rng.uniform(1, 4))) for a in range(n) for b in range(a + 1, n) if b == a + 1 or rng.random() < 0.3]
    w = np.zeros((len(names),) * 2)
    for a, b, d in rows:
        w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = 1 / d
    wells, edges = spark.createDataFrame([(v,) for v in names], "well string"), spark.createDataFrame(rows, "src string, dst string, d double")
    got = {r["well"]: r["eigenvector"] for r in spectra.eigenvector(wells, edges).collect()}
    np.testing.assert_allclose([got[v] for v in names], st.eigenvector(w), atol=1e-4)
    found = {r["well"]: r["embedding"] for r in spectra.laplacian(wells, edges, 2).collect()}
    v = np.array([found[x] for x in names])
    np.testing.assert_allclose(v.T @ v, np.eye(2), atol=1e-8)
    assert all(v[np.abs(v[:, j]).argmax(), j] > 0 for j in range(2))
    degree = w.sum(1)
    root = np.where(degree > 0, 1 / np.sqrt(np.where(degree > 0, degree, 1)), 0)
    laplace = np.diag((degree > 0).astype(float)) - root[:, None] * w * root
    values = np.linalg.eigvalsh(laplace)[1:3]
    np.testing.assert_allclose(np.einsum("ij,ik,kj->j", v, laplace, v), values, atol=1e-7)
    np.testing.assert_allclose(laplace @ v, v * values, atol=1e-4)


def test_spectra_without_edges(spark):
    wells, none = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "well string"), spark.createDataFrame([], "src string, dst string, d double")
    assert [r["eigenvector"] for r in spectra.eigenvector(wells, none).collect()] == [0.5] * 4
    assert spectra.laplacian(wells.limit(2), none, 2).first()["embedding"] == [0.0, 0.0]
    assert spectra.laplacian(wells, none, 2).count() == 4


# Crowds


@pytest.mark.parametrize("crowd", [1, 512])
def test_nearest_injectors_in_a_crowd(spark, monkeypatch, crowd):
    monkeypatch.setattr(pairs, "CROWD", crowd)
    rng = np.random.default_rng(7)
    place = lambda k, one: (5.0, 5.0, -9.0) if k % 10 else tuple(float(v) for v in rng.uniform(0, 9000, 3)) if not one else (5.0, 5.0, -9.0)
    near = lambda: tuple(float(v) for v in 40 + rng.uniform(0, 1, 3))
    p = [(f"p{k:03d}", *place(k, False)) for k in range(120)] + [(f"q{k}", *near()) for k in range(30)]
    i = [(f"i{k:03d}", *place(k, False)) for k in range(90)] + [(f"j{k}", *near()) for k in range(40)] + [("lost", None, 1.0, 1.0)]
    make = lambda rows: spark.createDataFrame(rows, "well string, x double, y double, z double").repartition(4)
    got = {}
    for r in pairs.nearest_pairs(make(p), make(i), 3).collect():
        got.setdefault(r["prod_id"], []).append((r["rk"], r["inj_id"], r["d"]))
    known = [v for v in i if v[1] is not None]
    for w, *at in p:
        want = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v[1:], at)))), v[0]) for v in known)[:3]
        found = sorted(got[w])
        assert [f[1] for f in found] == [v[1] for v in want]
        assert [f[2] for f in found] == pytest.approx([v[0] for v in want])
