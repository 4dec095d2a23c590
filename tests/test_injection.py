"""Pairs, causal evidence and attention against plain versions; the one call's invariants."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvion.operators import attention, features, field, injection, pairs
from fluvion.operators import statistics as st

CUT = dt.date(2004, 6, 1)


def month(k):
    return dt.date(2000 + k // 12, k % 12 + 1, 1)


def wells(spark, points):
    return spark.createDataFrame([(f"{n}", float(x), float(y), float(z)) for n, (x, y, z) in points.items()], "well string, x double, y double, z double")


@pytest.mark.parametrize("matrix", [None, [[4.0, 0.5, 0], [0.5, 1, 0], [0, 0, 0.25]]])
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_pairs_equal_all_pairs(spark, matrix, k):
    r = np.random.default_rng(k)
    clustered = np.vstack((r.normal(0, 30, (20, 3)), r.normal(3000, 30, (15, 3)), r.uniform(-9000, 9000, (10, 3))))
    p, i = {f"p{n}": v for n, v in enumerate(clustered)}, {f"i{n:02d}": v for n, v in enumerate(r.permutation(clustered)[:25] + r.normal(0, 1, (25, 3)))}
    got = {(x["prod_id"], x["rk"]): (x["inj_id"], x["metric_d"]) for x in pairs.nearest_pairs(wells(spark, p), wells(spark, i), k, matrix).collect()}
    inverse = np.linalg.inv(np.eye(3) if matrix is None else np.array(matrix))
    for name, v in p.items():
        d = sorted((float(np.sqrt((w - v) @ inverse @ (w - v))), n) for n, w in i.items())
        for rank in range(1, k + 1):
            assert got[name, rank][0] == d[rank - 1][1] and got[name, rank][1] == pytest.approx(d[rank - 1][0])
    assert len(got) == k * len(p)


def test_nearest_pairs_of_few_and_none(spark):
    one = wells(spark, {"a": (0, 0, 0)})
    assert pairs.nearest_pairs(one, one.where("false"), 3).count() == 0 and pairs.nearest_pairs(one.where("false"), one, 3).count() == 0
    got = pairs.nearest_pairs(one, wells(spark, {"b": (1, 0, 0), "c": (0, 0, 0)}), 5).orderBy("rk").collect()
    assert [(r["inj_id"], r["d"]) for r in got] == [("c", 0.0), ("b", 1.0)]


def test_metric_matrix():
    assert np.allclose(pairs.metric_matrix({"scale": {"x": 2.0}}), np.diag([4, 1, 1])) and np.allclose(pairs.metric_matrix({"inverse": np.diag([2, 1, 1])}), np.diag([0.5, 1, 1]))
    for bad in ({"scale": {"x": 0.0}}, {}):
        with pytest.raises(ValueError):
            pairs.metric_matrix(bad)


def test_lag_window_by_front_velocity_and_bad_distance(spark):
    pair = spark.createDataFrame([("a", "b", 900.0)], "prod_id string, inj_id string, d double")
    assert pairs.lag_window(pair, front_velocity=100.0).first()["upper_bound"] == 9
    with pytest.raises(Exception, match="positive finite distance"):
        pairs.lag_window(pair.withColumn("d", F.lit(0.0))).collect()


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 200])
def test_recurrences_over_blocks(spark, n):
    r = np.random.default_rng(n)
    x = r.normal(size=n)
    df = spark.createDataFrame([("a", month(k), float(v)) for k, v in enumerate(x)], "well string, ds date, v double")
    for tau in (0.01, 2.0, 50.0):
        d, y = np.exp(-1 / tau), [x[0]]
        for k in range(1, n):
            y.append(d * y[-1] + (1 - d) * x[max(k - 2, 0)])
        got = [q["v_crm"] for q in features.crm_filter(df, "well", "ds", "v", tau).orderBy("ds").collect()]
        assert np.allclose(got, y)
    a = [x[0]]
    for v in x[1:]:
        a.append(0.9 * v + 0.1 * a[-1])
    assert np.allclose([q["v_ema"] for q in features.ema(df, "well", "ds", "v", 0.1).orderBy("ds").collect()], a)


@pytest.mark.parametrize("n", [3, 4, 5, 8, 11, 14, 15, 30])
def test_production_stage_of_any_length(spark, n):
    import pandas as pd

    x = np.random.default_rng(n).normal(size=n)
    want = np.zeros(n, int)
    if n >= 5:
        s = pd.Series(x).rolling(min(5, n // 3), center=True).mean().bfill().ffill()
        d = s.diff().fillna(0.0).to_numpy()
        want = np.where(d > 0.5 * d.std(), 1, np.where(d < -0.5 * d.std(), 2, 0))
    df = spark.createDataFrame([("a", month(k), float(v)) for k, v in enumerate(x)], "well string, ds date, v double")
    assert [r["stage"] for r in features.production_stage(df, "well", "ds", "v").orderBy("ds").collect()] == want.tolist()


def brute_information(x, y, k=3):
    """Counts of points nearer than the k-th neighbour, pair by pair."""
    n = len(x)
    x, y = x / x.std(), y / y.std()
    total = 0.0
    digamma = lambda m: sum(1 / j for j in range(1, m)) - 0.5772156649015329
    for i in range(n):
        d = sorted(max(abs(x[i] - x[j]), abs(y[i] - y[j])) for j in range(n) if j != i)[k - 1]
        total += sum(digamma(1 + sum(abs(v[i] - v[j]) < d for j in range(n) if j != i)) for v in (x, y))
    return min(max(digamma(n) + digamma(k) - total / n, 0.0) / np.log(n + 1), 1)


def test_pair_statistics_by_brute_force(spark):
    r = np.random.default_rng(5)
    x, c = r.normal(size=60), r.normal(size=60)
    y = 0.8 * x + 0.5 * c + 0.2 * r.normal(size=60)
    df = spark.createDataFrame([("p", "i", month(k), float(y[k]), float(x[k]), float(c[k])) for k in range(60)], "prod_id string, inj_id string, ds date, y double, x double, c double")
    got = st.pair_statistics(df).first()
    assert got["mi"] == pytest.approx(brute_information(x, y), abs=1e-9)
    left = lambda v: v - np.polyval(np.polyfit(c, v, 1), c)
    assert got["cmi"] == pytest.approx(brute_information(left(x), left(y)), abs=1e-9)
    power = []
    for v in (x, y):
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
        parts = [[abs(sum((s - s.mean()) * w * np.exp(-2j * np.pi * f * np.arange(32) / 32))) ** 2 for f in range(17)] for s in (v[a : a + 32] for a in (0, 16))]
        power.append(np.log(np.mean(parts, axis=0) + 1e-12))
    assert got["psd_corr"] == pytest.approx((np.corrcoef(*power)[0, 1] + 1) / 2)
    assert st.pair_statistics(df, ("mi",)).columns == ["prod_id", "inj_id", "mi"]
    assert st.pair_statistics(df.where("ds < '2000-06-01'")).first()["mi"] is None


def test_regimes_have_no_gaps(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=60)
    df = spark.createDataFrame([("a", month(k), float(x)) for k, x in enumerate(v)] + [("b", month(k), 1.0) for k in range(3)], "prod_id string, ds date, v double")
    got = attention.regimes(df, "prod_id", "ds", "v", CUT).orderBy("prod_id", "ds").collect()
    train = [x["regime_id"] for x in got if x["prod_id"] == "a" and x["ds"] <= CUT]
    assert sorted(set(train)) == list(range(len(set(train)))) and {x["regime_id"] for x in got if x["prod_id"] == "a"} <= set(train)
    assert {x["regime_id"] for x in got if x["prod_id"] == "b"} == {0}


def test_stacked_fit_meets_its_conditions(spark):
    r = np.random.default_rng(8)
    n, shrink = 40, 0.2
    x, dx = r.normal(size=(n, 3)), r.normal(size=(n, 3))
    y = x @ [1.0, 0.3, -0.5] + 0.1 * r.normal(size=n)
    rows = [("p", month(k), 0, f"i{j}", float(y[k]), float(x[k, j]), float(dx[k, j]), 0.5 if j else 0.0) for k in range(n) for j in range(3)]
    df = spark.createDataFrame(rows, "prod_id string, ds date, regime_id int, inj_id string, y double, x double, dx double, prior double")
    got = {q["inj_id"]: q["learned"] for q in attention.regime_weights(df, shrink, None, ("x", "dx")).collect()}
    assert sum(got.values()) == pytest.approx(1) and min(got.values()) >= 0
    w = (np.array([got[f"i{j}"] for j in range(3)]) - shrink * np.array([0, 0.5, 0.5])) / (1 - shrink)
    # The shares belong to a vector that meets the elastic net's conditions on the stacked rows.
    a, target, alpha, l1 = np.vstack((x, dx)), np.tile(y, 2), max(1e-5, 1e-3 * (1 - shrink)), 0.7
    a, target = a - a.mean(0), target - target.mean()
    active = w > 1e-9
    scale = np.linalg.solve(a[:, active].T @ a[:, active] / (2 * n) + alpha * (1 - l1) * np.eye(active.sum()), a[:, active].T @ target / (2 * n) - alpha * l1)
    assert np.allclose(scale / scale.sum(), w[active], atol=1e-6)
    few = {q["inj_id"]: q["learned"] for q in attention.regime_weights(df.where("ds < '2000-09-01'"), shrink, None, ("x", "dx")).collect()}
    assert few == pytest.approx({"i0": 0.0, "i1": 0.5, "i2": 0.5})


def test_assemble_pulls_the_future_to_the_last_training_rows(spark):
    rows = [("p", "i", month(k), 0.5, 0.2 + 0.1 * k, 0.4) for k in range(6)]
    df = spark.createDataFrame(rows, "prod_id string, inj_id string, ds date, mix double, learned double, prior double")
    got = [r["alpha"] for r in attention.assemble(df, month(3), 0.25).orderBy("ds").collect()]
    alpha = [0.5 * (0.2 + 0.1 * k) + 0.2 for k in range(6)]
    held = np.mean(alpha[1:4])
    assert got == pytest.approx([*alpha[:4], *(0.75 * a + 0.25 * held for a in alpha[4:])])


def test_kernel_choice_keeps_the_base_of_equals():
    tried = injection.candidates(injection.Settings())
    assert tried[0] == (0, "idw", {"p": 1.5}) and len(tried) == len({(k, tuple(sorted(p.items()))) for k, _, p in tried}) == 40
    assert injection.choose(tried, {}) == (0, 0.0)
    base = next(k for k, (n, _, _) in enumerate(tried) if n == 2)
    assert injection.choose(tried, {base: 5.0, base + 1: 5.0 + 1e-12, base + 2: 4.0})[0] == base
    assert injection.choose(tried, {0: 5.0, base: 5.0})[0] == 0 and injection.choose(tried, {1: 5.0, 0: 4.0})[0] == 1


def field_rows(spark, injectors=True):
    r = np.random.default_rng(6)
    kinds = {"1": "PROD", "2": "PROD", "4": "PROD", "3": "INJ", "6": "INJ", "9": "INJ"} if injectors else {"1": "PROD", "2": "PROD"}
    rates = {w: np.abs(r.normal(50, 15, 60)) for w in kinds}
    for k in range(2, 60):
        for w in ("1", "2"):
            rates[w][k] = rates[w][k] * 0.2 + (rates["3"][k - 1] if injectors else 0)
    rows = [(w, month(k), t, float(rates[w][k]) if t == "PROD" else 0.0, float(rates[w][k]) if t == "INJ" else 0.0, float(100 + r.normal())) for w, t in kinds.items() for k in range(60) if (w, k) != ("4", 30)]
    places = spark.createDataFrame([(w, 300.0 * int(w), 100.0 * (int(w) % 4), -2000.0) for w in kinds], "well string, x double, y double, z double")
    return spark.createDataFrame(rows, "well string, ds date, type string, wlpr double, wwir double, wthp double"), places


def test_injection_features_as_one_call(spark):
    panel, places = field_rows(spark)
    made = injection.build(panel, places, CUT, injection.Settings(top=3))
    rows = made.features.collect()
    assert len(rows) == 3 * 60 and made.features.columns == ["well", "ds", *injection.FEATURES]
    assert all(np.isfinite(r[c]) for r in rows for c in injection.FEATURES)
    sums = made.alpha.groupBy("prod_id", "ds").agg(F.sum("alpha").alias("s"), F.min("alpha").alias("m")).collect()
    assert len(sums) == 180 and all(s["s"] == pytest.approx(1) and s["m"] >= 0 for s in sums)
    summary = {(r["prod_id"], r["inj_id"]): r for r in made.summary.collect()}
    assert len(summary) == 9 and all(1 <= r["lower_bound"] <= r["lag"] <= r["upper_bound"] and r["tau"] >= r["lower_bound"] for r in summary.values())
    assert summary["1", "3"]["weight"] == max(r["weight"] for (p, _), r in summary.items() if p == "1") and summary["1", "3"]["corr"] > 0.7
    for p in "124":
        assert sum(r["weight"] for (q, _), r in summary.items() if q == p) == pytest.approx(1)
    # The plain features are the weighted lagged rates.
    x = {(r["well"], r["ds"]): r["wwir"] for r in panel.where("type = 'INJ'").collect()}
    back = lambda d, m: dt.date(d.year + (d.month - 1 - m) // 12, (d.month - 1 - m) % 12 + 1, 1)
    for r in rows[::17]:
        want = sum(s["weight"] * x.get((i, back(r["ds"], s["lag"])), 0.0) for (p, i), s in summary.items() if p == r["well"])
        assert r["inj_wwir_lag_weighted"] == pytest.approx(want)
    assert made.kernel[0] in {c[0] for c in injection.CANDIDATES}


def test_injection_without_injectors(spark):
    panel, places = field_rows(spark, injectors=False)
    made = injection.build(panel, places, CUT)
    assert made.summary.count() == 0 and made.kernel is None and made.alpha is None
    assert {r[c] for r in made.features.collect() for c in injection.FEATURES} == {0.0}


def test_field_features_as_one_call(spark):
    panel, places = field_rows(spark)
    prod = panel.where("type = 'PROD'").select("well", "ds", "wlpr")
    chosen = spark.createDataFrame([("1", "3", 0.6, 2, 3.0), ("1", "6", 0.4, 1, 2.0)], "prod_id string, inj_id string, weight double, lag int, tau double")
    made, static = field.build(prod, places, CUT, chosen)
    got = {r["well"]: r for r in static.collect()}
    assert set(got) == {"1", "2", "3", "4", "6", "9"} and got["1"]["crm_sum"] == pytest.approx(1) and got["1"]["crm_tau"] == 2.5 and got["2"]["crm_count"] == 0
    assert sum(r["pagerank"] for r in got.values()) == pytest.approx(0, abs=1e-9)
    rows = made.collect()
    assert len(rows) == prod.count() and {"wlpr_graph_agg", "wlpr_dtw_agg", "degree", "graph_n2v_0", "graph_spectral_3"} <= set(made.columns)


def test_graph_measures_in_one_task_and_series_functions(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, d double")
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "well string")
    got = {r["well"]: r["v"] for r in st.whole_graph(edges, names, lambda n, w, d: {"v": w.sum(1)}, "well string, v double").collect()}
    assert got == {"a": 1.0, "b": 2.0, "c": 1.0, "x": 0.0}
    rows = spark.createDataFrame([(w, month(k), float(v)) for w, s in (("a", [1, 2, 4, 7]), ("b", [1, 2, 4, 7]), ("c", [5, 5, 5, 5])) for k, v in enumerate(s)], "well string, ds date, v double")
    steps = st.z_scored_steps(rows, "well", "ds", "v", month(9))
    assert {r["well"]: len(r["s"]) for r in steps.collect()} in ({"a": 3, "b": 3, "c": 3}, {"a": 4, "b": 4, "c": 4})
    some = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    d = {(r["src"], r["dst"]): r["dtw"] for r in st.warped_distances(steps, some).collect()}
    assert d["a", "b"] == 0 and d["a", "c"] > 0
    like = {(r["src"], r["dst"]): r["similarity"] for r in st.warped_similarity(st.warped_distances(steps, some)).collect()}
    assert like["a", "b"] == 1 and 0 < like["a", "c"] < 1


def test_series_kernels(spark):
    t, v = np.arange(12.0), np.arange(12.0) ** 2
    gone = v.copy()
    gone[[3, 7]] = np.nan
    df = spark.createDataFrame([("a", month(k), None if np.isnan(x) else float(x)) for k, x in enumerate(gone)], "well string, ds date, v double")
    got = [r["v_filled"] for r in st.impute_spline(df, "well", "ds", "v").orderBy("ds").collect()]
    assert np.allclose(got, v, atol=2.0) and got[0] == 0 and got[5] == 25
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 2))
    x[17] = (25, -25)
    df = spark.createDataFrame([("a", month(k), float(a), float(b)) for k, (a, b) in enumerate(x)] + [("b", month(k), 1.0, 2.0) for k in range(4)], "well string, ds date, p double, q double")
    flags = {(r["well"], r["ds"]): r["is_outlier"] for r in st.outlier_flags(df, "well", "ds", ["p", "q"]).collect()}
    assert flags["a", month(17)] and sum(flags.values()) <= 6 and not any(f for (w, _), f in flags.items() if w == "b")
    wide = features.windowed_matrix(df.where("well = 'a'"), "well", "ds", "p")
    made = st.window_embedding(wide, "well", "ds", "p_window", month(40)).collect()
    assert len(made) == 48 and all(len(m["embedding"]) == 3 for m in made)
    assert st.conditional_information(x[:, 0], x[:, 0], x[:, 1]) > st.conditional_information(x[:, 0], r.normal(size=60), x[:, 1])
