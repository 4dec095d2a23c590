"""Panel operators on small hand-made tables: nulls, gaps, ties, short series, empty tables;
and numeric kernels against brute force or their invariants."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvion.functions.html import markdown
from fluvion.operators import attention, features, forecasting, graph, metrics, pairs, panel, quality
from fluvion.operators import statistics as st


def month(k):
    return dt.date(2020 + k // 12, k % 12 + 1, 1)


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, month(k), v) for k, v in enumerate(values)], "well string, ds date, v double")


def column(df, name, order=("well", "ds")):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_reindex_drops_off_grid_rows_and_fills_gaps(spark):
    df = spark.createDataFrame([("a", month(0), 1.0), ("a", month(3), 2.0), ("a", dt.date(2020, 2, 15), 9.0), ("b", dt.date(2020, 1, 5), 1.0)], "well string, ds date, v double")
    got = [(r["well"], r["ds"], r["v"]) for r in panel.reindex(df, "well", "ds").orderBy("well", "ds").collect()]
    assert got == [("a", month(0), 1.0), ("a", month(1), None), ("a", month(2), None), ("a", month(3), 2.0)]


def test_fills(spark):
    df = series(spark, [None, 1.0, None, 3.0, None])
    assert column(panel.forward_fill(df, "well", "ds", ["v"]), "v") == [0.0, 1.0, 1.0, 3.0, 3.0]
    assert column(panel.both_fill(df, "well", "ds", ["v"]), "v") == [1.0, 1.0, 1.0, 3.0, 3.0]
    assert column(panel.cumulative_max(series(spark, [2.0, None, 1.0, 5.0]), "well", "ds", ["v"]), "v") == [2.0, None, 2.0, 5.0]
    assert column(panel.clip_nonnegative(series(spark, [-1.0, None, 2.0]), ["v"]), "v") == [0.0, None, 2.0]
    filled = panel.fill_missing(series(spark, [float("nan"), None, 2.0]), ["v", "w"])
    assert column(filled, "v") == [0.0, 0.0, 2.0] and column(filled, "w") == [0.0] * 3


def test_keep_first_settles_ties_by_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert {r["v"] for r in panel.keep_first(df, ["k"], ["n"]).collect()} == {"y", "z"}


def test_target_wells_and_split(spark):
    rows = [("a", month(k), "PROD") for k in range(10)] + [("b", month(k), "PROD" if k < 9 else "INJ") for k in range(10)] + [("c", month(0), "PROD")]
    df = spark.createDataFrame(rows, "well string, ds date, type string")
    assert [r["well"] for r in panel.target_wells(df, "well", "ds", least=5).collect()] == ["a"]
    parts = {(r["ds"]): r["part"] for r in panel.split(df.where("well = 'a'"), "well", "ds", 3).collect()}
    assert [parts[month(k)] for k in range(10)] == ["train"] * 7 + ["test"] * 3


def test_walk_forward_needs_long_series(spark):
    df = series(spark, [float(k) for k in range(20)])
    got = panel.walk_forward(df, "well", "ds", 2, 3, 3)
    assert {r["fold"]: (r["train"], r["val"]) for r in got.groupBy("fold").pivot("part", ["train", "val"]).count().collect()} == {0: (12, 2), 1: (15, 2), 2: (18, 2)}
    with pytest.raises(ValueError):
        panel.walk_forward(df, "well", "ds", 10, 10, 3)
    with pytest.raises(ValueError):
        panel.walk_forward(df.where("false"), "well", "ds", 1, 1, 1)


def test_crm_filter_follows_its_recurrence(spark):
    got = column(features.crm_filter(series(spark, [0.0, 10.0, 20.0, 30.0, 40.0]), "well", "ds", "v", 2.0), "v_crm")
    assert got == pytest.approx([0, 0, 0, 3.9346934, 10.25589899])
    assert column(features.crm_filter(series(spark, [7.0]), "well", "ds", "v", 2.0), "v_crm") == [7.0]
    assert column(features.ema(series(spark, [1.0, 2.0, 4.0]), "well", "ds", "v", 0.5), "v_ema") == [1.0, 1.5, 2.75]


def test_features_on_short_and_flat_series(spark):
    one = series(spark, [5.0])
    assert column(features.pressure_features(one.withColumn("p", F.col("v")), "well", "ds", "v", "p"), "pressure_gradient") == [0.0]
    assert column(features.rolling_stats(one, "well", "ds", "v", [3]), "v_ma3") == [None]
    assert column(features.savgol(series(spark, [2.0] * 9), "well", "ds", "v"), "v_smooth") == pytest.approx([2.0] * 9)
    assert column(features.bilateral(series(spark, [2.0] * 9), "well", "ds", "v"), "v_bilateral") == pytest.approx([2.0] * 9)
    assert column(features.production_stage(series(spark, [1.0] * 5), "well", "ds", "v"), "stage") == [0] * 5
    flags = features.structural_breaks(series(spark, [100.0, 10.0, None, 0.5, 50.0]), "well", "ds", "v")
    assert column(flags, "is_shutdown") == [False, True, False, False, False] and column(flags, "is_startup") == [False, False, False, False, True]


def test_impute_linear_monotone(spark):
    day = lambda k: dt.date(2020, 1, 1 + k)
    df = spark.createDataFrame([("a", day(k), v) for k, v in enumerate([None, 2.0, None, 4.0, None])] + [("b", day(0), None), ("b", day(1), 3.0), ("b", day(2), None)], "well string, ds date, v double")
    assert column(features.impute_linear_monotone(df, "well", "ds", "v"), "v_filled") == [1.0, 2.0, 3.0, 4.0, 5.0, 0.0, 3.0, 3.0]


def test_quality(spark):
    df = spark.createDataFrame([("a", month(0), 1.0), ("a", month(0), 1.0), ("a", month(5), None), ("b", month(0), -1.0)], "well string, ds date, v double")
    got = {(r["check"], r["column"]): r["value"] for r in quality.quality_report(df, "well", "ds", ["v"]).collect()}
    assert got[("rows", "")] == 4 and got[("nulls", "v")] == 1 and got[("negative", "v")] == 1 and got[("gaps", "well")] == 1 and got[("repeated", "well")] == 1
    empty = {(r["check"], r["column"]): r["value"] for r in quality.quality_report(df.where("false"), "well", "ds", ["v"]).collect()}
    assert set(empty.values()) == {0.0}
    wells = spark.createDataFrame([("a", 1.0, None, 1.0), ("a", 1.0, 1.0, 1.0)], "well string, x double, y double, z double")
    assert {r["check"]: r["value"] for r in quality.coordinate_validation(wells, "well").collect()} == {"null_coordinates": 1.0, "repeated_wells": 1.0}


def test_golden_lag_window(spark):
    pair = spark.createDataFrame([("14", "15", 794.2739212196323)], "prod_id string, inj_id string, d double")
    got = pairs.lag_window(pair).first()
    assert got["t_diff"] == pytest.approx(2.130766939807144) and got["t_front"] == pytest.approx(32.130766939807145)
    assert (got["lower_bound"], got["upper_bound"]) == (1, 2)


def test_golden_causal_score(spark):
    row = spark.createDataFrame([(0.061526860810793, 0.43772871706185923, 0.9888796735496237, 0.4188941014048544)], "g double, mi double, psd double, cmi double")
    got = pairs.causal_score(row, {"g": 0.35, "mi": 0.30, "psd": 0.20, "cmi": 0.15}).first()["causal_score"]
    assert got == pytest.approx(0.41346306632298824)
    none = row.select(F.lit(None).cast("double").alias("g"))
    assert pairs.causal_score(none, {"g": 1.0}).first()["causal_score"] in (None, 0.0)


def test_weights_and_errors(spark):
    df = spark.createDataFrame([("p", "i", 0.0), ("p", "j", 0.0), ("q", "i", 1.0), ("q", "j", 3.0)], "prod_id string, inj_id string, w double")
    got = {(r["prod_id"], r["inj_id"]): r["weight"] for r in pairs.normalised(df, "prod_id", "w").collect()}
    assert got == {("p", "i"): 0.5, ("p", "j"): 0.5, ("q", "i"): 0.25, ("q", "j"): 0.75}
    with pytest.raises(ValueError):
        pairs.metric_distance(df, [[1, 0, 0], [0, -1, 0], [0, 0, 1]])
    with pytest.raises(ValueError):
        pairs.kernel("none", F.col("w"))
    with pytest.raises(ValueError):
        pairs.direction_factor(df, (0, 0, 0))


def test_best_lag_finds_a_planted_delay(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=60)
    y = np.concatenate((r.normal(size=3), x[:-3])) + 0.01 * r.normal(size=60)
    pair = spark.createDataFrame([("a", "b", 1, 5)], "prod_id string, inj_id string, lower_bound long, upper_bound long")
    got = pairs.best_lag(pair, series(spark, y.tolist()).withColumnRenamed("v", "y"), series(spark, x.tolist(), "b").withColumnRenamed("v", "x"), F.to_date(F.lit("2030-01-01"))).first()
    assert got["lag"] == 3 and got["corr"] > 0.99 and got["overlap"] == 57
    none = pairs.best_lag(pair, series(spark, [1.0]).withColumnRenamed("v", "y"), series(spark, [1.0], "b").withColumnRenamed("v", "x"), F.to_date(F.lit("2030-01-01"))).first()
    assert (none["lag"], none["corr"], none["overlap"]) == (1, 0.0, 0)


def test_granger(spark):
    r = np.random.default_rng(2)
    x, y = r.normal(size=80), np.zeros(80)
    for k in range(1, 80):
        y[k] = 0.5 * y[k - 1] + 2 * x[k] + 0.1 * r.normal()
    rows = spark.createDataFrame([("a", "b", month(k), float(y[k]), float(x[k])) for k in range(80)], "prod_id string, inj_id string, ds date, y double, x double")
    d = np.column_stack([np.ones(79), y[:-1]])
    full = np.column_stack([d, x[1:]])
    mse = [np.mean((y[1:] - m @ np.linalg.lstsq(m, y[1:], rcond=None)[0]) ** 2) for m in (d, full)]
    assert pairs.granger(rows).first()["granger"] == pytest.approx((mse[0] - mse[1]) / mse[0])
    assert pairs.granger(rows.limit(5)).first()["granger"] is None


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 5.0, 5.0), ("b", 5.0, 5.0)], "unique_id string, y double, y_hat double")
    got = metrics.evaluate(df).first()
    assert got["mae"] == 0.25 and got["rmse"] == 0.5 and got["wmape"] == pytest.approx(100 / 14)
    flat = {r["unique_id"]: r for r in metrics.evaluate(df, ["unique_id"]).collect()}["b"]
    assert flat["r2"] is None and flat["correlation"] is None and flat["mae"] == 0
    assert metrics.evaluate(df.where("false")).first()["mae"] is None


def test_edges_within_equals_all_pairs(spark):
    r = np.random.default_rng(3)
    p = r.uniform(-50, 50, (60, 2))
    df = spark.createDataFrame([(f"w{k:02d}", float(a), float(b), 0.0) for k, (a, b) in enumerate(p)], "well string, x double, y double, z double")
    got = {(r["src"], r["dst"]) for r in graph.edges_within(df, 17.0).collect()}
    assert got == {(f"w{i:02d}", f"w{j:02d}") for i in range(60) for j in range(i + 1, 60) if np.hypot(*(p[i] - p[j])) <= 17.0}


def test_graph_measures_of_a_path(spark):
    wells = spark.createDataFrame([(k,) for k in "abcz"], "well string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src string, dst string, d double")
    assert {r["well"]: r["degree"] for r in graph.degree_centrality(wells, edges).collect()} == {"a": 1 / 3, "b": 2 / 3, "c": 1 / 3, "z": 0.0}
    assert {r["well"]: r["clustering"] for r in graph.clustering(wells, edges).collect()} == dict.fromkeys("abcz", 0.0)
    rank = {r["well"]: r["rank"] for r in graph.pagerank(wells, edges, rounds=12).collect()}
    assert sum(rank.values()) == pytest.approx(1) and rank["b"] > rank["a"] > rank["z"]
    close = {r["well"]: r["closeness"] for r in graph.closeness(wells, edges, 3).collect()}
    assert close["a"] == pytest.approx(4 / (4 * 3)) and close["z"] == 0.0
    score = st.betweenness(np.array([[np.inf, 1, np.inf], [1, np.inf, 2], [np.inf, 2, np.inf]]))
    assert score.tolist() == [0.0, 1.0, 0.0]


def test_warped_distance_against_recursion():
    r = np.random.default_rng(4)
    for n, m in ((1, 1), (1, 5), (6, 3), (12, 12), (20, 7)):
        a, b = r.normal(size=n), r.normal(size=m)
        d = np.full((n + 1, m + 1), np.inf)
        d[0, 0] = 0
        for i in range(n):
            for j in range(m):
                d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
        assert st.warped_distance(a, b) == pytest.approx(np.sqrt(d[n, m]))


def test_numeric_invariants():
    r = np.random.default_rng(5)
    x = r.normal(size=200)
    assert st.mutual_information(x, x + 0.01 * r.normal(size=200)) > 0.5 > 0.1 > st.mutual_information(x, r.normal(size=200))
    assert np.isnan(st.mutual_information(x[:7], x[:7]))
    assert st.spectral_correlation(x, x) == pytest.approx(1.0) and np.isnan(st.spectral_correlation(x[:9], x[:9]))
    t = np.arange(10.0)
    v = t**2
    v[[3, 6]] = np.nan
    assert st.cubic_fill(t, v)[[3, 6]] == pytest.approx([9, 36], abs=0.2)
    assert st.cubic_fill(t[:3], np.array([np.nan, 2.0, np.nan])).tolist() == [0.0, 2.0, 2.0]
    data = np.vstack([r.normal(size=(95, 2)), r.normal(size=(5, 2)) + 15])
    assert st.robust_outliers(data).nonzero()[0].tolist() == list(range(95, 100))
    w = np.abs(r.normal(size=(8, 8)))
    w = w + w.T
    np.fill_diagonal(w, 0)
    e = st.spectral(w, 3)
    assert e.T @ e == pytest.approx(np.eye(3), abs=1e-9)
    v = st.eigenvector(w)
    assert w @ v == pytest.approx((v @ w @ v) * v)
    assert st.walk_embedding(w).shape == (8, 4) and np.isfinite(st.walk_embedding(w)).all()
    blobs = np.vstack([r.normal(size=(10, 2)) * 0.1 + c for c in ((0, 0), (5, 5), (0, 9))])
    labels = st.cluster(blobs, 5)
    assert len(set(labels.tolist())) == 3 and all(len(set(labels[k : k + 10].tolist())) == 1 for k in (0, 10, 20))
    assert st.cluster(blobs[:2], 5).tolist() == [0, 0]


def test_positive_elastic_net_meets_its_conditions():
    r = np.random.default_rng(6)
    x = r.normal(size=(50, 5))
    y = x @ np.array([1.0, 0, 2.0, -1.0, 0]) + 3 + 0.1 * r.normal(size=50)
    w = st.positive_elastic_net(x, y, 0.05, 0.7)
    xc, yc = x - x.mean(0), y - y.mean()
    gradient = -xc.T @ (yc - xc @ w) / 50 + 0.05 * 0.7 + 0.05 * 0.3 * w
    assert (w >= 0).all() and np.abs(gradient[w > 0]).max() < 1e-6 and gradient[w == 0].min() > -1e-6


def test_forecasters(spark):
    y = np.arange(30.0)
    assert forecasting.persistence(y, 2).tolist() == [29, 29] and forecasting.drift(y, 2).tolist() == [30, 31]
    assert forecasting.seasonal(y, 2).tolist() == [18, 19] and len(forecasting.ridge(y, 4)) == 4
    assert all(f(y[:1], 3).tolist() == [0, 0, 0] and f(y[:0], 1).tolist() == [0] for f in forecasting.FORECASTERS.values())
    got = forecasting.forecast(series(spark, [1.0, 2.0]).selectExpr("well as unique_id", "ds", "v as y"), "drift", 2).orderBy("ds").collect()
    assert [(r["ds"], r["y_hat"]) for r in got] == [(month(2), 3.0), (month(3), 4.0)]


def test_simplex(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("a", float("nan")), ("a", None), ("b", 0.0), ("b", None)], "k string, v double")
    got = sorted((r["k"], r["s"]) for r in attention.simplex(df, ["k"], "v", "s").collect())
    assert got == [("a", 0.0), ("a", 0.0), ("a", 0.0), ("a", 1.0), ("b", 0.5), ("b", 0.5)]


def test_markdown():
    page = "<html><head><title>x</title></head><body><h2>A &amp; B</h2><p>one <b>two</b> <a href='u'>three</a></p><script>no</script><ol><li>i<li>ii</ol><p>unclosed"
    assert markdown(page) == "## A & B\n\none **two** [three](u)\n\n1. i\n2. ii\n\nunclosed"
    assert markdown(None) is None and markdown("") == "" and markdown("</p></ul>") == ""


def test_registry_is_complete(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["well", "ds", "type", "wlpr", "womr", "wwir", "wthp"]
