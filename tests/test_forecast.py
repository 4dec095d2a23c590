"""Conformal intervals and evaluation against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvion.operators import conformal, forecasting, metrics, reservoir


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=int(k))


def brute_eps(errors, method, alpha=0.1, decay=0.97):
    """errors in order of time."""
    e, n = np.asarray(errors, float), len(errors)
    if method == "icp":
        level = min(1.0, np.ceil((n + 1) * (1 - alpha)) / n)
        return np.sort(e)[int(np.clip(np.ceil(level * n), 1, n)) - 1]
    w = np.arange(1, n + 1) if method == "wcp_linear" else decay ** np.arange(n - 1, -1, -1)
    order = np.argsort(e, kind="stable")
    share = np.cumsum(w[order]) / w.sum()
    return e[order][min(int(np.searchsorted(share, 1 - alpha - 1e-12)), n - 1)]


@pytest.mark.parametrize("method", ["icp", "wcp_linear", "wcp_exp"])
@pytest.mark.parametrize("parts", [64, 3])
def test_epsilon_equals_sorting(spark, monkeypatch, method, parts):
    monkeypatch.setattr(conformal, "PARTS", parts)
    r = np.random.default_rng(4)
    rows, want = [], {}
    for h, n in ((1, 1), (2, 7), (3, 500), (4, 300)):
        e = np.round(r.exponential(size=n), 1 if h == 3 else 6)  # ties in step 3
        if h == 4:
            e[100:] = 2.0  # most rows have one value
        want[h] = brute_eps(e, method)
        rows += [(h, day(k // 3), f"{k:05d}", float(v)) for k, v in enumerate(e)]
    df = spark.createDataFrame(rows, "h_step int, ds date, unique_id string, abs_err double").repartition(7)
    got = {x["h_step"]: x["eps"] for x in conformal.epsilon(df, method, by=["h_step"]).collect()}
    assert got == pytest.approx(want)
    whole = sorted(rows, key=lambda x: (x[1], x[2], x[0]))
    one = df.withColumn("unique_id", F.concat("unique_id", F.lit("-"), F.col("h_step").cast("string")))
    assert conformal.epsilon(one, method).first()["eps"] == pytest.approx(brute_eps([x[3] for x in whole], method))
    assert conformal.epsilon(df.where("false"), method, by=["h_step"]).count() == 0


def test_profile_falls_back_and_applies(spark):
    assert [conformal.method_of(n) for n in ("split", " SCP ", "wcp", "wcp_lin", None, "?")] == ["icp", "icp", "wcp_exp", "wcp_linear", "wcp_exp", "wcp_exp"]
    rows = [(h, day(k), f"{h}{k}", float(k % 7 + h)) for h in (1, 2) for k in range(40 if h == 1 else 5)] + [(1, day(99), "none", None)]
    df = spark.createDataFrame(rows, "h_step int, ds date, unique_id string, abs_err double")
    got = {r["h_step"]: r for r in conformal.profile(df, 3, "icp", least=30).collect()}
    assert {h: (r["cp_source"], r["samples"]) for h, r in got.items()} == {1: ("per_horizon", 40), 2: ("global_fallback", 5), 3: ("global_fallback", 0)}
    assert got[2]["cp_eps"] == got[3]["cp_eps"] == got[1]["global_eps"] and got[1]["global_samples"] == 45
    future = spark.createDataFrame([("a", day(k), 10.0) for k in range(5)], "unique_id string, ds date, y_hat double")
    made = conformal.apply(future, conformal.profile(df, 3, "icp"), 3).orderBy("ds").collect()
    assert [r["h_step"] for r in made] == [1, 2, 3, 3, 3] and made[0]["cp_hi"] - made[0]["cp_lo"] == pytest.approx(2 * got[1]["cp_eps"])
    with pytest.raises(ValueError):
        conformal.apply(df, df, 3)


def test_interval_columns():
    assert conformal.interval_columns(["y", "q_0.1", "q_0.4", "q_0.7", "q_x", "q_0.5"]) == ("q_0.4", "q_0.7", pytest.approx(0.3), "quantile")
    assert conformal.interval_columns(["q_0.1", "cp_lo", "cp_hi", "q_0.9"])[:2] == ("cp_lo", "cp_hi")
    assert conformal.interval_columns(["q_0.1", "y"]) is None


def test_merge_needs_common_rows(spark):
    f = spark.createDataFrame([("a", day(0), 1.0, 0.5)], "unique_id string, ds date, y_hat double, `q_0.1` double")
    a = spark.createDataFrame([("a", day(0), 2.0)], "unique_id string, ds date, y double")
    assert conformal.merge_forecast(f, a).columns == ["unique_id", "ds", "y", "y_hat", "q_0.1"]
    with pytest.raises(ValueError):
        conformal.merge_forecast(f, a.withColumn("unique_id", F.lit("b")))


def test_reservoir_metrics_of_one_series(spark):
    r = np.random.default_rng(2)
    n = 30
    y, f, x = (np.abs(r.normal(10, 3, n)) for _ in range(3))
    cut, cut_hat, p, p_hat = np.linspace(0.1, 0.9, n), np.linspace(0.2, 0.8, n), r.normal(100, 5, n), r.normal(100, 5, n)
    df = spark.createDataFrame([("a", k, *(float(v[k]) for v in (y, f, x, cut, cut_hat, p, p_hat))) for k in range(n)], "id string, t int, y double, y_hat double, x double, cut double, cut_hat double, p double, p_hat double")
    got = reservoir.collection(df.withColumns({"low": F.col("y_hat") - 1, "high": F.col("y_hat") + 1}), "id", low="low", high="high").first()
    a, b = int(y.argmax()), int(f.argmax())
    assert got["decline_peak_time_error_months"] == abs(a - b)
    if a < n - 4 and b < n - 4:
        assert got["decline_decline_rate_true"] == pytest.approx(-np.polyfit(np.arange(n)[a:], np.log(y[a:]), 1)[0])
    assert got["decline_plateau_duration_true"] == (y >= 0.9 * y.max()).sum()
    assert got["pressure_pressure_gradient_rmse"] == pytest.approx(np.sqrt(np.mean((np.gradient(p_hat) - np.gradient(p)) ** 2)))
    assert got["pressure_drawdown_error_bar"] == pytest.approx(abs((p_hat[0] - p_hat[-1]) - (p[0] - p[-1])))
    lags = np.correlate(y - y.mean(), x - x.mean(), "full")[n - 1 :]
    assert got["injection_response_lag_true"] == lags.argmax()
    dy, dx = np.diff(y, prepend=y[0]), np.diff(x, prepend=x[0])
    assert got["injection_injection_efficiency_true"] == pytest.approx(np.cov(dy, dx)[0, 1] / dx.var())
    assert got["waterflood_breakthrough_time_true"] == np.flatnonzero(cut >= 0.5)[0] and got["waterflood_water_cut_gradient_true"] == pytest.approx(np.gradient(cut).mean())
    assert got["reliability_picp"] == pytest.approx(np.mean(np.abs(y - f) <= 1))
    short = reservoir.collection(df.where("t < 2"), "id").first()
    assert short["injection_response_lag_true"] is None and short["decline_decline_rate_true"] is None and short["waterflood_recovery_factor_true"] is None


def test_decline_of_a_nearly_level_series(spark):
    """The slope is 8e-6: the quotient by it shows the last digits of the sums behind it."""
    rates = [52, 330, 192, 195, 180, 252, 165, 157, 78, 111, 195, 259, 187, 196, 257, 126, 363, 251, 150, 229, 225, 241, 156, 188, 214, 86, 139, 228, 335, 191, 181, 152, 141, 201, 98, 397, 188, 148, 164, 72, 215, 190, 242, 231, 83, 198, 129, 272, 289, 131, 133, 175, 64, 202, 242, 193, 113, 197, 254, 77, 219, 131, 45, 61, 251, 219, 96, 96, 320, 394, 161, 269, 159, 91, 193, 136, 250, 143, 288, 228, 153, 167]
    rows = [("a", k, float(rates[k]), sum(map(float, rates[k - 3 : k])) / 3) for k in range(3, len(rates))]
    got = reservoir.decline(spark.createDataFrame(rows, "id string, t int, y double, y_hat double"), "id").first()
    assert got["decline_rate_true"] == pytest.approx(-8.146509565929631e-06, rel=1e-12)
    assert round(got["decline_rate_error_pct"], 6) == -166915.508289  # -166915.50828882917 by 50 digits


def test_full_metrics_and_fold_means(spark):
    df = spark.createDataFrame([("a", float(k), float(k + k % 2)) for k in range(10)] + [("b", 1.0, 1.0)], "unique_id string, y double, y_hat double")
    scales = spark.createDataFrame([("a", 2.0), ("b", 0.0)], "unique_id string, scale double")
    got = {r["unique_id"]: r for r in metrics.evaluate_all(df, ["unique_id"], scales=scales, features=3).collect()}
    assert got["a"]["mase"] == pytest.approx(0.25) and got["b"]["mase"] is None
    assert got["a"]["adjusted_r2"] == pytest.approx(1 - (1 - got["a"]["r2"]) * 9 / 6) and got["a"]["ioa"] > 0.9
    folds = spark.createDataFrame([(1, 10, 2.0, None), (2, 30, 4.0, 1.0)], "fold int, n int, mae double, kge double")
    mean = metrics.fold_means(folds, ["mae", "kge"]).first()
    assert (mean["mae"], mean["kge"], mean["n"]) == (3.5, 1.0, 40)


def test_physics_weight_schedules():
    for name in ("linear", "exponential", "cosine"):
        w = [forecasting.physics_weight(k, name) for k in range(0, 400, 10)]
        assert w[0] == 0.01 and w[4] == 0.01 and w[-1] == pytest.approx(0.3) and all(a <= b + 1e-12 for a, b in zip(w, w[1:]))


def test_folds_learn_from_their_own_past_only(spark):
    rows = spark.createDataFrame([(w, dt.date(2000 + k // 12, k % 12 + 1, 1), float(k)) for w in "ab" for k in range(30)], "well string, ds date, v double")
    made = forecasting.fold_features(rows, "well", "ds", 3, 3, 2, lambda df, end: df.crossJoin(df.where(F.col("ds") <= F.lit(end)).agg(F.max("v").alias("seen"))).select("well", "ds", "seen"))
    seen = {(r["fold"], r["part"]): (r["seen"], r["n"]) for r in made.groupBy("fold", "part", "seen").agg(F.count("*").alias("n")).collect()}
    assert seen == {(0, "train"): (23.0, 48), (0, "val"): (23.0, 6), (1, "train"): (26.0, 54), (1, "val"): (26.0, 6)}
