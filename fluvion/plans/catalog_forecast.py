"""Queries of conformal profiles, forecast evaluation and the reservoir's metrics; registered
on import. The forecast is the mean of the three months before, of every producer and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvion.operators import conformal, metrics, panel, pairs, reservoir
from fluvion.plans.catalog import query, rounded
from fluvion.plans.catalog_pairs import _METRICS, _RES, _residuals, _shifted
from fluvion.sources import tables as t

_W = "OVER (PARTITION BY unique_id ORDER BY t)"
_ALL = "OVER (PARTITION BY unique_id)"


def predicted(spark, sf) -> DataFrame:
    """unique_id, ds, t, y, oil, p, cut and their forecasts, x (injection), low, high."""
    b = Window.partitionBy("well").orderBy("ds").rowsBetween(-3, -1)
    inflow = pairs.injection_features(_shifted(spark, sf)).select(F.col("prod_id").alias("well"), "ds", F.col("inj_wwir_lag_weighted").alias("x"))
    rows = panel.time_index(panel.watercut(t.producers(spark, sf)), "well", "ds", "t").join(inflow, ["well", "ds"], "left")
    names = {"y": "wlpr", "oil": "womr", "p": "wthp", "cut": "watercut"}
    made = rows.select(F.col("well").alias("unique_id"), "ds", "t", *(F.col(c).alias(n) for n, c in names.items()), *(F.avg(c).over(b).alias(f"{n}_hat") for n, c in names.items()), F.coalesce("x", F.lit(0.0)).alias("x"))
    return made.where("t >= 3").withColumns({"low": 0.7 * F.col("y_hat"), "high": 1.3 * F.col("y_hat")})


def _places(part: dict[str, str], prefix: str = "") -> str:
    return ", ".join(f"round({e}, 6) + 0 AS {prefix}{n}" if kind == "f" else f"CAST({e} AS BIGINT) AS {prefix}{n}" for n, (kind, e) in part.items())


_GRADIENT = lambda c: f"CASE WHEN lag({c}) {_W} IS NULL THEN lead({c}) {_W} - {c} WHEN lead({c}) {_W} IS NULL THEN {c} - lag({c}) {_W} ELSE (lead({c}) {_W} - lag({c}) {_W}) / 2 END"
_DECLINE_FROM = f"""dp AS (SELECT *, max(y) {_ALL} AS py, max(y_hat) {_ALL} AS ph, max(t) {_ALL} AS e FROM predicted), dt AS (SELECT *, min(CASE WHEN y = py THEN t END) {_ALL} AS ty, min(CASE WHEN y_hat = ph THEN t END) {_ALL} AS th FROM dp),
  dg AS (SELECT unique_id, max(py) AS py, max(ph) AS ph, max(ty) AS ty, max(th) AS th, max(e) AS e, sum(y) AS cy, sum(y_hat) AS ch, count(*) FILTER (y >= 0.9 * py) AS qy, count(*) FILTER (y_hat >= 0.9 * ph) AS qh,
    count(*) FILTER (t >= ty AND y > 1e-9) AS ny, count(*) FILTER (t >= th AND y_hat > 1e-9) AS nh, regr_slope(CASE WHEN t >= ty AND y > 1e-9 THEN ln(y + 1e-9) END, t) AS sy, regr_slope(CASE WHEN t >= th AND y_hat > 1e-9 THEN ln(y_hat + 1e-9) END, t) AS sh FROM dt GROUP BY unique_id),
  decline AS (SELECT *, ny > 3 AND nh > 3 AND ty < e AND th < e AS fits FROM dg)"""
_DECLINE = {
    "peak_production_error_pct": ("f", "100 * abs(ph - py) / (py + 1e-9)"),
    "peak_time_error_months": ("i", "abs(th - ty)"),
    "decline_rate_true": ("f", "CASE WHEN fits THEN -sy END"),
    "decline_rate_pred": ("f", "CASE WHEN fits THEN -sh END"),
    "decline_rate_error_pct": ("f", "CASE WHEN fits THEN 100 * abs(sy - sh) / nullif(-sy + 1e-9, 0) END"),
    "cumulative_error_pct": ("f", "100 * abs(ch - cy) / (cy + 1e-9)"),
    "plateau_duration_true": ("i", "qy"),
    "plateau_duration_pred": ("i", "qh"),
    "plateau_duration_error": ("i", "abs(qh - qy)"),
}
_PRESSURE_FROM = f"""ps AS (SELECT *, {_GRADIENT("p_hat")} - ({_GRADIENT("p")}) AS g, abs(y / greatest(200 - p_hat, 1) - y / greatest(200 - p, 1)) AS i FROM predicted),
  pressure AS (SELECT unique_id, arg_min(p, t) - arg_max(p, t) AS dt, arg_min(p_hat, t) - arg_max(p_hat, t) AS dp, avg(i) AS i, sqrt(avg(g * g)) AS g FROM ps GROUP BY unique_id)"""
_PRESSURE = {"drawdown_error_bar": ("f", "abs(dp - dt)"), "drawdown_error_pct": ("f", "100 * abs(dp - dt) / nullif(dt + 1e-9, 0)"), "productivity_index_mae": ("f", "i"), "pressure_gradient_rmse": ("f", "g")}
_INJECTION_FROM = f"""js AS (SELECT *, y - coalesce(lag(y) {_W}, y) AS dy, y_hat - coalesce(lag(y_hat) {_W}, y_hat) AS dh, x - coalesce(lag(x) {_W}, x) AS dx, row_number() {_W} AS k, y - avg(y) {_ALL} AS cy, y_hat - avg(y_hat) {_ALL} AS ch, x - avg(x) {_ALL} AS cx FROM predicted),
  jg AS (SELECT unique_id, count(*) AS n, sum(x) / (sum(y) + 1e-9) AS vt, sum(x) / (sum(y_hat) + 1e-9) AS vp, CASE WHEN stddev_pop(dx) > 1e-9 THEN covar_samp(dy, dx) / (var_pop(dx) + 1e-9) END AS et, CASE WHEN stddev_pop(dx) > 1e-9 THEN covar_samp(dh, dx) / (var_pop(dx) + 1e-9) END AS ep FROM js GROUP BY unique_id),
  jl AS (SELECT a.unique_id, a.k - b.k AS l, round(sum(a.cy * b.cx), 3) AS st, round(sum(a.ch * b.cx), 3) AS sp FROM js a JOIN js b ON a.unique_id = b.unique_id AND a.k >= b.k GROUP BY a.unique_id, a.k - b.k),
  jb AS (SELECT unique_id, min(l) FILTER (a = 1) AS lt, min(l) FILTER (b = 1) AS lp FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY st DESC, l) AS a, row_number() OVER (PARTITION BY unique_id ORDER BY sp DESC, l) AS b FROM jl) GROUP BY unique_id),
  injection AS (SELECT jg.*, CASE WHEN n > 10 THEN lt END AS lt, CASE WHEN n > 10 THEN lp END AS lp FROM jg JOIN jb USING (unique_id))"""
_INJECTION = {"vrr_true": ("f", "vt"), "vrr_pred": ("f", "vp"), "vrr_error": ("f", "abs(vp - vt)"), "injection_efficiency_true": ("f", "et"), "injection_efficiency_pred": ("f", "ep"), "injection_efficiency_error": ("f", "abs(ep - et)"), "response_lag_true": ("i", "lt"), "response_lag_pred": ("i", "lp"), "response_lag_error": ("i", "abs(lp - lt)")}
_WATER_FROM = lambda oil, oil_hat: f"""ws AS (SELECT *, row_number() {_W} - 1 AS k, count(*) {_ALL} AS n, {_GRADIENT("cut")} AS gt, {_GRADIENT("cut_hat")} AS gp, {oil} AS ot, {oil_hat} AS op FROM predicted),
  wg AS (SELECT unique_id, min(k) FILTER (cut >= 0.05) AS bt, min(k) FILTER (cut_hat >= 0.05) AS bp, avg(abs(cut_hat - cut)) AS mae, sqrt(avg((cut_hat - cut) ** 2)) AS rmse, avg(ot) FILTER (k < 5 AND n > 5) * 100 + 1e-9 AS place, sum(ot) AS ot, sum(op) AS op, avg(gt) AS gt, avg(gp) AS gp FROM ws GROUP BY unique_id),
  waterflood AS (SELECT *, bt IS NOT NULL AND bp IS NOT NULL AS through FROM wg)"""  # noqa: E731
_WATER = {"breakthrough_time_true": ("i", "CASE WHEN through THEN bt END"), "breakthrough_time_pred": ("i", "CASE WHEN through THEN bp END"), "breakthrough_time_error": ("i", "abs(bp - bt)"), "water_cut_mae": ("f", "mae"), "water_cut_rmse": ("f", "rmse"), "recovery_factor_true": ("f", "ot / place"), "recovery_factor_pred": ("f", "op / place"), "recovery_factor_error": ("f", "abs(op / place - ot / place)"), "water_cut_gradient_true": ("f", "gt"), "water_cut_gradient_pred": ("f", "gp")}
_RELIABLE_FROM = f"""rs AS (SELECT *, CASE WHEN sign(y - coalesce(lag(y) {_W}, y)) = sign(y_hat - coalesce(lag(y_hat) {_W}, y_hat)) THEN 1.0 ELSE 0 END AS s, (y - coalesce(lag(y) {_W}, y)) ** 2 AS p2 FROM predicted),
  reliability AS (SELECT unique_id, count(*) AS n, avg(s) AS s, 1 - avg((y - y_hat) ** 2) / (avg(p2) + 1e-9) AS skill, avg(CASE WHEN y BETWEEN low AND high THEN 1.0 ELSE 0 END) AS c, avg(high - low) AS wide, max(y) - min(y) + 1e-9 AS span FROM rs GROUP BY unique_id)"""
_RELIABLE = {"direction_accuracy": ("f", "CASE WHEN n > 1 THEN s END"), "forecast_skill_vs_persistence": ("f", "CASE WHEN n > 1 THEN skill END"), "picp": ("f", "c"), "picp_deviation_from_target": ("f", "abs(c - 0.9)"), "mpiw": ("f", "wide"), "interval_sharpness": ("f", "wide / span")}


@query("predicted", f"WITH {_DECLINE_FROM} SELECT unique_id, {_places(_DECLINE)} FROM decline", dated=False)
def decline_curve_metrics(spark, sf):
    return rounded(reservoir.decline(predicted(spark, sf), "unique_id"))


@query("predicted", f"WITH {_PRESSURE_FROM} SELECT unique_id, {_places(_PRESSURE)} FROM pressure", dated=False)
def pressure_metrics(spark, sf):
    return rounded(reservoir.pressure(predicted(spark, sf), "unique_id"))


@query("predicted", f"WITH {_INJECTION_FROM} SELECT unique_id, {_places(_INJECTION)} FROM injection", dated=False)
def injection_metrics(spark, sf):
    return rounded(reservoir.injection(predicted(spark, sf), "unique_id"))


@query("predicted", f"WITH {_WATER_FROM('oil', 'oil_hat')} SELECT unique_id, {_places(_WATER)} FROM waterflood", dated=False)
def waterflood_metrics(spark, sf):
    return rounded(reservoir.waterflood(predicted(spark, sf), "unique_id", threshold=0.05))


@query("predicted", f"WITH {_RELIABLE_FROM} SELECT unique_id, {_places(_RELIABLE)} FROM reliability", dated=False)
def forecast_reliability(spark, sf):
    return rounded(reservoir.reliability(predicted(spark, sf), "unique_id", low="low", high="high"))


_PARTS = {"decline": _DECLINE, "pressure": _PRESSURE, "injection": _INJECTION, "waterflood": _WATER, "reliability": _RELIABLE}


@query("predicted", f"""WITH {_DECLINE_FROM}, {_PRESSURE_FROM}, {_INJECTION_FROM}, {_WATER_FROM('y * (1 - cut)', 'y_hat * (1 - cut_hat)')}, {_RELIABLE_FROM}
  SELECT * FROM {" JOIN ".join(f"(SELECT unique_id, {_places(p, f'{n}_')} FROM {n}) {'USING (unique_id)' if n != 'decline' else ''}" for n, p in _PARTS.items())}""", dated=False)
def reservoir_metrics(spark, sf):
    return rounded(reservoir.collection(predicted(spark, sf), "unique_id", low="low", high="high", threshold=0.05))


@query("predicted prod", f"""WITH s AS (SELECT unique_id, covar_pop(y, y_hat) / nullif(stddev_pop(y) * stddev_pop(y_hat), 0) AS r, stddev_samp(y_hat) / nullif(stddev_samp(y), 0) AS a, avg(y_hat) / nullif(avg(y), 0) AS b, avg(y) AS m FROM predicted GROUP BY unique_id),
  sc AS (SELECT well AS unique_id, avg(s) AS scale FROM (SELECT well, abs(wlpr - lag(wlpr) OVER (PARTITION BY well ORDER BY ds)) AS s FROM prod WHERE ds <= DATE '2001-04-01') GROUP BY well),
  j AS (SELECT f.*, y_hat - y AS e, r, a, b, m, scale FROM predicted f JOIN s USING (unique_id) LEFT JOIN sc USING (unique_id)),
  k AS (SELECT unique_id, {_METRICS}, round(1 - sum(e * e) / nullif(sum((abs(y_hat - m) + abs(y - m)) ** 2), 0), 6) AS ioa, round(CASE WHEN scale > 1e-9 THEN avg(abs(e)) / scale END, 6) AS mase, round(CASE WHEN count(*) > 4 THEN 1 - (sum(e * e) / nullif(var_pop(y) * count(y), 0)) * (count(*) - 1) / (count(*) - 4) ELSE 1 - sum(e * e) / nullif(var_pop(y) * count(y), 0) END, 6) AS adjusted_r2 FROM j GROUP BY unique_id, r, a, b, m, scale)
  SELECT * FROM k""", dated=False)
def metrics_full(spark, sf):
    train = t.producers(spark, sf).where(F.col("ds") <= F.to_date(F.lit("2001-04-01")))
    scales = metrics.scale(train, "well", "ds", "wlpr").withColumnRenamed("well", "unique_id")
    return rounded(metrics.evaluate_all(predicted(spark, sf), ["unique_id"], scales=scales, features=3))


_POSITION = "row_number() OVER (PARTITION BY {by} ORDER BY ds, unique_id)"


def _profile_sql(method: str, least: int) -> str:
    def eps(by: str) -> str:
        part = f"PARTITION BY {by}" if by else ""
        keys = f"{by}, " if by else ""
        group = f"GROUP BY {by}" if by else ""
        if method == "icp":
            return f"SELECT {keys}min(abs_err) AS eps FROM (SELECT *, row_number() OVER ({part} ORDER BY abs_err) AS k, count(*) OVER ({part}) AS n FROM res) WHERE k >= least(greatest(ceil(least(1, ceil((n + 1) * 0.9) / n) * n), 1), n) {group}"
        weight = "k" if method == "wcp_linear" else "pow(0.97, n - k)"
        return f"""SELECT {keys}min(abs_err) AS eps FROM (SELECT *, sum(w) OVER ({part} ORDER BY abs_err) / sum(w) OVER ({part}) AS s FROM (SELECT *, {weight} AS w FROM (SELECT *, row_number() OVER ({part} ORDER BY ds, unique_id) AS k, count(*) OVER ({part}) AS n FROM res))) WHERE s >= 0.9 - 1e-12 {group}"""

    return f"""{_RES}, each AS ({eps("h_step")}), whole AS ({eps("")}), counts AS (SELECT h_step, count(*) AS samples FROM res GROUP BY h_step),
      profile AS (SELECT CAST(g.h AS INTEGER) AS h_step, CASE WHEN coalesce(samples, 0) >= {least} THEN each.eps ELSE whole.eps END AS cp_eps, CASE WHEN coalesce(samples, 0) >= {least} THEN 'per_horizon' ELSE 'global_fallback' END AS cp_source, coalesce(samples, 0) AS samples, whole.eps AS global_eps, (SELECT count(*) FROM res) AS global_samples, 0.1::DOUBLE AS cp_alpha, '{method}' AS cp_method
        FROM generate_series(1, 8) AS g(h) LEFT JOIN each ON each.h_step = g.h LEFT JOIN counts ON counts.h_step = g.h, whole)"""


def _profile(spark, sf, method: str, least: int) -> DataFrame:
    return conformal.profile(_residuals(spark, sf), 8, method, least=least)


_SHOWN = "SELECT h_step, round(cp_eps, 6) AS cp_eps, cp_source, samples, round(global_eps, 6) AS global_eps, global_samples, cp_alpha, cp_method FROM profile"


@query("forecast", f"WITH {_profile_sql('wcp_exp', 30)} {_SHOWN}", dated=False)
def conformal_profile(spark, sf):
    """Eight steps, of which the last two have no errors and take those of all."""
    return rounded(_profile(spark, sf, "wcp", 30))


@query("forecast", f"WITH {_profile_sql('icp', 10**9)} {_SHOWN}", dated=False)
def conformal_profile_fallback(spark, sf):
    """No step has a thousand million errors: all fall back."""
    return rounded(_profile(spark, sf, "split_cp", 10**9))


@query("forecast", f"WITH {_profile_sql('wcp_linear', 30)} {_SHOWN}", dated=False)
def conformal_profile_linear(spark, sf):
    return rounded(_profile(spark, sf, " WCP_lin ", 30))


_APPLIED = """a AS (SELECT f.unique_id, f.ds, f.y, f.y_hat, CAST(least(row_number() OVER (PARTITION BY unique_id ORDER BY ds), 8) AS INTEGER) AS h_step FROM forecast f),
  applied AS (SELECT a.*, cp_eps, cp_source, y_hat - cp_eps AS cp_lo, y_hat + cp_eps AS cp_hi, cp_alpha, cp_method FROM a LEFT JOIN profile USING (h_step))"""


def _applied(spark, sf) -> DataFrame:
    return conformal.apply(t.forecast(spark, sf), _profile(spark, sf, "wcp_exp", 30), 8)


@query("forecast", f"WITH {_profile_sql('wcp_exp', 30)}, {_APPLIED} SELECT unique_id, ds, h_step, round(cp_eps, 6) AS cp_eps, cp_source, round(cp_lo, 6) AS cp_lo, round(cp_hi, 6) AS cp_hi, cp_alpha, cp_method FROM applied")
def conformal_apply(spark, sf):
    return rounded(_applied(spark, sf).select("unique_id", "ds", "h_step", "cp_eps", "cp_source", "cp_lo", "cp_hi", "cp_alpha", "cp_method"))


@query("forecast", f"WITH {_profile_sql('wcp_exp', 30)}, {_APPLIED} SELECT unique_id, ds, round(cp_lo, 6) AS low, round(cp_hi, 6) AS high, round(1 - cp_alpha, 6) AS level, 'conformal' AS interval_source FROM applied")
def interval_select(spark, sf):
    """Conformal columns win over quantiles."""
    rows = _applied(spark, sf).withColumn("q_0.4", F.col("y_hat") * 0.9).withColumn("q_0.6", F.col("y_hat") * 1.1)
    return rounded(conformal.intervals(rows).select("unique_id", "ds", "low", "high", "level", "interval_source"))


@query("forecast", "SELECT unique_id, ds, round(y_hat * 0.9, 6) AS low, round(y_hat * 1.2, 6) AS high, round(0.75 - 0.4, 6) AS level, 'quantile' AS interval_source FROM forecast")
def interval_select_quantiles(spark, sf):
    """Without them the quantiles nearest to the middle, here 0.4 and 0.75."""
    rows = t.forecast(spark, sf).select("unique_id", "ds", *((F.col("y_hat") * f).alias(f"q_{q}") for q, f in (("0.05", 0.5), ("0.4", 0.9), ("0.75", 1.2), ("0.95", 1.5), ("mid", 1.0))))
    return rounded(conformal.intervals(rows).select("unique_id", "ds", "low", "high", "level", "interval_source"))


@query("forecast prod", f"WITH {_profile_sql('wcp_exp', 30)}, {_APPLIED} SELECT a.unique_id, a.ds, round(p.wlpr, 6) AS y, CAST(p.t AS INTEGER) AS time_idx, round(a.y_hat, 6) AS y_hat, round(cp_lo, 6) AS cp_lo, round(cp_hi, 6) AS cp_hi FROM applied a JOIN (SELECT *, row_number() OVER (PARTITION BY well ORDER BY ds) - 1 AS t FROM prod) p ON p.well = a.unique_id AND p.ds = a.ds")
def forecast_merge(spark, sf):
    facts = panel.time_index(t.producers(spark, sf), "well", "ds").select(F.col("well").alias("unique_id"), "ds", F.col("wlpr").alias("y"), "time_idx")
    return rounded(conformal.merge_forecast(_applied(spark, sf), facts).select("unique_id", "ds", "y", "time_idx", "y_hat", "cp_lo", "cp_hi"))


_FOLDS = """indexed AS (SELECT well, ds, wlpr, row_number() OVER (PARTITION BY well ORDER BY ds) - 1 AS k FROM prod), base AS (SELECT min(m) + 1 - 6 - 6 * 2 AS b FROM (SELECT max(k) AS m FROM indexed GROUP BY well)),
  cut AS (SELECT f AS fold, b + 6 * f AS c FROM base, unnest([0, 1, 2]) AS g(f)), last AS (SELECT well, fold, wlpr AS y_hat FROM indexed JOIN cut ON k = c - 1),
  cv AS (SELECT fold, wlpr AS y, y_hat, y_hat - wlpr AS e FROM indexed JOIN cut ON k >= c AND k < c + 6 JOIN last USING (well, fold))"""


@query("prod", f"""WITH {_FOLDS}, f AS (SELECT fold, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 100 * avg(CASE WHEN abs(y) > 1e-9 THEN abs(e / y) END) AS mape, 100 * sum(abs(e)) / nullif(sum(abs(y)), 0) AS wmape, avg(e) AS mbe FROM cv GROUP BY fold)
  SELECT {", ".join(f"round(sum({m} * n) FILTER ({m} IS NOT NULL) / sum(n) FILTER ({m} IS NOT NULL), 6) AS {m}" for m in ("mae", "rmse", "mape", "wmape", "mbe"))}, CAST(sum(n) AS BIGINT) AS n FROM f""", dated=False)
def cv_aggregate(spark, sf):
    """Metrics of each fold, and their means by the folds' rows."""
    from fluvion.operators import forecasting

    folds = metrics.evaluate(forecasting.walk_forward_persistence(t.producers(spark, sf), "well", "ds", "wlpr", 6, 6, 3), ["fold"])
    return rounded(metrics.fold_means(folds, ["mae", "rmse", "mape", "wmape", "mbe"]))
