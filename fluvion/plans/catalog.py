"""Queries of the panel operators, each with its SQL where SQL can express it.

Doubles are rounded to six digits on both sides, since the order of sums is free.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvion.operators import features, panel
from fluvion.plans.oracle import over
from fluvion.sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(views: str = "", sql: str | None = None, dated: bool = True):
    """Register a function under its name, with DuckDB SQL over the named views. Dates are
    compared as text; ``dated``: the result has the column ds."""

    def put(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumn("ds", F.col("ds").cast("string")) if "ds" in df.columns else df

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = f"SELECT * REPLACE (CAST(ds AS VARCHAR) AS ds) FROM ({over(views, sql)})" if dated else over(views, sql)
        return run

    return put


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(c), 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


_W = "OVER (PARTITION BY well ORDER BY ds)"
_ALL = "OVER (PARTITION BY well)"


@query("panel", "SELECT well, ds, type, round(wlpr, 6) AS wlpr, round(womr, 6) AS womr, round(wwir, 6) AS wwir, round(wthp + 1e-9, 6) AS wthp FROM panel")
def panel_monthly(spark, sf):
    """Means of prices over quantities often end in a half of the last digit: 1e-9 settles these
    alike, whatever the order of the sums."""
    return rounded(t.panel(spark, sf).withColumn("wthp", F.col("wthp") + 1e-9))


@query("prod", """SELECT u.well, CAST(g.d AS DATE) AS ds, round(p.wlpr, 6) AS wlpr FROM (SELECT well, min(ds) AS a, max(ds) AS b FROM prod GROUP BY well) u,
  unnest(generate_series(u.a, u.b, INTERVAL 1 MONTH)) AS g(d) LEFT JOIN prod p ON p.well = u.well AND p.ds = CAST(g.d AS DATE)""")
def panel_reindex(spark, sf):
    return rounded(panel.reindex(t.producers(spark, sf).select("well", "ds", "wlpr"), "well", "ds"))


@query("spine", "SELECT unique_id, ds, round(y, 6) AS y FROM spine")
def panel_user_day(spark, sf):
    return rounded(panel.reindex(t.user_day(spark, sf), "unique_id", "ds", "day"))


@query("spine", "SELECT unique_id, ds, round(coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY ds), 0), 6) AS y FROM spine")
def ffill_zero(spark, sf):
    return rounded(panel.forward_fill(panel.reindex(t.user_day(spark, sf), "unique_id", "ds", "day"), "unique_id", "ds", ["y"]))


@query("spine", """SELECT unique_id, ds, round(coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY ds),
  first_value(y IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS y FROM spine""")
def ffill_bfill(spark, sf):
    return rounded(panel.both_fill(panel.reindex(t.user_day(spark, sf), "unique_id", "ds", "day"), "unique_id", "ds", ["y"]))


@query("spine", "SELECT unique_id, ds, round(CASE WHEN y IS NOT NULL THEN max(y) OVER (PARTITION BY unique_id ORDER BY ds) END, 6) AS y FROM spine")
def cummax(spark, sf):
    return rounded(panel.cumulative_max(panel.reindex(t.user_day(spark, sf), "unique_id", "ds", "day"), "unique_id", "ds", ["y"]))


@query("prod", f"SELECT well, ds, CAST(row_number() {_W} - 1 AS INTEGER) AS time_idx FROM prod")
def time_index(spark, sf):
    return panel.time_index(t.producers(spark, sf).select("well", "ds"), "well", "ds")


@query("", "SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END, 6) AS c_acctbal FROM customer", dated=False)
def clip_nonneg(spark, sf):
    return rounded(panel.clip_nonnegative(t.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query("prod", "SELECT well, ds, round(least(greatest(wlpr - womr, 0) / greatest(abs(wlpr), 1e-6), 1), 6) AS watercut FROM prod")
def watercut(spark, sf):
    return rounded(panel.watercut(t.producers(spark, sf)).select("well", "ds", "watercut"))


@query("panel", """SELECT well, ds, CAST(type = 'PROD' AS INTEGER) AS type_prod, CAST(type = 'INJ' AS INTEGER) AS type_inj, CAST(month(ds) AS INTEGER) AS month,
  round(sin(2 * pi() * month(ds) / 12), 6) + 0 AS month_sin, round(cos(2 * pi() * month(ds) / 12), 6) + 0 AS month_cos FROM panel""")
def calendar_features(spark, sf):
    return rounded(panel.calendar(t.panel(spark, sf)).select("well", "ds", "type_prod", "type_inj", "month", "month_sin", "month_cos"))


@query("spine", "SELECT unique_id, ds, round(coalesce(y, 0), 6) AS y, 0.0::DOUBLE AS pressure FROM spine")
def fill_missing(spark, sf):
    return rounded(panel.fill_missing(panel.reindex(t.user_day(spark, sf), "unique_id", "ds", "day"), ["y", "pressure"]))


@query("panel", "SELECT well, count(*) AS n_rows FROM panel GROUP BY well HAVING arg_max(type, ds) = 'PROD' AND count(*) >= 60", dated=False)
def target_wells(spark, sf):
    return panel.target_wells(t.panel(spark, sf), "well", "ds")


@query("prod", f"""WITH indexed AS (SELECT well, ds, CAST(row_number() {_W} - 1 AS INTEGER) AS time_idx FROM prod),
  base AS (SELECT min(m) + 1 - 6 - 6 * 2 AS b FROM (SELECT max(time_idx) AS m FROM indexed GROUP BY well))
  SELECT well, ds, time_idx, CAST(f AS INTEGER) AS fold, CASE WHEN time_idx < b + 6 * f THEN 'train' ELSE 'val' END AS part
  FROM indexed, base, unnest([0, 1, 2]) AS g(f) WHERE time_idx < b + 6 * f + 6""")
def walk_forward_folds(spark, sf):
    return panel.walk_forward(t.producers(spark, sf), "well", "ds", 6, 6, 3).select("well", "ds", "time_idx", "fold", "part")


@query("prod", """SELECT well, ds, round(wlpr * womr, 6) AS wlpr_x_womr, round(wlpr / (womr + 1e-6), 6) AS wlpr_div_womr, round(wthp * wlpr, 6) AS wthp_x_wlpr, round(wthp / (wlpr + 1e-6), 6) AS wthp_div_wlpr FROM prod""")
def interactions(spark, sf):
    return rounded(features.interactions(t.producers(spark, sf), [("wlpr", "womr"), ("wthp", "wlpr")]).select("well", "ds", "wlpr_x_womr", "wlpr_div_womr", "wthp_x_wlpr", "wthp_div_wlpr"))


@query("prod", """WITH span AS (SELECT min(ds) AS a, max(ds) AS b FROM prod), share AS (SELECT well, ds, 2 * pi() * date_diff('day', a, ds) / date_diff('day', a, b) AS t FROM prod, span)
  SELECT well, ds, round(sin(t), 6) + 0 AS fourier_sin_1, round(cos(t), 6) + 0 AS fourier_cos_1, round(sin(2 * t), 6) + 0 AS fourier_sin_2, round(cos(2 * t), 6) + 0 AS fourier_cos_2 FROM share""")
def fourier(spark, sf):
    return rounded(features.fourier(t.producers(spark, sf).select("well", "ds"), "ds", 2))


@query("coords", """WITH c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM coords), q AS (SELECT *, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS d,
  CASE WHEN x >= cx AND y >= cy THEN 0 WHEN x < cx AND y >= cy THEN 1 WHEN x < cx AND y < cy THEN 2 ELSE 3 END AS q FROM coords, c)
  SELECT well, round(x, 6) AS coord_x, round(y, 6) AS coord_y, round(z, 6) AS coord_z, round(abs(z), 6) AS depth, round(d, 6) AS center_distance,
  CAST(q = 0 AS INTEGER) AS quadrant_0, CAST(q = 1 AS INTEGER) AS quadrant_1, CAST(q = 2 AS INTEGER) AS quadrant_2, CAST(q = 3 AS INTEGER) AS quadrant_3 FROM q""", dated=False)
def spatial(spark, sf):
    places = t.coords(spark, sf)
    return rounded(features.spatial(places.select("well"), places, "well"))


@query("prod", """WITH ref AS (SELECT well, quantile_cont(CASE WHEN ds <= DATE '2000-12-01' AND wthp > 0 THEN wthp END, 0.95) AS r FROM prod GROUP BY well)
  SELECT well, ds, round(coalesce(wlpr / greatest(r - wthp, 1), 0), 6) AS productivity_index FROM prod JOIN ref USING (well)""")
def productivity_index(spark, sf):
    return rounded(features.productivity_index(t.producers(spark, sf), "well", "ds", "wlpr", "wthp", F.to_date(F.lit("2000-12-01"))).select("well", "ds", "productivity_index"))


@query("prod", f"""WITH n AS (SELECT *, lag(wthp) {_W} AS b, lead(wthp) {_W} AS a FROM prod)
  SELECT well, ds, round(CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN b IS NULL THEN a - wthp WHEN a IS NULL THEN wthp - b ELSE (a - b) / 2 END, 6) AS pressure_gradient,
  round(wlpr / greatest(200 - wthp, 1), 6) AS rate_per_drawdown, round(wthp * wlpr, 6) AS pressure_x_rate FROM n""")
def pressure_gradient(spark, sf):
    return rounded(features.pressure_features(t.producers(spark, sf), "well", "ds", "wlpr", "wthp").select("well", "ds", "pressure_gradient", "rate_per_drawdown", "pressure_x_rate"))


@query("prod", f"""WITH n AS (SELECT *, lag(wlpr) {_W} AS b FROM prod)
  SELECT well, ds, coalesce((b - wlpr) / greatest(b, 1e-6) > 0.7, false) AS is_shutdown, coalesce(b < 21 AND wlpr > b, false) AS is_startup FROM n""")
def structural_breaks(spark, sf):
    return features.structural_breaks(t.producers(spark, sf), "well", "ds", "wlpr", least=20.0).select("well", "ds", "is_shutdown", "is_startup")


def _rolling(n: int) -> str:
    w = f"OVER (PARTITION BY well ORDER BY ds ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    ok = f"CASE WHEN count(*) {_ALL} >= {n} THEN"
    return f"round({ok} avg(wlpr) {w} END, 6) AS wlpr_ma{n}, round({ok} coalesce(stddev_samp(wlpr) {w}, 0) END, 6) AS wlpr_std{n}, {ok} min(wlpr) {w} END AS wlpr_min{n}, {ok} max(wlpr) {w} END AS wlpr_max{n}"


@query("prod", f"SELECT well, ds, {', '.join(map(_rolling, (3, 6, 12)))} FROM prod")
def rolling_stats(spark, sf):
    return rounded(features.rolling_stats(t.producers(spark, sf).select("well", "ds", "wlpr"), "well", "ds", "wlpr").drop("wlpr"))


@query("prod", f"SELECT well, ds, round(wlpr - coalesce(lag(wlpr) {_W}, wlpr), 6) AS wlpr_diff FROM prod")
def first_diff(spark, sf):
    return rounded(features.first_difference(t.producers(spark, sf), "well", "ds", "wlpr").select("well", "ds", "wlpr_diff"))


@query("prod", f"""WITH c AS (SELECT well, ds, wlpr, sum(wlpr) {_W} AS cum, row_number() {_W} - 1 AS k, max(wlpr) {_ALL} AS peak, sum(wlpr) {_ALL} AS total FROM prod),
  d AS (SELECT *, k - min(CASE WHEN wlpr = peak THEN k END) {_ALL} AS since FROM c)
  SELECT well, ds, round(peak, 6) AS peak_rate, CAST(since AS INTEGER) AS time_since_peak, round(-ln(least(greatest(wlpr / peak, 1e-6), 1)) / greatest(since, 1), 6) + 0 AS decline_rate, round(cum / (total + 1e-6), 6) AS cum_share FROM d""")
def decline_features(spark, sf):
    from pyspark.sql import Window

    df = t.producers(spark, sf).withColumn("cum", F.sum("wlpr").over(Window.partitionBy("well").orderBy("ds")))
    return rounded(features.decline(df, "well", "ds", "wlpr", "cum").select("well", "ds", "peak_rate", "time_since_peak", "decline_rate", "cum_share"))


def _stage(pred: str, size: str) -> str:
    means = " ".join(f"WHEN 5 THEN avg(wlpr) OVER (PARTITION BY {pred} ORDER BY ds ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)" if k == 5 else f"WHEN {k} THEN avg(wlpr) OVER (PARTITION BY {pred} ORDER BY ds ROWS BETWEEN {k // 2} PRECEDING AND {(k - 1) // 2} FOLLOWING)" for k in (5, 4, 3, 2))
    return f"CASE {size} {means} ELSE wlpr END"


def _stage_sql(source: str) -> str:
    return f"""WITH a AS (SELECT well, ds, wlpr, row_number() {_W} AS k, count(*) {_ALL} AS n, least(5, count(*) {_ALL} // 3) AS size FROM {source}),
  b AS (SELECT *, CASE WHEN k > size // 2 AND k <= n - (size - 1) // 2 THEN {_stage("well", "size")} END AS f FROM a),
  c AS (SELECT *, coalesce(last_value(f IGNORE NULLS) {_W}, first_value(f IGNORE NULLS) OVER (PARTITION BY well ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS g FROM b),
  d AS (SELECT *, g - coalesce(lag(g) {_W}, g) AS delta FROM c), e AS (SELECT *, stddev_pop(delta) {_ALL} AS s FROM d)
  SELECT well, ds, CAST(CASE WHEN n < 5 THEN 0 WHEN delta > 0.5 * s THEN 1 WHEN delta < -0.5 * s THEN 2 ELSE 0 END AS INTEGER) AS stage FROM e"""


@query("prod", _stage_sql("prod"))
def production_stage(spark, sf):
    return features.production_stage(t.producers(spark, sf), "well", "ds", "wlpr").select("well", "ds", "stage")


_SG = " + ".join(f"({w!r}) * coalesce({'lag' if k < 3 else 'lead'}(wlpr, {abs(k - 3)}) {_W}, {'first' if k < 3 else 'last'}_value(wlpr) OVER (PARTITION BY well ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))" for k, w in enumerate(features.savgol_weights(7, 2)))


@query("prod", f"SELECT well, ds, round({_SG}, 6) AS wlpr_smooth FROM prod")
def savgol(spark, sf):
    return rounded(features.savgol(t.producers(spark, sf), "well", "ds", "wlpr").select("well", "ds", "wlpr_smooth"))


@query("prod", f"""WITH k AS (SELECT well, ds, wlpr, row_number() {_W} AS k, abs(wlpr - lag(wlpr) {_W}) AS step FROM prod), s AS (SELECT well, greatest(1.4826 * median(step), 1e-6) AS s FROM k GROUP BY well),
  w AS (SELECT a.well, a.ds, b.wlpr, exp(-0.5 * ((b.k - a.k) / 3.0) ** 2 - 0.5 * ((b.wlpr - a.wlpr) / s) ** 2) AS w FROM k a JOIN k b ON a.well = b.well AND abs(a.k - b.k) <= 7 JOIN s ON s.well = a.well)
  SELECT well, ds, round(sum(w * wlpr) / sum(w), 6) AS wlpr_bilateral FROM w GROUP BY well, ds""")
def bilateral(spark, sf):
    return rounded(features.bilateral(t.producers(spark, sf).select("well", "ds", "wlpr"), "well", "ds", "wlpr").drop("wlpr"))


@query("prod", f"""WITH RECURSIVE k AS (SELECT well, ds, wlpr AS x, row_number() {_W} AS k, coalesce(lag(wlpr, 2) {_W}, first_value(wlpr) {_W}) AS u FROM prod),
  r AS (SELECT well, k, x AS y FROM k WHERE k = 1 UNION ALL SELECT k.well, k.k, exp(-0.5) * r.y + (1 - exp(-0.5)) * k.u FROM r JOIN k ON k.well = r.well AND k.k = r.k + 1)
  SELECT well, ds, round(y, 6) AS wlpr_crm FROM k JOIN r USING (well, k)""")
def crm_filter(spark, sf):
    return rounded(features.crm_filter(t.producers(spark, sf).select("well", "ds", "wlpr"), "well", "ds", "wlpr", 2.0).drop("wlpr"))


@query("prod", f"""WITH RECURSIVE k AS (SELECT well, ds, wlpr AS x, row_number() {_W} AS k FROM prod),
  r AS (SELECT well, k, x AS y FROM k WHERE k = 1 UNION ALL SELECT k.well, k.k, 0.7 * k.x + 0.3 * r.y FROM r JOIN k ON k.well = r.well AND k.k = r.k + 1)
  SELECT well, ds, round(y, 6) AS wlpr_ema FROM k JOIN r USING (well, k)""")
def ema_simplex(spark, sf):
    return rounded(features.ema(t.producers(spark, sf).select("well", "ds", "wlpr"), "well", "ds", "wlpr", 0.3).drop("wlpr"))


@query("prod", f"""WITH k AS (SELECT well, ds, wlpr, row_number() {_W} AS k FROM prod)
  SELECT a.well, a.ds, CAST(g.i AS INTEGER) AS lag, b.wlpr AS value FROM k a, unnest(generate_series(1, 12)) AS g(i) JOIN k b ON b.well = a.well AND b.k = a.k - g.i WHERE a.k > 12""")
def windowed_matrix(spark, sf):
    rows = features.windowed_matrix(t.producers(spark, sf).select("well", "ds", "wlpr"), "well", "ds", "wlpr")
    return rows.select("well", "ds", F.posexplode("wlpr_window").alias("p", "value")).select("well", "ds", (12 - F.col("p")).alias("lag"), "value")


_GAPPY = "WITH c AS (SELECT unique_id, ds, y, CASE WHEN y IS NULL THEN NULL ELSE sum(y) OVER (PARTITION BY unique_id ORDER BY ds) END AS cum FROM spine)"


@query("spine", f"""{_GAPPY}, k AS (SELECT *, epoch(ds::TIMESTAMP) AS t, max(CASE WHEN cum IS NOT NULL THEN ds END) OVER w AS pd, count(cum) OVER (PARTITION BY unique_id) AS n,
    min(CASE WHEN cum IS NOT NULL THEN ds END) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qd FROM c WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
  f AS (SELECT k.unique_id, k.ds, k.cum, coalesce(k.cum, p.cum + (k.t - epoch(p.ds::TIMESTAMP)) * (q.cum - p.cum) / (epoch(q.ds::TIMESTAMP) - epoch(p.ds::TIMESTAMP))) AS v
    FROM k LEFT JOIN c p ON p.unique_id = k.unique_id AND p.ds = k.pd LEFT JOIN c q ON q.unique_id = k.unique_id AND q.ds = k.qd)
  SELECT unique_id, ds, round(coalesce(cum, max(v) OVER (PARTITION BY unique_id ORDER BY ds)), 6) AS cum_filled FROM f""")
def impute_linear_monotone(spark, sf):
    from pyspark.sql import Window

    spine = panel.reindex(t.user_day(spark, sf), "unique_id", "ds", "day")
    cum = F.when(F.col("y").isNotNull(), F.sum("y").over(Window.partitionBy("unique_id").orderBy("ds")))
    return rounded(features.impute_linear_monotone(spine.withColumn("cum", cum), "unique_id", "ds", "cum").select("unique_id", "ds", "cum_filled"))
