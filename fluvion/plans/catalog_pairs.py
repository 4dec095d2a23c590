"""Queries of validation, pairs, graphs, metrics and intervals, registered on import."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvion.operators import conformal, graph, metrics, panel, pairs, quality
from fluvion.plans.catalog import query, rounded
from fluvion.sources import tables as t

_CUT = "DATE '2001-04-01'"


def _cut():
    return F.to_date(F.lit("2001-04-01"))


@query("panel", """SELECT 'null' AS "check", 'well' AS "column", CAST(count(*) FILTER (well IS NULL) AS DOUBLE) AS value FROM panel
  UNION ALL SELECT 'null', 'ds', count(*) FILTER (ds IS NULL) FROM panel UNION ALL SELECT 'missing', 'wbhp', 1 UNION ALL SELECT 'domain', 'type', count(*) FILTER (type NOT IN ('PROD')) FROM panel
  UNION ALL SELECT 'negative', 'wlpr', count(*) FILTER (wlpr < 0) FROM panel""", dated=False)
def schema_violations(spark, sf):
    return quality.schema_violations(t.panel(spark, sf), ["well", "ds", "wbhp"], ["PROD"], nonnegative=["wlpr"])


@query("user_day", """WITH q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM user_day), g AS (SELECT unique_id, ds - lag(ds) OVER (PARTITION BY unique_id ORDER BY ds) AS gap FROM user_day)
  SELECT 'rows' AS "check", '' AS "column", CAST(count(*) AS DOUBLE) AS value FROM user_day UNION ALL SELECT 'keys', 'unique_id', count(DISTINCT unique_id) FROM user_day
  UNION ALL SELECT 'days', 'ds', max(ds) - min(ds) FROM user_day UNION ALL SELECT 'nulls', 'y', count(*) FILTER (y IS NULL) FROM user_day UNION ALL SELECT 'negative', 'y', count(*) FILTER (y < 0) FROM user_day
  UNION ALL SELECT 'outliers', 'y', count(*) FILTER (y < a - 3 * (b - a) OR y > b + 3 * (b - a)) FROM user_day, q UNION ALL SELECT 'gaps', 'unique_id', count(DISTINCT unique_id) FROM g WHERE gap > 1
  UNION ALL SELECT 'repeated', 'unique_id', coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM user_day GROUP BY unique_id, ds HAVING count(*) > 1)""", dated=False)
def quality_report(spark, sf):
    return quality.quality_report(t.user_day(spark, sf), "unique_id", "ds", ["y"], gap_days=1)


@query("coords", """SELECT 'null_coordinates' AS "check", CAST(count(*) FILTER (x IS NULL OR y IS NULL OR z IS NULL) AS DOUBLE) AS value FROM coords
  UNION ALL SELECT 'repeated_wells', count(*) FROM (SELECT well FROM coords GROUP BY well HAVING count(*) > 1)""", dated=False)
def coord_validation(spark, sf):
    return quality.coordinate_validation(t.coords(spark, sf), "well")


def _pairs(spark, sf) -> DataFrame:
    places = t.coords(spark, sf)
    return pairs.pair_table(places.where("type = 'PROD'"), places.where("type = 'INJ'"))


def _near(spark, sf) -> DataFrame:
    places = t.coords(spark, sf)
    return pairs.nearest_pairs(places.where("type = 'PROD'"), places.where("type = 'INJ'"), 5)


def _weighted(spark, sf) -> DataFrame:
    near = _near(spark, sf)
    return pairs.normalised(near.withColumn("w", pairs.kernel("idw", F.col("d"), p=2.0)), "prod_id", "w")


def _lagged(spark, sf) -> DataFrame:
    return pairs.lag_window(_weighted(spark, sf), touching=True)


def _rates(spark, sf) -> DataFrame:
    rows = t.panel(spark, sf).where("type = 'INJ'")
    step = F.col("wwir") - F.coalesce(F.lag("wwir").over(Window.partitionBy("well").orderBy("ds")), F.col("wwir"))
    return rows.select("well", "ds", F.col("wwir").alias("x"), step.alias("dx"))


def _target(spark, sf) -> DataFrame:
    return t.producers(spark, sf).select("well", "ds", F.col("wlpr").alias("y"))


def _shifted(spark, sf) -> DataFrame:
    return pairs.shifted(_lagged(spark, sf).withColumn("lag", F.col("lower_bound")), _target(spark, sf), _rates(spark, sf), ["x", "dx"])


@query("pairs", "SELECT prod_id, inj_id, round(d, 6) AS d FROM pairs", dated=False)
def pair_distance(spark, sf):
    return rounded(_pairs(spark, sf).select("prod_id", "inj_id", "d"))


@query("pairs", "SELECT prod_id, inj_id, round(sqrt(dx * dx / 4 + dy * dy + dz * dz / 0.25), 6) AS metric_d FROM pairs", dated=False)
def aniso_distance(spark, sf):
    return rounded(pairs.metric_distance(_pairs(spark, sf), [[4, 0, 0], [0, 1, 0], [0, 0, 0.25]]).select("prod_id", "inj_id", "metric_d"))


@query("pairs", """WITH c AS (SELECT *, coalesce((dx + dy) / sqrt(2) / nullif(d, 0), 0) AS cosine FROM pairs)
  SELECT prod_id, inj_id, round(cosine, 6) + 0 AS cosine, round(0.1 + 0.9 * pow(greatest(cosine, 0), 2), 6) AS direction_factor FROM c""", dated=False)
def direction_bias(spark, sf):
    return rounded(pairs.direction_factor(_pairs(spark, sf), (1, 1, 0), kappa=2.0).select("prod_id", "inj_id", "cosine", "direction_factor"))


@query("pairs", """SELECT prod_id, inj_id, round(pow(greatest(d, 1e-6), -1), 6) AS idw, round(exp(-d / 500), 6) AS exponential, round(exp(-0.5 * (d / 500) ** 2), 6) AS gaussian,
  round((1 + sqrt(3) * d / 500) * exp(-sqrt(3) * d / 500), 6) AS matern, round(1 / (1 + (d / 500) ** 2 / 2), 6) AS rational_quadratic, round(CASE WHEN d >= 500 THEN 0 ELSE 1 - 1.5 * d / 500 + 0.5 * (d / 500) ** 3 END, 6) AS spherical FROM pairs""", dated=False)
def kernel_values(spark, sf):
    made = {"idw": {"p": 1.0}, "exponential": {}, "gaussian": {}, "matern": {"nu": 1.5}, "rational_quadratic": {"alpha": 1.0}, "spherical": {}}
    return rounded(_pairs(spark, sf).select("prod_id", "inj_id", *(pairs.kernel(k, F.col("d"), **p).alias(k) for k, p in made.items())))


@query("weighted", "SELECT prod_id, inj_id, round(weight, 6) AS weight FROM weighted", dated=False)
def kernel_weights(spark, sf):
    return rounded(_weighted(spark, sf).select("prod_id", "inj_id", "weight"))


@query("near", "SELECT prod_id, inj_id, round(d, 6) AS d, rk FROM near", dated=False)
def topk_neighbors(spark, sf):
    return rounded(_near(spark, sf).select("prod_id", "inj_id", "d", "rk"))


@query("lagged", "SELECT prod_id, inj_id, round(t_diff, 6) AS t_diff, lower_bound, upper_bound FROM lagged", dated=False)
def lag_window(spark, sf):
    return rounded(_lagged(spark, sf).select("prod_id", "inj_id", "t_diff", "lower_bound", "upper_bound"))


_BEST = f"""lags AS (SELECT prod_id, inj_id, lower_bound, CAST(g.k AS BIGINT) AS lag FROM lagged, unnest(generate_series(lower_bound, upper_bound)) AS g(k)),
  obs AS (SELECT l.*, p.wlpr AS y, r.x FROM lags l JOIN prod p ON p.well = l.prod_id AND p.ds <= {_CUT} JOIN rates r ON r.well = l.inj_id AND r.ds = CAST(p.ds - to_months(CAST(l.lag AS INTEGER)) AS DATE)),
  scores AS (SELECT prod_id, inj_id, lag, covar_pop(x, y) / sqrt((var_pop(x) + 1e-6) * (var_pop(y) + 1e-6)) AS corr, count(*) AS overlap FROM obs GROUP BY prod_id, inj_id, lag HAVING count(*) >= 6),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prod_id, inj_id ORDER BY corr DESC, lag) AS n FROM scores) WHERE n = 1)"""


@query("lagged prod rates", f"""WITH {_BEST} SELECT l.prod_id, l.inj_id, coalesce(b.lag, lower_bound) AS lag, greatest(coalesce(b.lag, lower_bound), lower_bound) AS tau, round(coalesce(corr, 0), 6) + 0 AS corr, coalesce(overlap, 0) AS overlap
  FROM lagged l LEFT JOIN best b USING (prod_id, inj_id)""", dated=False)
def xcorr_best_lag(spark, sf):
    best = pairs.best_lag(_lagged(spark, sf), _target(spark, sf), _rates(spark, sf), _cut())
    return rounded(best.select("prod_id", "inj_id", "lag", "tau", "corr", "overlap"))


@query("shifted lagged", """SELECT prod_id, s.ds, round(sum(weight * x), 6) + 0 AS inj_wwir_lag_weighted, round(sum(weight * dx), 6) + 0 AS inj_wwit_diff_lag_weighted,
  round(sum(CASE WHEN rk = 1 THEN weight * x ELSE 0 END), 6) AS inj_top1_contribution, round(sum(CASE WHEN rk = 2 THEN weight * x ELSE 0 END), 6) AS inj_top2_contribution, round(sum(CASE WHEN rk = 3 THEN weight * x ELSE 0 END), 6) AS inj_top3_contribution
  FROM shifted s JOIN lagged l USING (prod_id, inj_id) GROUP BY prod_id, s.ds""")
def injection_features(spark, sf):
    return rounded(pairs.injection_features(_shifted(spark, sf)))


@query("coords lagged", """SELECT c.well, round(coalesce(sum(weight), 0), 6) AS crm_sum, round(coalesce(max(weight), 0), 6) AS crm_max, count(weight) AS crm_count, round(coalesce(avg(lower_bound), 0), 6) AS crm_lag, round(coalesce(avg(lower_bound), 0), 6) AS crm_tau
  FROM coords c LEFT JOIN lagged l ON l.prod_id = c.well GROUP BY c.well""", dated=False)
def crm_connectivity(spark, sf):
    return rounded(pairs.connectivity(t.coords(spark, sf), _lagged(spark, sf).withColumns({"lag": F.col("lower_bound"), "tau": F.col("lower_bound")})))


def _edges(spark, sf) -> DataFrame:
    return graph.edges_within(t.coords(spark, sf), 1000.0)


def _near_wells(spark, sf) -> DataFrame:
    return graph.nearest_within(t.coords(spark, sf), 1000.0, 3)


@query("edges", "SELECT src, dst, round(d, 6) AS d FROM edges", dated=False)
def graph_edges(spark, sf):
    return rounded(_edges(spark, sf))


@query("dirs coords", "SELECT c.well, round(count(src) / ((SELECT count(*) FROM coords) - 1), 6) AS degree FROM coords c LEFT JOIN dirs ON src = c.well GROUP BY c.well", dated=False)
def degree(spark, sf):
    return rounded(graph.degree_within(t.coords(spark, sf), 1000.0))


@query("dirs coords", """WITH RECURSIVE p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM dirs), n AS (SELECT count(*)::DOUBLE AS n FROM coords), linked AS (SELECT DISTINCT src FROM dirs),
  r AS (SELECT 0 AS k, well, 1.0::DOUBLE / n AS r FROM coords, n
    UNION ALL SELECT k, well, 0.15 / n + 0.85 * (coalesce(got, 0) + loose / n) FROM (
      SELECT (SELECT max(k) FROM r) + 1 AS k, c.well, n, (SELECT sum(r.r * p.p) FROM r JOIN p ON p.src = r.well WHERE p.dst = c.well) AS got, (SELECT coalesce(sum(r.r), 0) FROM r WHERE well NOT IN (SELECT src FROM linked)) AS loose FROM coords c, n) WHERE k <= 150)
  SELECT well, round(r, 6) AS rank FROM r WHERE k = 150""", dated=False)
def pagerank(spark, sf):
    """Until the ranks change by less than 1e-9 in all; 150 rounds bring the SQL below that."""
    return rounded(graph.pagerank(t.coords(spark, sf), _edges(spark, sf), tolerance=1e-9))


def _doubled(k: int) -> str:
    """Shortest paths of up to 2**k edges."""
    return ", ".join(f"p{n} AS MATERIALIZED (SELECT src, dst, min(d) AS d FROM (SELECT src, dst, d FROM p{n - 1} UNION ALL SELECT a.src, b.dst, a.d + b.d FROM p{n - 1} a JOIN p{n - 1} b ON a.dst = b.src WHERE a.src <> b.dst) GROUP BY src, dst)" for n in range(1, k + 1))


@query("dirs coords", f"""WITH p0 AS (SELECT src, dst, d FROM dirs), {_doubled(5)}
  SELECT c.well, round(coalesce(count(src) * count(src) / (sum(d) * ((SELECT count(*) FROM coords) - 1)), 0), 6) AS closeness FROM coords c LEFT JOIN p5 ON src = c.well GROUP BY c.well""", dated=False)
def closeness(spark, sf):
    """Paths of any number of edges; no shortest path of this field has more than the SQL's 32."""
    return rounded(graph.closeness(t.coords(spark, sf), _edges(spark, sf)))


@query("dirs coords", """WITH w AS (SELECT src, dst, w / (SELECT max(w) FROM dirs) AS w FROM dirs), tri AS (SELECT a.src AS well, sum(cbrt(a.w * b.w * c.w)) AS t FROM w a JOIN w b ON a.src = b.src AND a.dst < b.dst JOIN w c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src),
  k AS (SELECT src, count(*) AS k FROM dirs GROUP BY src) SELECT c.well, round(coalesce(2 * t / nullif(k * (k - 1), 0), 0), 6) AS clustering FROM coords c LEFT JOIN k ON k.src = c.well LEFT JOIN tri ON tri.well = c.well""", dated=False)
def clustering_coeff(spark, sf):
    return rounded(graph.clustering_within(t.coords(spark, sf), 1000.0))


@query("edges coords", """WITH e AS (SELECT *, 1 / d AS w FROM edges WHERE d > 0), q AS (SELECT quantile_cont(w, 0.5) AS cut FROM e), c AS (SELECT well, CASE WHEN z < -2060 THEN 1 ELSE 0 END AS cluster FROM coords)
  SELECT src, dst, round(d, 6) AS d FROM e JOIN c a ON a.well = src JOIN c b ON b.well = dst, q WHERE NOT (a.cluster <> b.cluster AND w < cut)""", dated=False)
def sparsify(spark, sf):
    places = t.coords(spark, sf).select("well", F.when(F.col("z") < -2060, 1).otherwise(0).alias("cluster"))
    return rounded(graph.sparsify(_edges(spark, sf), places, 0.5))


@query("dirs prod", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS n FROM dirs), s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM r WHERE n <= 3),
  g AS (SELECT s.src, o.ds, sum(share * o.wlpr) AS v FROM s JOIN prod o ON o.well = s.dst GROUP BY s.src, o.ds) SELECT p.well, p.ds, round(coalesce(v, 0), 6) AS wlpr_neighbours FROM prod p LEFT JOIN g ON g.src = p.well AND g.ds = p.ds""")
def neighbor_agg(spark, sf):
    return rounded(graph.nearest_aggregate(t.producers(spark, sf).select("well", "ds", "wlpr"), _near_wells(spark, sf), "wlpr").select("well", "ds", "wlpr_neighbours"))


@query("coords", "WITH s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(z) AS mz, stddev_pop(z) AS sz FROM coords) SELECT well, round((x - mx) / sx, 6) + 0 AS x, round((z - mz) / sz, 6) + 0 AS z FROM coords, s", dated=False)
def embed_scale(spark, sf):
    return rounded(graph.standardise(t.coords(spark, sf).select("well", "x", "z"), ["x", "z"]))


_METRICS = """count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(100 * avg(CASE WHEN abs(y) > 1e-9 THEN abs(e / y) END), 6) AS mape, round(100 * avg(coalesce(2 * abs(e) / nullif(abs(y) + abs(y_hat), 0), 0)), 6) AS smape,
  round(100 * sum(abs(e)) / nullif(sum(abs(y)), 0), 6) AS wmape, round(1 - sum(e * e) / nullif(var_pop(y) * count(y), 0), 6) AS r2, round(1 - sum(e * e) / nullif(var_pop(y) * count(y), 0), 6) AS nse, round(1 - sqrt((r - 1) ** 2 + (a - 1) ** 2 + (b - 1) ** 2), 6) AS kge,
  round(100 * sum(e) / nullif(sum(y), 0), 6) AS pbias, round(avg(e), 6) AS mbe, round(r, 6) AS correlation"""


def _metrics_sql(by: str, least: int = 1) -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}, r, a, b HAVING count(*) >= {least}" if by else "GROUP BY r, a, b"
    using = f"USING ({by})" if by else "ON true"
    return f"""WITH s AS (SELECT {keys}covar_pop(y, y_hat) / nullif(stddev_pop(y) * stddev_pop(y_hat), 0) AS r, stddev_samp(y_hat) / nullif(stddev_samp(y), 0) AS a, avg(y_hat) / nullif(avg(y), 0) AS b FROM forecast {f'GROUP BY {by}' if by else ''}),
      j AS (SELECT f.*, y_hat - y AS e, r, a, b FROM forecast f JOIN s {using}) SELECT {keys}{_METRICS} FROM j {group}"""


@query("forecast", _metrics_sql(""), dated=False)
def metrics_overall(spark, sf):
    return rounded(metrics.evaluate(t.forecast(spark, sf)))


@query("forecast", _metrics_sql("unique_id"), dated=False)
def metrics_by_well(spark, sf):
    return rounded(metrics.evaluate(t.forecast(spark, sf), ["unique_id"]))


@query("forecast", _metrics_sql("h_step", 2), dated=False)
def metrics_by_horizon(spark, sf):
    """Steps with one row only have no spread and are left out."""
    return rounded(metrics.evaluate(t.forecast(spark, sf), ["h_step"], least=2))


@query("forecast", "SELECT unique_id, ds, round(y, 6) AS y, round(y_hat, 6) AS y_hat, h_step FROM forecast")
def forecast_persistence(spark, sf):
    return rounded(t.forecast(spark, sf))


@query("forecast", """WITH m AS (SELECT *, avg(y) OVER (PARTITION BY unique_id) AS m FROM forecast) SELECT unique_id, round(1 - sum((y_hat - y) ** 2) / nullif(sum((abs(y_hat - m) + abs(y - m)) ** 2), 0), 6) AS ioa FROM m GROUP BY unique_id""", dated=False)
def index_of_agreement(spark, sf):
    return rounded(metrics.index_of_agreement(t.forecast(spark, sf), ["unique_id"]))


@query("forecast", """WITH b AS (SELECT *, avg(y_hat) OVER () AS base FROM forecast) SELECT round(1 - sum((y_hat - y) ** 2) / sum((base - y) ** 2), 6) AS skill FROM b""", dated=False)
def skill_score(spark, sf):
    df = t.forecast(spark, sf)
    return rounded(metrics.skill(df.crossJoin(F.broadcast(df.agg(F.avg("y_hat").alias("base")))), "base"))


@query("prod", "SELECT well, round(avg(s), 6) AS scale FROM (SELECT well, abs(wlpr - lag(wlpr) OVER (PARTITION BY well ORDER BY ds)) AS s FROM prod) GROUP BY well", dated=False)
def mase_scale(spark, sf):
    return rounded(metrics.scale(t.producers(spark, sf), "well", "ds", "wlpr"))


@query("forecast", """WITH p AS (SELECT *, max(y) OVER w AS py, max(y_hat) OVER w AS pf FROM forecast WINDOW w AS (PARTITION BY unique_id))
  SELECT unique_id, round(100 * (max(y_hat) - max(y)) / max(y), 6) + 0 AS peak_error, min(CASE WHEN y_hat = pf THEN ds END) - min(CASE WHEN y = py THEN ds END) AS peak_shift_days, round(100 * (sum(y_hat) - sum(y)) / sum(y), 6) + 0 AS cumulative_error FROM p GROUP BY unique_id""", dated=False)
def decline_metrics(spark, sf):
    return rounded(metrics.decline_metrics(t.forecast(spark, sf), "unique_id", "ds"))


@query("forecast", """WITH d AS (SELECT unique_id, sign(y - lag(y) OVER w) AS a, sign(y_hat - lag(y_hat) OVER w) AS b FROM forecast WINDOW w AS (PARTITION BY unique_id ORDER BY ds)) SELECT unique_id, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 6) AS direction_accuracy FROM d WHERE a IS NOT NULL GROUP BY unique_id""", dated=False)
def direction_accuracy(spark, sf):
    return rounded(metrics.direction_accuracy(t.forecast(spark, sf), "unique_id", "ds"))


def _residuals(spark, sf) -> DataFrame:
    return t.forecast(spark, sf).withColumn("abs_err", F.abs(F.col("y") - F.col("y_hat")))


_RES = "res AS (SELECT *, abs(y - y_hat) AS abs_err FROM forecast)"


@query("forecast", f"""WITH {_RES}, n AS (SELECT *, count(*) OVER (PARTITION BY h_step) AS n, row_number() OVER (PARTITION BY h_step ORDER BY abs_err) AS k FROM res)
  SELECT h_step, round(abs_err, 6) AS eps FROM n WHERE k = least(greatest(ceil(least(1, ceil((n + 1) * 0.9) / n) * n), 1), n)""", dated=False)
def conformal_icp(spark, sf):
    return rounded(conformal.epsilon(_residuals(spark, sf), "icp", by=["h_step"]))


def _weighted_sql(weight: str) -> str:
    return f"""WITH {_RES}, k AS (SELECT *, row_number() OVER (PARTITION BY h_step ORDER BY ds, unique_id) AS k, count(*) OVER (PARTITION BY h_step) AS n FROM res), w AS (SELECT *, {weight} AS cw FROM k),
      s AS (SELECT h_step, abs_err, sum(cw) OVER (PARTITION BY h_step ORDER BY abs_err) / sum(cw) OVER (PARTITION BY h_step) AS s FROM w) SELECT h_step, round(min(abs_err), 6) AS eps FROM s WHERE s >= 0.9 - 1e-12 GROUP BY h_step"""


@query("forecast", _weighted_sql("pow(0.97, n - k)"), dated=False)
def conformal_wcp_exp(spark, sf):
    return rounded(conformal.epsilon(_residuals(spark, sf), "wcp_exp", by=["h_step"]))


@query("forecast", _weighted_sql("k"), dated=False)
def conformal_wcp_linear(spark, sf):
    return rounded(conformal.epsilon(_residuals(spark, sf), "wcp_linear", by=["h_step"]))


_EPS = f"""{_RES}, n AS (SELECT *, count(*) OVER (PARTITION BY h_step) AS n, row_number() OVER (PARTITION BY h_step ORDER BY abs_err) AS k FROM res), eps AS (SELECT h_step, abs_err AS eps FROM n WHERE k = least(greatest(ceil(least(1, ceil((n + 1) * 0.9) / n) * n), 1), n))"""


def _intervals(spark, sf) -> DataFrame:
    res = _residuals(spark, sf)
    return res.join(conformal.epsilon(res, "icp", by=["h_step"]), "h_step").withColumns({"cp_lo": F.col("y_hat") - F.col("eps"), "cp_hi": F.col("y_hat") + F.col("eps")})


@query("forecast", f"WITH {_EPS}, i AS (SELECT *, CASE WHEN y BETWEEN y_hat - eps AND y_hat + eps THEN 1.0 ELSE 0 END AS c FROM res JOIN eps USING (h_step)) SELECT round(avg(c), 6) AS picp, round(avg(c) - 0.9, 6) + 0 AS deviation, round(avg(2 * eps), 6) AS mpiw FROM i", dated=False)
def reliability_metrics(spark, sf):
    return rounded(metrics.reliability(_intervals(spark, sf)))


@query("panel", f"""WITH last AS (SELECT well, arg_max(wwir, ds) AS f FROM panel WHERE ds < DATE '2001-01-01' GROUP BY well), c AS (SELECT well, ds, wwir, sum(wwir) OVER (PARTITION BY well ORDER BY ds) AS cum FROM panel WHERE type = 'INJ'),
  z AS (SELECT well, max(cum) AS frozen FROM c WHERE ds < DATE '2001-01-01' GROUP BY well)
  SELECT well, ds, round(CASE WHEN well = '3' AND ds >= DATE '2001-01-01' THEN 0 ELSE wwir END, 6) AS wwir, round(CASE WHEN well = '3' AND ds >= DATE '2001-01-01' THEN frozen ELSE cum END, 6) AS wwit FROM c LEFT JOIN z USING (well)""")
def scenario_shutoff(spark, sf):
    start = F.to_date(F.lit("2001-01-01"))
    rows = t.panel(spark, sf).where("type = 'INJ'").withColumn("cum", F.sum("wwir").over(Window.partitionBy("well").orderBy("ds")))
    frozen = rows.where(F.col("ds") < start).groupBy("well").agg(F.max("cum").alias("frozen"))
    off = (F.col("well") == "3") & (F.col("ds") >= start)
    out = rows.join(frozen, "well", "left")
    return rounded(out.select("well", "ds", F.when(off, 0.0).otherwise(F.col("wwir")).alias("wwir"), F.when(off, F.col("frozen")).otherwise(F.col("cum")).alias("wwit")))


@query("prod", "SELECT well, round(covar_pop(wlpr, womr) / (stddev_pop(wlpr) * stddev_pop(womr)), 6) AS wlpr_womr, round(covar_pop(wlpr, wthp) / (stddev_pop(wlpr) * stddev_pop(wthp)), 6) AS wlpr_wthp FROM prod GROUP BY well", dated=False)
def per_well_correlation(spark, sf):
    r = lambda a, b: pairs.correlation(F.col(a), F.col(b)).alias(f"{a}_{b}")
    return rounded(t.producers(spark, sf).groupBy("well").agg(r("wlpr", "womr"), r("wlpr", "wthp")))


@query("panel", "SELECT well, count(*) AS n, round(avg(wlpr), 6) AS mean, round(median(wlpr), 6) AS median, round(quantile_cont(wlpr, 0.9), 6) AS p90, arg_max(type, ds) AS last_type, CAST(max(ds) AS VARCHAR) AS last FROM panel GROUP BY well", dated=False)
def well_stats(spark, sf):
    return rounded(t.panel(spark, sf).groupBy("well").agg(F.count("*").alias("n"), F.avg("wlpr").alias("mean"), F.median("wlpr").alias("median"), F.percentile("wlpr", 0.9).alias("p90"), F.max_by("type", "ds").alias("last_type"), F.max("ds").cast("string").alias("last")))


_WIDTH = 16
_NUMBERED = "n AS (SELECT well, CAST(row_number() OVER (ORDER BY well) - 1 AS BIGINT) AS k FROM (SELECT DISTINCT well FROM prod))"


@query("prod", f"WITH {_NUMBERED} SELECT ds, CAST(k // {_WIDTH} AS INTEGER) AS block, {', '.join(f'round(sum(CASE WHEN k % {_WIDTH} = {j} THEN wlpr END), 6) AS v{j}' for j in range(_WIDTH))} FROM prod JOIN n USING (well) GROUP BY ds, k // {_WIDTH}")
def pivot_wide(spark, sf):
    """Every producer's rates side by side, sixteen to a block."""
    return rounded(panel.widened(t.producers(spark, sf), "well", "ds", "wlpr", _WIDTH)[0])


@query("prod", f"WITH {_NUMBERED} SELECT well, CAST(k // {_WIDTH} AS INTEGER) AS block, CAST(k % {_WIDTH} AS INTEGER) AS place FROM n", dated=False)
def pivot_places(spark, sf):
    """Where each producer stands in pivot_wide."""
    return panel.widened(t.producers(spark, sf), "well", "ds", "wlpr", _WIDTH)[1]


@query("prod", "SELECT well, ds, feature, round(value, 6) AS value FROM (SELECT well, ds, wlpr, womr FROM prod) UNPIVOT (value FOR feature IN (wlpr, womr))")
def melt_long(spark, sf):
    return rounded(t.producers(spark, sf).unpivot(["well", "ds"], ["wlpr", "womr"], "feature", "value"))


@query("prod coords", "SELECT well, ds FROM prod WHERE well IN (SELECT well FROM coords WHERE z < -2050)")
def join_semi_keys(spark, sf):
    return t.producers(spark, sf).select("well", "ds").join(t.coords(spark, sf).where("z < -2050").select("well"), "well", "left_semi")
