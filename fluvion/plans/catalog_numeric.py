"""Queries of the operators that run numpy on bounded groups, and of the attention
weights built on them; registered on import. Those without SQL are tested by their
invariants and against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvion.functions import html
from fluvion.operators import attention, clusters, features, forecasting, graph, pairs, panel, spectra
from fluvion.operators import statistics as st
from fluvion.plans.catalog import query, rounded
from fluvion.plans.catalog_pairs import _CUT, _cut, _shifted, _weighted
from fluvion.sources import tables as t
from fluvion.sources.lineage import cut


@query()
def impute_spline(spark, sf):
    return st.impute_spline(panel.reindex(t.user_day(spark, sf), "unique_id", "ds", "day"), "unique_id", "ds", "y")


@query()
def robust_outliers(spark, sf):
    return st.outlier_flags(t.producers(spark, sf), "well", "ds", ["wlpr", "wthp"])


@query()
def pca_embedding(spark, sf):
    rows = features.windowed_matrix(t.producers(spark, sf).select("well", "ds", "wlpr"), "well", "ds", "wlpr")
    return st.window_embedding(rows, "well", "ds", "wlpr_window", _cut())


def _field(spark, sf) -> tuple[DataFrame, DataFrame]:
    wells = t.coords(spark, sf)
    return wells, graph.edges_within(wells, 2500.0)


@query()
def betweenness(spark, sf):
    wells, edges = _field(spark, sf)
    return st.dealt_betweenness(edges, wells)


@query()
def eigenvector(spark, sf):
    wells, edges = _field(spark, sf)
    return spectra.eigenvector(wells, edges)


@query()
def spectral(spark, sf):
    wells, edges = _field(spark, sf)
    return spectra.laplacian(wells, edges, 3)


@query()
def node2vec(spark, sf):
    wells, edges = _field(spark, sf)
    return st.whole_graph(edges, wells, lambda n, w, d: {"embedding": list(st.walk_embedding(w))}, "well string, embedding array<double>")


def _steps(spark, sf) -> DataFrame:
    rows = t.producers(spark, sf).join(t.coords(spark, sf).select("well"), "well", "left_semi")
    return st.z_scored_steps(rows, "well", "ds", "wlpr", _cut())


@query()
def kmeans_silhouette(spark, sf):
    return clusters.kmeans(_steps(spark, sf), 5)


@query()
def dtw_distance(spark, sf):
    return st.all_warped_distances(_steps(spark, sf))


def _similar(spark, sf) -> DataFrame:
    return st.warped_similarity(cut(st.all_warped_distances(_steps(spark, sf))))


@query()
def dtw_similarity(spark, sf):
    return _similar(spark, sf)


@query()
def dtw_neighbor_agg(spark, sf):
    near = _similar(spark, sf).select("src", "dst", (1 / F.greatest("similarity", F.lit(1e-12))).alias("d"))
    return graph.neighbour_aggregate(t.producers(spark, sf).select("well", "ds", "wlpr"), near, "wlpr", 3)


def _weighted_rate(spark, sf) -> DataFrame:
    return pairs.injection_features(_shifted(spark, sf)).select(F.col("prod_id"), "ds", F.col("inj_wwir_lag_weighted").alias("v"))


_RATE = "rate AS (SELECT prod_id, s.ds, sum(weight * x) AS v FROM shifted s JOIN lagged l USING (prod_id, inj_id) GROUP BY prod_id, s.ds), step AS (SELECT *, v - coalesce(lag(v) OVER (PARTITION BY prod_id ORDER BY ds), v) AS d FROM rate)"


@query("shifted lagged", f"""WITH {_RATE}, q AS (SELECT prod_id, count(*) AS n, quantile_cont(v, 1.0 / 3) AS a, quantile_cont(v, 2.0 / 3) AS b, quantile_cont(d, 0.2) AS lo, quantile_cont(d, 0.8) AS hi FROM step WHERE ds <= {_CUT} GROUP BY prod_id),
  raw AS (SELECT step.*, CASE WHEN coalesce(n, 0) < 5 THEN 0 WHEN hi > lo AND d <= lo THEN 4 WHEN hi > lo AND d >= hi THEN 3 WHEN v < a THEN 0 WHEN v < b THEN 1 ELSE 2 END AS r FROM step LEFT JOIN q USING (prod_id)),
  seen AS (SELECT prod_id, r, row_number() OVER (PARTITION BY prod_id ORDER BY r) - 1 AS k, row_number() OVER (PARTITION BY prod_id ORDER BY count(*) DESC, r) AS o FROM raw WHERE ds <= {_CUT} GROUP BY prod_id, r)
  SELECT raw.prod_id, ds, CAST(coalesce(s.k, m.k, 0) AS INTEGER) AS regime_id FROM raw LEFT JOIN seen s ON s.prod_id = raw.prod_id AND s.r = raw.r LEFT JOIN seen m ON m.prod_id = raw.prod_id AND m.o = 1""")
def regime_labels(spark, sf):
    return attention.regimes(_weighted_rate(spark, sf), "prod_id", "ds", "v", _cut()).select("prod_id", "ds", "regime_id")


@query("shifted lagged", f"""WITH {_RATE}, q AS (SELECT prod_id, quantile_cont(v, 0.33) AS a, quantile_cont(v, 0.66) AS b, quantile_cont(abs(d), 0.9) AS s, count(v) AS n FROM step WHERE ds <= {_CUT} GROUP BY prod_id),
  g AS (SELECT *, CASE WHEN n < 5 THEN 0 WHEN v < a THEN 0 WHEN v < b THEN 1 ELSE 2 END AS stage, 0.15 * least(abs(d) / s, 1) AS shift FROM step JOIN q USING (prod_id)),
  m AS (SELECT *, 0.7 * greatest(CASE stage WHEN 0 THEN 0.55 WHEN 1 THEN 0.70 ELSE 0.80 END + shift, 1e-4) AS x, 0.3 * greatest(CASE stage WHEN 0 THEN 0.45 WHEN 1 THEN 0.30 ELSE 0.20 END - shift, 1e-4) AS y FROM g)
  SELECT prod_id, ds, CAST(stage AS INTEGER) AS stage_id, round(CASE WHEN n < 5 THEN 0.7 ELSE x / (x + y) END, 6) AS mix FROM m""")
def stage_mix(spark, sf):
    return rounded(attention.stage_mix(_weighted_rate(spark, sf), "prod_id", "ds", "v", _cut()).select("prod_id", "ds", "stage_id", "mix"))


@query("weighted coords", """WITH s AS (SELECT w.*, exp(-abs(p.z - i.z) / (abs(p.z) + abs(i.z))) AS l FROM weighted w JOIN coords p ON p.well = prod_id JOIN coords i ON i.well = inj_id)
  SELECT prod_id, inj_id, round(0.7 * weight + 0.3 * l / sum(l) OVER (PARTITION BY prod_id), 6) AS geo_prior FROM s""", dated=False)
def geo_prior(spark, sf):
    base = _weighted(spark, sf).withColumn("prior", F.col("weight"))
    return rounded(attention.geology_prior(base, t.coords(spark, sf), ["z"]).select("prod_id", "inj_id", "geo_prior"))


@query("prod", f"""WITH indexed AS (SELECT well, ds, wlpr, row_number() OVER (PARTITION BY well ORDER BY ds) - 1 AS k FROM prod), base AS (SELECT min(m) + 1 - 6 - 6 * 2 AS b FROM (SELECT max(k) AS m FROM indexed GROUP BY well)),
  cut AS (SELECT f AS fold, b + 6 * f AS c FROM base, unnest([0, 1, 2]) AS g(f)), last AS (SELECT well, fold, wlpr AS y_hat FROM indexed JOIN cut ON k = c - 1)
  SELECT i.well, i.ds, CAST(fold AS INTEGER) AS fold, CAST(k - c + 1 AS INTEGER) AS h_step, wlpr AS y, y_hat FROM indexed i JOIN cut ON k >= c AND k < c + 6 JOIN last USING (well, fold)""")
def walk_forward_cv(spark, sf):
    return forecasting.walk_forward_persistence(t.producers(spark, sf), "well", "ds", "wlpr", 6, 6, 3)


def _past(spark, sf) -> DataFrame:
    return t.producers(spark, sf).where(F.col("ds") <= _cut()).select(F.col("well").alias("unique_id"), "ds", F.col("wlpr").alias("y"))


_AHEAD = f"""past AS (SELECT well, ds, wlpr AS y, row_number() OVER (PARTITION BY well ORDER BY ds) AS k, count(*) OVER (PARTITION BY well) AS n FROM prod WHERE ds <= {_CUT}), ends AS (SELECT well, max(n) AS n, max(ds) AS ds, arg_max(y, ds) AS z, arg_min(y, ds) AS a FROM past GROUP BY well), ahead AS (SELECT * FROM ends, generate_series(1, 6) AS g(h))"""


@query("prod", f"WITH {_AHEAD} SELECT well AS unique_id, CAST(ds + to_months(CAST(h AS INTEGER)) AS DATE) AS ds, 'drift' AS model, round(z + CASE WHEN n > 1 THEN (z - a) / (n - 1) * h ELSE 0 END, 6) AS y_hat, CAST(h AS INTEGER) AS h_step FROM ahead")
def forecast_drift(spark, sf):
    return rounded(forecasting.forecast(_past(spark, sf), "drift", 6))


@query("prod", f"WITH {_AHEAD} SELECT a.well AS unique_id, CAST(a.ds + to_months(CAST(h AS INTEGER)) AS DATE) AS ds, 'seasonal' AS model, round(CASE WHEN a.n < 12 THEN z ELSE p.y END, 6) AS y_hat, CAST(h AS INTEGER) AS h_step FROM ahead a LEFT JOIN past p ON p.well = a.well AND p.k = a.n - 12 + h")
def forecast_seasonal(spark, sf):
    return rounded(forecasting.forecast(_past(spark, sf), "seasonal", 6))


@query()
def forecast_ridge(spark, sf):
    return forecasting.forecast(_past(spark, sf), "ridge", 6)


@query("forecast", """WITH l AS (SELECT *, lag(y_hat) OVER w AS p, lead(y_hat) OVER w AS n FROM forecast WINDOW w AS (PARTITION BY unique_id ORDER BY ds))
  SELECT unique_id, round(avg(coalesce((n - 2 * y_hat + p) ** 2, 0)), 6) AS smoothness, round(avg(CASE WHEN y_hat < 0 THEN y_hat * y_hat ELSE 0 END), 6) AS boundary, round(avg(coalesce((y_hat - p) ** 2, 0)), 6) AS balance FROM l GROUP BY unique_id""", dated=False)
def physics_penalties(spark, sf):
    return rounded(forecasting.physics_penalties(t.forecast(spark, sf), "unique_id", "ds").drop("diffusion"))


@query()
def html_to_markdown(spark, sf):
    return html.to_markdown(t.table(spark, sf, "pages"), "page_id", "html")
