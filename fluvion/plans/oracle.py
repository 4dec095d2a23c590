"""DuckDB SQL of the panel queries: the views of ``fluvion.sources.tables``, and a
statement for each query over them."""

from __future__ import annotations

VIEWS = {
    "panel": """SELECT CAST(l_suppkey AS VARCHAR) AS well, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
      CASE WHEN l_suppkey % 3 = 0 THEN 'INJ' ELSE 'PROD' END AS type,
      CASE WHEN l_suppkey % 3 = 0 THEN 0.0::DOUBLE ELSE sum(l_quantity) END AS wlpr,
      CASE WHEN l_suppkey % 3 = 0 THEN 0.0::DOUBLE ELSE sum(l_quantity * (1 - l_discount)) END AS womr,
      CASE WHEN l_suppkey % 3 = 0 THEN sum(l_quantity) ELSE 0.0::DOUBLE END AS wwir,
      avg(l_extendedprice / nullif(l_quantity, 0)) AS wthp
      FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate)""",
    "prod": "SELECT * FROM panel WHERE type = 'PROD'",
    "coords": """SELECT CAST(s_suppkey AS VARCHAR) AS well, CAST((s_suppkey * 37) % 101 * 50 AS DOUBLE) AS x, CAST((s_suppkey * 53) % 97 * 50 AS DOUBLE) AS y,
      CAST(-2000 - (s_suppkey % 13) * 10 AS DOUBLE) AS z, CASE WHEN s_suppkey % 3 = 0 THEN 'INJ' ELSE 'PROD' END AS type FROM supplier""",
    "user_day": "SELECT CAST(user_id AS VARCHAR) AS unique_id, CAST(ts AS DATE) AS ds, sum(value) AS y FROM events GROUP BY user_id, CAST(ts AS DATE)",
    "spine": """SELECT u.unique_id, CAST(g.d AS DATE) AS ds, e.y FROM (SELECT unique_id, min(ds) AS a, max(ds) AS b FROM user_day GROUP BY unique_id) u,
      unnest(generate_series(u.a, u.b, INTERVAL 1 DAY)) AS g(d) LEFT JOIN user_day e ON e.unique_id = u.unique_id AND e.ds = CAST(g.d AS DATE)""",
    "forecast": """SELECT well AS unique_id, ds, wlpr AS y, y_hat, CAST(7 - back AS INTEGER) AS h_step FROM (
      SELECT *, last_value(CASE WHEN back > 6 THEN wlpr END IGNORE NULLS) OVER (PARTITION BY well ORDER BY ds) AS y_hat FROM (
        SELECT *, row_number() OVER (PARTITION BY well ORDER BY ds DESC) AS back FROM prod)) WHERE back <= 6 AND y_hat IS NOT NULL""",
    "pairs": """SELECT p.well AS prod_id, i.well AS inj_id, sqrt((p.x - i.x) ** 2 + (p.y - i.y) ** 2 + (p.z - i.z) ** 2) AS d, i.x - p.x AS dx, i.y - p.y AS dy, i.z - p.z AS dz
      FROM coords p, coords i WHERE p.type = 'PROD' AND i.type = 'INJ'""",
    "near": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prod_id ORDER BY d, inj_id) AS rk FROM pairs) WHERE rk <= 5",
    "weighted": "SELECT *, w / sum(w) OVER (PARTITION BY prod_id) AS weight FROM (SELECT *, pow(greatest(d, 1e-6), -2) AS w FROM near)",
    "lagged": """SELECT prod_id, inj_id, d, rk, weight, t_diff, greatest(1, CAST(ceil(t_diff / 30) AS BIGINT)) AS lower_bound, greatest(1, CAST(ceil(t_front / 30) AS BIGINT)) AS upper_bound FROM (
      SELECT *, greatest(1.5 * t_diff, t_diff + 30) AS t_front FROM (SELECT *, d * d / (4 * (150 * 9.869233e-16 / (0.18 * 0.0012 * (8e-4 / 1e6)))) / 86400 AS t_diff FROM weighted))""",
    "rates": "SELECT well, ds, wwir AS x, wwir - coalesce(lag(wwir) OVER (PARTITION BY well ORDER BY ds), wwir) AS dx FROM panel WHERE type = 'INJ'",
    "shifted": """SELECT l.prod_id, l.inj_id, p.ds, l.lower_bound AS lag, p.wlpr AS y, r.x, r.dx FROM lagged l JOIN prod p ON p.well = l.prod_id
      JOIN rates r ON r.well = l.inj_id AND r.ds = CAST(p.ds - to_months(CAST(l.lower_bound AS INTEGER)) AS DATE)""",
    "edges": """SELECT a.well AS src, b.well AS dst, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM coords a JOIN coords b ON a.well < b.well
      WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1000000.0""",
    "dates": "SELECT DISTINCT ds FROM prod",
    "ys": """SELECT w.well, d.ds, coalesce(last_value(p.wlpr IGNORE NULLS) OVER b, 0) AS y, coalesce(last_value(p.wthp IGNORE NULLS) OVER b, first_value(p.wthp IGNORE NULLS) OVER a) AS c
      FROM (SELECT DISTINCT well FROM prod) w CROSS JOIN dates d LEFT JOIN prod p ON p.well = w.well AND p.ds = d.ds
      WINDOW b AS (PARTITION BY w.well ORDER BY d.ds), a AS (PARTITION BY w.well ORDER BY d.ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "xs": """SELECT well, ds, x, x - coalesce(lag(x) OVER (PARTITION BY well ORDER BY ds), x) AS dx FROM (SELECT w.well, d.ds, coalesce(i.wwir, 0) AS x
      FROM (SELECT DISTINCT well FROM panel WHERE type = 'INJ') w CROSS JOIN dates d LEFT JOIN panel i ON i.well = w.well AND i.ds = d.ds)""",
    "found": """SELECT l.prod_id, l.inj_id, l.d, l.rk, l.t_diff, l.lower_bound, l.upper_bound, coalesce(b.lag, l.lower_bound) AS lag, greatest(coalesce(b.lag, l.lower_bound), l.lower_bound) AS tau, coalesce(b.corr, 0) AS corr, coalesce(b.overlap, 0) AS overlap
      FROM lagged l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY prod_id, inj_id ORDER BY corr DESC, lag) AS n FROM (
        SELECT g.prod_id, g.inj_id, g.lag, covar_pop(x, y) / sqrt((var_pop(x) + 1e-6) * (var_pop(y) + 1e-6)) AS corr, count(*) AS overlap
        FROM (SELECT prod_id, inj_id, unnest(generate_series(lower_bound, upper_bound)) AS lag FROM lagged) g JOIN ys ON ys.well = g.prod_id AND ys.ds <= DATE '2001-04-01'
        JOIN xs ON xs.well = g.inj_id AND xs.ds = CAST(ys.ds - to_months(CAST(g.lag AS INTEGER)) AS DATE) GROUP BY g.prod_id, g.inj_id, g.lag HAVING count(*) >= 6)) b
      ON b.prod_id = l.prod_id AND b.inj_id = l.inj_id AND b.n = 1""",
    "lagrows": """SELECT f.prod_id, f.inj_id, f.rk, f.d, f.lag, f.tau, ys.ds, ys.y, ys.c, coalesce(xs.x, 0) AS x, coalesce(xs.dx, 0) AS dx, xs.x IS NOT NULL AS known
      FROM found f JOIN ys ON ys.well = f.prod_id LEFT JOIN xs ON xs.well = f.inj_id AND xs.ds = CAST(ys.ds - to_months(CAST(f.lag AS INTEGER)) AS DATE)""",
    "trained": """SELECT *, row_number() OVER (PARTITION BY prod_id, inj_id ORDER BY ds) AS k, count(*) OVER (PARTITION BY prod_id, inj_id) AS n
      FROM lagrows WHERE ds <= DATE '2001-04-01' AND known QUALIFY count(*) OVER (PARTITION BY prod_id, inj_id) >= 12""",
    "inflow": "SELECT prod_id, s.ds, sum(weight * x) AS x FROM shifted s JOIN lagged l USING (prod_id, inj_id) GROUP BY prod_id, s.ds",
    "predicted": """SELECT unique_id, ds, t, y, y_hat, oil, oil_hat, p, p_hat, cut, cut_hat, x, 0.7 * y_hat AS low, 1.3 * y_hat AS high FROM (
      SELECT c.well AS unique_id, c.ds, row_number() OVER w - 1 AS t, wlpr AS y, avg(wlpr) OVER b AS y_hat, womr AS oil, avg(womr) OVER b AS oil_hat, wthp AS p, avg(wthp) OVER b AS p_hat, cut, avg(cut) OVER b AS cut_hat, coalesce(i.x, 0) AS x
      FROM (SELECT *, least(greatest(wlpr - womr, 0) / greatest(abs(wlpr), 1e-6), 1) AS cut FROM prod) c LEFT JOIN inflow i ON i.prod_id = c.well AND i.ds = c.ds
      WINDOW w AS (PARTITION BY c.well ORDER BY c.ds), b AS (PARTITION BY c.well ORDER BY c.ds ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) WHERE t >= 3""",
    "dirs": "SELECT src, dst, d, 1 / d AS w FROM edges WHERE d > 0 UNION ALL SELECT dst, src, d, 1 / d FROM edges WHERE d > 0",
}

_USES = {"prod": ["panel"], "spine": ["user_day"], "forecast": ["prod"], "pairs": ["coords"], "near": ["pairs"], "weighted": ["near"], "lagged": ["weighted"], "rates": ["panel"], "shifted": ["lagged", "prod", "rates"], "inflow": ["shifted", "lagged"], "predicted": ["prod", "inflow"], "dates": ["prod"], "ys": ["prod", "dates"], "xs": ["panel", "dates"], "found": ["lagged", "ys", "xs"], "lagrows": ["found", "ys", "xs"], "trained": ["lagrows"], "edges": ["coords"], "dirs": ["edges"]}


def over(views: str, select: str) -> str:
    """A statement with the named views, and those that they use, in front."""
    order: list[str] = []

    def need(name: str) -> None:
        for v in _USES.get(name, []):
            need(v)
        if name not in order:
            order.append(name)

    for v in views.split():
        need(v)
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)
    body = select.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}" if head else body
