"""Queries over a field of more than twenty wells: every well takes part."""

import datetime as dt
import itertools

import numpy as np
import pytest

import __spark_entry__ as entry
from fluvion.operators import statistics as st

WELLS = 30


@pytest.fixture(scope="module")
def field(spark, tmp_path_factory):
    """Tables supplier and lineitem of 30 wells, 20 of which produce, over 12 months; well 28
    has rows in a month of its own."""
    d = tmp_path_factory.mktemp("field")
    r = np.random.default_rng(7)
    spark.createDataFrame([(k,) for k in range(1, WELLS + 1)], "s_suppkey long").write.parquet(f"{d}/supplier.parquet")
    at = [(k, dt.datetime(2000, m, 5)) for k in range(1, WELLS + 1) for m in range(1, 13)] + [(28, dt.datetime(2002, 1, 1))]
    rows = [(k, float(r.integers(1, 50)), float(r.integers(100, 900)), 0.1, ds) for k, ds in at]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    return str(d)


def producers():
    return {str(k) for k in range(1, WELLS + 1) if k % 3}


def paths(d):
    """Lengths and numbers of shortest paths by Floyd and Warshall's algorithm."""
    d, n = d.copy(), len(d)
    np.fill_diagonal(d, 0)
    edge = d.copy()
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    count = np.eye(n)
    for s in range(n):
        for v in d[s].argsort()[1:]:
            if np.isfinite(d[s, v]):
                count[s, v] = sum(count[s, u] for u in range(n) if u != v and np.isfinite(edge[u, v]) and abs(d[s, u] + edge[u, v] - d[s, v]) < 1e-9)
    return d, count


def test_betweenness_against_counts_of_paths():
    r = np.random.default_rng(8)
    for n in (1, 2, 9, 14):
        w = np.triu(np.where(r.random((n, n)) < 0.35, r.integers(1, 4, (n, n)).astype(float), np.inf), 1)
        w = np.where(np.triu(np.ones((n, n)), 1) > 0, w, np.inf)
        w = np.minimum(w, w.T)
        d, count = paths(w)
        want = np.zeros(n)
        for s, v, e in itertools.permutations(range(n), 3):
            if np.isfinite(d[s, e]) and abs(d[s, v] + d[v, e] - d[s, e]) < 1e-9:
                want[v] += count[s, v] * count[v, e] / count[s, e]
        assert st.betweenness(w) == pytest.approx(want / max((n - 1) * (n - 2), 1))
        assert st.passing(w, np.arange(n), block=3) == pytest.approx(want)


def test_warped_blocks_equal_single_pairs():
    r = np.random.default_rng(9)
    a = [r.normal(size=n) for n in (1, 5, 9, 3, 9, 0, 0)]
    b = [r.normal(size=n) for n in (4, 5, 2, 8, 9, 3, 0)]
    assert st.warped_block(a, b).tolist() == pytest.approx([st.warped_distance(x, y) for x, y in zip(a, b)])
    assert st.warped_block([], []).tolist() == []


def test_walks_follow_edges():
    w = np.array([[0, 1, 0, 0], [1, 0, 2, 0], [0, 2, 0, 0], [0, 0, 0, 0]], float)
    walks = st.biased_walks(w, length=6, each=4, block=2)
    assert sorted(x[0] for x in walks) == sorted([0, 1, 2, 3] * 4)
    assert all(len(x) == (1 if x[0] == 3 else 6) and all(w[a, b] > 0 for a, b in zip(x, x[1:])) for x in walks)


@pytest.mark.parametrize("name", ["betweenness", "eigenvector", "spectral", "node2vec"])
def test_graph_measures_have_every_well(spark, field, name):
    got = entry.queries()[name](spark, field).collect()
    assert sorted(int(r["well"]) for r in got) == list(range(1, WELLS + 1))
    if name == "betweenness":
        edges = {(r["src"], r["dst"]): r["d"] for r in st_edges(spark, field)}
        d = np.full((WELLS, WELLS), np.inf)
        for (a, b), v in edges.items():
            d[int(a) - 1, int(b) - 1] = d[int(b) - 1, int(a) - 1] = v
        assert [r["betweenness"] for r in sorted(got, key=lambda r: int(r["well"]))] == pytest.approx(st.betweenness(d).tolist())


def st_edges(spark, field):
    from fluvion.operators import graph
    from fluvion.sources import tables as t

    return graph.edges_within(t.coords(spark, field), 2500.0).collect()


def test_series_measures_have_every_producer(spark, field):
    q = entry.queries()
    assert {r["well"] for r in q["kmeans_silhouette"](spark, field).collect()} == producers()
    want = {(a, b) for a in producers() for b in producers() if a < b}
    assert sorted((r["src"], r["dst"]) for r in q["dtw_distance"](spark, field).collect()) == sorted(want)
    assert {(r["src"], r["dst"]) for r in q["dtw_similarity"](spark, field).collect()} == want
    assert {r["well"] for r in q["dtw_neighbor_agg"](spark, field).collect()} == producers()


def test_dealt_pairs_equal_single_pairs(spark):
    r = np.random.default_rng(10)
    s = {f"w{k}": r.normal(size=3 + k % 4).tolist() for k in range(23)}
    df = spark.createDataFrame(list(s.items()), "well string, s array<double>")
    assert st.all_warped_distances(df.limit(1)).collect() == []
    got = {(r["src"], r["dst"]): r["dtw"] for r in st.all_warped_distances(df, part=2).collect()}
    assert got == pytest.approx({(a, b): st.warped_distance(np.array(s[a]), np.array(s[b])) for a in s for b in s if a < b})


def test_widening_has_a_place_for_every_producer(spark, field):
    from fluvion.sources import tables as t

    places = {(r["block"], r["place"]): r["well"] for r in entry.queries()["pivot_places"](spark, field).collect()}
    assert sorted(places.values()) == sorted(producers())
    got = {}
    for r in entry.queries()["pivot_wide"](spark, field).collect():
        got |= {(r["ds"], places[r["block"], k]): r[f"v{k}"] for k in range(16) if r[f"v{k}"] is not None}
    want = {(str(r["ds"]), r["well"]): r["wlpr"] for r in t.producers(spark, field).collect()}
    assert got == want and any(ds == "2002-01-01" for ds, _ in got)
