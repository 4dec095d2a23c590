"""Closeness and rank of whole graphs, against brute force."""

import numpy as np
import pytest

from fluvion.operators import graph, statistics
from fluvion.plans import catalog_pairs


@pytest.fixture
def chain(spark):
    """Six wells in a row with a long way round, two more on their own, one alone."""
    names = "abcdefghi"
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.5), ("d", "e", 1.0), ("e", "f", 3.0), ("a", "f", 40.0), ("g", "h", 2.0)]
    w = np.full((9, 9), np.inf)
    for a, b, v in edges:
        w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = v
    return names, w, spark.createDataFrame([(k,) for k in names], "well string"), spark.createDataFrame(edges, "src string, dst string, d double")


def brute_closeness(w):
    d = w.copy()
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    r = np.isfinite(d).sum(1) - 1
    total = np.where(np.isfinite(d), d, 0).sum(1)
    return np.array([k * k / (s * (len(d) - 1)) if s else 0.0 for k, s in zip(r, total)])


def brute_rank(w):
    n = len(w)
    p = np.where(np.isfinite(w), 1 / w, 0)
    loose = p.sum(1) == 0
    p = np.where(loose[:, None], 1 / n, p / np.maximum(p.sum(1, keepdims=True), 1e-300))
    return np.linalg.solve(np.eye(n) - 0.85 * p.T, np.full(n, 0.15 / n))


def places(monkeypatch, wells, edges):
    monkeypatch.setattr(catalog_pairs.t, "coords", lambda spark, sf: wells)
    monkeypatch.setattr(catalog_pairs, "_edges", lambda spark, sf: edges)


def test_closeness_takes_paths_of_any_length(spark, monkeypatch, chain):
    names, w, wells, edges = chain
    places(monkeypatch, wells, edges)
    got = {r["well"]: r["closeness"] for r in catalog_pairs.closeness(spark, "").collect()}
    assert [got[k] for k in names] == pytest.approx(brute_closeness(w).tolist(), abs=1e-6)


def test_pagerank_goes_on_until_nothing_changes(spark, monkeypatch, chain):
    names, w, wells, edges = chain
    places(monkeypatch, wells, edges)
    got = {r["well"]: r["rank"] for r in catalog_pairs.pagerank(spark, "").collect()}
    assert [got[k] for k in names] == pytest.approx(brute_rank(w).tolist(), abs=1e-6)


def test_fixed_rounds_stay(spark, chain):
    names, w, wells, edges = chain
    assert graph.closeness(wells, edges, 2).where("well = 'a'").first()["closeness"] == pytest.approx(16 / ((1 + 3 + 40 + 43) * 8))


def test_lengths_from_lists_of_edges_equal_those_from_a_matrix():
    r = np.random.default_rng(6)
    for n, m in ((1, 0), (2, 1), (40, 60), (60, 400)):
        d = np.full((n, n), np.inf)
        for a, b, v in zip(r.integers(0, n, m), r.integers(0, n, m), r.random(m) + 0.1):
            if a != b:
                d[a, b] = d[b, a] = v
        src, dst = np.nonzero(np.isfinite(d))
        want = statistics.shortest(d, np.arange(n))
        assert statistics.lengths(n, src, dst, d[src, dst], np.arange(n)) == pytest.approx(want)


def test_closeness_of_a_field_whose_matrix_fits_no_task(spark):
    n = 12_000  # a matrix of these has 1.2 GB, in each task
    wells = spark.range(n).selectExpr("concat('w', id) AS well")
    edges = spark.range(n).where("id % 5 < 4").selectExpr("concat('w', id) AS src", "concat('w', id + 1) AS dst", "CAST(1 AS DOUBLE) AS d")
    got = statistics.closeness(edges, wells)
    ends = got.where("well IN ('w0', 'w2')").orderBy("well").collect()
    assert [x["closeness"] for x in ends] == pytest.approx([16 / (10 * (n - 1)), 16 / (6 * (n - 1))])
