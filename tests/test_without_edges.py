"""Measures of fields that keep no edges, against those of the edges."""

import numpy as np
import pytest

from fluvion.operators import graph
from fluvion.plans import catalog_pairs


@pytest.fixture(scope="module")
def places(spark):
    """Wells in several cells, some at one place, one far away, one without a place."""
    r = np.random.default_rng(4)
    rows = [(f"w{k}", float(x), float(y), float(z)) for k, (x, y, z) in enumerate(zip(r.integers(-8, 9, 60) * 50, r.integers(-8, 9, 60) * 50, r.integers(0, 3, 60) * 10))]
    rows += [("a", *rows[0][1:]), ("b", *rows[0][1:]), ("far", 9e4, 0.0, 0.0), ("lost", None, 1.0, 1.0)]
    return spark.createDataFrame(rows, "well string, x double, y double, z double")


def by_well(df, name):
    return {r["well"]: r[name] for r in df.collect()}


def test_triangles_of_a_field(places, monkeypatch):
    monkeypatch.setattr(graph, "CORNER", 7)
    monkeypatch.setattr(graph, "BLOCK", 5)
    want = by_well(graph.clustering(places, graph.edges_within(places, 250.0)), "clustering")
    got = by_well(graph.clustering_within(places, 250.0), "clustering")
    assert got == pytest.approx(want, abs=1e-12) and max(got.values()) > 0 and got["far"] == got["lost"] == 0


def test_the_query_of_triangles_makes_no_edges(places, monkeypatch):
    monkeypatch.setattr(catalog_pairs.t, "coords", lambda spark, sf: places)
    monkeypatch.setattr(catalog_pairs, "_edges", lambda spark, sf: pytest.fail("edges were made"))
    assert catalog_pairs.clustering_coeff(places.sparkSession, "").count() == 64
