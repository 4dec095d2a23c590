"""Shortest paths where many pairs are edges."""

import numpy as np
import pytest

from fluvion.operators import statistics as st


def field(n, radius):
    """Wells on a lattice, so that many paths are equally long."""
    k = np.arange(n)
    at = np.c_[k * 37 % 11 * 50.0, k * 53 % 7 * 50.0]
    d = np.sqrt(((at[:, None] - at) ** 2).sum(-1))
    return np.where((d <= radius) & (d > 0), d, np.inf)


@pytest.mark.parametrize("radius", [60.0, 180.0, 1000.0])
def test_rows_of_the_matrix_give_the_lengths(radius):
    w = field(70, radius)
    assert st.spread(w, np.arange(70)) == pytest.approx(st.shortest(w, np.arange(70)))


def test_lists_of_edges_are_lengthened_in_bounded_blocks(spark, monkeypatch):
    w = field(40, 180.0)
    a, b = np.nonzero(np.triu(np.isfinite(w)))
    edges = spark.createDataFrame([(f"w{i}", f"w{j}", float(w[i, j])) for i, j in zip(a.tolist(), b.tolist())], "src string, dst string, d double")
    wells = spark.createDataFrame([(f"w{k}",) for k in range(41)], "well string")
    want = {r["well"]: r["closeness"] for r in st.closeness(edges, wells).collect()}
    monkeypatch.setattr(st, "WHOLE", 0)
    monkeypatch.setattr(st, "WAYS", 2 * len(a))  # two sources at a time at most
    monkeypatch.setattr(st, "lengths", lambda n, s, d, v, some, real=st.lengths: real(n, s, d, v, some) if len(some) <= 1 else pytest.fail("too many at once"))
    got = {r["well"]: r["closeness"] for r in st.closeness(edges, wells).collect()}
    assert got == pytest.approx(want) and len(got) == 41 and got["w40"] == 0


def test_shares_of_equal_paths():
    w = np.full((4, 4), np.inf)
    for a, b in ((0, 1), (0, 2), (1, 3), (2, 3)):
        w[a, b] = w[b, a] = 1.0
    assert st.passing(w, np.arange(4)).tolist() == [1.0, 1.0, 1.0, 1.0]
