import numpy as np
import pytest

from fluvion.operators import statistics as st


def one_by_one(x, share=0.05, tries=30, seed=0):
    """Each try on its own."""
    n, p = x.shape
    rng, keep, best, chosen = np.random.default_rng(seed), (n + p + 1) // 2, np.inf, None

    def distance(rows):
        c = np.atleast_2d(np.cov(x[rows].T)) + 1e-9 * np.eye(p)
        d = x - x[rows].mean(0)
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d), np.linalg.slogdet(c)[1]

    for _ in range(tries):
        rows = rng.choice(n, p + 1, replace=False)
        for _ in range(20):
            rows = np.sort(np.argsort(distance(rows)[0], kind="stable")[:keep])
        if distance(rows)[1] < best:
            best, chosen = distance(rows)[1], rows
    d = distance(chosen)[0]
    return d > np.quantile(d, 1 - share)


@pytest.mark.parametrize("n,p", [(10, 1), (11, 2), (40, 2), (83, 3)])
def test_tries_step_together(n, p, monkeypatch):
    x = np.random.default_rng(n).normal(size=(n, p))
    want, calls, inv = one_by_one(x), [], np.linalg.inv
    monkeypatch.setattr(np.linalg, "inv", lambda a: calls.append(1) or inv(a))
    assert st.robust_outliers(x).tolist() == want.tolist()
    assert len(calls) <= 22  # a call for each step of all tries, not for each of each
