"""What is computed of many pairs at once is what each pair gives."""

import datetime as dt

import numpy as np

from fluvion.operators import attention
from fluvion.operators import statistics as st


def test_information_of_many_pairs_is_that_of_each():
    rng, pairs = np.random.default_rng(1), []
    for k in range(60):
        n = int(rng.choice([3, 8, 9, 40, 41, 600]))
        x, y = np.round(rng.gamma(2, 5, n)), rng.normal(size=n)
        if k % 5 == 0:
            x[:] = 2.0
        if k % 7 == 0:
            y[0] = np.nan
        pairs.append((x, y))
    for k in (3, 5):
        assert np.array_equal(st.information_of(pairs, k), [st.mutual_information(x, y, k) for x, y in pairs], equal_nan=True)
    assert len(st.information_of([])) == 0


def test_warping_many_pairs_is_that_of_each():
    rng = np.random.default_rng(2)
    a, b = ([rng.normal(size=rng.integers(0, 30)) for _ in range(st.WARPED + 40)] for _ in range(2))
    want = [st.warped_distance(x, y) if len(x) and len(y) else np.inf for x, y in zip(a, b)]
    assert np.array_equal(st.warped_block(a, b), want)
    assert len(st.warped_block([], [])) == 0


def test_regimes_of_a_producer_are_fitted_in_one_group(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        x = rng.gamma(2, size=3)
        y = float(x @ [0.6, 0.3, 0.1] + 0.01 * rng.normal())
        rows += [("p", dt.date(2000 + k // 12, k % 12 + 1, 1), k % 2, i, y, 1 / 3, float(v)) for i, v in zip("abc", x)]
    df = spark.createDataFrame(rows, "prod_id string, ds date, regime_id int, inj_id string, y double, prior double, x double")
    key = lambda d: {(r["regime_id"], r["inj_id"]): r["learned"] for r in d.collect()}
    made = attention.regime_weights(df)
    assert key(made) == key(attention.regime_weights(df.where("regime_id = 0"))) | key(attention.regime_weights(df.where("regime_id = 1")))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow [prod_id" in plan and "regime_id" not in plan.split("FlatMapGroupsInArrow")[1].split("]")[0]
