"""Values that are equal but for the last digits of a sum are treated alike."""

import datetime as dt

from pyspark.sql import functions as F

from fluvion.operators import attention


def test_regimes_of_changes_that_a_sum_parts(spark):
    """The 20 % quantile of 75 changes lies between the 15th and the 16th, which are both -40.9 but for the last digits."""
    changes = [-50.0 - k for k in range(14)] + [-40.9124920735575, -40.9124920735573] + [float(k) for k in range(59)]
    rows = [("p", dt.date(2000, 1, 1) + dt.timedelta(days=k), 100.0 + k, d) for k, d in enumerate(changes)]
    series = spark.createDataFrame(rows, "well string, ds date, v double, d double")
    got = [r["regime_id"] for r in attention.regimes(series, "well", "ds", "v", F.to_date(F.lit("2030-01-01")), change="d").orderBy("ds").collect()]
    assert len(set(got[:16])) == 1 and got[16] != got[15]


def test_stages_of_values_that_a_sum_parts(spark):
    """The 33 % quantile of 102 values lies between the 34th and the 35th."""
    values = [float(k) for k in range(33)] + [40.9124920735573, 40.9124920735575] + [50.0 + k for k in range(67)]
    rows = [("p", dt.date(2000, 1, 1) + dt.timedelta(days=k), v, 0.0) for k, v in enumerate(values)]
    series = spark.createDataFrame(rows, "well string, ds date, v double, d double")
    got = [r["stage_id"] for r in attention.stage_mix(series, "well", "ds", "v", F.to_date(F.lit("2030-01-01")), change="d").orderBy("ds").collect()]
    assert got[:33] == [0] * 33 and got[33:35] == [1, 1]
