"""Sums of doubles that are taken again may differ in the last digit; results must not show it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fluvion.operators import attention, conformal

def unsteady(column):
    """The column plus noise in its last digits, other noise whenever it is read."""
    return F.col(column) + F.expr("pmod(cast(reflect('java.lang.System', 'nanoTime') as bigint) div 100, 7) * 1e-13")


def test_quantiles_of_unsteady_values(spark):
    rows = spark.range(2000).select(F.col("id").cast("double").alias("v0")).repartition(4).withColumn("v", unsteady("v0")).select("v")
    shares = [k / 20 for k in range(1, 20)]
    got = conformal.quantiles(rows, "v", shares).first()
    assert tuple(got) == pytest.approx([s * 1999 for s in shares], abs=1e-6)


def _series(spark, n):
    days = spark.range(300 * n).select((F.col("id") % 300).cast("string").alias("well"), (F.col("id") / 300).cast("int").alias("k"))
    values = days.withColumns({"v0": (F.col("k") * 7 % n).cast("double"), "ds": F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("k"))})
    return values.withColumn("v", unsteady("v0")).select("well", "ds", "v", F.lit(0.0).alias("d"), "v0")


def test_regimes_compare_a_value_with_itself(spark):
    """Of 13 values 0 to 12 the terciles are 4 and 8 themselves: neither is below itself."""
    got = attention.regimes(_series(spark, 13), "well", "ds", "v", F.to_date(F.lit("2030-01-01")), change="d").groupBy("v0", "regime_id").count().collect()
    assert {(r["v0"], r["regime_id"]): r["count"] for r in got} == {(float(v), (v >= 4) + (v >= 8)): 300 for v in range(13)}


def test_stages_compare_a_value_with_itself(spark):
    """Of 101 values 0 to 100 the quantiles are 33 and 66 themselves."""
    got = attention.stage_mix(_series(spark, 101), "well", "ds", "v", F.to_date(F.lit("2030-01-01")), change="d").groupBy("v0", "stage_id").count().collect()
    assert {(r["v0"], r["stage_id"]): r["count"] for r in got} == {(float(v), (v >= 33) + (v >= 66)): 300 for v in range(101)}
