"""Views of the driver's star schema as a monthly panel of wells with places.

Suppliers are wells: every third injects, the others produce. The same arithmetic in
DuckDB SQL stands in ``fluvion.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well, ds, type, wlpr, womr, wwir, wthp: one row for each well and month with rows."""
    injects = F.col("l_suppkey") % 3 == 0
    month = F.trunc("l_shipdate", "month").alias("ds")
    cells = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", month).agg(F.sum("l_quantity").alias("q"), F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("o"), F.avg(F.try_divide("l_extendedprice", "l_quantity")).alias("wthp"))
    return cells.select(
        F.col("l_suppkey").cast("string").alias("well"),
        "ds",
        F.when(injects, "INJ").otherwise("PROD").alias("type"),
        F.when(injects, 0.0).otherwise(F.col("q")).alias("wlpr"),
        F.when(injects, 0.0).otherwise(F.col("o")).alias("womr"),
        F.when(injects, F.col("q")).otherwise(0.0).alias("wwir"),
        "wthp",
    )


def producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).where("type = 'PROD'")


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well, x, y, z, type."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("well"), ((k * 37) % 101 * 50.0).alias("x"), ((k * 53) % 97 * 50.0).alias("y"), (-2000.0 - (k % 13) * 10).alias("z"), F.when(k % 3 == 0, "INJ").otherwise("PROD").alias("type"))


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unique_id, ds, y: events summed by user and day, with gaps."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("unique_id"), F.to_date("ts").alias("ds")).agg(F.sum("value").alias("y"))


def forecast(spark: SparkSession, sf_dir: str, horizon: int = 6) -> DataFrame:
    """unique_id, ds, y, y_hat, h_step: the last months of each producer against its last
    value before them."""
    order = Window.partitionBy("well").orderBy("ds")
    back = Window.partitionBy("well").orderBy(F.desc("ds"))
    rows = producers(spark, sf_dir).withColumn("back", F.row_number().over(back))
    last = F.last(F.when(F.col("back") > horizon, F.col("wlpr")), True).over(order)
    return rows.withColumn("y_hat", last).where((F.col("back") <= horizon) & F.col("y_hat").isNotNull()).select(F.col("well").alias("unique_id"), "ds", F.col("wlpr").alias("y"), "y_hat", (horizon + 1 - F.col("back")).cast("int").alias("h_step"))
