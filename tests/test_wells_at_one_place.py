"""A producer and an injector at one place, as in fields that repeat themselves."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fluvion.operators import pairs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def field(spark, tmp_path_factory):
    """Places of sf0.001 and again those wells whose key is greater by 101 * 97 * 13, which are at the same places and
    of another type."""
    folder = tmp_path_factory.mktemp("field")
    twice = F.explode(F.array(F.lit(0), F.lit(101 * 97 * 13)))
    for name, key in (("supplier", "s_suppkey"), ("lineitem", "l_suppkey")):
        rows = spark.read.parquet(f"{SF}/{name}.parquet").withColumn("__more", twice)
        rows.withColumn(key, F.col(key) + F.col("__more")).drop("__more").coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["lag_window", "pair_summary", "static_prior"])
def test_wells_at_one_place_as_sql(spark, field, name):
    con = duckdb.connect()
    for table in ("supplier", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{field}/{table}.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, field).select(*columns)
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r[:2])))
    want, got = order(want.fetchall()), order(got.collect())
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-6)
    assert any(r[columns.index("distance_m")] == 0 for r in want) if "distance_m" in columns else True


def test_lag_window_of_wells_at_one_place(spark):
    pair = spark.createDataFrame([("a", "b", 0.0)], "prod_id string, inj_id string, d double")
    got = pairs.lag_window(pair, touching=True).first()
    assert (got["t_diff"], got["t_front"], got["lower_bound"], got["upper_bound"]) == (0.0, 30.0, 1, 1)
    for bad in (-1.0, float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="positive finite distance"):
            pairs.lag_window(pair.withColumn("d", F.lit(bad).cast("double")), touching=True).collect()
