"""Validation and quality counts of a panel, each in one pass over it; and what fails on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvion.operators.conformal import quantiles


def _long(row: DataFrame, names: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One wide row as rows (check, column, value)."""
    pairs = [F.struct(F.lit(a).alias("check"), F.lit(b).alias("column"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for a, b, c in names]
    return row.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def schema_violations(df: DataFrame, required: Sequence[str], kinds: Sequence[str], kind: str = "type", nonnegative: Sequence[str] = ()) -> DataFrame:
    """check, column, value: rows that break a rule. A missing column counts as 1."""
    aggs, names = [], []
    for c in required:
        expr = F.sum(F.col(c).isNull().cast("int")) if c in df.columns else F.lit(1)
        aggs.append(expr.alias(f"n{len(names)}"))
        names.append(("null" if c in df.columns else "missing", c, f"n{len(names)}"))
    aggs.append(F.sum((~F.col(kind).isin(*kinds)).cast("int")).alias(f"n{len(names)}"))
    names.append(("domain", kind, f"n{len(names)}"))
    for c in nonnegative:
        aggs.append(F.sum((F.col(c) < 0).cast("int")).alias(f"n{len(names)}"))
        names.append(("negative", c, f"n{len(names)}"))
    return _long(df.agg(*aggs), names)


def quality_report(df: DataFrame, key: str, time: str, rates: Sequence[str], gap_days: int = 60) -> DataFrame:
    """check, column, value: rows, keys, repeated keys, days covered, nulls, negatives and
    values beyond three times the interquartile range, and keys with gaps."""
    n = lambda e: F.sum(F.coalesce(e, F.lit(False)).cast("int"))
    # Quantiles of all columns come from one pass: a row for each value and its column's number.
    long = df.select(F.inline(F.array(*(F.struct(F.lit(k).alias("column"), F.col(c).cast("double").alias("v")) for k, c in enumerate(rates))))) if rates else None
    found = quantiles(long, "v", (0.25, 0.75), ["column"]) if rates else None
    at = lambda k, q: F.max(F.when(F.col("column") == k, F.col(q)))
    wide = df.crossJoin(F.broadcast(found.agg(*(f for k, c in enumerate(rates) for f in (at(k, "q0").alias(f"a_{c}"), at(k, "q1").alias(f"b_{c}")))))) if rates else df  # one row
    aggs, names = [F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.datediff(F.max(time), F.min(time)).alias("days")], [("rows", "", "rows"), ("keys", key, "keys"), ("days", time, "days")]
    for c in rates:
        low, high = F.col(f"a_{c}"), F.col(f"b_{c}")
        aggs += [n(F.col(c).isNull()).alias(f"nulls_{c}"), n(F.col(c) < 0).alias(f"neg_{c}"), n((F.col(c) < low - 3 * (high - low)) | (F.col(c) > high + 3 * (high - low))).alias(f"out_{c}")]
        names += [("nulls", c, f"nulls_{c}"), ("negative", c, f"neg_{c}"), ("outliers", c, f"out_{c}")]
    steps = df.withColumn("gap", F.datediff(time, F.lag(time).over(Window.partitionBy(key).orderBy(time))))
    gaps = steps.where(F.col("gap") > gap_days).agg(F.countDistinct(key).alias("gaps"))
    twice = df.groupBy(key, time).count().where("count > 1").agg(F.sum(F.col("count") - 1).alias("repeated"))
    return _long(wide.agg(*aggs), names).unionByName(_long(gaps, [("gaps", key, "gaps")])).unionByName(_long(twice, [("repeated", key, "repeated")]))


def coordinate_validation(df: DataFrame, key: str) -> DataFrame:
    """check, value: rows with a null coordinate, and keys that stand more than once."""
    bad = df.agg(F.sum((F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()).cast("int")).alias("v")).select(F.lit("null_coordinates").alias("check"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("value"))
    twice = df.groupBy(key).count().where("count > 1").agg(F.count("*").alias("v")).select(F.lit("repeated_wells").alias("check"), F.col("v").cast("double").alias("value"))
    return bad.unionByName(twice)


class ValidationError(ValueError):
    """Rows break the rules; ``failures`` lists all of them."""

    def __init__(self, failures: list[tuple[str, str, float]]):
        self.failures = failures
        super().__init__("; ".join(f"{check} {column}: {value:g} rows" for check, column, value in failures))


def require_valid(df: DataFrame, required: Sequence[str], kinds: Sequence[str], kind: str = "type", nonnegative: Sequence[str] = ()) -> DataFrame:
    """``df`` itself; raises ValidationError with every rule that a row breaks."""
    broken = [(r["check"], r["column"], r["value"]) for r in schema_violations(df, required, kinds, kind, nonnegative).collect() if r["value"]]
    if broken:
        raise ValidationError(broken)
    return df


def require_places(df: DataFrame, key: str) -> DataFrame:
    """``df`` itself; raises where a column is missing or a key stands more than once. Null
    coordinates are let through."""
    if missing := [c for c in (key, "x", "y", "z") if c not in df.columns]:
        raise ValidationError([("missing", c, 1) for c in missing])
    twice = {r["check"]: r["value"] for r in coordinate_validation(df, key).collect()}["repeated_wells"]
    if twice:
        raise ValidationError([("repeated", key, twice)])
    return df


def series_report(df: DataFrame, key: str, time: str, cumulative: Sequence[str], kind: str, columns: Sequence[str]) -> DataFrame:
    """check, column, value: keys whose cumulative column falls somewhere, rows of each type, and
    1 for each column of which more than half is null."""
    w = Window.partitionBy(key).orderBy(time)
    falls = df.select(key, *((F.col(c) < F.lag(c).over(w)).alias(c) for c in cumulative))
    per_key = falls.groupBy(key).agg(*(F.max(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(c) for c in cumulative))
    decreasing = _long(per_key.agg(*(F.sum(c).alias(c) for c in cumulative)), [("non_monotonic", c, c) for c in cumulative])
    empty = _long(df.agg(*((F.avg(F.col(c).isNull().cast("double")) > 0.5).cast("int").alias(c) for c in columns)), [("mostly_null", c, c) for c in columns])
    types = df.groupBy(kind).agg(F.count("*").cast("double").alias("value")).select(F.lit("type").alias("check"), F.coalesce(F.col(kind), F.lit("")).alias("column"), "value")
    return decreasing.unionByName(empty).unionByName(types)
