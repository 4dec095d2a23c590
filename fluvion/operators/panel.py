"""Regularising and preparing panels: one series for each key, ordered by time.

Windows are by key, so a series is the unit that must fit one task; panels grow by
keys. Every operator keeps columns that it doesn't name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvion.sources.lineage import cut


def _order(key: str, time: str):
    return Window.partitionBy(key).orderBy(time)


def _upto(key: str, time: str):
    return _order(key, time).rowsBetween(Window.unboundedPreceding, 0)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key, the first by ``order``, which must settle ties."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def reindex(df: DataFrame, key: str, time: str, step: str = "month") -> DataFrame:
    """Each key's rows on a calendar grid from its first to its last grid date. Rows off
    the grid are dropped; grid dates without a row have nulls."""
    grid = F.trunc(time, step) if step == "month" else F.col(time).cast("date")
    first = F.when(F.min(grid) < F.min(time), F.add_months(F.min(grid), 1)).otherwise(F.min(grid)) if step == "month" else F.min(grid)
    spans = df.groupBy(key).agg(first.alias("a"), F.max(grid).alias("b")).where("a <= b")
    spine = spans.select(key, F.explode(F.sequence("a", "b", F.expr(f"interval 1 {step}"))).alias("__at")).select(key, F.col("__at").cast("date").alias(time))
    return spine.join(df.withColumn(time, F.col(time).cast("date")), [key, time], "left")


def forward_fill(df: DataFrame, key: str, time: str, columns: Sequence[str], default: float | None = 0.0) -> DataFrame:
    """Nulls take the last value before them, then ``default``."""
    w = _upto(key, time)
    filled = {c: F.last(c, True).over(w) for c in columns}
    return df.withColumns({c: v if default is None else F.coalesce(v, F.lit(default)) for c, v in filled.items()})


def both_fill(df: DataFrame, key: str, time: str, columns: Sequence[str]) -> DataFrame:
    """Nulls take the last value before them, else the first one after them."""
    after = _order(key, time).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(_upto(key, time)), F.first(c, True).over(after)) for c in columns})


def cumulative_max(df: DataFrame, key: str, time: str, columns: Sequence[str]) -> DataFrame:
    """Running maximum; null where the value is."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.max(c).over(_upto(key, time))) for c in columns})


def time_index(df: DataFrame, key: str, time: str, name: str = "time_idx") -> DataFrame:
    return df.withColumn(name, F.row_number().over(_order(key, time)) - 1)


def upto(time: str, cutoff, key: str) -> Column:
    """Rows that may be learned from: up to a date or, where ``cutoff`` is a function, up to the
    date that it gives for the key in the column ``key`` (folds.Folds.cutoff)."""
    own = cutoff(key) if callable(cutoff) and not isinstance(cutoff, Column) else cutoff
    return F.col(time) <= own


def clip_nonnegative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) < 0, 0.0).otherwise(F.col(c)) for c in columns})


def watercut(df: DataFrame, liquid: str = "wlpr", oil: str = "womr", name: str = "watercut") -> DataFrame:
    """Share of water in the liquid, 0 to 1; 0 where unknown."""
    water = F.greatest(F.col(liquid) - F.col(oil), F.lit(0.0)) / F.greatest(F.abs(liquid), F.lit(1e-6))
    known = F.col(liquid).isNotNull() & F.col(oil).isNotNull()
    return df.withColumn(name, F.when(known, F.least(water, F.lit(1.0))).otherwise(0.0))


def calendar(df: DataFrame, time: str = "ds", kind: str = "type") -> DataFrame:
    """Type flags, month and its place on the circle of the year."""
    angle = 2 * F.lit(3.141592653589793) * F.month(time) / 12
    return df.withColumns({"type_prod": (F.col(kind) == "PROD").cast("int"), "type_inj": (F.col(kind) == "INJ").cast("int"), "month": F.month(time), "month_sin": F.sin(angle), "month_cos": F.cos(angle)})


def fill_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that are absent are added as 0, nulls and NaN become 0."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in columns})


def target_wells(df: DataFrame, key: str, time: str, kind: str = "type", least: int = 60) -> DataFrame:
    """Keys whose last row is a producer's and that have at least ``least`` rows."""
    last = F.max_by(kind, time)
    return df.groupBy(key).agg(F.count("*").alias("n_rows"), last.alias("last_type")).where((F.col("last_type") == "PROD") & (F.col("n_rows") >= least)).select(key, "n_rows")


def split(df: DataFrame, key: str, time: str, horizon: int) -> DataFrame:
    """Adds ``part``: test from the month that leaves ``horizon`` months up to the
    earliest of the keys' ends, train before; and train_cutoff, the month before that, but
    not before the first row."""
    end = df.groupBy(key).agg(F.max(time).alias("e"), F.min(time).alias("f")).agg(F.min("e").alias("e"), F.min("f").alias("f"))
    start = end.select(F.add_months("e", 1 - horizon).alias("__start"), F.greatest(F.add_months("e", -horizon), F.col("f").cast("date")).alias("train_cutoff"))
    return df.crossJoin(F.broadcast(start)).withColumn("part", F.when(F.col(time) < F.col("__start"), "train").otherwise("test")).drop("__start")


def walk_forward(df: DataFrame, key: str, time: str, horizon: int, step: int, folds: int) -> DataFrame:
    """Adds fold and part for each fold that a row is in: growing training windows, each
    followed by ``horizon`` rows of validation. Series too short for that raise."""
    indexed = time_index(df, key, time)
    total = indexed.groupBy(key).agg(F.max("time_idx").alias("m")).agg(F.min("m").alias("m")).first()["m"]
    base = (total + 1 if total is not None else 0) - horizon - step * (folds - 1)
    if base <= 0:
        raise ValueError("the shortest series is too short for these folds")
    each = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    cut = base + step * F.col("fold")
    spread = indexed.withColumn("fold", each).withColumn("part", F.when(F.col("time_idx") < cut, "train").when(F.col("time_idx") < cut + horizon, "val"))
    return spread.where("part is not null")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Each key once, with its number in rising order from 0. Keys are sorted over all tasks; each counts its own, and what
    stands in the tasks before is added. Written, since the sort's tasks must stay as they were."""
    placed = cut(df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).select(key, F.monotonically_increasing_id().alias("__id")))
    # The number of the task, and the place within it.
    placed = placed.select(key, F.shiftright("__id", 33).alias("__task"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__nth"))
    counts = placed.groupBy("__task").agg(F.count("*").alias("__n"))
    before = counts.select("__task", F.coalesce(F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each task
    return placed.join(F.broadcast(before), "__task").select(key, (F.col("__before") + F.col("__nth")).alias("number"))


def widened(df: DataFrame, key: str, time: str, value: str, width: int = 64) -> tuple[DataFrame, DataFrame]:
    """(time, block, v0, v1...: the series side by side in blocks of ``width`` columns; key, block, place: where each series
    stands). However many series there are, columns are ``width`` and no name comes to the driver. A month without a row of
    any of a block's series has no row there; values of one key and time are summed."""
    places = numbered(df, key).select(key, F.floor(F.col("number") / width).cast("int").alias("block"), (F.col("number") % width).cast("int").alias("place"))
    joined = df.select(key, time, value).join(places, key)
    wide = joined.groupBy(time, "block").agg(*(F.sum(F.when(F.col("place") == k, F.col(value))).alias(f"v{k}") for k in range(width)))
    return wide, places
