"""Conformal intervals: quantiles of past errors, a profile by horizon, and intervals.

Quantiles are exact and never sort a whole group in one task: approximate splits cut a
group into parts, sums of the parts say which one holds the quantile, and only that part is
ordered. Equal values are one row with their weight.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvion.sources.lineage import cut

#: Names of the methods, and what they stand for.
METHODS = {
    "icp": "icp",
    "split": "icp",
    "split_cp": "icp",
    "scp": "icp",
    "wcp": "wcp_exp",
    "wcp_exp": "wcp_exp",
    "wcp_exponential": "wcp_exp",
    "wcp_lin": "wcp_linear",
    "wcp_linear": "wcp_linear",
}
#: Parts that a group is cut into before the one that matters is ordered.
PARTS = 64


def method_of(name: str | None) -> str:
    """The method that a name stands for; any other name is exponential weighting."""
    return METHODS.get((name or "").strip().lower(), "wcp_exp")


def smallest_reaching(df: DataFrame, by: Sequence[str], value: str, weight: Column, *targets: Callable[[Column], Column]) -> DataFrame:
    """by, target (its place), eps: the least value at which the weights up to it reach each
    target of their sum; the largest value where rounding keeps them from that. The values are
    written once: a sum that is taken again in another order of its rows may differ in the last
    digit, and then falls into another part than the one that was counted."""
    keys = list(by) or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(0))
    one = cut(rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.sum(weight).alias("__w")))
    splits = one.groupBy(*keys).agg(F.percentile_approx("__v", [k / PARTS for k in range(1, PARTS)], 1000).alias("__s"), F.sum("__w").alias("__total"))
    dealt = one.join(splits, keys).withColumn("__part", F.size(F.filter("__s", lambda s: s < F.col("__v"))))
    sums = dealt.groupBy(*keys, "__part", "__total").agg(F.sum("__w").alias("__sum"))
    # At most PARTS rows in a window from here on.
    upto = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__part"))
    last = F.max("__part").over(Window.partitionBy(*keys))
    wanted = F.posexplode(F.array(*(t(F.col("__total")).cast("double") for t in targets))).alias("target", "__t")
    found = sums.withColumns({"__upto": upto, "__last": last}).select("*", wanted).where((F.col("__upto") >= F.col("__t")) | (F.col("__part") == F.col("__last")))
    found = found.groupBy(*keys, "target", "__t").agg(F.min(F.struct("__part", (F.col("__upto") - F.col("__sum")).alias("__before"))).alias("__f")).select(*keys, "target", "__t", "__f.*")
    inside = dealt.join(found, [*keys, "__part"])
    within = F.col("__before") + F.sum("__w").over(Window.partitionBy(*keys, "target").orderBy("__v"))
    reached = inside.withColumn("__r", within).groupBy(*keys, "target").agg(F.coalesce(F.min(F.when(F.col("__r") >= F.col("__t"), F.col("__v"))), F.max("__v")).alias("eps"))
    return reached.select(*by, "target", "eps")


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """q0, q1... in one row, or behind ``by`` in one row for each of few groups: exact quantiles of a column, each between
    the two values around it by their distance; nulls without values. No value is held more than once, nor
    all of them by one task."""
    at = lambda share, n: F.floor(share * (n - 1))
    targets = [f for s in shares for f in (lambda n, s=s: at(s, n) + 1, lambda n, s=s: F.least(at(s, n) + 2, n))]
    found = smallest_reaching(df, by, value, F.lit(1), *targets)
    wide = found.groupBy(*by).agg(*(F.max(F.when(F.col("target") == k, F.col("eps"))).alias(f"__{k}") for k in range(len(targets))))
    counts = df.groupBy(*by).agg(F.count(value).alias("__n"))
    made = counts.join(F.broadcast(wide), list(by), "left") if by else counts.crossJoin(F.broadcast(wide))
    part = lambda s: s * (F.col("__n") - 1) - at(s, F.col("__n"))
    return made.select(*by, *((F.col(f"__{2 * k}") + part(s) * (F.col(f"__{2 * k + 1}") - F.col(f"__{2 * k}"))).alias(f"q{k}") for k, s in enumerate(shares)))


def positions(df: DataFrame, by: Sequence[str], time: str, tie: str, name: str = "position") -> DataFrame:
    """The place of each row of a group by time, ties by ``tie``, from 1. Rows are counted by
    time first, so that a task orders the rows of one moment only."""
    keys = list(by)
    counts = df.groupBy(*keys, time).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__n").over(w.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("__before", before).withColumn("__total", F.sum("__n").over(w)).drop("__n")
    at = F.row_number().over(Window.partitionBy(*keys, time).orderBy(tie))
    return df.join(starts, [*keys, time]).withColumn(name, F.col("__before") + at).withColumn("__total", F.col("__total")).drop("__before")


def epsilon(df: DataFrame, method: str, alpha: float = 0.1, decay: float = 0.97, by: Sequence[str] = (), time: str = "ds", tie: str = "unique_id", value: str = "abs_err") -> DataFrame:
    """by, eps: the half width that covers 1 - alpha of the errors. icp: the value at rank
    ceil((n + 1) (1 - alpha)), at most n; wcp_linear and wcp_exp: the quantile under weights
    that grow with the place in time, by 1 and by 1 / decay a row."""
    level = 1 - alpha
    if method == "icp":
        rank = lambda n: F.least(F.greatest(F.ceil(F.least(F.lit(1.0), F.ceil((n + 1) * level) / n) * n), F.lit(1)), n)
        return smallest_reaching(df, by, value, F.lit(1), rank).drop("target")
    placed = positions(df.where(F.col(value).isNotNull()), by, time, tie)
    weight = F.col("position").cast("double") if method == "wcp_linear" else F.pow(F.lit(float(decay)), F.col("__total") - F.col("position"))
    return smallest_reaching(placed, by, value, weight, lambda total: (level - 1e-12) * total).drop("target")


def profile(df: DataFrame, horizon: int, method: str = "wcp_exp", alpha: float = 0.1, decay: float = 0.97, per_horizon: bool = True, least: int = 30, step: str = "h_step", **names: str) -> DataFrame:
    """h_step (1 to ``horizon``), cp_eps, cp_source, samples, global_eps, global_samples,
    cp_alpha, cp_method: the step's own half width, or that of all errors (global_fallback)
    where the step has fewer than ``least``."""
    method = method_of(method)
    known = df.where(F.col("abs_err").isNotNull())
    whole = epsilon(known, method, alpha, decay, (), **names).select(F.col("eps").alias("global_eps")).crossJoin(known.agg(F.count("*").alias("global_samples")))
    counts = known.groupBy(step).agg(F.count("*").alias("samples"))
    steps = df.sparkSession.range(1, horizon + 1).select(F.col("id").cast("int").alias(step))
    out = steps.join(F.broadcast(counts), step, "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    out = out.join(F.broadcast(epsilon(known, method, alpha, decay, [step], **names)), step, "left").crossJoin(F.broadcast(whole))
    own = (F.col("samples") >= least) & F.lit(per_horizon)
    return out.select(step, F.when(own, F.col("eps")).otherwise(F.col("global_eps")).alias("cp_eps"), F.when(own, "per_horizon").otherwise("global_fallback").alias("cp_source"), "samples", "global_eps", "global_samples", F.lit(float(alpha)).alias("cp_alpha"), F.lit(method).alias("cp_method"))


def apply(forecast: DataFrame, profile: DataFrame, horizon: int, key: str = "unique_id", time: str = "ds") -> DataFrame:
    """Adds h_step (place in the series, at most ``horizon``), cp_eps, cp_source, cp_lo, cp_hi,
    cp_alpha and cp_method. The profile has one row for each step."""
    if "y_hat" not in forecast.columns:
        raise ValueError("intervals need a column y_hat")
    at = F.least(F.row_number().over(Window.partitionBy(key).orderBy(time)), F.lit(horizon)).cast("int")
    rows = forecast.drop("h_step", "cp_eps", "cp_source", "cp_lo", "cp_hi", "cp_alpha", "cp_method").withColumn("h_step", at)
    made = rows.join(F.broadcast(profile.select("h_step", "cp_eps", "cp_source", "cp_alpha", "cp_method")), "h_step", "left")
    return made.withColumns({"cp_lo": F.col("y_hat") - F.col("cp_eps"), "cp_hi": F.col("y_hat") + F.col("cp_eps")})


def interval_columns(columns: Sequence[str]) -> tuple[str, str, float | None, str] | None:
    """(low, high, level, source) of a forecast's columns: cp_lo and cp_hi (level None: 1 -
    cp_alpha), else the quantile columns q_* nearest below and above 0.5; None without both."""
    if "cp_lo" in columns and "cp_hi" in columns:
        return "cp_lo", "cp_hi", None, "conformal"
    levels = {}
    for c in columns:
        if c.startswith("q_"):
            try:
                levels[float(c[2:])] = c
            except ValueError:
                continue
    below, above = [q for q in levels if q < 0.5], [q for q in levels if q > 0.5]
    if not below or not above:
        return None
    low, high = max(below), min(above)
    return levels[low], levels[high], min(max(high - low, 0.0), 1.0), "quantile"


def intervals(df: DataFrame) -> DataFrame:
    """Adds low, high, level and interval_source by the forecast's own columns; nulls where it
    has none."""
    found = interval_columns(df.columns)
    if found is None:
        return df.select("*", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0.9).alias("level"), F.lit(None).cast("string").alias("interval_source"))
    low, high, level, source = found
    if level is not None:
        nominal = F.lit(level)
    else:
        nominal = F.coalesce(1 - F.col("cp_alpha"), F.lit(0.9)) if "cp_alpha" in df.columns else F.lit(0.9)
    return df.select("*", F.col(f"`{low}`").alias("low"), F.col(f"`{high}`").alias("high"), nominal.alias("level"), F.lit(source).alias("interval_source"))


def merge_forecast(forecast: DataFrame, actual: DataFrame, key: str = "unique_id", time: str = "ds") -> DataFrame:
    """Actuals (key, time, y and time_idx where there is one) with the forecast's y_hat,
    q_* and cp_* columns; raises if they have no row in common."""
    kept = [key, time, "y_hat", *(c for c in forecast.columns if c.startswith(("q_", "cp_")))]
    facts = [key, time, "y", *(["time_idx"] if "time_idx" in actual.columns else [])]
    merged = actual.select(*facts).join(forecast.select(*(F.col(f"`{c}`") for c in dict.fromkeys(kept))), [key, time])
    if merged.isEmpty():
        raise ValueError("forecast and actuals have no row in common")
    return merged
