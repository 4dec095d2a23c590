"""Errors of a forecast in a reservoir engineer's terms, one row for each series.

Every function takes rows of series (key, time index t) and sums over them; windows are by
series. What a series is too short or too flat for is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvion.operators import lags

EPS = 1e-9


def _percent(part: Column, whole: Column) -> Column:
    return 100 * F.try_divide(part, whole + EPS)


def decline(df: DataFrame, key: str, t: str = "t", y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Errors of the peak, of its time, of the exponential decline after it (by a line
    through the logarithms of more than three positive rows), of the total, and of the rows at
    0.9 of the peak and above."""
    whole = Window.partitionBy(key)
    tops = df.withColumns({"__py": F.max(y).over(whole), "__ph": F.max(y_hat).over(whole)})
    at = lambda c, top: F.min(F.when(F.col(c) == F.col(top), F.col(t))).over(whole)
    placed = tops.withColumns({"__ty": at(y, "__py"), "__th": at(y_hat, "__ph"), "__end": F.max(t).over(whole)})
    after = {n: (F.col(t) >= F.col(start)) & (F.col(c) > EPS) for n, c, start in (("y", y, "__ty"), ("h", y_hat, "__th"))}
    # Slopes near 0 are differences of large products: both sides are taken from their means first.
    logs = placed.withColumns({f"__l{n}": F.when(after[n], F.log(F.col(c) + EPS)) for n, c in (("y", y), ("h", y_hat))})
    less = lambda c, n: c - F.avg(F.when(after[n], c)).over(whole)
    centred = logs.withColumns({f"__{a}{n}": less(c, n) for n in "yh" for a, c in (("d", F.col(t).cast("double")), ("r", F.col(f"__l{n}")))})
    line = lambda n: F.try_divide(F.sum(F.when(after[n], F.col(f"__d{n}") * F.col(f"__r{n}"))), F.sum(F.when(after[n], F.col(f"__d{n}") ** 2)))
    count = lambda n: F.sum(after[n].cast("int"))
    plateau = lambda c, top: F.sum((F.col(c) >= 0.9 * F.col(top)).cast("int"))
    g = centred.groupBy(key).agg(F.max("__py").alias("py"), F.max("__ph").alias("ph"), F.max("__ty").alias("ty"), F.max("__th").alias("th"), F.max("__end").alias("end"), line("y").alias("sy"), line("h").alias("sh"), count("y").alias("ny"), count("h").alias("nh"), F.sum(y).alias("cy"), F.sum(y_hat).alias("ch"), plateau(y, "__py").alias("plateau_duration_true"), plateau(y_hat, "__ph").alias("plateau_duration_pred"))
    fits = (F.col("ny") > 3) & (F.col("nh") > 3) & (F.col("ty") < F.col("end")) & (F.col("th") < F.col("end"))
    return g.select(
        key,
        _percent(F.abs(F.col("ph") - F.col("py")), F.col("py")).alias("peak_production_error_pct"),
        F.abs(F.col("th") - F.col("ty")).cast("long").alias("peak_time_error_months"),
        F.when(fits, -F.col("sy")).alias("decline_rate_true"),
        F.when(fits, -F.col("sh")).alias("decline_rate_pred"),
        F.when(fits, _percent(F.abs(F.col("sy") - F.col("sh")), -F.col("sy"))).alias("decline_rate_error_pct"),
        _percent(F.abs(F.col("ch") - F.col("cy")), F.col("cy")).alias("cumulative_error_pct"),
        "plateau_duration_true",
        "plateau_duration_pred",
        F.abs(F.col("plateau_duration_pred") - F.col("plateau_duration_true")).alias("plateau_duration_error"),
    )


def _gradient(column: str, w) -> Column:
    """Half the change over both neighbours; at the ends the whole change to the one."""
    before, after = F.lag(column).over(w), F.lead(column).over(w)
    return F.when(before.isNull(), after - F.col(column)).when(after.isNull(), F.col(column) - before).otherwise((after - before) / 2)


def pressure(df: DataFrame, key: str, t: str = "t", p: str = "p", p_hat: str = "p_hat", rate: str = "y", reservoir: float = 200.0) -> DataFrame:
    """Errors of the drawdown, of the productivity index against a reservoir pressure, and of
    the pressure's gradient."""
    w = Window.partitionBy(key).orderBy(t)
    index = lambda c: F.col(rate) / F.greatest(reservoir - F.col(c), F.lit(1.0))
    steps = df.withColumns({"__g": _gradient(p_hat, w) - _gradient(p, w), "__pi": F.abs(index(p_hat) - index(p))})
    fall = lambda c: F.min_by(c, t) - F.max_by(c, t)
    g = steps.groupBy(key).agg(fall(p).alias("dt"), fall(p_hat).alias("dp"), F.avg("__pi").alias("productivity_index_mae"), F.sqrt(F.avg(F.col("__g") ** 2)).alias("pressure_gradient_rmse"))
    off = F.abs(F.col("dp") - F.col("dt"))
    return g.select(key, off.alias("drawdown_error_bar"), _percent(off, F.col("dt")).alias("drawdown_error_pct"), "productivity_index_mae", "pressure_gradient_rmse")


def injection(df: DataFrame, key: str, t: str = "t", y: str = "y", y_hat: str = "y_hat", x: str = "x", least: int = 11) -> DataFrame:
    """Voidage replacement, production gained for injection added, and the lag of the largest
    cross-correlation (first of equals), of truth and forecast. The lags come from one
    transform of each series; a series is one array of the same grouping."""
    w = Window.partitionBy(key).orderBy(t)
    change = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.col(c))
    d = df.withColumns({"__dy": change(y), "__dh": change(y_hat), "__dx": change(x)})
    gain = lambda c: F.when(F.stddev_pop("__dx") > EPS, F.try_divide(F.covar_samp(c, "__dx"), F.var_pop("__dx") + EPS))
    g = d.groupBy(key).agg(F.try_divide(F.sum(x), F.sum(y) + EPS).alias("vrr_true"), F.try_divide(F.sum(x), F.sum(y_hat) + EPS).alias("vrr_pred"), gain("__dy").alias("injection_efficiency_true"), gain("__dh").alias("injection_efficiency_pred"), F.count("*").alias("__n"), F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), *(F.col(c).cast("double").alias(n) for n, c in (("y", y), ("h", y_hat), ("x", x)))))).alias("__s"))

    @F.pandas_udf("response_lag_true long, response_lag_pred long")
    def lagged(series: pd.Series) -> pd.DataFrame:
        made = [np.array([[p["y"], p["h"], p["x"]] for p in s], float) for s in series]
        return pd.DataFrame([(lags.response_lag(v[:, 0], v[:, 2]), lags.response_lag(v[:, 1], v[:, 2])) for v in made], columns=["response_lag_true", "response_lag_pred"])

    out = g.select("*", lagged(F.transform("__s", lambda p: p.dropFields("t"))).alias("__l")).select("*", "__l.*").drop("__l", "__s")
    long_enough = F.col("__n") >= least
    lag = lambda c: F.when(long_enough, F.col(c))
    error = lambda c: F.abs(F.col(f"{c}_pred") - F.col(f"{c}_true"))
    out = out.withColumns({c: lag(c) for c in ("response_lag_true", "response_lag_pred")})
    return out.select(key, *(c for n in ("vrr", "injection_efficiency", "response_lag") for c in (f"{n}_true", f"{n}_pred", error(n).alias(f"{n}_error"))))


def waterflood(df: DataFrame, key: str, t: str = "t", oil: str = "oil", oil_hat: str = "oil_hat", cut: str = "cut", cut_hat: str = "cut_hat", threshold: float = 0.5, early: int = 5) -> DataFrame:
    """Errors of the row of water breakthrough, of the water cut, of recovery against a
    hundred times the mean of the first rows, and the mean gradients of the water cut."""
    w, whole = Window.partitionBy(key).orderBy(t), Window.partitionBy(key)
    d = df.withColumns({"__k": F.row_number().over(w) - 1, "__gt": _gradient(cut, w), "__gp": _gradient(cut_hat, w), "__n": F.count("*").over(whole)})
    first = lambda c: F.min(F.when(F.col(c) >= threshold, F.col("__k")))
    off = F.col(cut_hat) - F.col(cut)
    g = d.groupBy(key).agg(first(cut).alias("bt"), first(cut_hat).alias("bp"), F.avg(F.abs(off)).alias("water_cut_mae"), F.sqrt(F.avg(off * off)).alias("water_cut_rmse"), F.avg(F.when((F.col("__k") < early) & (F.col("__n") > early), F.col(oil))).alias("__e"), F.sum(oil).alias("__ot"), F.sum(oil_hat).alias("__op"), F.avg("__gt").alias("water_cut_gradient_true"), F.avg("__gp").alias("water_cut_gradient_pred"))
    both = F.col("bt").isNotNull() & F.col("bp").isNotNull()
    place = F.col("__e") * 100 + EPS
    rt, rp = F.col("__ot") / place, F.col("__op") / place
    return g.select(key, F.when(both, F.col("bt")).cast("long").alias("breakthrough_time_true"), F.when(both, F.col("bp")).cast("long").alias("breakthrough_time_pred"), F.abs(F.col("bp") - F.col("bt")).cast("long").alias("breakthrough_time_error"), "water_cut_mae", "water_cut_rmse", rt.alias("recovery_factor_true"), rp.alias("recovery_factor_pred"), F.abs(rp - rt).alias("recovery_factor_error"), "water_cut_gradient_true", "water_cut_gradient_pred")


def reliability(df: DataFrame, key: str, t: str = "t", y: str = "y", y_hat: str = "y_hat", low: str | None = None, high: str | None = None, level: float = 0.9) -> DataFrame:
    """Share of steps with the right sign, skill over the value before, and with intervals
    their coverage, its distance from the level, mean width, and width over the range."""
    w = Window.partitionBy(key).orderBy(t)
    before = F.coalesce(F.lag(y).over(w), F.col(y))
    sign = lambda c: F.signum(F.col(c) - F.coalesce(F.lag(c).over(w), F.col(c)))
    d = df.withColumns({"__s": (sign(y) == sign(y_hat)).cast("double"), "__p": (F.col(y) - before) ** 2})
    many = F.count("*") > 1
    made = [F.when(many, F.avg("__s")).alias("direction_accuracy"), F.when(many, 1 - F.try_divide(F.avg((F.col(y) - F.col(y_hat)) ** 2), F.avg("__p") + EPS)).alias("forecast_skill_vs_persistence")]
    if low and high:
        inside = F.avg(F.when((F.col(y) >= F.col(low)) & (F.col(y) <= F.col(high)), 1.0).otherwise(0.0))
        width = F.avg(F.col(high) - F.col(low))
        made += [inside.alias("picp"), F.abs(inside - level).alias("picp_deviation_from_target"), width.alias("mpiw"), F.try_divide(width, F.max(y) - F.min(y) + EPS).alias("interval_sharpness")]
    return d.groupBy(key).agg(*made)


def collection(df: DataFrame, key: str, t: str = "t", low: str | None = None, high: str | None = None, threshold: float = 0.5) -> DataFrame:
    """All of them that the columns allow (p and p_hat; x; cut and cut_hat), named by part:
    decline_*, pressure_*, injection_*, waterflood_*, reliability_*. Oil rates are the rates
    less their water."""
    has = lambda *c: all(x in df.columns for x in c)
    parts = {"decline": decline(df, key, t)}
    if has("p", "p_hat"):
        parts["pressure"] = pressure(df, key, t)
    if has("x"):
        parts["injection"] = injection(df, key, t)
    if has("cut", "cut_hat"):
        oils = df.withColumns({"__oil": F.col("y") * (1 - F.col("cut")), "__oil_hat": F.col("y_hat") * (1 - F.col("cut_hat"))})
        parts["waterflood"] = waterflood(oils, key, t, "__oil", "__oil_hat", threshold=threshold)
    parts["reliability"] = reliability(df, key, t, low=low, high=high)
    out = None
    for name, part in parts.items():
        part = part.select(key, *(F.col(c).alias(f"{name}_{c}") for c in part.columns if c != key))
        out = part if out is None else out.join(part, key)
    return out
