"""Features of single series: windows, differences, filters, decline, imputation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvion.operators.panel import upto


def _order(key: str, time: str):
    return Window.partitionBy(key).orderBy(time)


def _all(key: str):
    return Window.partitionBy(key)


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Product and ratio of column pairs; ratios that don't exist are 0."""
    out = {}
    for a, b in pairs:
        out[f"{a}_x_{b}"] = F.col(a) * F.col(b)
        out[f"{a}_div_{b}"] = F.coalesce(F.try_divide(F.col(a), F.col(b) + 1e-6), F.lit(0.0))
    return df.withColumns(out)


def fourier(df: DataFrame, time: str, count: int, by: Sequence[str] = ()) -> DataFrame:
    """Sines and cosines of the time since the first row, as a share of the whole span, of all
    rows or of each group of ``by``, of which there are few."""
    span = df.groupBy(*by).agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    t = F.datediff(time, "__a") / F.greatest(F.datediff("__b", "__a"), F.lit(1))
    wide = df.join(F.broadcast(span), list(by)) if by else df.crossJoin(F.broadcast(span))
    out = {}
    for k in range(1, count + 1):
        angle = 2 * F.lit(3.141592653589793) * k * t
        out |= {f"fourier_sin_{k}": F.sin(angle), f"fourier_cos_{k}": F.cos(angle)}
    return wide.withColumns(out).drop("__a", "__b")


def spatial(df: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """Coordinates, depth, distance to the centroid and the quadrant around it. Keys
    without a place stand on the origin with quadrant 0."""
    centre = places.agg(F.avg("x").alias("__cx"), F.avg("y").alias("__cy"), F.avg("z").alias("__cz"))
    placed = places.crossJoin(F.broadcast(centre))
    d = F.sqrt((F.col("x") - F.col("__cx")) ** 2 + (F.col("y") - F.col("__cy")) ** 2 + (F.col("z") - F.col("__cz")) ** 2)
    east, north = F.col("x") >= F.col("__cx"), F.col("y") >= F.col("__cy")
    quadrant = F.when(east & north, 0).when(~east & north, 1).when(~east & ~north, 2).otherwise(3)
    places = placed.select(key, "x", "y", "z", d.alias("d"), quadrant.alias("q"))
    joined = df.join(places, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    q = F.coalesce(F.col("q"), F.lit(0))
    flags = {f"quadrant_{k}": (q == k).cast("int") for k in range(4)}
    return joined.withColumns({"coord_x": zero("x"), "coord_y": zero("y"), "coord_z": zero("z"), "depth": F.abs(zero("z")), "center_distance": zero("d"), **flags}).drop("x", "y", "z", "d", "q")


def productivity_index(df: DataFrame, key: str, time: str, rate: str, pressure: str, cutoff) -> DataFrame:
    """Rate over drawdown from the 95th percentile of the key's pressures up to a date."""
    known = F.when(upto(time, cutoff, key) & (F.col(pressure) > 0), F.col(pressure))
    ref = df.groupBy(key).agg(F.percentile(known, 0.95).alias("__ref"))
    drop = F.greatest(F.col("__ref") - F.col(pressure), F.lit(1.0))
    j = F.when(F.col("__ref").isNotNull() & F.col(pressure).isNotNull(), F.col(rate) / drop)
    return df.join(ref, key, "left").withColumn("productivity_index", F.coalesce(j, F.lit(0.0))).drop("__ref")


def pressure_features(df: DataFrame, key: str, time: str, rate: str, pressure: str, reservoir: float = 200.0) -> DataFrame:
    """Gradient (central, one-sided at the ends), rate over drawdown, and product."""
    w = _order(key, time)
    before, after = F.lag(pressure).over(w), F.lead(pressure).over(w)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    gradient = F.when(first & last, 0.0).when(first, after - F.col(pressure)).when(last, F.col(pressure) - before).otherwise((after - before) / 2)
    return df.withColumns({"pressure_gradient": gradient, "rate_per_drawdown": F.col(rate) / F.greatest(F.lit(reservoir) - F.col(pressure), F.lit(1.0)), "pressure_x_rate": F.col(pressure) * F.col(rate)})


def structural_breaks(df: DataFrame, key: str, time: str, rate: str, threshold: float = 0.7, least: float = 0.0) -> DataFrame:
    before = F.lag(rate).over(_order(key, time))
    down = (before - F.col(rate)) / F.greatest(before, F.lit(1e-6)) > threshold
    up = (before < least + 1) & (F.col(rate) > before)
    return df.withColumns({"is_shutdown": F.coalesce(down, F.lit(False)), "is_startup": F.coalesce(up, F.lit(False))})


def rolling_stats(df: DataFrame, key: str, time: str, column: str, windows: Sequence[int] = (3, 6, 12)) -> DataFrame:
    """Mean, sample deviation, least and most over the last rows; null for a series
    shorter than the window."""
    out, long = {}, F.count("*").over(_all(key))
    for n in windows:
        w = _order(key, time).rowsBetween(1 - n, 0)
        ok = long >= n
        out |= {
            f"{column}_ma{n}": F.when(ok, F.avg(column).over(w)),
            f"{column}_std{n}": F.when(ok, F.coalesce(F.stddev_samp(column).over(w), F.lit(0.0))),
            f"{column}_min{n}": F.when(ok, F.min(column).over(w)),
            f"{column}_max{n}": F.when(ok, F.max(column).over(w)),
        }
    return df.withColumns(out)


def first_difference(df: DataFrame, key: str, time: str, column: str) -> DataFrame:
    """Difference to the row before; 0 for the first."""
    return df.withColumn(f"{column}_diff", F.col(column) - F.coalesce(F.lag(column).over(_order(key, time)), F.col(column)))


def decline(df: DataFrame, key: str, time: str, rate: str, cumulative: str) -> DataFrame:
    """Peak, rows since the first peak, decline constant, and the share of the total."""
    w, whole = _order(key, time), _all(key)
    indexed = df.withColumn("__t", F.row_number().over(w) - 1).withColumn("peak_rate", F.max(rate).over(whole))
    peak_at = F.min(F.when(F.col(rate) == F.col("peak_rate"), F.col("__t"))).over(whole)
    share = F.try_divide(F.col(rate), F.col("peak_rate"))
    ratio = F.when(share < 1e-6, 1e-6).when(share > 1, 1.0).otherwise(share)
    total = F.last(cumulative).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = indexed.withColumn("time_since_peak", F.col("__t") - peak_at)
    return out.withColumns({"decline_rate": -F.log(ratio) / F.greatest(F.col("time_since_peak"), F.lit(1)), "cum_share": F.col(cumulative) / (total + 1e-6)}).drop("__t")


def production_stage(df: DataFrame, key: str, time: str, rate: str) -> DataFrame:
    """0 plateau, 1 build-up, 2 decline, from the change of a centred mean against half its
    deviation. The mean is over five rows, or a third of a series under fifteen; with an even
    number of rows it reaches one further back. 0 for series under five rows."""
    w = _order(key, time)
    mean = lambda size: F.avg(rate).over(w.rowsBetween(-(size // 2), (size - 1) // 2))
    smooth = df.withColumns({"__n": F.count("*").over(_all(key)), "__at": F.row_number().over(w)})
    size = F.least(F.lit(5), F.floor(F.col("__n") / 3))
    smooth = smooth.withColumn("__size", size).withColumn("__m", F.when(F.col("__size") == 5, mean(5)).when(F.col("__size") == 4, mean(4)).when(F.col("__size") == 3, mean(3)).when(F.col("__size") == 2, mean(2)).otherwise(F.col(rate)))
    # Rows whose window is not full take the nearest full one's mean.
    inside = (F.col("__at") > F.floor(F.col("__size") / 2)) & (F.col("__at") <= F.col("__n") - F.floor((F.col("__size") - 1) / 2))
    full = F.when(inside, F.col("__m"))
    smooth = smooth.withColumn("__m", F.coalesce(F.last(full, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(full, True).over(w.rowsBetween(0, Window.unboundedFollowing))))
    change = smooth.withColumn("__d", F.col("__m") - F.coalesce(F.lag("__m").over(w), F.col("__m")))
    spread = F.stddev_pop("__d").over(_all(key))
    stage = F.when(F.col("__n") < 5, 0).when(F.col("__d") > 0.5 * spread, 1).when(F.col("__d") < -0.5 * spread, 2).otherwise(0)
    return change.withColumn("stage", stage).drop("__n", "__at", "__m", "__d", "__size")


def savgol_weights(window: int, order: int) -> list[float]:
    """Weights of the least-squares polynomial's value at the middle of the window."""
    at = np.arange(window) - window // 2
    return np.linalg.pinv(np.vander(at, order + 1, increasing=True))[0].tolist()


def savgol(df: DataFrame, key: str, time: str, column: str, window: int = 7, order: int = 2) -> DataFrame:
    """Savitzky-Golay smoothing; beyond the ends the end values repeat."""
    window += 1 - window % 2
    w, half = _order(key, time), window // 2
    first = F.first(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    total = None
    for k, weight in enumerate(savgol_weights(window, order)):
        shift = k - half
        value = F.coalesce(F.lag(column, -shift).over(w), first) if shift < 0 else F.coalesce(F.lead(column, shift).over(w), last)
        total = value * weight if total is None else total + value * weight
    return df.withColumn(f"{column}_smooth", total)


def bilateral(df: DataFrame, key: str, time: str, column: str, half: int = 7, sigma: float = 3.0) -> DataFrame:
    """Means weighted by nearness in time and in value; the scale of values is 1.4826
    times the median step between rows."""
    w = _order(key, time)
    stepped = df.withColumn("__step", F.abs(F.col(column) - F.lag(column).over(w)))
    scaled = stepped.withColumn("__s", F.greatest(1.4826 * F.median("__step").over(_all(key)), F.lit(1e-6)))
    near = None, None
    for k in range(-half, half + 1):
        value = F.lag(column, -k).over(w) if k < 0 else F.lead(column, k).over(w) if k else F.col(column)
        weight = F.exp(F.lit(-0.5 * (k / sigma) ** 2) - 0.5 * ((value - F.col(column)) / F.col("__s")) ** 2)
        terms = F.coalesce(weight * value, F.lit(0.0)), F.coalesce(weight, F.lit(0.0))
        near = terms if near[0] is None else (near[0] + terms[0], near[1] + terms[1])
    return scaled.withColumn(f"{column}_bilateral", near[0] / near[1]).drop("__step", "__s")


#: Rows that a recurrence takes at once; what a block leaves over goes to the next.
BLOCK = 64


def _recurrence(df: DataFrame, key: str, time: str, name: str, keep: Column, inflow: Column) -> DataFrame:
    """y(t) = keep y(t-1) + inflow(t), y of the first row its inflow. keep must not change
    within a series. A series is cut into blocks: within one, y is a sum of the block's inflows
    times powers of keep; blocks are joined by what each leaves over, in an array as long as a
    series has blocks. So no array holds a whole series, and no power vanishes."""
    w = _order(key, time)
    rows = df.withColumns({"__t": F.row_number().over(w) - 1, "__keep": keep, "__in": inflow})
    rows = rows.withColumns({"__b": F.floor(F.col("__t") / BLOCK), "__k": F.col("__t") % BLOCK})
    block = Window.partitionBy(key, "__b").orderBy("__t")
    # keep may be so small that its powers vanish within a block: terms are summed one by one.
    own = F.aggregate(F.collect_list("__in").over(block.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0), lambda acc, v: acc * F.col("__keep") + v)
    rows = rows.withColumn("__own", own)
    ends = rows.groupBy(key, "__b").agg(F.max_by("__own", "__t").alias("e"), F.max("__k").alias("k"), F.first("__keep").alias("__keep"))
    chain = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("__b").alias("b"), "e", "k"))).alias("s"), F.first("__keep").alias("__keep"))
    left = F.aggregate("s", F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) * F.pow(F.col("__keep"), x["k"] + 1) + x["e"])))
    before = chain.select(key, F.posexplode(left).alias("__b", "__left"))
    out = rows.join(before, [key, "__b"]).withColumn(name, F.col("__own") + F.col("__left") * F.pow(F.col("__keep"), F.col("__k") + 1))
    return out.select(*df.columns, name)


def crm_filter(df: DataFrame, key: str, time: str, column: str, tau: float | Column, step: float = 1.0, input_delay: int = 2) -> DataFrame:
    """Exponential filter y(t) = d y(t-1) + (1 - d) x(t - input_delay), d = exp(-step/tau),
    y(0) = x(0); indices below 0 count as 0. Keys and times must be unique; a ``tau`` by column
    must not change within a series."""
    w = _order(key, time)
    d = F.exp(-step / tau) if isinstance(tau, Column) else F.lit(float(np.exp(-step / tau)))
    first = F.first(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    delayed = F.coalesce(F.lag(column, input_delay).over(w), first)
    inflow = F.when(F.row_number().over(w) == 1, F.col(column)).otherwise((1 - d) * delayed)
    return _recurrence(df, key, time, f"{column}_crm", d, inflow)


def ema(df: DataFrame, key: str, time: str, column: str, smooth: float) -> DataFrame:
    """a(t) = (1 - s) a(t) + s a(t-1), from the first value on. Keys and times unique."""
    w = _order(key, time)
    inflow = F.when(F.row_number().over(w) == 1, F.col(column)).otherwise((1 - smooth) * F.col(column))
    return _recurrence(df, key, time, f"{column}_ema", F.lit(float(smooth)), inflow)


def windowed_matrix(df: DataFrame, key: str, time: str, column: str, lags: int = 12) -> DataFrame:
    """Rows with the ``lags`` values before them, oldest first, as an array; rows with
    fewer before them are left out."""
    w = _order(key, time)
    held = df.withColumn("__n", F.row_number().over(w)).withColumn(f"{column}_window", F.collect_list(column).over(w.rowsBetween(-lags, -1)))
    return held.where(F.col("__n") > lags).drop("__n")


def impute_linear_monotone(df: DataFrame, key: str, time: str, column: str) -> DataFrame:
    """Fill nulls of a cumulative series: linear in time between known rows, beyond the
    ends with the slope of the two outermost known rows, then a running maximum. With
    fewer than two known rows: last value, then 0."""
    w = _order(key, time)
    t = F.unix_timestamp(F.col(time).cast("timestamp")).cast("double")
    known = F.col(column).isNotNull()
    point = F.when(known, F.struct(t.alias("t"), F.col(column).alias("v")))
    upto, after, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.withColumns({"__t": t, "__p": F.last(point, True).over(upto), "__q": F.first(point, True).over(after), "__n": F.count(column).over(whole), "__r": F.count(column).over(upto)})
    # The two outermost known rows of each end, each on every row once.
    at = lambda k: F.first(F.when(known & (F.col("__r") == k), F.struct(F.col("__t").alias("t"), F.col(column).alias("v"))), True).over(whole)
    d = d.withColumns({"__a": at(1), "__b": at(2), "__y": at(F.col("__n") - 1), "__z": at(F.col("__n"))})
    line = lambda a, b: a["v"] + (F.col("__t") - a["t"]) * F.try_divide(b["v"] - a["v"], b["t"] - a["t"])
    col = F.col
    value = F.when(col("__p").isNull(), line(col("__a"), col("__b"))).when(col("__q").isNull(), line(col("__y"), col("__z"))).otherwise(line(col("__p"), col("__q")))
    filled = F.when(col("__n") < 2, F.coalesce(F.col("__p.v"), F.lit(0.0))).otherwise(F.coalesce(F.col(column), value))
    d = d.withColumn("__f", filled)
    return d.withColumn(f"{column}_filled", F.coalesce(F.col(column), F.max("__f").over(upto))).drop("__t", "__p", "__q", "__n", "__r", "__a", "__b", "__y", "__z", "__f")
