"""Numerics that Column expressions can't say: one series, pair or small graph at a time,
in numpy. Whoever calls them brings groups of bounded size (a series, a pair of series)."""

from __future__ import annotations

import math
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvion.operators import splines
from fluvion.operators.panel import upto
from fluvion.sources.lineage import cut


def _grouped(df: DataFrame, keys: list[str], columns: list[str], order: list[str], fn, schema: str) -> DataFrame:
    """``fn`` over each group's columns (sorted); it returns a dict of output columns."""
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        made = fn(*(frame[c].to_numpy() for c in columns))
        made = {k: np.atleast_1d(v) for k, v in made.items()}
        n = len(next(iter(made.values())))
        return pd.DataFrame({**{k: [v] * n for k, v in zip(keys, key)}, **made})

    return df.select(*dict.fromkeys([*keys, *order, *columns])).groupBy(*keys).applyInPandas(run, schema)


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Nearest-neighbour estimate of mutual information over ln(n + 1), 0 to 1; NaN for
    fewer than eight rows. Equal values are parted by 1e-10 times the parts behind the point
    of multiples of an irrational number, one for x and one for y."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y, n = x[ok], y[ok], int(ok.sum())
    if n < 8:
        return float("nan")
    scaled = []
    for v, irrational in ((x, 0.6180339887498949), (y, 0.41421356237309515)):
        v = v / (v.std() or 1.0)
        scaled.append(v + 1e-10 * max(1.0, np.abs(v).mean()) * (np.arange(1, n + 1) * irrational % 1.0))
    radius = np.nextafter(kth_distance(*scaled, k), 0)
    near = [within(v, radius) for v in scaled]  # itself included
    value = _digamma(np.array([n])) + _digamma(np.array([k])) - np.mean(_digamma(near[0])) - np.mean(_digamma(near[1]))
    return float(np.clip(max(value[0], 0.0) / np.log(n + 1), 0, 1))


def kth_distance(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The distance of each point to its k-th nearest other one, by the larger of both differences. Points are sorted by x and look
    ever farther to both sides, until what lies there is farther in x alone; few do for long."""
    n, order = len(x), np.argsort(x, kind="stable")
    u, v = x[order], y[order]
    nearest, left, step = np.full((n, k), np.inf), np.arange(n), 1
    while len(left) and step < n:
        far = np.full(len(left), np.inf)  # how near in x anything unseen can be
        for side in (-step, step):
            other = left + side
            ok = (other >= 0) & (other < n)
            a, b = left[ok], other[ok]
            gap = np.abs(u[a] - u[b])
            far[ok] = np.minimum(far[ok], gap)
            d = np.maximum(gap, np.abs(v[a] - v[b]))
            closer = d < nearest[a, -1]
            a, d = a[closer], d[closer]
            nearest[a, -1] = d
            nearest[a] = np.sort(nearest[a], axis=1)
        left, step = left[far < nearest[left, -1]], step + 1
    out = np.empty(n)
    out[order] = nearest[:, -1]
    return out


def within(v: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many values lie within each one's radius, itself included, by search in order. Sums round, so
    both ends are set by differences."""
    order = np.argsort(v, kind="stable")
    s, n = v[order], len(v)
    low, high = np.searchsorted(s, v - radius, "left"), np.searchsorted(s, v + radius, "right")  # [low, high)
    while True:
        inside = lambda at: (at >= 0) & (at < n) & (np.abs(s[np.clip(at, 0, n - 1)] - v) <= radius)
        wider, narrower = inside(low - 1), ~inside(low) & (low < high)
        more, less = inside(high), ~inside(high - 1) & (low < high)
        if not (wider.any() or narrower.any() or more.any() or less.any()):
            return high - low
        low = low - wider + (narrower & ~wider)
        high = high + more - (less & ~more)


def _digamma(n: np.ndarray) -> np.ndarray:
    """Of positive whole numbers: harmonic numbers less Euler's constant."""
    n = np.asarray(n, int)
    sums = np.concatenate(([0.0], np.cumsum(1.0 / np.arange(1, max(int(n.max()), 1)))))
    return sums[n - 1] - 0.5772156649015329


def spectral_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """(r + 1) / 2 of the logarithms of both power spectra, each a mean over half-overlapping
    Hann windows of up to 32 rows without their mean; NaN for fewer than 16 rows."""
    n = len(x)
    if n < 16:
        return float("nan")
    length = min(32, n)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    spectra = []
    for v in (x, y):
        parts = [v[a : a + length] for a in range(0, n - length + 1, length // 2)]
        power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * window)) ** 2 for p in parts], axis=0)
        spectra.append(np.log(power + 1e-12))
    a, b = (s - s.mean() for s in spectra)
    norm = np.sqrt((a @ a) * (b @ b))
    return float((a @ b / norm + 1) / 2) if norm > 1e-12 else 0.5


#: Points of the longest series whose differences are taken each with each, and differences that are held at once.
SQUARE, HELD = 512, 1 << 17


def information_of(pairs: list[tuple[np.ndarray, np.ndarray]], k: int = 3) -> np.ndarray:
    """``mutual_information`` of every pair. Pairs of equal length are taken together, with all differences between their
    points; a series too long for that goes by itself."""
    out, of = np.full(len(pairs), np.nan), {}
    for at, (x, y) in enumerate(pairs):
        ok = np.isfinite(x) & np.isfinite(y)
        n = int(ok.sum())
        if n > max(SQUARE, k):
            out[at] = mutual_information(x, y, k)
        elif n >= 8 and n > k:
            of.setdefault(n, []).append((at, x[ok], y[ok]))
        elif n >= 8:
            out[at] = mutual_information(x, y, k)
    for n, same in of.items():
        step = max(1, HELD // (n * n))
        for a in range(0, len(same), step):
            at, *both = zip(*same[a : a + step])
            gaps = []
            for v, irrational in zip(both, (0.6180339887498949, 0.41421356237309515)):
                v = np.array(v, float)
                size = v.std(1, keepdims=True)
                v = v / np.where(size == 0, 1.0, size)
                v = v + 1e-10 * np.maximum(1.0, np.abs(v).mean(1, keepdims=True)) * (np.arange(1, n + 1) * irrational % 1.0)
                gap = v[:, :, None] - v[:, None, :]
                gaps.append(np.abs(gap, out=gap))
            far = np.maximum(*gaps)
            far[:, np.arange(n), np.arange(n)] = np.inf
            far.partition(k - 1, axis=2)
            radius = np.nextafter(far[:, :, k - 1], 0)[:, :, None]
            near = [_digamma((gap <= radius).sum(2)).mean(1) for gap in gaps]  # itself included
            value = _digamma(np.array([n])) + _digamma(np.array([k])) - near[0] - near[1]
            out[list(at)] = np.clip(np.maximum(value, 0.0) / np.log(n + 1), 0, 1)
    return out


def left_by_line(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a line in z leaves of x and of y; nothing of fewer than eight rows."""
    ok = np.isfinite(x) & np.isfinite(y) & np.isfinite(z)
    x, y, z = x[ok], y[ok], z[ok]
    if len(z) < 8:
        return x[:0], y[:0]
    d = np.column_stack([np.ones(len(z)), z])
    return tuple(v - d @ np.linalg.lstsq(d, v, rcond=None)[0] for v in (x, y))


def conditional_information(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> float:
    """Mutual information of what a line in z leaves of x and of y."""
    return mutual_information(*left_by_line(x, y, z))


def pair_statistics(rows: DataFrame, parts: tuple[str, ...] = ("mi", "psd_corr", "cmi")) -> DataFrame:
    """prod_id, inj_id and those of mi, psd_corr, cmi that are asked for. rows: prod_id,
    inj_id, ds, y, x, and c, the condition; without c it is y one row before. A group is one
    pair's rows; a batch of pairs is taken together (``information_of``)."""
    given = "c" in rows.columns
    condition = lambda y, c: c if given else np.concatenate(([np.nan], y[:-1]))
    made = {
        "mi": lambda each: information_of([(x, y) for y, x, _ in each]),
        "psd_corr": lambda each: np.array([spectral_correlation(x, y) for y, x, _ in each], float),
        "cmi": lambda each: information_of([left_by_line(x, y, condition(y, c)) for y, x, c in each]),
    }

    # Packed numbers: a row of Python objects for each month would take thirty times their memory.
    @F.pandas_udf(", ".join(f"{n} double" for n in parts))
    def found(y: pd.Series, x: pd.Series, c: pd.Series) -> pd.DataFrame:
        each = [tuple(np.asarray(v, float) for v in row) for row in zip(y, x, c)]
        return pd.DataFrame({n: made[n](each) for n in parts})

    point = F.struct("ds", *(F.col(n).cast("double").alias(n) for n in ("y", "x")), (F.col("c") if given else F.lit(None)).cast("double").alias("c"))
    series = rows.groupBy("prod_id", "inj_id").agg(F.array_sort(F.collect_list(point)).alias("s"))
    made_ = series.select("prod_id", "inj_id", found("s.y", "s.x", "s.c").alias("f"))
    return made_.select("prod_id", "inj_id", "f.*")


def information_by(rows: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """keys (strings), mi: ``mutual_information`` of y and x over each group's rows, by ds."""
    return _grouped(rows, keys, ["y", "x"], ["ds"], lambda y, x: {"mi": mutual_information(x.astype(float), y.astype(float), k)}, ", ".join(f"{c} string" for c in keys) + ", mi double")


def cubic_fill(t: np.ndarray, v: np.ndarray, least: float = 0.0, smooth: float = 0.01) -> np.ndarray:
    """Missing values from the natural cubic spline that bends least while it leaves squared residuals of
    ``smooth`` for each known value (0: through them), at least ``least``; beyond the ends its end slopes
    go on. Fewer than four known: the last value before, then 0. Linear in the series' length."""
    known = np.isfinite(v)
    out = v.astype(float).copy()
    if known.all():
        return out
    if known.sum() < 4:
        last = 0.0
        for i in range(len(out)):
            last = out[i] if known[i] else last
            out[i] = last
        return out
    x, y = t[known].astype(float), out[known]
    f, g = splines.fit(x, y, smooth * len(x))
    out[~known] = np.maximum(splines.value(x, f, g, t[~known].astype(float)), least)
    return out


def impute_spline(df: DataFrame, key: str, time: str, column: str, least: float = 0.0, smooth: float = 0.01) -> DataFrame:
    """key, time, the column with what is missing filled (see cubic_fill), series by series."""
    days = df.withColumn("__t", F.unix_date(F.col(time).cast("date")).cast("double"))
    return _grouped(days.select(key, time, "__t", column), [key], [time, "__t", column], [time], lambda at, t, v: {time: at, f"{column}_filled": cubic_fill(t, v.astype(float), least, smooth)}, f"{key} string, {time} date, {column}_filled double")


def robust_outliers(x: np.ndarray, share: float = 0.05, tries: int = 30, seed: int = 0) -> np.ndarray:
    """Flags of the ``share`` of rows that lie farthest from the half of the rows whose
    covariance has the smallest determinant, found by concentration steps."""
    n, p = x.shape
    rng = np.random.default_rng(seed)
    keep = (n + p + 1) // 2

    def distances(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of ``rows`` the distances of all and the logarithm of the determinant."""
        some = x[rows]
        mean = some.mean(1)
        off = some - mean[:, None]
        c = off.transpose(0, 2, 1) @ off / (rows.shape[1] - 1) + 1e-9 * np.eye(p)
        d = x - mean[:, None]
        return ((d @ np.linalg.inv(c)) * d).sum(2), np.linalg.slogdet(c)[1]

    # All tries take their steps together; those that don't move any more are left out.
    rows = np.array([rng.choice(n, p + 1, replace=False) for _ in range(tries)])
    left, kept = np.arange(tries), np.zeros((tries, keep), int)
    for step in range(20):
        d = distances(rows)[0]
        after = np.sort(np.argsort(d, axis=1, kind="stable")[:, :keep], axis=1)
        moved = np.full(len(left), True) if after.shape != rows.shape else (after != rows).any(1)
        kept[left] = after
        left, rows = left[moved], after[moved]
        if not len(left):
            break
    chosen = kept[distances(kept)[1].argmin()]
    d = distances(chosen[None])[0][0]
    return d > np.quantile(d, 1 - share)


def outlier_flags(df: DataFrame, key: str, time: str, columns: list[str], share: float = 0.05) -> DataFrame:
    """key, time, is_outlier: false for series with fewer than ten complete rows."""

    def one(at, *values):
        x = np.column_stack([v.astype(float) for v in values])
        ok, flags = np.isfinite(x).all(1), np.zeros(len(x), bool)
        if ok.sum() >= 10:
            good = x[ok]
            low, mid, high = np.percentile(good, [25, 50, 75], axis=0)
            flags[ok] = robust_outliers((good - mid) / np.where(high > low, high - low, 1.0), share)
        return {time: at, "is_outlier": flags}

    return _grouped(df, [key], [time, *columns], [time], one, f"{key} string, {time} date, is_outlier boolean")


def principal_components(x: np.ndarray, fit: np.ndarray, count: int) -> np.ndarray:
    """Centred projections on the leading directions of the rows ``fit``; of each direction
    the entry largest in size is positive."""
    mean = x[fit].mean(0)
    axes = np.linalg.svd(x[fit] - mean, full_matrices=False)[2][:count]
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return (x - mean) @ axes.T


def window_embedding(rows: DataFrame, key: str, time: str, window: str, cutoff, count: int = 3) -> DataFrame:
    """key, time, embedding: components of each series' windows, fitted to rows up to the
    cutoff; series with too few rows have none."""
    marked = rows.withColumn("__fit", upto(time, cutoff, key))

    def one(at, values, fit):
        x = np.stack(values)
        fit = fit.astype(bool)
        if len(x) < x.shape[1] + count or fit.sum() < max(count, 2):
            return {time: at[:0], "embedding": []}
        return {time: at, "embedding": list(principal_components(x, fit, count))}

    def run(key_values: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(time)
        made = one(frame[time].to_numpy(), frame[window].tolist(), frame["__fit"].to_numpy())
        return pd.DataFrame({key: [key_values[0]] * len(made[time]), time: made[time], "embedding": list(made["embedding"])})

    return marked.select(key, time, window, "__fit").groupBy(key).applyInPandas(run, f"{key} string, {time} date, embedding array<double>")


def warped_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping: the root of the least sum of squared differences along a path,
    by anti-diagonals."""
    n, m = len(a), len(b)
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)  # the two diagonals before
    before[0] = 0.0
    for d in range(2, n + m + 1):
        now = np.full(n + 1, np.inf)
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        now[i] = np.minimum(np.minimum(last[i - 1], last[i]), before[i - 1]) + (a[i - 1] - b[d - i - 1]) ** 2
        before, last = last, now
    return float(np.sqrt(last[n]))


#: Pairs that are warped at once: their diagonals stay in a core's cache.
WARPED = 256


def warped_block(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """``warped_distance`` of a[k] and b[k] for all k, some at once: shorter series are padded, and
    a pair's result stands where its own series end."""
    return np.concatenate([np.zeros(0), *(_warped(a[k : k + WARPED], b[k : k + WARPED]) for k in range(0, len(a), WARPED))])


def _warped(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """A row of each matrix is a place in the series, a column a pair, so that a diagonal is one piece of memory."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b)], int)
    n, m = sizes.max(0)
    x, y, out = np.zeros((len(a), n)), np.zeros((len(a), m)), np.full(len(a), np.inf)
    for k, (u, v) in enumerate(zip(a, b)):
        x[k, : len(u)] = u
        y[k, m - len(v) :] = v[::-1]  # from its end, so that all begin in the last row
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    before, last, now = (np.full((n + 1, len(a)), np.inf) for _ in range(3))
    gap = np.empty((n, len(a)))
    before[0] = 0.0
    total, some = sizes.sum(1), (sizes > 0).all(1)
    for d in range(2, n + m + 1):
        low, high = max(1, d - m), min(n, d - 1)
        g, row = gap[low - 1 : high], now[low : high + 1]
        np.subtract(x[low - 1 : high], y[m - d + low : m - d + high + 1], out=g)
        np.multiply(g, g, out=g)
        np.minimum(last[low - 1 : high], last[low : high + 1], out=row)
        np.minimum(row, before[low - 1 : high], out=row)
        np.add(row, g, out=row)
        now[:low] = now[high + 1 :] = np.inf
        ends = np.flatnonzero((total == d) & some)
        out[ends] = now[sizes[ends, 0], ends]
        before, last, now = last, now, before
    return np.sqrt(out)


def warped_distances(series: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst, dtw of pairs of series. series: well, s (array of double); pairs: src, dst."""
    side = lambda end, name: series.select(F.col("well").alias(end), F.col("s").alias(name))
    both = pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst")

    @F.pandas_udf("double")
    def dtw(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(warped_block(a.tolist(), b.tolist()))

    return both.select("src", "dst", dtw("a", "b").alias("dtw"))


def all_warped_distances(series: DataFrame, part: int = 64) -> DataFrame:
    """src, dst, dtw of all pairs with src < dst. Series are dealt into parts of about
    ``part``; every two parts meet in one group, so a series is sent once for each part."""
    parts = -(-series.count() // part) or 1
    own = F.pmod(F.xxhash64("well"), F.lit(parts)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = series.select("well", "s", own.alias("p"), other.alias("o")).select("well", "s", "p", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("well").reset_index(drop=True)
        a, b = np.triu_indices(len(frame), 1)
        own = frame["p"].to_numpy()
        meet = (own[a] != own[b]) | (key[0] == key[1])
        a, b, s = a[meet], b[meet], frame["s"].tolist()
        d = [warped_block([s[x] for x in a[k : k + 512]], [s[x] for x in b[k : k + 512]]) for k in range(0, len(a), 512)]
        well = frame["well"].to_numpy()
        return pd.DataFrame({"src": well[a], "dst": well[b], "dtw": np.concatenate([np.zeros(0), *d])}).astype({"src": object, "dst": object})

    return dealt.repartition(min(parts * (parts + 1) // 2, 1000), "i", "j").groupBy("i", "j").applyInPandas(run, "src string, dst string, dtw double")


def warped_similarity(distances: DataFrame, by: Column | None = None) -> DataFrame:
    """exp(-d**2 / (2 s**2)) with s the median distance, at least 1e-9: of all pairs or of each
    of few groups, by an expression over src and dst."""
    median = F.greatest(F.percentile("dtw", 0.5), F.lit(1e-9)).alias("s")
    if by is None:
        scaled = distances.crossJoin(F.broadcast(distances.agg(median)))
    else:
        grouped = distances.withColumn("__by", by)
        scaled = grouped.join(F.broadcast(grouped.groupBy("__by").agg(median)), "__by")
    return scaled.select("src", "dst", F.exp(-F.col("dtw") * F.col("dtw") / (2 * F.col("s") * F.col("s"))).alias("similarity"))


def z_scored_steps(df: DataFrame, key: str, time: str, column: str, cutoff) -> DataFrame:
    """well, s: each series' differences up to a date, as z-scores (zeros if constant)."""
    w = Window.partitionBy(key).orderBy(time)
    steps = df.where(upto(time, cutoff, key)).withColumn("__d", F.col(column) - F.lag(column).over(w)).where("__d is not null")
    of = Window.partitionBy(key)
    z = F.coalesce(F.try_divide(F.col("__d") - F.avg("__d").over(of), F.stddev_pop("__d").over(of)), F.lit(0.0))
    scored = steps.withColumn("__z", z)
    return scored.groupBy(F.col(key).alias("well")).agg(F.array_sort(F.collect_list(F.struct(time, "__z"))).alias("s")).select("well", F.col("s.__z").alias("s"))


def distance_matrix(frame: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Names in order and the lengths of edges between them, infinite without one."""
    names = sorted(set(frame["src"]) | set(frame["dst"]))
    at = {n: k for k, n in enumerate(names)}
    d = np.full((len(names), len(names)), np.inf)
    for a, b, v in zip(frame["src"], frame["dst"], frame["d"]):
        if a != b:
            d[at[a], at[b]] = d[at[b], at[a]] = v
    return names, d


def whole_graph(edges: DataFrame, wells: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(names, weights, distances)`` over one graph small enough for one task (the
    matrices are n x n); distances are infinite without an edge."""
    rows = edges.where("d > 0").select("src", "dst", "d").unionByName(wells.select(F.col("well").alias("src"), F.col("well").alias("dst"), F.lit(0.0).alias("d")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names, d = distance_matrix(frame)
        with np.errstate(divide="ignore"):
            w = np.where(np.isfinite(d), 1 / d, 0.0)
        return pd.DataFrame({"well": names, **fn(names, w, d)})

    return rows.groupBy(F.lit(1).alias("__one")).applyInPandas(run, schema)


def dealt_graph(edges: DataFrame, wells: DataFrame, fn, schema: str, parts: int = 12) -> DataFrame:
    """``fn(names, distances, sources)`` in ``parts`` tasks, each of which has the whole
    graph (an n x n matrix) and its share of the vertices as sources."""
    rows = edges.where("d > 0").select("src", "dst", "d").unionByName(wells.select(F.col("well").alias("src"), F.col("well").alias("dst"), F.lit(0.0).alias("d")))
    dealt = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        names, d = distance_matrix(frame)
        return pd.DataFrame(fn(names, d, np.arange(key[0], len(names), parts))).astype({"well": object})  # Arrow takes no empty frame of text

    return dealt.repartition(parts, "part").groupBy("part").applyInPandas(run, schema)


def shortest(distances: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Lengths of the shortest paths from each source to all vertices, infinite where there
    is none: Dijkstra's algorithm for all sources at once."""
    n, at = len(distances), np.arange(len(sources))
    found = np.full((len(sources), n), np.inf)
    found[at, sources] = 0.0
    left = found.copy()  # infinite once a vertex is settled
    for _ in range(n):
        v = left.argmin(1)
        here = left[at, v]
        if not np.isfinite(here).any():
            break
        way = here[:, None] + distances[v]
        left[at, v] = np.inf
        better = way < found
        found[better] = left[better] = way[better]
    return found


def spread(distances: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """``shortest`` for graphs with many edges: what a vertex brings nearer is found a row of the matrix at a time, for all
    sources; only vertices that came nearer since their last turn have another, the nearest first."""
    found = distances[sources]
    found[np.arange(len(sources)), sources] = 0.0
    told, way = np.full(found.shape, np.inf), np.empty(found.shape)  # with what length each had its turn
    told[np.arange(len(sources)), sources] = 0.0  # the sources' edges are there
    while True:
        left = np.flatnonzero((found < told).any(0))
        if not len(left):
            return found
        for u in left[found[:, left].min(0).argsort(kind="stable")]:
            told[:, u] = found[:, u]
            np.add(told[:, u, None], distances[u], out=way)
            np.minimum(found, way, out=found)


def passing(distances: np.ndarray, sources: np.ndarray, block: int = 32) -> np.ndarray:
    """The sum over paths from the sources of the share that leads through each vertex.
    Lengths that differ by 1e-12 of themselves are equal. Of a block of sources those steps are kept that
    lie on shortest paths; shares go along them until none changes."""
    n, score = len(distances), np.zeros(len(distances))
    for k in range(0, len(sources), block):
        some = sources[k : k + block]
        at, length = np.arange(len(some)), spread(distances, some)
        most, way, steps = np.where(np.isfinite(length), length * (1 + 1e-12), -1.0), np.empty(length.shape), []
        for u in range(n):
            near = length[:, u, None]
            np.add(near, distances[u], out=way)
            end = np.flatnonzero(way <= most)
            begin = end // n * n + u
            ok = length.ravel()[begin] < length.ravel()[end]
            steps.append(np.stack((begin[ok], end[ok])))
        begin, end = np.concatenate(steps, axis=1) if steps else np.zeros((2, 0), int)
        start = np.zeros(length.size)
        start[at * n + some] = 1.0
        paths, gain = start, np.zeros(length.size)
        while True:
            now = start + np.bincount(end, paths[begin], length.size)
            if (now == paths).all():
                break
            paths = now
        share = paths[begin] / np.maximum(paths[end], 1.0)
        while True:
            now = np.bincount(begin, share * (1 + gain[end]), length.size)
            if (now == gain).all():
                break
            gain = now
        gain[at * n + some] = 0.0
        score += gain.reshape(length.shape).sum(0)
    return score


def betweenness(distances: np.ndarray) -> np.ndarray:
    """Share of shortest paths between others that lead through each vertex."""
    n = len(distances)
    score = passing(distances, np.arange(n))
    return score / ((n - 1) * (n - 2)) if n > 2 else score


def numbered(edges: DataFrame, wells: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(well, v: the wells and the ends of edges with a number each, from 0; part, a, b, d: the edges by number, once for each
    part, with a row (n, n, 0) that says how many vertices there are)."""
    rows = edges.where("d > 0 and src <> dst").select("src", "dst", "d")
    ends = wells.select("well").union(rows.select("src")).union(rows.select("dst")).distinct()
    names = cut(ends.select("well", (F.row_number().over(Window.orderBy("well")) - 1).cast("int").alias("v")))
    side = lambda end, name: F.broadcast(names.select(F.col("well").alias(end), F.col("v").alias(name)))
    listed = rows.join(side("src", "a"), "src").join(side("dst", "b"), "dst").select("a", "b", "d")
    count = names.agg(F.count("*").cast("int").alias("a")).select("a", F.col("a").alias("b"), F.lit(0.0).alias("d"))
    return names, listed.unionByName(count).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def _listed(frame: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of vertices and both directions of the edges of a part of ``numbered``."""
    a, b, d = (frame[c].to_numpy() for c in ("a", "b", "d"))
    way = d > 0
    return int(a[~way][0]), np.concatenate((a[way], b[way])), np.concatenate((b[way], a[way])), np.concatenate((d[way], d[way]))


def _matrix(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    made = np.full((n, n), np.inf)
    made[a, b] = d
    return made


def dealt_betweenness(edges: DataFrame, wells: DataFrame, parts: int = 12) -> DataFrame:
    """well, betweenness: ``betweenness`` with the sources dealt over tasks, each of which has the whole graph (an n x n matrix)."""
    names, dealt = numbered(edges, wells, parts)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n, a, b, d = _listed(frame)
        score = passing(_matrix(n, a, b, d), np.arange(key[0], n, parts)) if key[0] < n else np.zeros(n)
        return pd.DataFrame({"v": np.arange(n, dtype=np.int32), "s": score / max((n - 1) * (n - 2), 1)})

    score = dealt.repartition(parts, "part").groupBy("part").applyInPandas(run, "v int, s double").groupBy("v").agg(F.sum("s").alias("betweenness"))
    return names.join(score, "v").select("well", "betweenness")


def lengths(n: int, src: np.ndarray, dst: np.ndarray, d: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """``shortest`` from lists of directed edges: every way is lengthened by all edges until none
    gets shorter. Memory is edges times sources."""
    order = np.argsort(dst, kind="stable")
    src, dst, d = src[order], dst[order], d[order]
    ends, first = np.unique(dst, return_index=True)
    found = np.full((n, len(sources)), np.inf)
    found[sources, np.arange(len(sources))] = 0.0
    while len(ends):
        now = np.minimum(found[ends], np.minimum.reduceat(found[src] + d[:, None], first, axis=0))
        if (now == found[ends]).all():
            break
        found[ends] = now
    return found.T


#: Vertices of the largest graph whose matrix a task may hold (0.5 GB), and ways that ``lengths`` lengthens at once.
WHOLE, WAYS = 8192, 1 << 22


def closeness(edges: DataFrame, wells: DataFrame, parts: int = 12, block: int = 32) -> DataFrame:
    """well, closeness by shortest paths of any number of edges; 0 for a well without any. Sources
    are dealt over ``parts`` tasks, each of which has the list of edges, and taken in blocks; where every sixteenth pair is an
    edge or more, and the matrix fits a task, it is made there."""
    names, dealt = numbered(edges, wells, parts)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n, a, b, d = _listed(frame)
        dense = n <= WHOLE and len(a) * 16 >= n * n
        matrix = _matrix(n, a, b, d) if dense else None
        step = block if dense else max(1, min(block, WAYS // max(len(a), 1)))
        mine, out = np.arange(key[0], n, parts), [np.zeros(0)]
        for k in range(0, len(mine), step):
            some = mine[k : k + step]
            length = spread(matrix, some) if dense else lengths(n, a, b, d, some)
            near = np.isfinite(length)
            reached, total = near.sum(1) - 1, np.where(near, length, 0.0).sum(1)
            out.append(reached * reached / np.maximum(total * (n - 1), np.finfo(float).tiny))
        return pd.DataFrame({"v": mine.astype(np.int32), "closeness": np.concatenate(out)})

    found = dealt.repartition(parts, "part").groupBy("part").applyInPandas(run, "v int, closeness double")
    return names.join(found, "v").select("well", "closeness")


def eigenvector(weights: np.ndarray) -> np.ndarray:
    """Leading eigenvector, not negative, of length 1."""
    values, vectors = np.linalg.eigh(weights)
    v = np.abs(vectors[:, values.argmax()])
    return v / (np.linalg.norm(v) or 1.0)


def spectral(weights: np.ndarray, count: int) -> np.ndarray:
    """Eigenvectors 1..count of the normalised Laplacian; each one's largest entry in size
    is positive. Zeros for graphs that are too small."""
    n = len(weights)
    if n < count + 1:
        return np.zeros((n, count))
    degree = weights.sum(1)
    root = np.where(degree > 0, 1 / np.sqrt(np.where(degree > 0, degree, 1)), 0)
    laplacian = np.diag((degree > 0).astype(float)) - root[:, None] * weights * root
    vectors = np.linalg.eigh(laplacian)[1][:, 1 : count + 1]
    return vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(count)])


def positive_elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, l1: float, rounds: int = 2000, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of at least 0 that minimise |y - b - x w|**2 / (2 n) + alpha l1 sum(w) +
    alpha (1 - l1) / 2 |w|**2, by coordinate descent on the columns' products; b is free."""
    n = len(y)
    x, y = x - x.mean(0), y - y.mean()
    # Plain numbers: for the few columns of a well they are faster than small arrays.
    products, target = (x.T @ x / n).tolist(), (x.T @ y / n).tolist()
    w, used = [0.0] * len(target), [j for j in range(len(target)) if products[j][j] != 0]
    for _ in range(rounds):
        moved = 0.0
        for j in used:
            size = products[j][j]
            rest = target[j] - sum(map(operator.mul, products[j], w)) + size * w[j]
            new = max(0.0, rest - alpha * l1) / (size + alpha * (1 - l1))
            if new != w[j]:
                moved = max(moved, abs(new - w[j]) * math.sqrt(size))
                w[j] = new
        if moved < tolerance:
            break
    return np.array(w)


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by Euclidean distance; 0 for a cluster of one, -1 without two clusters."""
    if len(set(labels.tolist())) < 2:
        return -1.0
    d = np.array([np.sqrt(((x - v) ** 2).sum(-1)) for v in x])
    out = np.zeros(len(x))
    for i, k in enumerate(labels):
        same = labels == k
        if same.sum() > 1:
            a = d[i, same].sum() / (same.sum() - 1)
            b = min(d[i, labels == m].mean() for m in set(labels.tolist()) - {k})
            out[i] = (b - a) / max(a, b, 1e-12)
    return float(out.mean())


def cluster(x: np.ndarray, most: int, starts: int = 10, seed: int = 42) -> np.ndarray:
    """k-means labels for the k from 2 to ``most`` with the best silhouette, the first of
    equals; all 0 for fewer than three rows."""
    best, chosen = -np.inf, np.zeros(len(x), int)
    for k in range(2, min(most, len(x) - 1) + 1) if len(x) >= 3 else ():
        cost, labels = np.inf, chosen
        for s in range(starts):
            rng = np.random.default_rng(seed + s)
            centres = x[rng.choice(len(x), k, replace=False)]
            for _ in range(100):
                at = ((x[:, None] - centres) ** 2).sum(-1).argmin(1)
                after = np.array([x[at == c].mean(0) if (at == c).any() else centres[c] for c in range(k)])
                if np.allclose(after, centres):
                    break
                centres = after
            total = ((x - centres[at]) ** 2).sum()
            if total < cost - 1e-12:
                cost, labels = total, at
        score = silhouette(x, labels)
        if score > best + 1e-12:
            best, chosen = score, labels
    return chosen


def biased_walks(weights: np.ndarray, length: int = 20, each: int = 50, back: float = 1.0, out: float = 2.0, seed: int = 42, block: int = 256) -> list[list[int]]:
    """Random walks that weigh a return by 1 / back and a step away by 1 / out. Walks step
    together in blocks; one that has no edge to leave by ends."""
    rng, n, walks = np.random.default_rng(seed), len(weights), []
    linked = weights.any(1)
    for _ in range(each):
        starts = rng.permutation(n)
        for k in range(0, n, block):
            path = [starts[k : k + block]]
            walks += [[v] for v in path[0][~linked[path[0]]].tolist()]
            path[0] = path[0][linked[path[0]]]
            while len(path) < length:
                w = weights[path[-1]]
                if len(path) > 1:
                    bias = np.where(weights[path[-2]] > 0, 1.0, 1 / out)
                    bias[np.arange(len(bias)), path[-2]] = 1 / back
                    w = w * bias
                sums = w.cumsum(1)
                drawn = np.minimum(rng.random(len(w)) * sums[:, -1], np.nextafter(sums[:, -1], 0))
                path.append((sums <= drawn[:, None]).sum(1))
            walks += np.array(path).T.tolist()
    return walks


def walk_embedding(weights: np.ndarray, count: int = 4, window: int = 5) -> np.ndarray:
    """Embedding of vertices by how often walks bring them together: leading directions of
    the positive pointwise mutual information of co-occurrence within the window."""
    n = len(weights)
    seen = np.zeros((n, n))
    walks = [w for w in biased_walks(weights) if len(w) > 1]
    for gap in range(1, window + 1):
        u = np.array([x for w in walks for x in w[:-gap]], int)
        v = np.array([x for w in walks for x in w[gap:]], int)
        met = np.bincount(u * n + v, minlength=n * n).reshape(n, n)
        seen += met + met.T
    total, side = seen.sum() or 1.0, seen.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.log(seen * total / np.outer(side, side))
    u, s, _ = np.linalg.svd(np.where(np.isfinite(pmi), np.maximum(pmi, 0), 0.0))
    made = np.zeros((n, count))
    made[:, : min(count, n)] = (u * np.sqrt(s))[:, :count]
    return made * np.where(made[np.abs(made).argmax(0), np.arange(count)] < 0, -1, 1)
