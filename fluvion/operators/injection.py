"""Injection features as one call: pairs, lags, kernels, causal evidence and attention.

Everything is rows of (producer, injector, month) for the nearest injectors of each producer:
as many as producers times ``top`` times months, joined and summed by Spark. Only the scores
of the kernel candidates, a few dozen, come to the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvion.operators import attention, features, pairs, statistics
from fluvion.operators.panel import upto
from fluvion.sources.lineage import cut

PAIR = ["prod_id", "inj_id"]
#: Kernels that are tried, with their base and the grid around it.
CANDIDATES = (
    ("idw", {"p": 1.5}, {"p": [0.5, 1.0, 1.5, 2.0, 3.0, 4.0]}),
    ("exponential", {"scale": 400.0}, {"scale": [200.0, 400.0, 600.0, 800.0, 1000.0]}),
    ("gaussian", {"scale": 400.0}, {"scale": [200.0, 400.0, 600.0, 800.0, 1000.0]}),
    ("matern", {"scale": 400.0, "nu": 1.5}, {"scale": [200.0, 400.0, 600.0, 800.0], "nu": [0.5, 1.5, 2.5]}),
    ("rational_quadratic", {"scale": 400.0, "alpha": 1.0}, {"scale": [200.0, 400.0, 600.0, 800.0], "alpha": [0.5, 1.0, 2.0]}),
)
#: Weights of the causal score's parts, and the rows that they need.
CAUSAL_PARTS = {"granger": 0.35, "mi": 0.30, "psd_corr": 0.20, "cmi": 0.15}
CAUSAL_ROWS = 12
#: Months back of the features at fixed lags.
FIXED_LAGS = (1, 3, 6)


@dataclass(frozen=True)
class Direction:
    """A preferred direction of flow; see ``pairs.direction_factor``."""

    vector: Sequence[float]
    mode: str = "forward"
    floor: float = 0.1
    kappa: float = 1.0


@dataclass(frozen=True)
class Settings:
    top: int = 5
    candidates: Sequence[tuple[str, Mapping[str, float], Mapping[str, Sequence[float]] | None]] = CANDIDATES
    anisotropy: Mapping | None = None
    direction: Direction | None = None
    lag: Mapping[str, float] = field(default_factory=dict)
    overlap: int = 6
    crm: bool = True
    prior_share: float = 0.35
    blend: float = 0.2
    smooth: float = 0.05
    anchor: float = 0.25


def expand(base: Mapping[str, float], grid: Mapping[str, Sequence[float]] | None) -> list[dict[str, float]]:
    """The base, then every combination of the grid's values over it that differs from it."""
    out = [dict(base)]
    keys = [k for k, v in (grid or {}).items() if v]
    for values in itertools.product(*(grid[k] for k in keys)) if keys else ():
        made = {**base, **dict(zip(keys, map(float, values)))}
        if made not in out:
            out.append(made)
    return out


def candidates(settings: Settings) -> list[tuple[int, str, dict[str, float]]]:
    """(number of the kernel, its name, its parameters), in the order they are tried."""
    return [(k, name, params) for k, (name, base, grid) in enumerate(settings.candidates) for params in expand(base, grid)]


def spine(rows: DataFrame, dates: DataFrame, values: Mapping[str, str], fill: str) -> DataFrame:
    """Every well of ``rows`` at every date; values by their new names. fill: zero, forward
    (then 0) or both (the last known value, else the next)."""
    wide = rows.select("well").distinct().crossJoin(dates).join(rows.select("well", "ds", *(F.col(c).alias(n) for n, c in values.items())), ["well", "ds"], "left")
    before = Window.partitionBy("well").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("well").orderBy("ds").rowsBetween(0, Window.unboundedFollowing)
    made = {}
    for n in values:
        known = F.col(n) if fill == "zero" else F.last(n, True).over(before)
        made[n] = F.coalesce(known, F.first(n, True).over(after)) if fill == "both" else F.coalesce(known, F.lit(0.0))
    return wide.withColumns(made)


def pair_windows(producers: DataFrame, injectors: DataFrame, settings: Settings) -> DataFrame:
    """The nearest injectors of each producer by the metric distance, with the direction's
    factor and the window of lags. producers, injectors: well, x, y, z. A producer and an injector
    may be at one place."""
    near = pairs.nearest_pairs(producers, injectors, settings.top, pairs.metric_matrix(settings.anisotropy) if settings.anisotropy else None)
    if settings.direction:
        d = settings.direction
        near = pairs.direction_factor(near, d.vector, d.mode, d.floor, d.kappa)
    else:
        near = near.withColumns({"cosine": F.lit(None).cast("double"), "direction_factor": F.lit(1.0)})
    return pairs.lag_window(near.drop("dx", "dy", "dz"), distance="metric_d", **{"touching": True, **settings.lag})


def lagged(found: DataFrame, target: DataFrame, source: DataFrame) -> DataFrame:
    """found with y (and c) of the producer at each date of the spine, and x, dx of the
    injector ``lag`` months before; ``known`` where that month is on the spine, else 0."""
    y = target.select(F.col("well").alias("prod_id"), *(c for c in target.columns if c != "well"))
    x = source.select(F.col("well").alias("inj_id"), F.col("ds").alias("__at"), "x", "dx")
    rows = found.join(y, "prod_id").withColumn("__at", F.add_months("ds", -F.col("lag").cast("int"))).join(x, ["inj_id", "__at"], "left")
    return rows.withColumn("known", F.col("x").isNotNull()).fillna(0.0, ["x", "dx"]).drop("__at")


def causal_evidence(rows: DataFrame, least: int = CAUSAL_ROWS) -> DataFrame:
    """prod_id, inj_id, granger, mi, psd_corr, cmi, causal_score from training rows (y, x and
    the condition c); pairs with fewer than ``least`` rows are absent."""
    usable = rows.where("known and x is not null and y is not null and c is not null")
    enough = usable.groupBy(*PAIR).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(*PAIR)
    usable = cut(usable.join(enough, PAIR, "left_semi").select(*PAIR, "ds", "y", "x", "c"))  # read by each part
    parts = pairs.granger(usable).join(statistics.pair_statistics(usable), PAIR)
    parts = parts.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in CAUSAL_PARTS})
    return pairs.causal_score(parts, CAUSAL_PARTS)


def kernel_scores(near: DataFrame, rows: DataFrame, tried: Sequence[tuple[int, str, Mapping[str, float]]], group: Callable[[str], Column] | None = None) -> DataFrame:
    """cand (place in ``tried``), score: the sum over producers of |correlation| between the
    weighted lagged rates and the target, in one job for all candidates. With ``group``, a
    function of the producers' column, also group: a score for each of these.

    rows: those of the pairs in near, with its metric_d and direction_factor. Rows go to their producer once;
    candidates are columns until a producer's month is one row, and none of them is sent anywhere."""
    value = [pairs.kernel(name, F.col("metric_d"), **p) * F.col("direction_factor") for _, name, p in tried]
    total = near.groupBy("prod_id").agg(F.count("*").alias("__n"), F.array(*(F.sum(v) for v in value)).alias("__t"))
    met = rows.select("prod_id", "ds", "y", "x", "metric_d", "direction_factor").repartition("prod_id").join(total, "prod_id")
    # Shares of the producer's sum (pairs.normalised).
    share = lambda k: F.when(F.col("__t")[k] > 0, value[k] / F.col("__t")[k]).otherwise(1.0 / F.col("__n"))
    months = met.groupBy("prod_id", "ds").agg(F.first("y").alias("y"), *(F.sum(share(k) * F.col("x")).alias(f"__v{k}") for k in range(len(tried))))
    series = months.select("prod_id", "y", F.posexplode(F.array(*(f"__v{k}" for k in range(len(tried))))).alias("cand", "v"))
    r = series.groupBy("cand", "prod_id").agg(F.abs(pairs.correlation(F.col("v"), F.col("y"))).alias("r"))
    by = [group("prod_id").alias("group")] if group else []
    return r.groupBy(*by, "cand").agg(F.sum(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))).alias("score"))


def choose(tried: Sequence[tuple[int, str, Mapping[str, float]]], scores: Mapping[int, float]) -> tuple[int, float]:
    """The place of the chosen candidate: within a kernel the base, unless another's score is
    above the best so far by more than 1e-9; among kernels the highest, the first of equals."""
    best: dict[int, tuple[int, float]] = {}
    for k, (kernel, _, _) in enumerate(tried):
        score = scores.get(k, 0.0)
        if kernel not in best or score > best[kernel][1] + 1e-9:
            best[kernel] = (k, score)
    return max(best.values(), key=lambda b: (b[1], -b[0]))


@dataclass
class Injection:
    features: DataFrame  # well, ds and the features
    summary: DataFrame  # one row for each pair
    alpha: DataFrame | None  # weights of each pair by month
    kernel: tuple[str, dict[str, float], float] | dict | None


FEATURES = ("inj_wwir_lag_weighted", "inj_wwit_diff_lag_weighted", "inj_wwir_crm_weighted", "inj_wwir_lag_attn", "inj_wwit_diff_lag_attn", "inj_wwir_crm_attn", *(f"inj_top{k}_contribution" for k in (1, 2, 3)), *(f"inj_wwir_lag_{m}m" for m in FIXED_LAGS))


def build(panel: DataFrame, places: DataFrame, cutoff, settings: Settings = Settings(), windows: DataFrame | None = None, group: Callable[[str], Column] | None = None) -> Injection:
    """All injection features of a panel (well, ds, type, wlpr, wwir and, as the condition of
    causal tests, wthp) with places (well, x, y, z). Rows up to ``cutoff`` are for learning.

    Without injectors, or producers with places, the features are zeros, the summary is empty
    and there is no kernel. Injectors' missing months are 0; producers' take the last known
    rate. Tables that are read again are cut in the checkpoint folder.

    ``windows``: pairs and lags that are known already (see pair_windows). Where keys carry a
    group, as those of folds do, ``cutoff`` may be a function of the key's column (panel.upto),
    and ``group``, another such function, lets each group choose its own kernel; ``kernel`` then is
    a dict by group.
    """
    prod, inj = panel.where("type = 'PROD'"), panel.where("type = 'INJ'")
    dates = cut(prod.select("ds").distinct())
    place = lambda wells: places.select("well", "x", "y", "z").join(wells.select("well").distinct(), "well", "left_semi")
    windows = cut(pair_windows(place(prod), place(inj), settings) if windows is None else windows)
    wells = prod.select("well").distinct().crossJoin(dates)
    if windows.isEmpty():
        empty = windows.select(*PAIR, F.col("d").alias("distance_m"), F.col("metric_d").alias("metric_distance_m"))
        return Injection(wells.select("well", "ds", *(F.lit(0.0).alias(c) for c in FEATURES)), empty, None, None)
    target = spine(prod, dates, {"y": "wlpr"}, "forward").join(spine(prod, dates, {"c": "wthp"}, "both"), ["well", "ds"])
    step = F.col("x") - F.coalesce(F.lag("x").over(Window.partitionBy("well").orderBy("ds")), F.col("x"))
    source = cut(spine(inj, dates, {"x": "wwir"}, "zero").withColumn("dx", step))
    target = cut(target)
    found = cut(pairs.best_lag(windows, target, source, cutoff, settings.overlap))
    rows = cut(lagged(found, target, source))
    train = rows.where(upto("ds", cutoff, "prod_id"))
    evidence = cut(causal_evidence(train))

    tried = candidates(settings)
    scores: dict[object, dict[int, float]] = {}
    for r in kernel_scores(found, train, tried, group).collect():  # groups times candidates
        scores.setdefault(r["group"] if group else None, {})[r["cand"]] = r["score"]
    best = {g: choose(tried, s) for g, s in (scores or {None: {}}).items()}
    kernels = {g: (*tried[at][1:], score) for g, (at, score) in best.items()}
    of = lambda make: _by_group(group, {g: make(*k) for g, k in kernels.items()})
    value = of(lambda name, params, score: pairs.kernel(name, F.col("metric_d"), **params))
    named = {"kernel_type": of(lambda name, params, score: F.lit(name)), "kernel_params": of(lambda name, params, score: F.lit(", ".join(f"{k}={v:g}" for k, v in sorted(params.items())))), "kernel_score": of(lambda name, params, score: F.lit(float(score)))}
    weighted = pairs.normalised(found.withColumns({"__k": value * F.col("direction_factor"), **named}), "prod_id", "__k").drop("__k")
    scored = weighted.join(evidence, PAIR, "left")
    # Without causal evidence the correlation stands in for it.
    scored = scored.withColumn("__c", F.coalesce("causal_score", F.greatest("corr", F.lit(0.0))))
    chosen = cut(pairs.causal_adjust(scored, causal="__c").drop("weight", "__c").withColumnRenamed("adjusted_weight", "weight"))

    rows = rows.join(chosen.select(*PAIR, "weight"), PAIR)
    if settings.crm:
        rows = rows.join(_filtered(chosen, source), ["prod_id", "inj_id", "ds"])
    else:
        rows = rows.withColumn("crm", F.lit(0.0))
    rows = cut(rows)
    part = lambda c: F.sum(F.col("weight") * F.col(c))
    tops = [F.sum(F.when(F.col("rk") == k, F.col("weight") * F.col("x")).otherwise(0.0)).alias(f"inj_top{k}_contribution") for k in (1, 2, 3)]
    made = rows.groupBy("prod_id", "ds").agg(part("x").alias("inj_wwir_lag_weighted"), part("dx").alias("inj_wwit_diff_lag_weighted"), part("crm").alias("inj_wwir_crm_weighted"), *tops)
    each = chosen.select(*PAIR, "weight", F.explode(F.array(*map(F.lit, FIXED_LAGS))).alias("lag"))
    fixed = lagged(each, target.select("well", "ds", "y"), source).groupBy("prod_id", "ds").agg(*(F.sum(F.when(F.col("lag") == m, F.col("weight") * F.col("x")).otherwise(0.0)).alias(f"inj_wwir_lag_{m}m") for m in FIXED_LAGS))

    alpha = cut(attention_weights(rows, chosen, panel, cutoff, settings))
    attended = rows.join(alpha.select(*PAIR, "ds", "alpha"), [*PAIR, "ds"]).groupBy("prod_id", "ds").agg(*(F.sum(F.col("alpha") * F.col(c)).alias(n) for c, n in (("x", "inj_wwir_lag_attn"), ("dx", "inj_wwit_diff_lag_attn"), ("crm", "inj_wwir_crm_attn"))))
    out = wells.select(F.col("well").alias("prod_id"), "ds")
    for part_ in (made, fixed, attended):
        out = out.join(part_, ["prod_id", "ds"], "left")
    out = out.fillna(0.0, list(FEATURES)).withColumnRenamed("prod_id", "well").select("well", "ds", *FEATURES)
    return Injection(out, summary(chosen, alpha), alpha, kernels if group else kernels[None])


def _by_group(group: Callable[[str], Column] | None, values: Mapping[object, Column]) -> Column:
    """The value of each row's group."""
    if group is None:
        return values[None]
    made = F.lit(None)
    for g, v in values.items():
        made = F.when(group("prod_id") == g, v).otherwise(made)
    return made


def _filtered(chosen: DataFrame, source: DataFrame) -> DataFrame:
    """prod_id, inj_id, ds, crm: each pair's injector filtered with the pair's tau. One filter
    for an injector and a tau, however many pairs share them."""
    wanted = chosen.select("inj_id", "tau").distinct()
    series = wanted.join(source.select(F.col("well").alias("inj_id"), "ds", "x"), "inj_id").withColumn("__key", F.concat_ws("|", "inj_id", "tau"))
    made = features.crm_filter(series, "__key", "ds", "x", F.col("tau")).select("inj_id", "tau", "ds", F.col("x_crm").alias("crm"))
    return chosen.select(*PAIR, "tau").join(made, ["inj_id", "tau"]).drop("tau")


def attention_weights(rows: DataFrame, chosen: DataFrame, panel: DataFrame, cutoff, settings: Settings = Settings(), columns: Sequence[str] = ("wthp",)) -> DataFrame:
    """prod_id, inj_id, ds, alpha, is_train, regime_id, stage_id: weights by month. rows:
    prod_id, inj_id, ds, y, x, dx, crm; chosen: the pairs with weight, corr, d, lag, tau.

    A pair's prior is its weight, drawn towards the likeness of both wells' medians; regimes
    have weights learned from the changes of y; the mix of both follows the stage, and months
    after the cutoff are drawn to the last training months.
    """
    medians = panel.groupBy("well").agg(*(F.median(c).alias(c) for c in columns if c in panel.columns))
    base = attention.simplex(chosen, ["prod_id"], "weight", "prior")
    base = attention.geology_prior(base, medians, [c for c in columns if c in panel.columns])
    share = settings.prior_share
    base = attention.simplex(base.withColumn("__e", (1 - share) * F.col("prior") + share * F.col("geo_prior")), ["prod_id"], "__e", "effective")
    static = pairs.static_prior(base.drop("prior").withColumn("weight", F.col("effective")))
    static = attention.simplex(static.withColumn("__s", (1 - share) * F.col("prior") + share * F.col("geo_prior")), ["prod_id"], "__s", "static").select(*PAIR, "effective", "static")
    made = rows.drop("weight").join(static, PAIR)
    total = made.groupBy("prod_id", "ds").agg(F.sum(F.col("effective") * F.col("x")).alias("v"), F.sum(F.col("effective") * F.col("dx")).alias("step"))
    labels = attention.regimes(total, "prod_id", "ds", "v", cutoff, change="step").select("prod_id", "ds", "regime_id")
    mixes = attention.stage_mix(total, "prod_id", "ds", "v", cutoff, change="step", smooth=settings.smooth).select("prod_id", "ds", "stage_id", "mix")
    change = F.col("y") - F.coalesce(F.lag("y").over(Window.partitionBy(*PAIR).orderBy("ds")), F.col("y"))
    known = made.join(labels, ["prod_id", "ds"]).withColumn("y", change).withColumn("prior", F.col("effective"))
    learned = cut(attention.regime_weights(known, settings.blend, cutoff, blocks=("x", "dx", "crm") if settings.crm else ("x", "dx")))  # read twice by what smooths it
    joined = known.join(learned, ["prod_id", "regime_id", "inj_id"], "left").withColumn("learned", F.coalesce("learned", "effective"))
    joined = attention.smoothed(joined, [*PAIR], "ds", "learned", settings.smooth).withColumn("prior", F.col("static")).join(mixes, ["prod_id", "ds"])
    return attention.assemble(joined, cutoff, settings.anchor).select(*PAIR, "ds", "alpha", "is_train", "regime_id", "stage_id")


def summary(chosen: DataFrame, alpha: DataFrame) -> DataFrame:
    """One row for each pair with its distances, lags, evidence and mean weights."""
    means = alpha.groupBy(*PAIR).agg(
        F.avg(F.when(F.col("is_train"), F.col("alpha"))).alias("attn_alpha_train_mean"),
        F.max_by(F.when(F.col("is_train"), F.col("alpha")), F.when(F.col("is_train"), F.col("ds"))).alias("attn_alpha_train_last"),
        F.max_by("alpha", "ds").alias("attn_alpha_full_last"),
        F.avg("alpha").alias("__all"),
    )
    shown = chosen.join(means, PAIR, "left").withColumn("attn_alpha", F.coalesce("attn_alpha_train_mean", "__all"))
    return shown.select(
        *PAIR,
        F.col("d").alias("distance_m"),
        F.col("metric_d").alias("metric_distance_m"),
        "direction_factor",
        F.col("cosine").alias("direction_cosine"),
        "kernel_type",
        "kernel_params",
        "kernel_score",
        "weight",
        "lag",
        "tau",
        "corr",
        F.col("granger").alias("granger_score"),
        F.col("mi").alias("mutual_info"),
        "psd_corr",
        F.col("cmi").alias("conditional_mi"),
        "causal_score",
        "overlap",
        "lower_bound",
        "upper_bound",
        F.col("t_diff").alias("t_diff_days"),
        F.col("t_front").alias("t_front_days"),
        "attn_alpha",
        (F.col("attn_alpha") - F.col("weight")).alias("attn_minus_kernel"),
        "attn_alpha_train_mean",
        "attn_alpha_train_last",
        "attn_alpha_full_last",
    )
