"""Weights of injectors that change with time: regimes, stages, and their assembly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvion.operators import features
from fluvion.operators.panel import upto
from fluvion.operators.statistics import positive_elastic_net
from fluvion.sources.lineage import cut


def simplex(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Shares of a group's sum; what isn't finite or is negative counts as 0; equal shares
    where nothing is left."""
    w = Window.partitionBy(*group)
    clean = F.when(F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (F.col(value) < 0), 0.0).otherwise(F.col(value))
    part = df.withColumn("__p", clean)
    total = F.sum("__p").over(w)
    return part.withColumn(name, F.when(total > 0, F.col("__p") / total).otherwise(1.0 / F.count("*").over(w))).drop("__p")


def geology_prior(pairs: DataFrame, medians: DataFrame, columns: list[str], base: str = "prior") -> DataFrame:
    """0.7 of the base prior and 0.3 of the likeness of both wells' medians, as shares;
    without a shared column the base prior. medians: well and the columns."""
    if not columns:
        return pairs.withColumn("geo_prior", F.col(base))
    side = lambda end, tag: medians.select(F.col("well").alias(end), *(F.col(c).alias(f"{tag}{c}") for c in columns))
    both = pairs.join(side("prod_id", "__p_"), "prod_id", "left").join(side("inj_id", "__i_"), "inj_id", "left")
    like = [F.exp(-F.coalesce(F.try_divide(F.abs(F.col(f"__p_{c}") - F.col(f"__i_{c}")), F.abs(f"__p_{c}") + F.abs(f"__i_{c}")), F.lit(0.0))) for c in columns]
    near = both.withColumn("__l", F.coalesce(sum(like, F.lit(0.0)) / len(columns), F.lit(0.0)))
    mixed = simplex(near, ["prod_id"], "__l", "__s").withColumn("geo_prior", 0.7 * F.col(base) + 0.3 * F.col("__s"))
    return mixed.select(*pairs.columns, "geo_prior")


def _stepped(series: DataFrame, key: str, time: str, value: str, change: str | None) -> DataFrame:
    """``__d``: the column ``change``, or the step from the row before. Written once: quantiles
    are values of the series and are compared with them, so a sum that was taken again in another
    order of its rows would fall on the other side of itself."""
    step = F.col(change) if change else F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(key).orderBy(time)), F.col(value))
    return cut(series.withColumn("__d", step))


#: Values closer than this share of a series' largest count as equal: the order of a sum may part them.
TIE = 1e-12


def _slack(value: str):
    return (TIE * F.max(F.abs(value))).alias("__t")


def regimes(series: DataFrame, key: str, time: str, value: str, cutoff, change: str | None = None) -> DataFrame:
    """Numbers of regimes: by the terciles of the training values, then one for changes at or
    above the training changes' 80th percentile and one for those at or below the 20th, which
    wins. Regimes of training rows are numbered from 0 without gaps; a row of any other takes
    the most frequent one's number, the smallest of equals. Fewer than five training rows: 0."""
    stepped = _stepped(series, key, time, value, change).withColumn("__train", upto(time, cutoff, key))
    train = stepped.where("__train")
    q = train.groupBy(key).agg(F.count(value).alias("__n"), F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("__q"), F.percentile("__d", F.array(F.lit(0.2), F.lit(0.8))).alias("__e"), _slack(value))
    third = F.when(F.col(value) < F.col("__q")[0] - F.col("__t"), 0).when(F.col(value) < F.col("__q")[1] - F.col("__t"), 1).otherwise(2)
    apart = F.col("__e")[1] > F.col("__e")[0] + F.col("__t")
    raw = F.when(F.coalesce(F.col("__n"), F.lit(0)) < 5, 0).when(apart & (F.col("__d") <= F.col("__e")[0] + F.col("__t")), 4).when(apart & (F.col("__d") >= F.col("__e")[1] - F.col("__t")), 3).otherwise(third)
    labelled = stepped.join(q, key, "left").withColumn("__r", raw)
    counts = labelled.where("__train").groupBy(key, "__r").agg(F.count("*").alias("__c"))
    seen = counts.groupBy(key).agg(F.array_sort(F.collect_set("__r")).alias("__seen"), (-F.max(F.struct(F.col("__c"), (-F.col("__r")).alias("r")))["r"]).alias("__mode"))
    known = labelled.join(seen, key, "left")
    at = F.array_position("__seen", F.col("__r"))
    number = F.coalesce(F.when(at > 0, at), F.array_position("__seen", F.col("__mode"))) - 1
    return known.withColumn("regime_id", F.coalesce(number, F.lit(0)).cast("int")).select(*series.columns, "regime_id")


def smoothed(df: DataFrame, keys: list[str], time: str, column: str, share: float) -> DataFrame:
    """a(t) = (1 - s) a(t) + s a(t-1) over each series, from its first value on."""
    if not share:
        return df
    key = "__series"
    named = df.withColumn(key, F.concat_ws("|", *keys))
    made = features.ema(named.select(key, time, column), key, time, column, share).select(key, time, F.col(f"{column}_ema").alias("__a"))
    return named.join(made, [key, time]).withColumn(column, F.col("__a")).drop(key, "__a")


#: Shares of the regime and the static part by stage.
STAGE_MIX = ((0.55, 0.45), (0.70, 0.30), (0.80, 0.20))


def stage_mix(series: DataFrame, key: str, time: str, value: str, cutoff, base: tuple[float, float] = (0.70, 0.30), change: str | None = None, smooth: float = 0.0) -> DataFrame:
    """stage_id by the training values' 33rd and 66th percentiles, and mix, the share of
    the regime part: the stage's, shifted by the size of the change, times the base, smoothed
    over time. Fewer than five training rows: stage 0 and the base itself."""
    stepped = _stepped(series, key, time, value, change)
    q = stepped.where(upto(time, cutoff, key)).groupBy(key).agg(F.count(value).alias("__n"), F.percentile(value, F.array(F.lit(0.33), F.lit(0.66))).alias("__q"), F.percentile(F.abs("__d"), 0.9).alias("__s"), _slack(value))
    j = stepped.join(q, key, "left").withColumn("__few", F.coalesce(F.col("__n"), F.lit(0)) < 5)
    stage = F.when(F.col("__few"), 0).when(F.col(value) < F.col("__q")[0] - F.col("__t"), 0).when(F.col(value) < F.col("__q")[1] - F.col("__t"), 1).otherwise(2)
    j = j.withColumn("stage_id", F.coalesce(stage, F.lit(0)))
    shift = 0.15 * F.least(F.coalesce(F.try_divide(F.abs("__d"), F.col("__s")), F.lit(0.0)), F.lit(1.0))
    share = lambda k: F.when(F.col("stage_id") == 0, STAGE_MIX[0][k]).when(F.col("stage_id") == 1, STAGE_MIX[1][k]).otherwise(STAGE_MIX[2][k])
    a, b = F.greatest(share(0) + shift, F.lit(1e-4)) * base[0], F.greatest(share(1) - shift, F.lit(1e-4)) * base[1]
    mixed = j.withColumn("mix", F.when(F.col("__few"), base[0] / sum(base)).otherwise(a / (a + b)))
    return smoothed(mixed.select(*series.columns, "stage_id", "mix"), [key], time, "mix", smooth)


def regime_weights(rows: DataFrame, shrink: float = 0.2, cutoff=None, blocks: tuple[str, ...] = ("x",)) -> DataFrame:
    """prod_id, regime_id, inj_id, learned: for each producer and regime with at least twelve
    rows, and two for each injector, the weights of a non-negative elastic net of y on the
    injectors' columns, as shares, blended with the prior. The ``blocks`` of columns are stacked
    under each other, each against the same y. rows: prod_id, ds, regime_id, inj_id, y, prior
    and the blocks; a group is one producer's rows, whose regimes are parted as arrays."""
    train = rows if cutoff is None else rows.where(upto("ds", cutoff, "prod_id"))

    def fitted(date: np.ndarray, of: np.ndarray, y_: np.ndarray, prior_: np.ndarray, x_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The places of a regime's injectors among the producer's, and their weights."""
        dates, at = np.unique(date, return_inverse=True)
        names, of = np.unique(of, return_inverse=True)
        n, p = len(dates), len(names)
        y, prior, wide = np.full(n, np.nan), np.full(p, np.nan), np.zeros((len(blocks), n, p))
        for out, place, v in ((y, (at,), y_), (prior, (of,), prior_), *((x, (at, of), v) for x, v in zip(wide, x_))):
            rows = np.flatnonzero(~np.isnan(v))[::-1]  # the first of equals is written last
            out[tuple(k[rows] for k in place)] = v[rows]
        prior = prior / prior.sum() if prior.sum() > 0 else np.full(len(prior), 1 / len(prior))
        learned = prior
        if p > 1 and n >= max(12, 2 * p):
            w = positive_elastic_net(wide.reshape(-1, p), np.tile(y, len(wide)), max(1e-5, 1e-3 * (1 - shrink)), 0.7)
            if w.sum() > 0:
                learned = (1 - shrink) * w / w.sum() + shrink * prior
        return names, learned

    def one(key: tuple, table: pa.Table) -> pa.Table:
        number = lambda c: np.asarray(table[c].cast(pa.float64()).to_numpy(), float)  # noqa: E731  null is NaN
        regime, date = (table[c].to_numpy() for c in ("regime_id", "ds"))
        listed = table["inj_id"].combine_chunks().dictionary_encode()
        names, of = np.unique(np.array(listed.dictionary.to_pylist(), object), return_inverse=True)
        of = of[listed.indices.to_numpy()]
        y, prior, x = number("y"), number("prior"), [number(b) for b in blocks]
        made = [(r, *fitted(date[m], of[m], y[m], prior[m], [v[m] for v in x])) for r, m in ((r, regime == r) for r in np.unique(regime))]
        ids = names[np.concatenate([at for _, at, _ in made])].tolist()
        regimes = np.concatenate([np.full(len(at), r) for r, at, _ in made])
        return pa.table({"prod_id": pa.array([key[0].as_py()] * len(ids), pa.string()), "regime_id": pa.array(regimes, pa.int32()), "inj_id": pa.array(ids, pa.string()), "learned": pa.array(np.concatenate([w for _, _, w in made]))})

    return train.select("prod_id", "ds", "regime_id", "inj_id", "y", *blocks, "prior").groupBy("prod_id").applyInArrow(one, "prod_id string, regime_id int, inj_id string, learned double")


def assemble(rows: DataFrame, cutoff, anchor: float = 0.25, last: int = 3) -> DataFrame:
    """alpha = mix * learned + (1 - mix) * prior; after the cutoff pulled by ``anchor``
    to its mean over the last training rows. rows: prod_id, inj_id, ds, mix, learned,
    prior, of which the last two sum to 1 over a producer's injectors."""
    w = Window.partitionBy("prod_id", "inj_id")
    made = rows.withColumn("alpha", F.col("mix") * F.coalesce("learned", "prior") + (1 - F.col("mix")) * F.col("prior")).withColumn("is_train", upto("ds", cutoff, "prod_id"))
    back = F.row_number().over(Window.partitionBy("prod_id", "inj_id", "is_train").orderBy(F.desc("ds")))
    made = made.withColumn("__b", back)
    held = F.avg(F.when(F.col("is_train") & (F.col("__b") <= last), F.col("alpha"))).over(w)
    pulled = F.when(F.col("is_train") | held.isNull(), F.col("alpha")).otherwise((1 - anchor) * F.col("alpha") + anchor * held)
    return made.withColumn("alpha", pulled).drop("__b")
