"""A whole run as one call: load, check, validate, forecast, evaluate, write."""

from __future__ import annotations

import dataclasses
import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvion.operators import conformal, folds, metrics, panel, quality
from fluvion.sources import files, sheets
from fluvion.sources.lineage import cut

#: Columns of a history, beside the rate, without which a row says nothing, and those that are 0 where a history hasn't them.
REQUIRED, OPTIONAL = ("well", "date", "type"), ("womr", "wwir", "wthp")


@dataclass(frozen=True)
class Settings:
    """least: months that a producer must have; conformal: method, alpha, decay, whether by step, and the least
    errors of a step (conformal.profile); folds: layout, features and model."""

    least: int = 60
    method: str = "wcp_exp"
    alpha: float = 0.1
    decay: float = 0.97
    per_horizon: bool = True
    samples: int = 30
    folds: folds.Settings = field(default_factory=folds.Settings)


def load_places(spark: SparkSession, path: str) -> DataFrame:
    """well, x, y, z from a spreadsheet (.xlsx), delimited text (.csv) or lines of words."""
    reader = {"xlsx": sheets.places_sheet, "csv": files.places_table}.get(path.rsplit(".", 1)[-1].lower(), files.places_text)
    return reader(spark, path)


def regular(history: DataFrame, least: int) -> DataFrame:
    """well, ds, type, wlpr, womr, wwir, wthp: a row for each month of a well from its first to its last. Missing rates of
    producers are the last known ones, injectors' 0, pressures the last known or else the next ones. A well is
    what its last row says; producers with fewer than ``least`` rows are left out."""
    rows = history.select("well", F.trunc("date", "month").alias("ds"), "date", "type", "wlpr", *((F.col(c) if c in history.columns else F.lit(0.0)).cast("double").alias(c) for c in OPTIONAL))
    rows = panel.keep_first(rows, ["well", "ds"], ["date"]).drop("date")
    kinds = rows.groupBy("well").agg(F.max_by("type", "ds").alias("type"), F.count("*").alias("__n")).where((F.col("type") == "INJ") | ((F.col("type") == "PROD") & (F.col("__n") >= least))).drop("__n")
    grid = panel.reindex(rows.drop("type"), "well", "ds").join(kinds, "well")
    filled = panel.both_fill(panel.forward_fill(grid.withColumn("wwir", F.coalesce("wwir", F.lit(0.0))), "well", "ds", ["wlpr", "womr"]), "well", "ds", ["wthp"])
    zero = F.col("type") == "INJ"
    return filled.select("well", "ds", "type", *(F.when(zero, 0.0).otherwise(F.col(c)).alias(c) for c in ("wlpr", "womr")), F.when(zero, F.col("wwir")).otherwise(0.0).alias("wwir"), F.coalesce("wthp", F.lit(0.0)).alias("wthp"))


@dataclass
class Outcome:
    """forecast: unique_id, ds, h_step, y_hat, q_*, cp_*; merged: with y; summary and alpha: pairs of wells (None without
    injection); profile: half widths by step; document: what metrics.json holds."""

    forecast: DataFrame
    merged: DataFrame
    summary: DataFrame
    alpha: DataFrame | None
    profile: DataFrame
    document: dict


def forecast(rows: DataFrame, places: DataFrame, settings: Settings = Settings()) -> Outcome:
    """The last months of all producers, forecast from those before: validated by folds within these, with conformal
    intervals from the folds' residuals. rows: see regular; places: well, x, y, z."""
    s = settings.folds
    placed = places.join(rows.groupBy("well").agg(F.max("type").alias("type")), "well")
    rows = cut(rows.join(placed.select("well"), "well", "left_semi"))
    producers = panel.split(rows.where("type = 'PROD'"), "well", "ds", s.horizon)
    cutoff = producers.agg(F.max("train_cutoff")).first()[0]
    if cutoff is None:
        raise ValueError("no producer with a place has enough months")
    until = producers.agg(F.max("ds")).first()[0]
    known = cut(folds.validate(rows.where(F.col("ds") <= F.lit(cutoff)), placed, s, ("global",))["global"])
    profile = cut(folds.calibrate(known, s.horizon, settings.method, settings.alpha, settings.decay, settings.per_horizon, settings.samples))
    whole = folds.Folds({0: cutoff}, {0: until})
    part = producers.drop("train_cutoff").withColumn("part", F.when(F.col("part") == "train", "train").otherwise("val")).withColumn("fold", F.lit(0))
    injectors = rows.where("type = 'INJ'").withColumn("fold", F.lit(0))
    made, injection = folds.keyed_features(part, injectors, placed, whole, s)
    made = cut(made)
    ahead = folds.global_forecast(made, "well", "ds", "wlpr", s.model)[0].drop("fold").withColumnRenamed("well", "unique_id")
    ahead = cut(conformal.apply(ahead, profile, s.horizon))
    facts = made.where("part = 'val'").select(F.col("well").alias("unique_id"), "ds", F.col("wlpr").alias("y"))
    merged = cut(conformal.merge_forecast(ahead, facts).join(ahead.select("unique_id", "ds", "h_step"), ["unique_id", "ds"]))
    plain = lambda df: [{k: files._plain(v) for k, v in r.asDict().items()} for r in df.collect()]
    document = {
        "train_cutoff": str(cutoff),
        "overall": plain(metrics.evaluate(merged))[0],
        "by_horizon": plain(metrics.evaluate(merged, ["h_step"], least=2).orderBy("h_step")),
        "reliability": plain(metrics.reliability(merged, 1 - settings.alpha))[0],
        "cv_by_fold": plain(metrics.evaluate(known, ["fold"]).orderBy("fold")),
        "conformal": plain(profile.orderBy("h_step")),
    }
    strip = lambda df: df.withColumns({c: folds.without_fold(c) for c in ("prod_id", "inj_id")})
    return Outcome(ahead, merged, strip(injection.summary), strip(injection.alpha) if injection.alpha is not None else None, profile, document)


def run(spark: SparkSession, history: str, places: str, out: str, settings: Settings = Settings()) -> Outcome:
    """Read the history and places, check them, forecast, and write below ``out``: predictions (CSV), metrics by
    well (JSON lines), metrics.json, metadata and the quality report (JSON documents), the pairs' summary (CSV) and their
    weights by month (Parquet). Rows that break a rule, and wells that stand twice, raise."""
    raw = cut(files.well_history(spark, history))
    quality.require_valid(raw, (*REQUIRED, *(["wlpr"] if "wlpr" not in raw.columns else [])), ("PROD", "INJ"))  # a rate may be null
    at = cut(quality.require_places(load_places(spark, places), "well"))
    rows = cut(regular(raw, settings.least))
    made = forecast(rows, at, settings)
    report = quality.quality_report(raw, "well", "date", [c for c in ("wlpr", *OPTIONAL) if c in raw.columns])
    cutoff = datetime.date.fromisoformat(made.document["train_cutoff"])
    producers = rows.where("type = 'PROD'")
    files.write_csv(made.forecast, f"{out}/predictions")
    files.write_json(metrics.evaluate(made.merged, ["unique_id"]), f"{out}/metrics_by_well")
    files.write_document(spark, made.document, f"{out}/metrics.json")
    files.write_document(spark, files.quality_document(report), f"{out}/quality.json")
    files.write_document(spark, files.run_metadata(dataclasses.asdict(settings), producers.where(F.col("ds") <= F.lit(cutoff)), producers.where(F.col("ds") > F.lit(cutoff)), "well", "ds"), f"{out}/metadata.json")
    files.write_csv(made.summary, f"{out}/pair_summary")
    if made.alpha is not None:
        files.write_parquet(made.alpha, f"{out}/alpha")
    return made
