"""Reading and writing of well data: histories, places, distances, results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def label(c: Column) -> Column:
    """A well's name as text: whole numbers without a fraction, other text trimmed."""
    number = c.try_cast("double")
    whole = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e15) & (number == F.floor(number))
    return F.when(whole, number.try_cast("bigint").cast("string")).otherwise(F.trim(c))


def well_history(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """The monthly history of wells from delimited text with a header: names in lower case
    (DATA is date), days first in dates, everything else a number or null. Rows without a
    readable date or a well are dropped, unnamed columns too; of rows with one well and
    date the first stays."""
    raw = spark.read.csv(path, sep=sep, header=True)
    named = [(c, {"data": "date"}.get(c.strip().lower(), c.strip().lower())) for c in raw.columns]
    named = [(c, n) for c, n in named if not n.startswith("unnamed") and not n.startswith("_c")]
    out = []
    for c, n in named:
        if n == "date":
            out.append(F.to_date(F.try_to_timestamp(F.col(f"`{c}`"), F.lit("dd.MM.yyyy"))).alias(n))
        elif n == "well":
            out.append(label(F.col(f"`{c}`")).alias(n))
        elif n == "type":
            out.append(F.upper(F.trim(F.col(f"`{c}`"))).alias(n))
        else:
            out.append(F.col(f"`{c}`").try_cast("double").alias(n))
    rows = raw.withColumn("__n", F.monotonically_increasing_id()).select(*out, "__n").where("date is not null and well is not null and well <> ''")
    first = Window.partitionBy("well", "date").orderBy("__n")
    return rows.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k", "__n")


def places_table(spark: SparkSession, path: str) -> DataFrame:
    """well, x, y, z from delimited text with these names in any case; a missing one raises."""
    raw = spark.read.csv(path, header=True)
    names = {c.strip().lower(): c for c in raw.columns}
    if missing := [c for c in ("well", "x", "y", "z") if c not in names]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return raw.select(label(F.col(f"`{names['well']}`")).alias("well"), *(F.col(f"`{names[c]}`").try_cast("double").alias(c) for c in "xyz"))


def places_text(spark: SparkSession, path: str) -> DataFrame:
    """well, x, y, z from lines "well x y z"; quotes are blanks, lines that begin with --
    are comments, lines with fewer words are skipped."""
    words = F.split(F.trim(F.translate("value", "'", " ")), r"\s+")
    lines = spark.read.text(path).where(~F.trim("value").startswith("--")).select(words.alias("w")).where(F.size("w") >= 4)
    return lines.select(label(F.col("w")[0]).alias("well"), *(F.col("w")[k].try_cast("double").alias(c) for k, c in enumerate("xyz", 1)))


def distance_matrix(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, d from a square table with wells as rows and as columns; empty cells are
    absent, columns x, y, z and unnamed ones no wells."""
    raw = spark.read.csv(path, header=True)
    key, *rest = raw.columns
    wells = [c for c in rest if c.strip().lower() not in ("x", "y", "z") and not c.strip().lower().startswith(("unnamed", "_c"))]
    cells = F.array(*(F.struct(label(F.lit(c)).alias("dst"), F.col(f"`{c}`").try_cast("double").alias("d")) for c in wells))
    long = raw.select(label(F.col(f"`{key}`")).alias("src"), F.inline(cells))
    return long.where("d is not null and not isnan(d)")


def with_distance(pairs: DataFrame, matrix: DataFrame, fallback: str = "d") -> DataFrame:
    """Pairs with the matrix's distance, else that of the reverse pair, else their own."""
    there = matrix.select(F.col("src").alias("prod_id"), F.col("dst").alias("inj_id"), F.col("d").alias("__a"))
    back = matrix.select(F.col("dst").alias("prod_id"), F.col("src").alias("inj_id"), F.col("d").alias("__b"))
    joined = pairs.join(there, ["prod_id", "inj_id"], "left").join(back, ["prod_id", "inj_id"], "left")
    return joined.withColumn("distance_m", F.coalesce("__a", "__b", fallback)).drop("__a", "__b")


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited text with a header; maps and arrays as JSON."""
    nested = ("map", "array", "struct")
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")  # noqa: E731  names may have dots, as q_0.5 has
    df.select(*(F.to_json(named(c)).alias(c) if k.startswith(nested) else named(c) for c, k in df.dtypes)).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def _plain(v: Any) -> Any:
    return None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v


def metrics_json(df: DataFrame, most: int = 10_000) -> str:
    """Rows of metrics as indented JSON; what isn't finite is null. A report is small: more than
    ``most`` rows raise, since they would all come to the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; write it with write_json")
    return json.dumps([{k: _plain(v) for k, v in r.asDict(True).items()} for r in rows], indent=2, default=str)


def write_json(df: DataFrame, path: str) -> None:
    """Rows of any number as JSON lines, written by the executors."""
    df.write.mode("overwrite").json(path)


def write_document(spark: SparkSession, tree: dict[str, Any], path: str) -> None:
    """One JSON document (settings, counts, spans of a run) as a text file of Spark's file
    system, keys in order."""
    text = json.dumps(tree, indent=2, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def run_metadata(settings: dict[str, Any], train: DataFrame, test: DataFrame, key: str, time: str) -> dict[str, Any]:
    """What a run's document says of its data: keys, spans and rows of both parts."""
    part = lambda df: df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.min(time).cast("string").alias("first"), F.max(time).cast("string").alias("last")).first().asDict()
    return {"settings": settings, "train": part(train), "test": part(test)}


def quality_document(report: DataFrame, issues: Sequence[str] = ("negative", "repeated", "gaps", "non_monotonic", "mostly_null", "outliers")) -> dict[str, Any]:
    """A quality report (check, column, value) as one document, with the checks that found
    something listed as issues."""
    rows = [(r["check"], r["column"], r["value"]) for r in report.collect()]
    tree: dict[str, Any] = {}
    for check, column, value in sorted(rows):
        tree.setdefault(check, {})[column or "all"] = value
    found = [f"{c} {col}".strip() for c, col, v in sorted(rows) if c in issues and v]
    return {"checks": tree, "issues": found, "passed": not found}


def discovered(spark: SparkSession, root: str, extensions: Sequence[str] = ("pdf", "docx", "html", "md", "txt")) -> DataFrame:
    """path, name, extension, size of all files below ``root`` with one of the extensions, in
    whatever case; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    return found.select("path", name.alias("name"), extension.alias("extension"), "size").where(F.col("extension").isin(*extensions))


def converted(documents: DataFrame, done: DataFrame | None, convert, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(documents converted by ``convert``, a report of key and status). Those in ``done`` (key)
    are skipped; a conversion that gives null has failed."""
    todo = documents if done is None else documents.join(done.select(key).distinct(), key, "left_anti")
    made = convert(todo)
    status = F.when(F.col("markdown").isNull(), "failed").otherwise("ok").alias("status")
    report = made.select(key, status)
    if done is not None:
        report = report.unionByName(documents.join(done.select(key).distinct(), key, "left_semi").select(key, F.lit("skipped").alias("status")))
    return made.where("markdown is not null"), report


class Cache:
    """Tables below a folder of Spark's file system, by name and by the settings they were made
    with. A table is there once it is written whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, **settings: Any) -> str:
        key = hashlib.md5(json.dumps(settings, sort_keys=True, default=str).encode(), usedforsecurity=False).hexdigest()
        return f"{self.root}/{name}-{key}"

    def _file(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def get(self, name: str, **settings: Any) -> DataFrame | None:
        at, system = self._file(self.path(name, **settings) + "/_SUCCESS")
        return self.spark.read.parquet(self.path(name, **settings)) if system.exists(at) else None

    def put(self, df: DataFrame, name: str, **settings: Any) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name, **settings))
        return self.spark.read.parquet(self.path(name, **settings))

    def made(self, make, name: str, **settings: Any) -> DataFrame:
        """What is there, or what ``make()`` gives, written first."""
        found = self.get(name, **settings)
        return self.put(make(), name, **settings) if found is None else found

    def clear(self) -> None:
        at, system = self._file(self.root)
        system.delete(at, True)


def flattened(tree: dict[str, Any], prefix: str = "") -> dict[str, Any]:
    """Nested settings as dotted names; lists as text."""
    out: dict[str, Any] = {}
    for k, v in tree.items():
        name = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, dict):
            out |= flattened(v, name)
        else:
            out[name] = str(v) if isinstance(v, list | tuple) else v
    return out
