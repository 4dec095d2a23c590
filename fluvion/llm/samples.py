"""Bounded training samples and the batch scoring that the text classifiers share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvion.llm import scratch
from fluvion.llm.arrays import slices
from fluvion.llm.scratch import map_batches, numbered, trim

#: Bounds of what a fit reads: bytes of text in all, and of one text.
SAMPLE_BYTES, SAMPLE_TEXT = 48 << 20, 1 << 20


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def bounded(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of the id."""
    return rows.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(most)


def with_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, most_bytes: int = SAMPLE_BYTES, most_text: int = SAMPLE_TEXT) -> DataFrame:
    """One text (``__text``) for each of a bounded set of distinct ids, with the set's other
    columns: at most as many rows as ids, in at most ``most_bytes`` of text. Of the texts of
    an id on several rows the first in the order of strings counts; a text above
    ``most_text`` bytes, and what exceeds the bytes in the order of the id's hash, is not
    learned from. Written, as more than one job reads it."""
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    chosen = texts.join(F.broadcast(ids), id_col).groupBy(*ids.columns).agg(F.min("__text").alias("__text"))
    chosen = scratch.keep(chosen.withColumn("__bytes", F.octet_length("__text")).where(F.col("__bytes") <= most_text), "sample")
    # The window has one row for each of a bounded number of ids, and no texts.
    upto = F.sum("__bytes").over(Window.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)))
    inside = chosen.select(id_col, "__bytes").distinct().withColumn("__upto", upto).where(F.col("__upto") <= most_bytes).select(id_col)
    return chosen.join(F.broadcast(inside), id_col, "left_semi").drop("__bytes")


def fitted(sample: DataFrame, id_col: str, fit: Callable[[pa.Table], object]) -> object:
    """What ``fit`` makes of a bounded sample, in one task of an executor, so that the driver
    never holds the sample. The rows come in the order of the ids, whatever order the
    cluster returns them in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        table = pa.Table.from_batches(got).sort_by([(id_col, "ascending"), *((c, "ascending") for c in sorted(got[0].schema.names) if c != id_col)]) if got else pa.table({c: [] for c in names})
        del got
        model = pickle.dumps(fit(table))
        del table
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])
        trim()

    names = sample.columns
    rows = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else fit(pa.table({c: [] for c in names}))


def scored(df: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], dict[str, pa.Array]]], columns: str, keep_text: bool = False) -> DataFrame:
    """All columns of ``df``, of any names (the text only with ``keep_text``), plus ``columns`` (a DDL string), which the
    function that ``make`` returns computes from a slice of texts."""
    names = [c.split()[0].strip("`") for c in columns.split(",")]
    rest = [c for c in df.columns if (keep_text or c != text_col) and c not in names]
    rows = numbered(df, rest if keep_text else [*rest, text_col])
    text, keeps = f"c{rest.index(text_col) if keep_text else len(rest)}", rows.columns[: len(rest)]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keeps), columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            for part in slices(batch, text):
                out = score(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keeps), *(out[n] for n in names)], [*keeps, *names])

    return map_batches(rows, run, schema).toDF(*rest, *names)


def doubles(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.float64), pa.float64())
