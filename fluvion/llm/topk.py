"""Exact top-k search by inner product with vector-approximation files.

Every dimension's range is cut into 256 equal cells, and a vector's approximation is
the cell of each component: one byte instead of eight. A scan of the approximations
alone bounds every inner product from both sides. A vector is of interest to a query only
if its upper bound reaches the query's k-th largest lower bound. Exact vectors are then read
by falling upper bound, in rounds that double, until the k-th best exact score of a query
beats the bound of whatever it has not read.

Components are whole numbers here, so scores are exact. Queries and vectors meet in a
grid of bounded blocks; only approximations travel there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvion.llm import scratch
from fluvion.llm.scratch import map_batches

#: Vectors and queries in a block of the grid.
VECTOR_ROWS, QUERY_ROWS = 8192, 1024
CELLS = 256
LONG_MOST = (1 << 63) - 1
#: Vectors that the first round reads for each of the k that are asked for.
FIRST_READS = 2


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _longs(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(-1, size)


def bounded_scan(q: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, lower, upper) of what may be among each query's k best of a
    block, with bounds of its score. own: pairs that are a query and itself."""
    middle = low + (cells + 0.5) * width
    half = np.abs(q) @ (width / 2)
    score = q @ middle.T
    # Doubles add up some rounding; the bounds make room for it.
    room = half + 1e-9 * (np.abs(q) @ np.abs(middle).max(axis=0, initial=0)) + 1
    score[own] = -np.inf
    if score.shape[1] > k:
        kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    else:
        kth = np.full(len(q), -np.inf)
    i, j = np.nonzero((score + 2 * room[:, None] >= kth[:, None]) & np.isfinite(score))
    return i, j, score[i, j] - room[i], score[i, j] + room[i]


def read_in_order(near: DataFrame, vectors: DataFrame, asked: DataFrame, k: int) -> tuple[DataFrame, int]:
    """The k best of each query and how many exact vectors were read for them. near:
    query_id, id, lower, upper, written."""
    by_lower = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    kth = near.withColumn("n", F.row_number().over(by_lower)).where(F.col("n") <= k).groupBy("query_id").agg(F.min("lower").alias("least"), F.count("*").alias("n"))
    wanted = near.join(kth, "query_id").where((F.col("n") < k) | (F.col("upper") >= F.col("least"))).select("query_id", "id", "upper")
    unread = scratch.keep(wanted, "topk-unread")
    score = F.aggregate(F.zip_with("v", "q", F.try_multiply), F.lit(0).cast("long"), F.try_add)
    # Null while a score is a long; scores beyond are the end of the longs, in the order of doubles.
    rough = F.aggregate(F.zip_with("v", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    by_upper = Window.partitionBy("query_id").orderBy(F.desc("upper"), "id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    best, width, reads = None, FIRST_READS * k, 0
    while True:
        # Of each query what stands next. Each task keeps as many before they meet, so that
        # no task orders all candidates of a query.
        ahead = unread.withColumn("n", F.row_number().over(by_upper)).where(F.col("n") <= width).select("query_id", "id")
        ahead = scratch.keep(ahead, "topk-next")
        pairs = ahead.join(vectors.select("id", "v"), "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        exact = pairs.select("query_id", F.col("id").alias("vec_id"), score.alias("score"), "v", "q")
        beyond = exact.withColumn("beyond", F.when(F.col("score").isNull(), rough))
        held = F.coalesce("score", F.when(F.col("beyond") > 0, F.lit(LONG_MOST)).otherwise(F.lit(-LONG_MOST - 1)))
        scores = scratch.keep(beyond.select("query_id", "vec_id", held.alias("score"), "beyond"), "topk-scores")
        reads += scores.count()
        found = scores if best is None else best.select("query_id", "vec_id", "score", "beyond").unionByName(scores)
        best = scratch.keep(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "topk-best")
        last = best.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
        # Only what can still beat a query's k-th best stays.
        unread = unread.join(last, "query_id").where((F.col("n") < k) | (F.col("upper") >= F.col("kth").cast("double"))).drop("kth", "n").join(ahead, ["query_id", "id"], "left_anti")
        unread = scratch.keep(unread, "topk-unread")
        if unread.isEmpty():
            return best, reads
        width *= 2


def search(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """The k highest inner products of each row of ``queries`` with the rows of ``df`` that
    have another id, over components floor(scale * x).

    Returns query_id (long), rank (int, from 1), vec_id (long), score (long). Ties go to the
    smaller id; a query gets all rows if there are fewer than k. Vectors that are null or
    hold null or non-finite components take no part, on either side, nor do null ids.
    Vectors meet only those of their own length. A row that is repeated counts once, a
    query that is repeated is answered once. An empty table gives an empty result.
    Scores are exact while their sums are longs, as they are for components below 2**24 in size; a
    score beyond is given as the nearest long, and such scores come in the order of their
    doubles. A scaled component beyond the longs counts as the nearest.
    """
    rows = lambda t: t.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(finite(F.col("v")) & F.col("id").isNotNull()).select("id", whole_numbers(F.col("v"), scale).alias("v")).withColumn("size", F.size("v"))
    # Of equal vectors only the k + 1 smallest ids can be among anyone's k best.
    equal = Window.partitionBy("v").orderBy("id")
    vectors = rows(df).distinct().withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k + 1).drop("n")
    vectors = scratch.keep(vectors, "topk-vectors")
    asked = scratch.keep(rows(queries).distinct(), "topk-queries")
    # One row per vector length; each has as many ranges as dimensions.
    parts = vectors.select("size", F.posexplode("v").alias("d", "x")).groupBy("size", "d").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    grids = {}
    for s in {r["size"] for r in parts}:
        mine = sorted((r["d"], r["low"], r["high"]) for r in parts if r["size"] == s)
        low, high = (np.array([m[c] for m in mine], np.float64) for c in (1, 2))
        grids[s] = (low, np.maximum(high - low, 1) / (CELLS - 1e-6))

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, lists = b.column("size").to_pylist(), b.column("v")
            values, ends = lists.flatten().to_numpy(), np.cumsum([0, *sizes])
            out = []
            for size, s, e in zip(sizes, ends[:-1], ends[1:]):
                low, width = grids[size]
                out.append(np.clip((values[s:e] - low) / width, 0, CELLS - 1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("size"), pa.array(out, pa.binary())], ["id", "size", "cells"])

    file = scratch.keep(map_batches(vectors.where("size > 0"), approximate, "id long, size int, cells binary"), "topk-file")
    n, m = file.count(), asked.count()
    if not n or not m:
        return asked.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vector_blocks, query_blocks = -(-n // VECTOR_ROWS), -(-m // QUERY_ROWS)
    spread = lambda t, own, others, names: t.withColumn(names[0], F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")).withColumn(names[1], F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    left = spread(file, vector_blocks, query_blocks, ("vb", "qb")).groupBy("size", "vb", "qb")
    right = spread(asked, query_blocks, vector_blocks, ("qb", "vb")).groupBy("size", "vb", "qb")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            i = j = lower = upper = np.zeros(0)
            ids = asking = np.zeros(0, np.int64)
        else:
            size = left.column("size")[0].as_py()
            low, width = grids[size]
            ids, asking = left.column("id").to_numpy(), right.column("id").to_numpy()
            cells = np.frombuffer(b"".join(left.column("cells").to_pylist()), np.uint8).reshape(-1, size)
            q = _longs(right.column("v"), size).astype(np.float64)
            i, j, lower, upper = bounded_scan(q, cells, low, width, k, asking[:, None] == ids)
        i, j = i.astype(np.int64), j.astype(np.int64)
        return pa.table({"query_id": asking[i], "id": ids[j], "lower": np.asarray(lower, np.float64), "upper": np.asarray(upper, np.float64)})

    near = left.cogroup(right).applyInArrow(scan, "query_id long, id long, lower double, upper double")
    near = scratch.keep(near, "topk-candidates")
    best, _ = read_in_order(near, vectors, asked, k)
    return best.select("query_id", "rank", "vec_id", "score")
