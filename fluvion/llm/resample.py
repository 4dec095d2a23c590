"""Importance resampling towards a target by hashed word features.

Texts are counted once: each becomes a row of a sparse matrix, document by bucket, compressed
(the buckets, the counts), and the rows are written. All else reads these rows, which no reader
holds more of than some thousands at once. Their column sums are the distributions of the
corpus and of the target; the logarithm of how much likelier the target is in a bucket is
that bucket's gain; and the matrix times the gains gives each document its weight. Seeded
Gumbel noise on the weights turns the highest scores into a draw without replacement.

Only the gains, one number for each bucket, come to the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvion.llm import scratch
from fluvion.llm.arrays import LOWER, buffers, slices
from fluvion.llm.scratch import map_batches, quoted

#: Bytes of words: digits, small letters (capitals are made small first), and all of other characters.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of a text that are cut into words at once.
PART_BYTES = 1 << 20


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a slice of texts, which of them each word is, and which text it is in."""
    table: dict[bytes, int] = {}
    which, texts, at, n = [], [], 0, len(data)
    while at < n:
        upto = min(n, at + PART_BYTES)
        while upto < n and WORD[LOWER[data[upto - 1]]]:  # no word is cut
            step = np.flatnonzero(~WORD[LOWER[data[upto : upto + 4096]]])
            upto = upto + int(step[0]) + 1 if len(step) else min(n, upto + 4096)
        low = LOWER[data[at:upto]]
        inside = WORD[low]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        borders = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, upto, "left")] - at
        begins[borders] = inside[borders]
        starts = np.flatnonzero(begins)
        if len(starts):
            sums = np.cumsum(inside)
            ends = np.append(sums[starts[1:]] - 1, sums[-1])
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(low[inside])])
            coded = packed.dictionary_encode()
            known = np.array([table.setdefault(w, len(table)) for w in coded.dictionary.to_pylist()], np.int64)
            which.append(known[coded.indices.to_numpy()])
            texts.append(np.searchsorted(offsets, starts + at, "right") - 1)
        at = upto
    none = [np.zeros(0, np.int64)]
    return list(table), np.concatenate(which or none), np.concatenate(texts or none)


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and of every feature, a run of 1 to ``longest`` words of one text
    joined by single spaces, its text and its bucket: crc32 of its bytes modulo ``buckets``."""
    distinct, which, text = words(data, offsets)
    n_words = np.bincount(text, minlength=len(offsets) - 1)
    sums = np.array([zlib.crc32(w) for w in distinct], np.int64)[which] if len(which) else which
    rows, cols, run = [text], [sums % buckets], sums
    for length in range(2, longest + 1):
        # A run's crc32 goes on from that of the run without its last word.
        keep = text[length - 1 :] == text[: -(length - 1)]
        pairs, place = np.unique(run[:-1] << 32 | which[length - 1 :], return_inverse=True)
        run = np.array([zlib.crc32(b" " + distinct[p & 0xFFFFFFFF], p >> 32) for p in pairs.tolist()], np.int64)[place] if len(pairs) else np.zeros(0, np.int64)
        rows.append(text[length - 1 :][keep])
        cols.append(run[keep] % buckets)
    return n_words, np.concatenate(rows), np.concatenate(cols)


def compressed(n: int, rows: np.ndarray, cols: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts (n + 1), buckets and counts of ``n`` compressed rows, buckets rising within a row."""
    cells, counts = np.unique(rows * buckets + cols, return_counts=True)
    return np.searchsorted(cells, np.arange(n + 1) * buckets), cells % buckets, counts


def matrix(df: DataFrame, id_col: str, text_col: str, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """The written rows: task and place (which row), i, n_words, and the row's buckets, rising, and
    counts; at most ``buckets`` of these. Null texts are empty rows."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "t"):
                data, offsets = buffers(part.column("t"))
                n_words, rows, cols = features(data, offsets, longest, buckets)
                starts, cells, counts = compressed(part.num_rows, rows, cols, buckets)
                lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(v, pa.int32())) for v in (cells, counts)]
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int32()), pa.array(np.arange(seen, seen + n), pa.int64()), part.column("i"), pa.array(n_words, pa.int64()), *lists], ["task", "place", "i", "n_words", "buckets", "counts"])
                seen += n

    rows = df.select(F.col(quoted(id_col)).alias("i"), F.col(quoted(text_col)).cast("string").alias("t"))
    made = map_batches(rows, run, f"task int, place long, i {kind}, n_words long, buckets array<int>, counts array<int>")
    return scratch.keep(made, "matrix")


def column_sums(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows of a written matrix. Each task adds its rows up
    and gives one row a bucket that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            cells, counts = (batch.column(c).flatten().to_numpy() for c in ("buckets", "counts"))
            np.add.at(total, cells, counts)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    sums = map_batches(rows.select("buckets", "counts"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for r in sums.collect():  # as many rows as buckets
        total[r["bucket"]] = r["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share of the target over that of the source, each
    bucket counted once more than it occurs."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * float(s_all + buckets) / ((s + 1) * float(t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """i, task, place (the row's place in its task), n_words, n_features and weight of all
    rows: the matrix times the gains."""
    kind = rows.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, counts = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("buckets", "counts"))
            starts = np.concatenate(([0], np.cumsum(batch.column("counts").value_lengths().to_numpy().astype(np.int64))))
            many, worth = (np.diff(np.concatenate(([0], np.cumsum(v)))[starts]) for v in (counts, counts * gain[cells]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("i", "task", "place", "n_words")), pa.array(many, pa.int64()), pa.array(worth, pa.int64())], ["i", "task", "place", "n_words", "n_features", "weight"])

    return map_batches(rows, run, f"i {kind}, task int, place long, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> F.Column:
    """floor(1000 times Gumbel noise) from the first eight hex digits h of the sha256 of ``seed:id``:
    -ln(-ln((h + 0.5) / 2^32)). A null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, draw: int) -> DataFrame:
    """Rank 1 to ``draw`` by falling score, ties by rising id (null ids last), then by place. The
    rows are sorted over all tasks and each counts its own; what stands in the tasks before is
    added, so no task sees all rows. The sorted rows are written, as their tasks must stay."""
    ordered = scored.orderBy(F.desc("score"), F.asc_nulls_last("i"), "task", "place").select("i", "task", "place")
    kind = scored.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("task"), batch.column("place"), pa.array([part] * n, pa.int32()), pa.array(np.arange(seen + 1, seen + n + 1), pa.int64())], ["task", "place", "part", "nth"])
            seen += n

    numbered = scratch.keep(map_batches(ordered, run, f"task int, place long, part int, nth long"), "ranks")
    counts = numbered.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each task of the sort.
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return numbered.join(F.broadcast(before), "part").select("task", "place", (F.col("nth") + F.col("before")).alias("rank")).where(F.col("rank") <= draw)


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Draw ``percent`` of the documents with at least ``least_words`` words (rounded down), as
    near to the target's distribution of features as chance and their weights make them.

    Words are runs of digits, letters a-z (A-Z are made small) and characters beyond ASCII;
    features are runs of 1 to ``longest`` of them. Returns id_col, n_features, weight (the sum of
    its features' gains), score (weight plus seeded noise), rank (from 1; null if not drawn).

    A null or empty text has no features and weight 0. A null id has the noise of an empty one
    and comes last among equal scores. Repeated rows are documents of their own; rows that are
    alike in score and id come in the order of their tasks and places. Other columns are not read,
    whatever their names. An empty table gives an empty result; an empty target is all
    smoothing. A text of any length is counted whole, in some ten times its memory.
    """
    counted = matrix(df, id_col, text_col, longest, buckets)
    wanted = matrix(target.select(F.lit(0).alias("i"), F.col(quoted(target_text)).alias("t")), "i", "t", longest, buckets)
    gain = gains(column_sums(counted, buckets), column_sums(wanted, buckets))
    scored = weights(counted, gain).withColumn("score", F.col("weight") + noise("i", seed))
    scored = scratch.keep(scored, "weights")
    eligible = scored.where(F.col("n_words") >= least_words)
    found = ranked(eligible, eligible.count() * percent // 100)
    joined = scored.join(found, ["task", "place"], "left")
    return joined.select(F.col("i").alias(id_col), "n_features", "weight", "score", "rank")
