"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so a packing is decided from the count of
pieces of each length, which is small however large the corpus is. Pieces above one
third of the capacity, of which two fit a sequence at most, are matched greedily;
smaller ones go, longest first, where they leave the least gap. The outcome is a list of
slots: so many sequences have a piece of this length at this place. Every piece then
finds its sequence from its rank among the pieces of its length. Ranks come from
counts by task, so no task ever sees all pieces of a length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvion.llm import scratch
from fluvion.llm.arrays import slices, strings
from fluvion.llm.bpe import codec
from fluvion.llm.scratch import map_batches


@dataclass
class Group:
    """``count`` sequences that are filled alike: the lengths in order, and the gap."""

    count: int
    filled: tuple[int, ...]
    gap: int


def match_large(counts: dict[int, int], capacity: int) -> list[Group]:
    """Greedy matching of pieces above a third of the capacity: each, longest first,
    takes the longest other that fits beside it."""
    left = {s: c for s, c in counts.items() if 3 * s > capacity and c > 0}
    order = sorted(left, reverse=True)
    groups = []
    for s in order:
        while left[s]:
            mate = next((m for m in order if m + s <= capacity and m <= s and left[m] > (m == s)), None)
            if mate is None:
                groups.append(Group(left[s], (s,), capacity - s))
                left[s] = 0
            else:
                n = left[s] // 2 if mate == s else min(left[s], left[mate])
                groups.append(Group(n, (s, mate), capacity - s - mate))
                left[s] -= n
                left[mate] -= n
    return groups


def best_fit(groups: list[Group], counts: dict[int, int], capacity: int) -> list[Group]:
    """Put the other pieces, longest first, into the smallest gap that holds them."""
    gaps: dict[int, list[Group]] = {}
    for g in groups:
        gaps.setdefault(g.gap, []).append(g)
    for s in sorted((s for s, c in counts.items() if 3 * s <= capacity and c > 0), reverse=True):
        n = counts[s]
        heap = [g for g in gaps if g >= s and gaps[g]]
        heapq.heapify(heap)
        while n and heap:
            gap = heap[0]
            g = gaps[gap].pop()
            if not gaps[gap]:
                heapq.heappop(heap)
            used = min(n, g.count)
            if used < g.count:
                gaps[gap].append(Group(g.count - used, g.filled, gap))
            n -= used
            put = Group(used, (*g.filled, s), gap - s)
            if put.gap >= s and not gaps.get(put.gap):
                heapq.heappush(heap, put.gap)
            gaps.setdefault(put.gap, []).append(put)
        each = capacity // s
        if full := n // each:
            gaps.setdefault(capacity - s * each, []).append(Group(full, (s,) * each, capacity - s * each))
        if rest := n % each:
            gaps.setdefault(capacity - s * rest, []).append(Group(1, (s,) * rest, capacity - s * rest))
    return [g for same in gaps.values() for g in same if g.count]


def slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) of all slots. Ranks count from
    0 within a length; the k-th rank of a slot goes to the k-th sequence of its group."""
    groups = best_fit(match_large(counts, capacity), counts, capacity)
    taken: dict[int, int] = dict.fromkeys(counts, 0)
    out, sequence = [], 0
    for g in groups:
        place = 0
        for s in g.filled:
            out.append((s, taken[s], g.count, sequence, place))
            taken[s] += g.count
            place += s
        sequence += g.count
    return out


def pieces(df: DataFrame, path: str, pattern: str, id_col: str, text_col: str, capacity: int, end_id: int, digest_only: bool) -> DataFrame:
    """Pieces of all documents: id, piece, start, length, ids (binary; with ``digest_only``
    ids_crc32), and the task and the rank among the task's pieces of that length,
    counted as they come."""
    kind = df.schema[id_col].dataType.simpleString()
    name, what = ("ids_crc32", "long") if digest_only else ("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, task, tail = codec(path, pattern), TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                row, piece, start, length, ids, rank = [], [], [], [], [], []
                for k, text in enumerate(strings(part.column("t")).to_pylist()):
                    coded = c.encode(text) + tail
                    n = len(coded) // 4
                    at, number, upto = 0, 0, n % capacity or capacity
                    while at < n:
                        row.append(k)
                        piece.append(number)
                        start.append(at)
                        length.append(upto - at)
                        part_ids = coded[4 * at : 4 * upto]
                        ids.append(zlib.crc32(part_ids) if digest_only else part_ids)
                        rank.append(int(seen[upto - at]))
                        seen[upto - at] += 1
                        at, upto, number = upto, upto + capacity, number + 1
                yield pa.RecordBatch.from_arrays([part.column("i").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.int64() if digest_only else pa.binary()), pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())], ["i", "piece", "start", "length", name, "task", "rank"])

    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return map_batches(rows, run, f"i {kind}, piece int, start long, length long, {name} {what}, task int, rank long")


def place(kept: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset (long) to a written table of pieces.

    ``kept`` must not change between reads: tasks and ranks in it are facts, not order.
    """
    spark = kept.sparkSession
    by_task = kept.groupBy("length", "task").agg(F.count("*").alias("n"))
    by_task = scratch.keep(by_task, "packing-counts")
    # At most ``capacity`` rows, whatever the corpus.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    base = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = by_task.select("length", "task", base.alias("base"))
    plan = np.array(sorted(slots(counts, capacity)), np.int64).reshape(-1, 5)
    # The slots of one length, as arrays in one row: as many rows as lengths.
    each = [(int(s), *(plan[plan[:, 0] == s, k].tolist() for k in (1, 3, 4))) for s in np.unique(plan[:, 0])]
    table = spark.createDataFrame(each, "length long, ranks array<long>, sequences array<long>, offsets array<long>")
    starts = bases.join(F.broadcast(table), "length")
    ranked = kept.join(starts, ["length", "task"]).withColumn("r", F.col("rank") + F.col("base"))
    # Slots stand by their first rank: the last that begins at or before r holds it.
    slot = F.expr("size(filter(ranks, x -> x <= r))")
    ranked = ranked.withColumn("slot", slot)
    return ranked.select(*kept.columns, (F.element_at("sequences", F.col("slot")) + F.col("r") - F.element_at("ranks", F.col("slot"))).alias("sequence_id"), F.element_at("offsets", F.col("slot")).alias("offset")).drop("task", "rank")


def pack(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, digest_only: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document is the ids of its text, then ``end_id``; only longer ones are cut, into
    pieces of ``capacity``, of which the first may be shorter. Returns per piece: id_col,
    piece, start, length, ids (binary, little-endian unsigned 32-bit; with
    ``digest_only`` ids_crc32 instead), sequence_id, offset.

    A null or empty text is one piece of one token. Null ids and repeated rows are
    documents of their own. Equal lengths may be exchanged between sequences from run to
    run. Other columns are not read. An empty table gives an empty result. A text of any
    length is encoded whole.
    """
    kept = scratch.keep(pieces(df, path, pattern, id_col, text_col, capacity, end_id, digest_only), "packing-pieces")
    return place(kept, capacity).withColumnRenamed("i", id_col)
