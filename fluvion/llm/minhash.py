"""MinHash near-duplicates by tensored banding.

Two small collections of minhash keys are computed for each document. A table key is a
pair, one key from each collection, so m keys a side make m * m tables for 2 * m keys'
work. Documents that share a table key are candidates; which of them are linked is
decided on their full shingle sets.

Rows with the same set are one node. Candidates are verified in three steps, of which the
first two are linear in the rows of the tables. First each node meets the smallest
candidate of all its tables; the links found make a forest, whose roots stand for
their trees. Then every node meets the smallest of each of its tables, unless both hang on
one root by now. What remains are tables of three nodes and more whose nodes are not all
linked: the nodes of these are joined in units of bounded size, those of the largest
class against the others and the others against each other, never the
largest class against itself. So a group of near copies costs about as much as it has
table rows, and only mutual candidates that are not linked cost a square. Where many tables
hang together in a chain, what meets is what shares tables with one node, not all of the chain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvion.llm import scratch
from fluvion.llm.arrays import U64, Words, buffers, joined, mix, runs, slices
from fluvion.llm.links import components, roots
from fluvion.llm.scratch import map_batches

#: Minhashes in a key, and the share of pairs at the threshold that may be missed.
KEY_HASHES, MISSED = 4, 2e-5
#: Nodes, and shingles, in a part of a block.
PART_DOCS, PART_SHINGLES = 512, 400_000
#: Nodes outside its most frequent class up to which tables that hang together are one block.
WIDE_DOCS = 2048


def collection_size(similarity: float, rows: int = KEY_HASHES, missed: float = MISSED) -> int:
    """Keys in each collection so that a pair at ``similarity`` shares one in both with
    probability 1 - ``missed``."""
    return max(2, math.ceil(math.log(missed / 2) / math.log(1 - similarity**rows)))


class Signer:
    """Shingle sets of a batch of texts, and their keys."""

    def __init__(self, words: int, keys: int, rows: int = KEY_HASHES):
        rng = np.random.default_rng(4242)
        self.words, self.keys, self.rows = words, keys, rows
        self.factors = rng.integers(0, 1 << 31, 2 * keys * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.shifts = rng.integers(0, 1 << 32, 2 * keys * rows, dtype=np.uint32)

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        """Of each text, its distinct shingles' fingerprints, sorted."""
        w = Words(*buffers(column), lower=True)
        out, shingles = [], runs(w.prints, self.words)
        for a, b in zip(w.first[:-1], w.first[1:]):
            if b - a >= self.words:
                out.append(np.unique(shingles[a : b - self.words + 1]))
            elif b > a:  # fewer words: the whole sequence is the one shingle
                x = np.full(1, b - a, U64)
                for k in range(a, b):
                    x = joined(x, w.prints[k : k + 1])
                out.append(x)
            else:
                out.append(np.zeros(0, U64))
        return out

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """Keys of each set, sets by 2 * keys: first one collection, then the other.
        Empty sets have zeros."""
        out = np.zeros((len(sets), 2 * self.keys), U64)
        full = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
        if not len(full):
            return out
        x = np.concatenate([sets[k] for k in full])
        x = (x ^ (x >> U64(32))).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(sets[k]) for k in full])[:-1]))
        for key in range(2 * self.keys):
            made = np.full(len(full), key, U64)
            for k in range(key * self.rows, (key + 1) * self.rows):
                t = x ^ self.shifts[k]
                t *= self.factors[k]
                t ^= t >> np.uint32(15)
                t *= np.uint32(0x2C1B3C6D)
                made = mix(made * U64(0xD6E8FEB86659FD93) + np.minimum.reduceat(t, starts))
            out[full, key] = made
        return out


def set_fingerprints(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits of each sorted set."""
    out = []
    for s in sets:
        a = mix(s + U64(0x632BE59BD9B4E019)).sum(dtype=U64)
        b = mix(s ^ U64(0x9E3779B97F4A7C15)).sum(dtype=U64)
        out.append(np.array([a, b], U64).tobytes())
    return out


def signed(df: DataFrame, id_col: str, text_col: str, signer: Signer) -> DataFrame:
    """id, n_shingles, print (binary, of the set), keys (array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                sets = signer.sets(part.column("t"))
                keys = signer.signatures(sets).view(np.int64)
                offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_fingerprints(sets), pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel(), pa.int64()))], ["id", "n_shingles", "print", "keys"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), run, "id long, n_shingles long, print binary, keys array<long>")


def tables(nodes: DataFrame, keys: int) -> DataFrame:
    """node, t: the tables that hold a node, of those that two keys of other nodes reach."""
    one = nodes.select("node", F.posexplode("keys").alias("k", "key"))
    shared = one.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1").select("k", "key")
    mine = one.join(shared, ["k", "key"]).select("node", F.struct("k", "key").alias("x"), (F.col("k") < keys).alias("left"))
    sides = mine.groupBy("node").agg(F.collect_list(F.when(F.col("left"), F.col("x"))).alias("a"), F.collect_list(F.when(~F.col("left"), F.col("x"))).alias("b"))
    return sides.select("node", F.explode("a").alias("a"), "b").select("node", "a", F.explode("b").alias("b")).select("node", F.xxhash64("a", "b").alias("t"))


def full_sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, signer: Signer) -> DataFrame:
    """node, n, set (array of long) of the nodes in ``wanted`` (node, rep, print), from the
    texts of their smallest ids."""
    texts = df.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("t")).join(wanted, "rep").select("node", "print", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                sets = signer.sets(part.column("t"))
                same = [a == b for a, b in zip(set_fingerprints(sets), part.column("print").to_pylist())]  # an id may have several texts
                sets = [s for s, k in zip(sets, same) if k]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32())
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("node").filter(pa.array(same)), pa.ListArray.from_arrays(offsets, pa.array(values))], ["node", "set"])

    return map_batches(texts, run, "node long, set array<long>").groupBy("node").agg(F.first("set").alias("set")).select("node", F.size("set").alias("n"), "set")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) with 100 * intersection >= percent * union."""
    a, b = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("set").alias("su")), sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("set").alias("sv"))
    met = pairs.join(a, "u").join(b, "v").where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    both = F.size(F.array_intersect("su", "sv"))
    return met.where(100 * both >= percent * (F.col("nu") + F.col("nv") - both)).select("u", "v")


def same_enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def first_shared(a: list[int], b: list[int]) -> int | None:
    """The smallest value of two sorted lists."""
    return min(set(a) & set(b), default=None) if a[0] != b[0] else a[0]


def unit_links(ids: np.ndarray, sides: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], signatures: np.ndarray, percent: int, blocks: list[list[int]], block: int) -> list[tuple[int, int]]:
    """Links that connect what is linked within a unit: a forest over verified pairs.
    sides: 0 and 1 for the two parts (all 0: one part against itself); labels: the
    classes known before, within which no pair is looked at; blocks: of each node, sorted. A
    pair that meets in several blocks is verified in the first of these."""
    n, keys = len(ids), signatures.shape[1] // 2
    two = bool(sides.any())
    rows, cols = (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)) if two else (np.arange(n), np.arange(n))
    label = np.unique(labels, return_inverse=True)[1]
    found_a, found_b, found_e = [], [], []
    for at in range(0, len(rows), 256):
        r = rows[at : at + 256]
        left = np.zeros((len(r), len(cols)), np.uint8)
        right = np.zeros_like(left)
        for k in range(keys):
            left += signatures[r, k][:, None] == signatures[cols, k]
            right += signatures[r, keys + k][:, None] == signatures[cols, keys + k]
        hit = (left > 0) & (right > 0) & (label[r][:, None] != label[cols])
        if not two:
            hit &= cols > r[:, None]
        i, j = np.nonzero(hit)
        found_a.append(r[i])
        found_b.append(cols[j])
        found_e.append(left[i, j].astype(np.int32) + right[i, j])
    a, b, estimate = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b, found_e))
    order = np.argsort(-estimate, kind="stable")
    a, b = a[order], b[order]
    links = []
    while len(a):  # pairs connected by now go at once, the rest in order
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        done = 0
        for x, y in zip(a[:4096].tolist(), b[:4096].tolist()):
            done += 1
            if label[x] != label[y] and first_shared(blocks[x], blocks[y]) == block and same_enough(sets[x], sets[y], percent):
                links.append((int(ids[x]), int(ids[y])))
                lo, hi = sorted((label[x], label[y]))
                label[label == hi] = lo
        a, b = a[done:], b[done:]
    return links


def blocks_of(rest: DataFrame) -> DataFrame:
    """node, label, block: which nodes of mixed tables meet. rest: t, node, label, v (the table's
    smallest node), written tables.

    Tables that hang together are one block while few of its nodes, WIDE_DOCS at most, have
    another label than its most frequent one. Beyond that a block is what shares tables with one smallest node, so that
    work follows the tables and not the square of all that hangs together; a node is then in
    as many blocks as its tables have smallest nodes.
    """
    found = components(rest.select(F.col("node").alias("u"), "v"))
    members = rest.select("node", "label").distinct().join(found.select(F.col("id").alias("node"), F.col("component_id").alias("block")), "node")
    members = scratch.keep(members, "minhash-blocks")
    others = members.groupBy("block", "label").agg(F.count("*").alias("n")).groupBy("block").agg((F.sum("n") - F.max("n")).alias("others"))
    wide = scratch.keep(members.join(others.where(F.col("others") > WIDE_DOCS), "block").select("block", "node"), "minhash-wide")
    if wide.isEmpty():
        return members
    # A star's number is a node of its own component, whose number is no longer in use.
    stars = rest.join(wide.select("node"), "node", "left_semi").select("node", "label", F.col("v").alias("block")).distinct()
    return scratch.keep(members.join(wide.select("block").distinct(), "block", "left_anti").select("node", "label", "block").unionByName(stars), "minhash-blocks")


def rest_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: links between nodes of a block that have different labels. members: node,
    label, block, written."""
    known = sets.join(members, "node")
    by_label = known.groupBy("block", "label").agg(F.count("*").alias("n"), F.sum("n").alias("s"))
    parts = lambda n, s: F.greatest(F.lit(1), F.ceil(n / PART_DOCS), F.ceil(s / PART_SHINGLES)).cast("int")
    top = by_label.groupBy("block").agg(F.max(F.struct("n", "s", "label")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    plan = top.select("block", F.col("top.label").alias("main"), parts(F.col("top.n"), F.col("top.s")).alias("mains"), parts(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("others"))
    plan = scratch.keep(plan, "minhash-plan")
    placed = members.join(plan, "block").withColumn("large", F.col("label") == F.col("main"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("large"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    unit = lambda low, high, kind, side: F.struct(low.alias("low"), high.alias("high"), F.lit(kind).alias("main"), side.cast("int").alias("side"))
    against = F.transform(upto(F.col("others")), lambda i: unit(i, F.col("part"), 1, F.lit(1)))
    facing = F.transform(upto(F.col("mains")), lambda j: unit(F.col("part"), j, 1, F.lit(0)))
    among = F.transform(upto(F.col("others")), lambda i: unit(F.least("part", i), F.greatest("part", i), 0, F.col("part") > i))
    dealt = placed.withColumn("unit", F.explode(F.when(F.col("large"), against).otherwise(F.concat(facing, among))))
    homes = members.groupBy("node").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    units = dealt.select("node", "label", "block", "unit.*").join(sets.select("node", "set"), "node").join(nodes.select("node", "keys"), "node").join(homes, "node")

    def join(table: pa.Table) -> pa.Table:
        lists = lambda name: [np.asarray(x, np.int64).view(U64) for x in table.column(name).to_pylist()]
        ids, sides, labels = (table.column(c).to_numpy() for c in ("node", "side", "label"))
        found = unit_links(ids, sides, labels, lists("set"), np.stack(lists("keys")), percent, table.column("blocks").to_pylist(), table.column("block")[0].as_py())
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return units.groupBy("block", "main", "low", "high").applyInArrow(join, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Link documents whose shingle sets of ``words`` words have 100 * intersection >=
    percent * union. Words are lower-cased (A-Z) runs of other than 0x20, 0x09-0x0D; with
    fewer words the whole sequence is one shingle.

    Returns id_col (long), n_shingles (long), component_id (long: the smallest id
    reachable, itself included) and kept (boolean: it is that id), one row for each row.

    Texts that are null or without words have no shingles and link with nothing, as do
    rows with a null id (component null, kept true). An id on several rows is one document:
    it is linked by each of its texts, and all its rows get the same component.
    Other columns are not read. An empty table gives an empty result. Copies are found whatever
    their number; a pair at exactly the threshold is missed with probability MISSED, a
    nearer one with less. Shingles are compared by 64 bits, sets that are equal by 128,
    made from hashes of the words. A text of any length is read whole; a task needs some 40
    bytes a word of its longest text beside the text itself.
    """
    keys = collection_size(percent / 100)
    signer = Signer(words, keys)
    signs = scratch.keep(signed(df, id_col, text_col, signer), "minhash-signatures")
    full = signs.where("n_shingles > 0 and id is not null")
    nodes = full.groupBy("print").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"))
    # The numbers are facts once they are written. Joins below are of written tables, so
    # that both sides are plain shuffles and a class with very many rows can be split.
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "minhash-sets")
    copies = scratch.keep(full.select("id", "n_shingles", "print").join(nodes.select("print", "node", "rep"), "print").drop("print"), "minhash-copies")

    table = scratch.keep(tables(nodes, keys), "minhash-tables")
    least = table.groupBy("t").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1")
    least = scratch.keep(least, "minhash-least")
    edges = scratch.keep(table.join(least, "t").where("node <> v").select(F.col("node").alias("u"), "v").distinct(), "minhash-candidates")
    wanted = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    sets = scratch.keep(full_sets(df, nodes.select("node", "rep", "print").join(wanted, "node", "left_semi"), id_col, text_col, signer), "minhash-full")

    first = edges.groupBy("u").agg(F.min("v").alias("v"))
    trees = roots(linked(first, sets, percent))
    root = lambda c: trees.select(F.col("u").alias(c), F.col("v").alias(f"{c}_root"))
    at_roots = lambda pairs: pairs.join(root("u"), "u", "left").join(root("v"), "v", "left").select("u", "v", F.coalesce("u_root", "u").alias("a"), F.coalesce("v_root", "v").alias("b")).where("a <> b")
    second = scratch.keep(linked(at_roots(edges.join(first, ["u", "v"], "left_anti")).select("u", "v"), sets, percent), "minhash-links")
    several = scratch.keep(copies.groupBy("id").agg(F.min("node").alias("v"), F.max("node").alias("most")).where("v < most").select("id", "v"), "minhash-several")
    same_id = copies.join(several, "id").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    labels = _labelled(trees, at_roots(second.unionByName(same_id)))

    open_tables = table.join(least.where("n > 2").select("t"), "t").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_tables = scratch.keep(open_tables, "minhash-open")
    mixed = scratch.keep(open_tables.groupBy("t").agg(F.min("node").alias("v"), (F.min("label") < F.max("label")).alias("mixed")).where("mixed").select("t", "v"), "minhash-mixed")
    if not mixed.isEmpty():
        rest = open_tables.join(mixed, "t")
        more = rest_links(blocks_of(rest), nodes, sets, percent)
        of = labels.select(F.col("node").alias("u"), F.col("label").alias("a")), labels.select(F.col("node").alias("v"), F.col("label").alias("b"))
        more = more.join(of[0], "u", "left").join(of[1], "v", "left").select("u", "v", F.coalesce("a", "u").alias("a"), F.coalesce("b", "v").alias("b")).where("a <> b")
        labels = _labelled(labels.select(F.col("node").alias("u"), F.col("label").alias("v")), more)

    smallest = labels.join(nodes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("component_id"))
    smallest = scratch.keep(smallest, "minhash-smallest")
    component = scratch.keep(labels.join(smallest, "label").select("node", "component_id"), "minhash-components")
    found = copies.join(component, "node", "left").select("id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    empty = signs.where("n_shingles = 0 and id is not null").select("id", "n_shingles")
    also = found.join(empty.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("component_id").alias("component_id"))
    found = found.unionByName(empty.join(also, "id", "left").withColumn("component_id", F.coalesce("component_id", "id")))
    unnamed = signs.where("id is null").select("id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = found.unionByName(unnamed).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    return out.withColumnRenamed("id", id_col)


def _labelled(trees: DataFrame, links: DataFrame) -> DataFrame:
    """node, label: trees (u, v: its root) joined by links between roots (a, b). Nodes
    without links are absent."""
    classes = scratch.keep(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "minhash-roots")
    hung = trees.join(classes.withColumnRenamed("id", "v"), "v", "left").select(F.col("u").alias("node"), F.coalesce("component_id", "v").alias("label"))
    tops = hung.unionByName(classes.select(F.col("id").alias("node"), F.col("component_id").alias("label")))
    return scratch.keep(tops.unionByName(hung.select(F.col("label").alias("node"), "label")).distinct(), "minhash-labels")
