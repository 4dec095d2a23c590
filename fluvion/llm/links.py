"""Connected components of a table of links, by star contraction, and roots of a forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvion.llm import scratch


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the smallest of each vertex and its neighbours among the links u-v."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """From links (u, v; long) to (id, component_id): the smallest id that each linked
    id reaches. Ids without links to others are absent; nulls and loops are no links.

    Large-star hangs every larger neighbour on a vertex's smallest one, small-star does
    so with the smaller ones; they alternate until nothing changes. Each round is joins
    and sums over linear tables; a hub's links are split like any skewed join.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = scratch.keep(edges, "links"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join's sides are plain shuffles and a hub's links can be split.
        large = both.join(scratch.keep(_least(both), "least"), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_least(large), "u")
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = scratch.keep(hung, "links")
    hubs = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(hubs)


def roots(parents: DataFrame) -> DataFrame:
    """From a forest (u, v; v < u is the parent of u, of which it has one) to (u, v: the root
    of u's tree). Each round halves the ways left; a parent of very many is one side of a
    join of two written tables, which can be split."""
    parents = scratch.keep(parents.select("u", "v"), "parents")
    while True:
        above = parents.select(F.col("u").alias("v"), F.col("v").alias("w"))
        moved = scratch.keep(parents.join(above, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved")), "parents")
        parents = moved.select("u", "v")
        if moved.where("moved").isEmpty():
            return parents
