"""Connected components of links in a few rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node, component (smallest node reachable) of every node that ``links`` (a, b) mention.

    Large-star and small-star steps in turn, which need about the logarithm of the longest path. Each step points the
    neighbours of a node at their smallest, by an aggregate with map-side combining and a join on the node (a hot node
    is split by Spark's skew join). Each round is written to the shared folder, so nothing is recomputed; only its row
    count and a checksum reach the driver. Raises if ``rounds`` don't suffice.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    for _ in range(rounds):
        edges = written(small_star(large_star(edges)), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFF)))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).withColumnRenamed("u", "c")
    return both.where("v > u").join(least, both["u"] == least["c"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node's smaller neighbours and the node itself to the smallest of them (``u`` is the larger end)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
    moved = edges.join(least, edges["u"] == least["c"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
