"""Connected components of a graph given as edges, by alternating stars.

Each round links every node to the least label around it (large star), then the labels of its smaller neighbours
among each other (small star); the edges become stars around the least node of each component in O(log^2 n) rounds.
A node's least neighbour is a partial aggregate, and the join back is one that Spark splits where a node is hot, so
a hub with a third of all edges fits no single task. Every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ROUNDS = 60


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): every v of u, and u, with the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) of one ordered type; per node that has an edge: node, root (the least node of its component)."""
    now = scratch.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges0")
    before = None
    for k in range(1, ROUNDS):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both).filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        down = large.filter("a <> b").distinct().select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = _star(down)
        linked = small.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(small.select(F.col("m").alias("a"), F.col("u").alias("b")))
        now = scratch.table(linked.filter("a <> b").distinct(), f"edges{k}")
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if k > 1:
            scratch.drop(f"edges{k - 1}")
        if (sign.n, sign.s) == before:
            break
        before = (sign.n, sign.s)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
