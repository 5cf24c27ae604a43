"""Connected components by least labels and short-cuts, checkpointed in the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .saved import saved


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b); per node that has a link: node, root (the least node that it reaches)."""
    both = saved(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = saved(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"))
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        lower = labels.join(seen, F.col("node") == F.col("u")).select("node", F.least("root", "near").alias("root"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("far"))
        now = saved(lower.join(jump, "root", "left").select("node", F.coalesce("far", "root").alias("root")))
        changed = now.alias("n").join(labels.alias("l"), "node").filter("n.root <> l.root").limit(1).count()
        labels = now
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
