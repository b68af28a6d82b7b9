"""Connected components by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import cut


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One step over rows (u, v) with u > v.

    Each node learns the smallest node m among its neighbours (large star: all of them; small
    star: the smaller ones) and itself, and links its larger (small star: its own) side to m.
    The smallest is a partial aggregate, so a node with very many links is no hot spot."""
    seen = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = seen.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    least = least.select("node", F.least("node", "m").alias("m"))
    joined = seen.join(least, seen["u"] == least["node"]).select("u", "v", "m")
    if large:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return linked.where("u > v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b) but the roots; a root is its component's smallest node."""
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before = None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before or state[0] == 0:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        pairs = cut(_star(_star(pairs, True), False))
