"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wakeline.session import stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: every node with an edge, and the smallest node of its component.

    ``edges`` has columns a and b of one type. Each round links every node's larger neighbours, then its
    smaller ones, to its smallest neighbour; minima are aggregates, so a hub costs one partial row per task.
    Rounds are written as stage tables. Empty edges give no rows.
    """
    now = stage(_pairs(edges.select("a", "b")), "edges")
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stage(_pairs(large), "edges")
        # a > b in every row: the smaller neighbours of a node are its b
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(lows.select("a", F.col("m").alias("b")))
        after = stage(_pairs(small), "edges")
        # a star forest: no node is both a leaf and a centre, and no leaf has two centres
        chained = after.join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        done = chained and after.groupBy("a").count().where("count > 1").isEmpty()
        now = after
        if done:
            leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _pairs(edges: DataFrame) -> DataFrame:
    """Distinct edges, larger end first, without loops."""
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.where("a > b").distinct()
