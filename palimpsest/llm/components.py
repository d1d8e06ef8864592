"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut


def connected(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of each end of edges (a, b).

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"):
    O(log^2 n) rounds at worst, two or three for star-like input. Minima are partial aggregates and neighbours stay
    rows, so a node with very many links makes no large group. Each round is checkpointed.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        # Large star: every neighbour above u goes to the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored first: a join of two shuffles, neither of which is the aggregate's own, can split a node of many links.
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").distinct())
        # Done when each node points at one root, and roots at none.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if not ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").take(1):
            break
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
