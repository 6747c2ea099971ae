"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, unsent


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (smallest node of the component) for every node with an edge.

    Each step points nodes at smaller neighbours; a step is a grouped minimum and a join, both of which
    Spark spreads for a hub of any size.  The number of steps grows with the logarithm of the diameter.
    """
    e = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        # Large star: neighbours greater than a node go to the smallest of the node and its neighbours.
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(unsent(low), "x").where("y > x AND y <> m").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # Small star: a node's smaller neighbours, and itself, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(unsent(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = materialise(small.where("u <> v").distinct(), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
