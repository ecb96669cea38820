"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, sized


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) of all nodes of `edges` (a, b), the component being its smallest node.

    Alternates large-star and small-star steps: every node hands its smallest neighbour to its larger ones, then to
    its smaller ones. Each step is one aggregate and one join on the node; a hot node is a key whose one-row side
    is the aggregate, so the adaptive join can split its rows. Every round is checkpointed.
    """
    star = sized(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    parts = star.rdd.getNumPartitions()  # edges never become more
    before = None
    for _ in range(limit):
        both = star.union(star.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(parts).distinct()
        # u > v now on every row
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k"))
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        star = durable(small.coalesce(parts).distinct().coalesce(parts))
        state = star.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = star.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
