"""Connected components by alternating large-star and small-star steps.

Only per-node minima are aggregated, never neighbour lists, so a node with any
number of edges stays a matter of partial aggregation and splittable joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step: each node's neighbours (smaller ones, or larger ones) are linked to its smallest neighbour."""
    if small:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # written, so that the join deals both sides out anew and a hub's edges can be split
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    joined = both.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, root)``, root the smallest node reachable.

    Nodes without an edge to another node don't appear.  Self-edges and repeated
    edges are ignored; an empty input gives an empty result.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")

    def mark(df: DataFrame):
        # min and sum of per-edge hashes: equal when nothing changed
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.min(F.xxhash64("b", "a"))).first())

    seen = mark(now)
    while seen[0]:
        now = written(_star(written(_star(now, small=False), "cc"), small=True), "cc")
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
