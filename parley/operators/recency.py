"""Recency of communities over calls: a window of the last five counts, and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 5


def state_before(counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``counts(community, call, n)`` to the state each call finds: ``(community, call, lc, gc)``.

    ``lc``: counts of the last ``window`` calls added up, ``gc``: of all calls
    before.  Calls are dense numbers; a call in which a community doesn't occur
    counts zero.  A window of zeros is as good as none, so evictions need no rows.
    """
    w = Window.partitionBy("community").orderBy("call")
    back = F.sum("n").over(w.rangeBetween(-window, -1))
    total = F.sum("n").over(w.rangeBetween(Window.unboundedPreceding, -1))
    return counts.select("community", "call", "n", F.coalesce(back, F.lit(0)).alias("lc"), F.coalesce(total, F.lit(0)).alias("gc"))


def rank_groups(groups: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``groups(call, grp, community)`` ranked within their call by the state before it.

    A group's value is the sum of ``lc`` over its communities, or of ``gc`` if
    none was seen lately; the first sort stands before the second.
    """
    calls = groups.select("call", "community").distinct()
    grid = counts.select("community", "call", "n").unionByName(calls.select("community", "call", F.lit(0).cast("long").alias("n")))
    state = state_before(grid.groupBy("community", "call").agg(F.sum("n").alias("n")), window).drop("n")
    v = groups.join(state, ["call", "community"], "left").groupBy("call", "grp").agg(F.coalesce(F.sum("lc"), F.lit(0)).alias("lc"), F.coalesce(F.sum("gc"), F.lit(0)).alias("gc"))
    v = v.select("call", "grp", (F.col("lc") > 0).alias("lately"), F.when(F.col("lc") > 0, F.col("lc")).otherwise(F.col("gc")).alias("value"))
    order = Window.partitionBy("call").orderBy(F.desc("lately"), F.desc("value"), "grp")
    return v.withColumn("rank", F.row_number().over(order))


def place(new: DataFrame, known: DataFrame, k: int = 10, least: int = 2) -> DataFrame:
    """``(qid, community)``: the commonest community among each new vector's k nearest known ones, if it has ``least`` votes, else -1."""
    from ..functions.vectors import knn

    near = knn(new, known, k).join(known.select("iid", "community"), "iid")
    votes = near.groupBy("qid", "community").agg(F.count("*").alias("n"), F.min("rank").alias("best"))
    top = votes.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "best"))).where("r = 1")
    return top.select("qid", F.when(F.col("n") >= least, F.col("community")).otherwise(-1).alias("community"))
