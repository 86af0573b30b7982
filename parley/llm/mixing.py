"""Mixing sources to target weights, without a sort.

Every document has a fixed hash, cut into three-digit levels.  Sizes are summed
by source and first level; a running sum over that histogram finds the bucket in
which a source's budget ends.  Only this bucket is summed again by the next
level, and so on.  What is left is one hash per source, and the mix is a filter
``hash < threshold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import unused, written

#: Hex digits of a level, and levels: a histogram has at most 16**DIGITS rows a source.
DIGITS, LEVELS = 3, 10


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``sizes(source, source_size)`` with each source's rank by code point, null last, without gathering them in one task."""
    dealt = written(sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "sources")
    before = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.join(F.broadcast(before), "part").select("source", "source_size", (F.col("before") + rank - 1).alias("rank"))


def targets(ranked: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Each source's target: its weight's part of ``share`` times all sizes, at most ``cap`` times its own size.

    What a source can't take is reshared by weight until no target is above its cap.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = written(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap)), "weights")
    level = 0.0
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        got, left = rows.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not left:
            break
        new = (total - got) / left
        if new <= level:
            break
        level = new
    return rows.select("source", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target"))


def _thresholds(docs: DataFrame, want: DataFrame) -> DataFrame:
    """``(source, upto)``: of a source's documents, those with a hash below ``upto`` add up to ``need`` most nearly."""
    open_ = want.select("source", "need", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below"))
    shut = None
    for level in range(LEVELS):
        last = level == LEVELS - 1
        # the boundary buckets: one row a source
        part = docs.join(open_, docs.source.eqNullSafe(open_.source) & (F.col("hash").startswith(F.col("prefix")) if level else F.lit(True))).select(
            open_.source.alias("source"), "need", "prefix", "below", F.substring("hash", 1, DIGITS * (level + 1)).alias("bucket"), "size", "hash"
        )
        hist = part.groupBy("source", "need", "prefix", "below", "bucket").agg(F.sum("size").alias("sum"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        run = Window.partitionBy("source").orderBy("bucket")
        cum = hist.withColumn("before", F.col("below") + F.sum("sum").over(run) - F.col("sum"))
        # the first bucket that is not taken whole
        ends = cum.where(F.col("before") + F.col("sum") > F.col("need")).groupBy("source", "need").agg(F.min_by(F.struct("bucket", "before", "sum", "low", "high"), "bucket").alias("at")).select("source", "need", "at.*")
        ends = written(ends, f"bound{level}")
        single = (F.col("low") == F.col("high")) | F.lit(last)
        # one hash left: it is taken if that comes nearer; the bound "~" is above its hash
        done = ends.where(single).select("source", F.when(F.col("before") + F.col("sum") / 2 <= F.col("need"), F.concat("high", F.lit("~"))).otherwise(F.col("low")).alias("upto"))
        shut = done if shut is None else shut.unionByName(done)
        open_ = ends.where(~single).select("source", "need", F.col("bucket").alias("prefix"), F.col("before").alias("below"))
        if last or not open_.limit(1).count():
            return shut


def _sized(docs: DataFrame) -> DataFrame:
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), _hash().alias("hash"))


def _hash():
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def plan_of(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, source_size, target, whole, upto)``, one row a source, from ``sizes(source, size, hash)``."""
    aims = targets(ranked_sources(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    aims = written(aims.withColumn("whole", whole.cast("long")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    upto = _thresholds(sizes, aims.where("need > 0").select("source", "need"))
    return written(aims.join(upto.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "whole", "upto"), "plan")


def _copies(hash_):
    return F.col("whole") + F.when(hash_ < F.col("upto"), 1).otherwise(0)


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row of ``docs``.

    Size is the number of words in the text (null: 0).  A document is taken
    whole, ``taken / size`` times: as often as the source's target holds all of
    the source, and once more if its hash is below the source's threshold.  The
    hash is of doc_id alone: reruns agree, and rows that share an id (or have
    none) go together.  A source without words has target 0.  Texts of any length
    are counted whole.  An empty table gives an empty result.
    """
    rows = written(_sized(docs), "sizes")
    plan = plan_of(rows, weights, share, cap).withColumnRenamed("source", "_s")
    return rows.join(plan, rows.source.eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * _copies(F.col("hash"))).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies`` added (an own column of this name is replaced).

    Nulls, ties, repeated rows and empty tables as in ``mix``; documents without
    words are taken like their source; other columns may have any names.  The
    texts aren't shuffled: the plan has one row a source and is joined to them.
    """
    name, plan_ = unused(docs, "name"), unused(docs, "plan")
    plan = plan_of(written(_sized(docs), "sizes"), weights, share, cap).select(F.col("source").alias(name), F.struct("whole", "upto").alias(plan_))
    copies = docs.drop("copies").join(plan, F.col("source").eqNullSafe(F.col(name))).drop(name)
    times = F.col(plan_)["whole"] + F.when(_hash() < F.col(plan_)["upto"], 1).otherwise(0)
    return copies.withColumn("copies", times.cast("long")).drop(plan_).where("copies > 0")
