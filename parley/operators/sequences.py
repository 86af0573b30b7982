"""Orders, islands and sessions over rows of a group, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def ranked(df: DataFrame, group: list[str], *order, name: str = "rank") -> DataFrame:
    """A rank from 0 in each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def first_of(df: DataFrame, group: list[str], *order, n: int = 1) -> DataFrame:
    """The first row, or the first ``n``, of each group."""
    return ranked(df, group, *order, name="_first").where(F.col("_first") < n).drop("_first")


def islands(df: DataFrame, group: list[str], order: str, gap: int = 1, compat: bool = False, name: str = "island") -> DataFrame:
    """Rows of a group whose ``order`` differs from the row before by at most ``gap`` share an island, numbered from 0.

    ``compat`` keeps a quirk: a last island of one row is dropped, unless it is
    the group's only row.
    """
    w = Window.partitionBy(*group).orderBy(order)
    breaks = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(0))
    out = df.withColumn("_break", breaks).withColumn(name, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")
    if compat:
        whole = Window.partitionBy(*group)
        out = out.withColumn("_last", F.max(name).over(whole)).withColumn("_n", F.count("*").over(Window.partitionBy(*group, name)))
        out = out.where((F.col("_last") == 0) | (F.col(name) < F.col("_last")) | (F.col("_n") > 1)).drop("_last", "_n")
    return out


def sessions(df: DataFrame, group: list[str], ts: str, seconds: int = 120, name: str = "session") -> DataFrame:
    """Rows at most ``seconds`` after the row before share a session, numbered from 0."""
    w = Window.partitionBy(*group).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    late = micros - F.lag(micros).over(w) > seconds * 1_000_000
    return df.withColumn("_late", F.coalesce(late.cast("int"), F.lit(0))).withColumn(name, F.sum("_late").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_late")


def rolling_mean(value: Column, group: list[str], order: str, n: int = 7) -> Column:
    """Mean of the last ``n`` rows; null for the first n - 1."""
    w = Window.partitionBy(*group).orderBy(order)
    return F.when(F.row_number().over(w) >= n, F.avg(value).over(w.rowsBetween(-(n - 1), 0)))


def merged_runs(groups: DataFrame, key: list[str], order: str, first: str, last: str, name: str = "merged") -> DataFrame:
    """Groups in order merge while the cluster of one's last segment is that of the next one's first."""
    w = Window.partitionBy(*key).orderBy(order)
    breaks = F.coalesce((F.lag(last).over(w) != F.col(first)).cast("int"), F.lit(0))
    return groups.withColumn("_b", breaks).withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def mode(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group, ties to the one seen first."""
    n = df.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(order).alias("_seen"))
    return first_of(n, group, F.desc("n"), "_seen").drop("_seen")


def joined_text(df: DataFrame, group: list[str], order: str, text: str = "text", sep: str = " ") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(*group).agg(F.array_join(F.transform(parts, lambda x: x[text]), sep).alias(text))


def next_within(df: DataFrame, group: list[str], order: str, id_: str, reach: int = 1) -> DataFrame:
    """Pairs whose order differs by 0 to ``reach``, the second not before the first: an equi-join on shifted orders."""
    shifted = df.select(*group, F.col(id_).alias("src"), F.explode(F.array(*[F.col(order) + k for k in range(reach + 1)])).alias("_o"))
    return shifted.join(df.select(*group, F.col(id_).alias("dst"), F.col(order).alias("_o")), [*group, "_o"]).where("src <> dst").drop("_o")


def contained(intervals: DataFrame, key: list[str], id_: str = "id", start: str = "start", end: str = "end", singles: str | None = "n") -> DataFrame:
    """Pairs (inner, outer) of a group's intervals, one inside the other; two of one row each never pair."""
    a = intervals.select(*key, F.col(id_).alias("inner_id"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(singles).alias("_n"))
    b = intervals.select(*key, F.col(id_).alias("outer_id"), F.col(start).alias("_s2"), F.col(end).alias("_e2"), F.col(singles).alias("_n2"))
    inside = F.col("_s").between(F.col("_s2"), F.col("_e2")) & F.col("_e").between(F.col("_s2"), F.col("_e2"))
    return a.join(b, key).where(inside & (F.col("inner_id") != F.col("outer_id")) & ((F.col("_n") > 1) | (F.col("_n2") > 1))).select(*key, "inner_id", "outer_id")


def ranked_over_all(df: DataFrame, *order, value: str | None = None, name: str = "rank") -> DataFrame:
    """``df`` with its rank from 0 among all rows and, with ``value``, the sum of it over the rows before (``before``).

    Rows are dealt by ranges of ``order``, each sorted on its own and told what the
    ranges before it hold, so no task sorts all.  ``order`` has to tell all rows apart.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    total = F.sum(value) if value else F.lit(0)
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n"), total.alias("_v"))  # a row for each partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_sum"))
    own = Window.partitionBy("_part").orderBy(*order)
    out = dealt.join(F.broadcast(parts), "_part").withColumn(name, F.col("_rows") + F.row_number().over(own) - 1)
    if value:
        out = out.withColumn("before", F.col("_sum") + F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.select(*df.columns, name, *(["before"] if value else []))
