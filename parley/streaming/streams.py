"""Streams: recency counters per community, sessions, windows, incremental upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.requests import REQUEST

WINDOW = 5


def recency(calls: DataFrame, window: int = WINDOW) -> DataFrame:
    """A stream ``calls(community, call, n)`` to the state each call finds: ``(community, call, lc, gc)``.

    State of a community: counts of its last calls by number, and its total.
    Calls come in order; a gap counts as zeros, so that a window that has run out
    is the same as one that was evicted.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, counts, total = state.get if state.exists else ([], [], 0)
        numbers, counts = list(numbers), list(counts)
        rows = pd.concat(list(frames)).groupby("call", as_index=False)["n"].sum().sort_values("call")
        out = []
        for call, n in zip(rows["call"].tolist(), rows["n"].tolist()):
            keep = [i for i, c in enumerate(numbers) if c >= call - window]
            numbers, counts = [numbers[i] for i in keep], [counts[i] for i in keep]
            out.append((key[0], call, sum(c for m, c in zip(numbers, counts) if m < call), total - sum(c for m, c in zip(numbers, counts) if m == call)))
            if call in numbers:
                counts[numbers.index(call)] += n
            else:
                numbers.append(call)
                counts.append(n)
            total += n
        state.update((numbers, counts, total))
        yield pd.DataFrame(out, columns=["community", "call", "lc", "gc"])

    return calls.groupBy("community").applyInPandasWithState(run, "community string, call long, lc long, gc long", "numbers array<long>, counts array<long>, total long", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream; a session's window ends ``gap`` after its last event, events later than ``late`` are dropped."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def ended(events: DataFrame, ts: str = "ts", after: str = "1 day") -> DataFrame:
    """``events`` and one row without a key, ``after`` the last of them: it moves the watermark on, so that a stream that ends gives its last sessions too.

    The row's own session stays open and is never given.
    """
    last = events.agg(F.max(ts).alias(ts)).where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts) + F.expr(f"INTERVAL {after}"))
    return events.unionByName(last, allowMissingColumns=True)


def windowed(events: DataFrame, key: str, ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling or sliding windows, late events dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """Request files of a folder as they come, one call each: ``(context_id, segments)``."""
    raw = spark.readStream.schema("value STRING").option("wholetext", True).text(path)
    body = F.from_json("value", REQUEST)["body"]
    return raw.select(body["contextId"].alias("context_id"), body["segments"].alias("segments"))


def upserting(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Each micro-batch adds the rows whose keys the table in ``path`` lacks; a batch that is tried again adds nothing twice."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        try:
            known = spark.read.parquet(path).where(F.col("_batch") != number).select(*keys)
            new = new.join(known, keys, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that has come so far, to Parquet files in ``path``."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
