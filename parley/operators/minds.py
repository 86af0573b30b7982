"""What is known of entities between calls: vectors, communities and counters, that every call adds to in one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vectors as V
from ..sources import artifacts
from ..sources.shared import written
from . import recency
from . import sequences as S

#: Calls that a community's recent counts go back.
RECENT = 5


def seed(spark: SparkSession, root: str, entities: DataFrame, communities: DataFrame) -> artifacts.State:
    """The first state: ``entities(entity, vec)``, ``communities(entity, community)``; counters are empty."""
    summed = V.mean_vectors(entities.select("entity", V.as_doubles(F.col("vec")).alias("vec")), ["entity"], how="sum")
    counters = spark.createDataFrame([], "community int, total long, recent array<long>")
    return artifacts.commit(artifacts.state(spark, root), root, {"entities": summed, "communities": communities.select("entity", F.col("community").cast("int").alias("community")), "counters": counters})


def enrich(spark: SparkSession, root: str, call: DataFrame, batch: int | None = None, k: int = 10, least: int = 2) -> artifacts.State:
    """A call's entities added to the state; ``call(entity, vec)`` has a row for each mention.

    Vectors of an entity add up over mentions and calls.  One that has no
    community gets that of most of its ``k`` nearest known ones, if ``least`` agree; else it
    stays without, and a later call may place it.  A community's counters grow by the entities placed
    in it, and the call's number joins its last ``RECENT`` ones.  All tables change in one
    commit; a ``batch`` that is in the state already changes nothing.
    """
    before = artifacts.state(spark, root)
    if batch is not None and before.batch is not None and batch <= before.batch:
        return before
    entities, communities, counters = (before.table(x) for x in ("entities", "communities", "counters"))
    mentions = written(call.select("entity", V.as_doubles(F.col("vec")).alias("vec")), "mentions")
    summed = written(V.mean_vectors(mentions.unionByName(entities), ["entity"], how="sum"), "summed")
    named = mentions.select("entity").distinct().join(communities, "entity", "left_anti")
    new = summed.join(named, "entity").select(F.col("entity").alias("qid"), "vec")
    known = summed.join(communities, "entity").select(F.col("entity").alias("iid"), "vec", "community")
    placed = written(recency.place(new, known, k, least).where("community <> -1").select(F.col("qid").alias("entity"), "community"), "placed")
    grown = placed.groupBy("community").agg(F.count("*").alias("n"))
    latest = F.when(F.col("n").isNull(), F.col("recent")).otherwise(F.array_append(F.coalesce("recent", F.array().cast("array<long>")), F.col("n")))
    total = F.coalesce("total", F.lit(0).cast("long")) + F.coalesce("n", F.lit(0).cast("long"))
    counted = counters.join(grown, "community", "full").select("community", total.alias("total"), F.slice(latest, F.greatest(F.size(latest) - RECENT + 1, F.lit(1)), RECENT).alias("recent"))
    return artifacts.commit(before, root, {"entities": summed, "communities": communities.unionByName(placed), "counters": counted}, batch)


def enrich_stream(calls: DataFrame, root: str, checkpoint: str, **options) -> StreamingQuery:
    """Every micro-batch of a stream ``calls(entity, vec)`` as one call; a batch that is run again after a failure counts once."""
    return calls.writeStream.foreachBatch(lambda df, batch: enrich(df.sparkSession, root, df, batch, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def golden_ranks(groups: DataFrame, known: DataFrame, k: int = 10, least: int = 3, share: float = 0.9) -> DataFrame:
    """``(community, freq, rank, share, chosen)``: in how many golden groups a community is at home, most first.

    ``groups(grp, vec)``, ``known(entity, vec, community)``.  A group's communities are those that
    at least ``least`` of its ``k`` nearest entities have; ties in frequency go to the smaller community.  ``share`` is the running
    share of all frequencies; chosen are communities up to the one whose share reaches the bound ``share``.
    """
    items = known.select(F.col("entity").alias("iid"), "vec")
    near = V.knn(groups.select(F.col("grp").alias("qid"), "vec"), items, k).select("qid", F.col("iid").alias("entity"))
    home = near.join(known.select("entity", "community"), "entity").groupBy("qid", "community").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    freq = written(home.groupBy("community").agg(F.count("*").alias("freq")), "frequencies")
    total = freq.agg(F.sum("freq")).first()[0] or 1
    ranked = S.ranked_over_all(freq, F.desc("freq"), "community", value="freq")
    upto = F.col("before") + F.col("freq")
    return ranked.select("community", "freq", F.col("rank").cast("int").alias("rank"), F.round(upto / F.lit(total), 6).alias("share"), (F.col("before") / F.lit(total) < share).alias("chosen"))


def generate(spark: SparkSession, root: str, groups: DataFrame, known: DataFrame, k: int = 10, least: int = 3, share: float = 0.9) -> artifacts.State:
    """A mind from a golden set, as a first state that calls can enrich: the chosen communities of ``golden_ranks`` and their entities.

    Their counters start at their frequencies, without recent calls; ``ranks(community,
    freq, rank, share)`` is a table of the state.  A golden set without repeated communities makes an empty mind.
    """
    ranks = written(golden_ranks(groups, known, k, least, share).where("chosen").drop("chosen"), "ranks")
    kept = written(known.join(ranks.select("community"), "community", "left_semi").select("entity", V.as_doubles(F.col("vec")).alias("vec"), F.col("community").cast("int").alias("community")), "kept")
    counters = ranks.select(F.col("community").cast("int").alias("community"), F.col("freq").alias("total"), F.array().cast("array<long>").alias("recent"))
    tables = {"entities": V.mean_vectors(kept, ["entity"], how="sum"), "communities": kept.select("entity", "community").distinct(), "counters": counters, "ranks": ranks}
    return artifacts.commit(artifacts.state(spark, root), root, tables)


def weighted_places(new: DataFrame, state: artifacts.State, k: int = 10) -> DataFrame:
    """``new(qid, vec)`` to ``(qid, community, votes, weight)``: votes of the ``k`` nearest entities, each weighing its community's frequency in the golden set.

    Ties go to the community of the nearer entity.  An empty mind places nothing.
    """
    entities = state.table("entities").withColumnRenamed("entity", "iid")
    of = state.table("communities").withColumnRenamed("entity", "iid").join(state.table("ranks").select(F.col("community").cast("int").alias("community"), "freq"), "community")
    near = V.knn(new, entities, k).join(of, "iid")
    votes = near.groupBy("qid", "community").agg(F.count("*").alias("votes"), F.sum("freq").alias("weight"), F.min("rank").alias("best"))
    return S.first_of(votes, ["qid"], F.desc("weight"), "best").select("qid", "community", "votes", "weight")
