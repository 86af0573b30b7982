"""Property graphs as node and edge tables: triples, idempotent upserts, knowledge-graph rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def triples(df: DataFrame, *edges: tuple[str, str, str]) -> DataFrame:
    """``(src, rel, dst)`` for each (source column, relation, target column)."""
    parts = [df.select(F.col(a).cast("string").alias("src"), F.lit(r).alias("rel"), F.col(b).cast("string").alias("dst")) for a, r, b in edges]
    return reduce(DataFrame.unionByName, parts).where("src is not null and dst is not null").distinct()


def upsert(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``known`` and the rows of ``new`` whose keys it lacks; running it again changes nothing."""
    return known.unionByName(new.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def linked(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges whose two ends exist, given by key, as node ids: ``(src_uid, dst_uid, rel)``."""
    a, b = nodes.select(F.col("uid").alias("src_uid"), F.col(key).alias("src")), nodes.select(F.col("uid").alias("dst_uid"), F.col(key).alias("dst"))
    return edges.join(a, "src").join(b, "dst").select("src_uid", "rel", "dst_uid")


def latest(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables merged like dictionaries: for each key the row of the last table that has it."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    all_ = reduce(DataFrame.unionByName, tagged)
    others = [c for c in parts[0].columns if c not in keys]
    return all_.groupBy(*keys).agg(F.max_by(F.struct(*others), "_part").alias("_v")).select(*keys, "_v.*")


def cooccurring(mentions: DataFrame, least: int = 1) -> DataFrame:
    """``(src, dst, meet_ctr, para_ctr, sent_ctr)`` of terms that share paragraphs.

    ``mentions``: ``(term, kind, meeting_id, para_id, sent_id)``.  Entities come
    before keyphrases; a pair needs a shared paragraph, two shared sentences if
    the first is a keyphrase, one if the second is.
    """
    m = mentions.select("term", "kind", "meeting_id", "para_id", "sent_id").distinct()
    a = m.select(F.col("term").alias("src"), F.col("kind").alias("ka"), "meeting_id", "para_id", F.col("sent_id").alias("sa"))
    b = m.select(F.col("term").alias("dst"), F.col("kind").alias("kb"), "meeting_id", "para_id", F.col("sent_id").alias("sb"))
    before = ((F.col("ka") == "entity") & (F.col("kb") == "keyphrase")) | ((F.col("ka") == F.col("kb")) & (F.col("src") < F.col("dst")))
    pair = a.join(b, ["meeting_id", "para_id"]).where(before)
    both = F.when(F.col("sa") == F.col("sb"), F.struct("meeting_id", "para_id", "sa"))
    n = pair.groupBy("src", "dst", "ka", "kb").agg(F.countDistinct("meeting_id").alias("meet_ctr"), F.countDistinct("meeting_id", "para_id").alias("para_ctr"), F.countDistinct(both).alias("sent_ctr"))
    enough = (F.col("para_ctr") >= least) & ((F.col("ka") != "keyphrase") | (F.col("sent_ctr") >= 2)) & ((F.col("kb") != "keyphrase") | (F.col("sent_ctr") >= 1))
    return n.where(enough).select("src", "dst", "meet_ctr", "para_ctr", "sent_ctr")


def two_hops(edges: DataFrame, nodes: DataFrame, start: DataFrame, first: str, kind: str) -> DataFrame:
    """``(start, middle, end)``: along an edge of type ``first``, then any edge, to a node of ``kind``."""
    e1 = edges.where(F.col("rel") == first).select(F.col("src").alias("start"), F.col("dst").alias("middle"))
    e2 = edges.select(F.col("src").alias("middle"), F.col("dst").alias("end"))
    ends = nodes.where(F.col("kind") == kind).select(F.col("node").alias("end"))
    return e1.join(start.select(F.col("node").alias("start")), "start", "left_semi").join(e2, "middle").join(ends, "end", "left_semi").select("start", "middle", "end").distinct()


def within_neighbours(phrases: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, phrase)`` whose other words are all neighbours of its first word."""
    n = edges.select("src", "dst").union(edges.select("dst", "src")).groupBy("src").agg(F.collect_set("dst").alias("near"))
    p = phrases.withColumn("w", F.split("phrase", " ")).withColumn("src", F.col("w")[0])
    return p.join(n, "src").where(F.size(F.array_except(F.slice("w", F.lit(2), F.size("w")), F.col("near"))) == 0).select("id", "phrase")
