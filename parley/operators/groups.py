"""Meeting groups: from sentence communities to time-ordered groups of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.shared import written
from . import communities as C
from . import edges as E
from . import intervals
from . import sequences as S


def refine(membership: DataFrame) -> DataFrame:
    """``(meeting, node, seg_order, community)``: each segment keeps its sentences of the community that has most of them, ties to the later."""
    n = membership.groupBy("meeting", "seg_order", "community").agg(F.count("*").alias("n"))
    best = S.first_of(n, ["meeting", "seg_order"], F.desc("n"), F.desc("community")).select("meeting", "seg_order", "community")
    return membership.join(best, ["meeting", "seg_order", "community"], "left_semi").select("meeting", "node", "seg_order", "community")


def island_groups(refined: DataFrame, compat: bool = False) -> DataFrame:
    """``(meeting, grp, seg_order)``: runs of segments next to each other, within a community; groups numbered by community and start."""
    rows = refined.select("meeting", "community", "seg_order").distinct()
    i = S.islands(rows, ["meeting", "community"], "seg_order", compat=compat)
    g = i.groupBy("meeting", "community", "island").agg(F.min("seg_order").alias("first"))
    g = g.withColumn("grp", F.row_number().over(Window.partitionBy("meeting").orderBy("community", "first")) - 1)
    return i.join(g, ["meeting", "community", "island"]).select("meeting", "grp", "seg_order")


def merge_contained(groups: DataFrame) -> DataFrame:
    """Groups that lie within another's span are merged into it until none is left; two single segments never merge."""
    rows = groups.distinct()
    spans = rows.groupBy("meeting", F.col("grp").alias("id")).agg(F.min("seg_order").alias("start"), F.max("seg_order").alias("end"), F.count("*").alias("n"))
    to = intervals.absorbed(spans, ["meeting"]).withColumnRenamed("id", "grp")
    return rows.join(to, ["meeting", "grp"]).select("meeting", F.col("into").alias("grp"), "seg_order").distinct()


def drop_short_singles(groups: DataFrame, segments: DataFrame, least_words: int = 40) -> DataFrame:
    """Where a meeting has a group of several segments, groups of one segment under ``least_words`` words go."""
    sized = groups.withColumn("n", F.count("*").over(Window.partitionBy("meeting", "grp")))
    sized = sized.withColumn("most", F.max("n").over(Window.partitionBy("meeting")))
    words = segments.select("meeting", "seg_order", F.size(F.split("text", " ")).alias("words"))
    return sized.join(words, ["meeting", "seg_order"]).where("most = 1 or n > 1 or words >= " + str(least_words)).select("meeting", "grp", "seg_order")


def merge_in_time(groups: DataFrame, vectors: DataFrame, seed: int = 0) -> DataFrame:
    """Second level: groups of similar mean vectors form super-communities, and groups that follow each other in one are merged.

    ``vectors``: ``(meeting, node, seg_order, vec)``.  Groups come out numbered in
    the order of their first segment.
    """
    own = groups.join(vectors, ["meeting", "seg_order"])
    mean = V.mean_vectors(own, ["meeting", "grp"])
    e = V.cosine_pairs(mean, "grp", "vec", ["meeting"])
    top = C.per_graph(e.where("weight > 0"), "meeting", "louvain", seed=seed).select("meeting", F.col("node").alias("grp"), F.col("value").cast("int").alias("super"))
    g = groups.groupBy("meeting", "grp").agg(F.min("seg_order").alias("first")).join(top, ["meeting", "grp"], "left")
    g = g.withColumn("super", F.coalesce("super", -1 - F.col("grp")))
    merged = S.merged_runs(g, ["meeting"], "first", "super", "super").select("meeting", "grp", "merged")
    return groups.join(merged, ["meeting", "grp"]).select("meeting", F.col("merged").cast("int").alias("grp"), "seg_order").distinct()


def group_meetings(sentences: DataFrame, seed: int = 0, least_words: int = 40) -> DataFrame:
    """The whole way: ``sentences(meeting, node, seg_order, text, vec)`` to ``(meeting, grp, seg_order)``.

    Cosine graph of each meeting, pruned by neighbourhood in time and by node
    quartiles; Louvain, the lowest modularity of five runs; segments to their main
    community; islands; containment; short single segments out; merging in time.
    """
    pairs = written(V.cosine_pairs(sentences, "node", "vec", ["meeting"]), "pairs")
    keyed = lambda c: F.concat_ws("/", F.col("meeting").cast("string"), F.col(c).cast("string"))
    flat = pairs.select(keyed("src").alias("src"), keyed("dst").alias("dst"), "weight", "meeting", F.col("src").alias("s"), F.col("dst").alias("d"))
    orders = sentences.select(keyed("node").alias("node"), F.col("seg_order").alias("order"))
    kept = E.neighbour_window_prune(flat, orders).join(flat.select("src", "dst", "meeting", "s", "d"), ["src", "dst"]).select("meeting", F.col("s").alias("src"), F.col("d").alias("dst"), "weight")
    found = C.per_graph(written(kept, "pruned"), "meeting", "louvain_lowest_of_5", seed=seed)
    membership = found.join(sentences.select("meeting", "node", "seg_order"), ["meeting", "node"]).select("meeting", "node", "seg_order", F.col("value").cast("int").alias("community"))
    groups = merge_contained(island_groups(refine(written(membership, "membership"))))
    segments = S.joined_text(sentences, ["meeting", "seg_order"], "node", "text")
    return merge_in_time(written(drop_short_singles(groups, segments, least_words), "groups"), sentences.select("meeting", "node", "seg_order", "vec"), seed)
