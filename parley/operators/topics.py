"""Topics of groups of text, and the nodes that stand for clusters: graphs of many groups ranked together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..sources.shared import written
from . import chunking, detect, models, ranking, similarity, tagging
from . import edges as E
from . import sequences as S
from .batches import per_group

#: Phrases of a group up to which its graph is made in one task: four matrices of this many rows and columns are held.
MOST = 4096


def topic_candidates(sentences: DataFrame, group: str, grammar: str = chunking.GRAMMARS["topic"], stop_words=T.STOP_WORDS) -> DataFrame:
    """``sentences(group, pos, text)`` to ``(group, node, phrase)``: distinct chunks of a group, numbered in the order they first come up."""
    tokens = sentences.select(group, "pos", tagging.tokens(F.col("text")).alias("tokens")).withColumn("tags", tagging.penn_tags(F.col("tokens")))
    found = tokens.select(group, "pos", F.posexplode(chunking.candidate_phrases(F.col("tokens"), F.col("tags"), grammar, stop_words)).alias("at", "phrase"))
    first = found.groupBy(group, "phrase").agg(F.min(F.struct("pos", "at")).alias("first"))
    return S.ranked(first.select(group, "phrase", "first.*"), [group], "pos", "at", "phrase", name="node").select(group, "node", "phrase")


def _ranks(m: np.ndarray, alpha: float = 0.85, tol: float = 1e-9, most_rounds: int = 300) -> np.ndarray:
    """PageRank of the nodes with vectors ``m`` in their cosine graph with loops, each edge kept if it reaches the third quartile of its earlier end."""
    length = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(length == 0, 1, length)
    n = len(m)
    w = np.triu(m @ m.T)
    w += np.triu(w, 1).T
    pos = 0.75 * (n - 1)
    low, high = int(np.floor(pos)), int(np.ceil(pos))
    ends = np.partition(w, sorted({low, high}), axis=1)
    a, b = ends[:, low], ends[:, high]
    cut = np.where(a == b, a, (high - pos) * a + (pos - low) * b) if high > low else a
    kept = np.where(np.triu(w >= cut[:, None]), w, 0.0)
    kept += np.triu(kept, 1).T
    out = kept.sum(1)
    stuck = ~(out > 0)
    share = np.where(stuck[:, None], 0.0, kept / np.where(stuck, 1, out)[:, None])
    r = np.full(n, 1.0 / n)
    for _ in range(most_rounds):
        new = (1 - alpha) / n + alpha * (r @ share + r[stuck].sum() / n)
        moved, r = np.abs(new - r).sum(), new
        if moved < n * tol:
            return r
    raise RuntimeError(f"the ranks of a group's phrases still move after {most_rounds} rounds")


def phrase_ranks(phrases: DataFrame, group: str) -> DataFrame:
    """``phrases(group, node, vec)`` to ``(group, node, rank)``: of each group's pruned cosine graph.

    Groups pass by the batch; one of more than ``MOST`` phrases goes as tables of edges and ranks, whatever its size.
    """
    kind = phrases.schema["node"].dataType.simpleString()
    rows = phrases.select(group, "node", "vec")
    large = rows.groupBy(F.col(group).alias("_of")).agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("_of")
    same = F.equal_null(group, "_of")

    def run(of: tuple, own: dict[str, np.ndarray]) -> list:
        return [own["node"], _ranks(np.array(own["vec"].tolist(), np.float64).reshape(len(own["node"]), -1))]

    any_large = large.limit(1).count() > 0
    small = rows.join(F.broadcast(large), same, "left_anti") if any_large else rows  # large groups are few: each has more than MOST rows
    ranks = per_group(small, [group], run, f"node {kind}, rank double", ["node"])
    if not any_large:
        return ranks
    own = written(rows.join(F.broadcast(large), same, "left_semi"), "large")
    pairs = written(V.cosine_pairs(own, "node", "vec", [group], digits=None), "pairs")
    return ranks.unionByName(ranking.pagerank_of_graphs(E.quartile_prune(pairs, (group,)), [group], own.select(group, "node")))


def topics(sentences: DataFrame, group: str, embedder: detect.Embedder | None = None, grammar: str = chunking.GRAMMARS["topic"], ratio: float = 0.3, keep: int = 10, top: int = 5) -> DataFrame:
    """``sentences(group, pos, text, vec)`` to ``(group, rank, phrase, score)``: up to ``top`` phrases that name what a group is about.

    The sentences next to the centroids of a group's vectors make its summary; the
    summary's chunks are nodes of a cosine graph with loops, cut at the third quartile of each edge's
    earlier end.  Of the ``keep`` nodes with most PageRank those closest to the summary's vector come first.
    Ties go to the earlier phrase.  A group without candidates has no rows.
    """
    short = written(models.summaries(sentences, group, ratio), "summaries")
    summary = short.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("s")).select(group, F.array_join("s.text", " ").alias("text"))
    nodes = topic_candidates(short, group, grammar)
    phrases = written(detect.embedded(nodes.withColumn("ended", F.concat("phrase", F.lit("."))), "ended", embedder).drop("ended"), "phrases")
    ranks = phrase_ranks(phrases, group)
    best = S.first_of(phrases.join(ranks, [group, "node"]), [group], F.desc(F.round("rank", 9)), "node", n=keep)
    near = best.join(detect.embedded(summary, "text", embedder, "whole").select(group, "whole"), group)
    near = near.withColumn("score", F.round(F.coalesce(V.cosine(F.col("vec"), F.col("whole")), F.lit(0.0)), 6))
    return S.ranked(near, [group], F.desc("score"), "node", name="rank").where(F.col("rank") < top).select(group, (F.col("rank") + 1).alias("rank"), "phrase", "score")


def influential_nodes(nodes: DataFrame, edges: DataFrame | None = None, least: int = 6, rounds: int | None = None, above: float = 0.25) -> DataFrame:
    """``(cluster, node, inner_rank, rank)``: of each cluster the node with most PageRank inside it, and the cluster's own rank.

    ``nodes(cluster, node, vec)``, ``edges(cluster, src, dst, weight)`` within clusters; clusters of fewer
    than ``least`` nodes are left out.  Without edges they are all pairs whose cosine is more than ``above``, ranked in ``rounds`` (10) without a pair as a row.  The nodes found make the cluster graph: cosine weights, all pairs and loops. Ties go to the smaller node.
    """
    large = nodes.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cluster")
    own = written(nodes.join(large, "cluster"), "clusters")
    if edges is None:
        inner = similarity.pagerank_of_groups(own.select("cluster", F.col("node").alias("id"), "vec"), ["cluster"], above, rounds=10 if rounds is None else rounds)
    else:
        inner = ranking.pagerank_of_graphs(edges.join(large, "cluster"), ["cluster"], own.select("cluster", "node"), rounds=rounds)
    best = S.first_of(inner.withColumn("inner_rank", F.round("rank", 9)).drop("rank"), ["cluster"], F.desc("inner_rank"), "node")
    best = written(best.join(own.select("cluster", "node", "vec"), ["cluster", "node"]), "influential")
    outer = V.cosine_pairs(best, "cluster", "vec", digits=None).withColumn("all", F.lit(0))
    ranks = ranking.pagerank_of_graphs(outer, ["all"], best.select(F.lit(0).alias("all"), F.col("cluster").alias("node")), rounds=rounds)
    return best.join(ranks.select(F.col("node").alias("cluster"), "rank"), "cluster").select("cluster", "node", "inner_rank", "rank")
