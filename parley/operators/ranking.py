"""PageRank, components and reachability over edge tables, with lineage cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int | None = 10, tol: float = 1e-4, weighted: bool = False, most_rounds: int = 100) -> DataFrame:
    """``edges(src, dst[, weight])``, undirected, to ``(node, rank)``.

    Uniform start; rank of nodes without edges is spread over all.  ``rounds``
    None: until the ranks move less than ``tol`` a node in all; an error if they still do after ``most_rounds``.
    """
    w = F.col("weight") if weighted else F.lit(1.0)
    arcs = edges.where("src <> dst").select("src", "dst", w.alias("w"))
    arcs = arcs.unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    out = arcs.groupBy("src").agg(F.sum("w").alias("out"))
    arcs = written(arcs.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")), "arcs")
    nodes = written(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for t in range(rounds or most_rounds):
        got = ranks.join(arcs, ranks.node == arcs.src).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = nodes.join(got, nodes.node == got.dst, "left").select("node", F.coalesce("got", F.lit(0.0)).alias("got"))
        # what isn't passed on (nodes without arcs) is spread evenly
        kept = new.crossJoin(F.broadcast(new.agg((1.0 - F.sum("got")).alias("lost")))).select("node", (F.lit((1 - alpha) / n) + alpha * (F.col("got") + F.col("lost") / n)).alias("rank"))
        old, ranks = ranks, written(kept, f"rank{t}") if rounds is None or t % 3 == 2 else kept
        if rounds is None and old.join(ranks.withColumnRenamed("rank", "r2"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("r2")))).first()[0] < n * tol:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"the ranks still move after {most_rounds} rounds")
    return ranks


def pagerank_of_graphs(edges: DataFrame, graph: list[str], nodes: DataFrame | None = None, alpha: float = 0.85, rounds: int | None = None, tol: float = 1e-6, most_rounds: int = 200) -> DataFrame:
    """``edges(*graph, src, dst, weight)``, undirected, to ``(*graph, node, rank)``: weighted PageRank of all graphs at once.

    Rows are keyed by graph and node, so a graph of any size is spread out.  A loop
    is one arc; ``nodes(*graph, node)`` adds nodes without edges, whose rank is spread over their graph.
    Repeated edges add up.  ``rounds`` None: until no graph moves by ``tol`` a node; an error if one still does after ``most_rounds``.
    """
    there = edges.select(*graph, "src", "dst", F.col("weight").cast("double").alias("w"))
    back = there.where("src <> dst").select(*graph, F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    arcs = there.unionByName(back).groupBy(*graph, "src", "dst").agg(F.sum("w").alias("w"))
    out = arcs.groupBy(*graph, "src").agg(F.sum("w").alias("out")).where("out > 0")
    arcs = written(arcs.join(out, [*graph, "src"]).select(*graph, F.col("src").alias("node"), "dst", (F.col("w") / F.col("out")).alias("share")), "arcs")
    own = edges.select(*graph, F.explode(F.array("src", "dst")).alias("node"))
    own = (own if nodes is None else own.unionByName(nodes.select(*graph, "node"))).distinct()
    sizes = own.groupBy(*graph).agg(F.count("*").alias("n"))
    own = written(own.join(sizes, graph).join(out.select(*graph, F.col("src").alias("node"), F.lit(True).alias("passes")), [*graph, "node"], "left").select(*graph, "node", "n", F.col("passes").isNull().alias("stuck")), "nodes")
    stuck = own.where("stuck").limit(1).count() > 0
    ranks = own.withColumn("rank", 1 / F.col("n"))
    for t in range(most_rounds if rounds is None else rounds):
        got = ranks.join(arcs, [*graph, "node"]).groupBy(*graph, F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = own.join(got, [*graph, "node"], "left")
        if stuck:
            new = new.join(ranks.where("stuck").groupBy(*graph).agg(F.sum("rank").alias("lost")), graph, "left")
        lost = F.coalesce("lost", F.lit(0.0)) / F.col("n") if stuck else F.lit(0.0)
        rank = (1 - alpha) / F.col("n") + alpha * (F.coalesce("got", F.lit(0.0)) + lost)
        new = new.select(*graph, "node", "n", "stuck", rank.alias("rank"))
        last = rounds is not None and t == rounds - 1
        old, ranks = ranks, written(new, "ranks") if t % 3 == 2 or last else new
        if rounds is None and t % 3 == 2:
            moved = old.join(ranks.select(*graph, "node", F.col("rank").alias("r2")), [*graph, "node"]).groupBy(*graph).agg((F.sum(F.abs(F.col("rank") - F.col("r2"))) / F.max("n")).alias("moved"))
            if (moved.agg(F.max("moved")).first()[0] or 0.0) < tol:
                break
    else:
        if rounds is None:
            raise RuntimeError(f"the ranks of some graph still move after {most_rounds} rounds")
    return ranks.select(*graph, "node", "rank")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``, the smallest node reachable, by minimum labels and label jumping."""
    arcs = edges.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    arcs = written(arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "arcs")
    labels = written(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("c", F.col("node")), "labels")
    while True:
        near = arcs.join(labels, arcs.v == labels.node).groupBy("u").agg(F.min("c").alias("m"))
        new = labels.join(near, labels.node == near.u, "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = new.select(F.col("node").alias("n2"), F.col("c").alias("c2"))
        new = written(new.join(jump, F.col("c") == F.col("n2"), "left").select("node", F.least("c", F.coalesce("c2", "c")).alias("c")), "labels")
        moved = new.join(labels.withColumnRenamed("c", "old"), "node").where("c <> old").limit(1).count()
        labels = new
        if not moved:
            break
    return labels.withColumnRenamed("c", "component")


def expand(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``(node, depth)`` of nodes reached from ``start(node)`` along ``edges(src, dst)``, each at its least depth."""
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    edge = seen
    for d in range(1, depth + 1):
        edge = edge.join(edges, edge.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(edge)
    return seen
