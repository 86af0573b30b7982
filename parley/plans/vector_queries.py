"""Queries over vectors and similarity graphs (table ``embeddings``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import edges as E
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import similarity as A
from ..sources.shared import table, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _edges(spark, sf_dir, loops=True, least: float | None = None) -> DataFrame:
    return V.cosine_pairs(_vectors(spark, sf_dir), loops=loops, least=least)


_PAIRS = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings),
e AS (SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.vec, b.vec), 6) + 0.0 AS weight FROM v a JOIN v b ON a.id <= b.id),
s AS (SELECT src AS node, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e WHERE src <> dst),
st AS (SELECT node, quantile_cont(weight, 0.25) AS q1, quantile_cont(weight, 0.75) AS q3, avg(weight) AS mean, stddev_pop(weight) AS pstdev FROM s GROUP BY node)"""


@query(f"WITH {_PAIRS} SELECT * FROM e")
def cosine_pairs(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"WITH {_PAIRS} SELECT * FROM e WHERE src < dst AND weight > 0.25")
def cosine_pairs_upper_triangle(spark, sf_dir):
    return E.threshold(_edges(spark, sf_dir, loops=False, least=0.25), 0.25)


@query(f"WITH {_PAIRS} SELECT src, dst, weight FROM e JOIN st ON src = node WHERE weight > q3 + (q3 - q1)")
def cosine_node_iqr_prune(spark, sf_dir):
    return A.iqr_prune(_vectors(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT src, dst, weight FROM e JOIN st ON src = node WHERE weight >= q3")
def cosine_node_q3_prune(spark, sf_dir):
    return A.quartile_prune(_vectors(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT * FROM e WHERE weight >= (SELECT quantile_cont(weight, 0.9) FROM e)")
def edge_percentile_prune(spark, sf_dir):
    return A.percentile_prune(_vectors(spark, sf_dir), 90)


@query(f"""WITH {_PAIRS}, k AS (
  SELECT src, dst, weight, abs(src // 5 - dst // 5) AS gap, 2 * q3 - q1 AS far, mean + pstdev AS near FROM e JOIN st ON src = node)
SELECT src, dst, CASE WHEN gap = 0 THEN 1.0 ELSE weight END AS weight FROM k
WHERE weight > far OR gap = 0 OR (gap <= 2 AND weight > near)""")
def neighbour_window_prune(spark, sf_dir):
    orders = _vectors(spark, sf_dir).select(F.col("id").alias("node"), F.floor(F.col("id") / 5).alias("order"))
    return A.neighbour_window_prune(_vectors(spark, sf_dir), orders)


@query(f"WITH {_PAIRS}, t AS (SELECT * FROM e WHERE src < dst) SELECT src, dst FROM t ORDER BY weight DESC, src, dst LIMIT (SELECT ceil(count(*) * 0.15)::BIGINT + 1 FROM t)")
def topk_fraction_edges(spark, sf_dir):
    return A.top_fraction(_vectors(spark, sf_dir), 0.15)


@query(f"""WITH {_PAIRS}, d AS (SELECT node, other, CASE WHEN node = other THEN avg(weight) OVER (PARTITION BY node) ELSE weight END AS w FROM s),
n AS (SELECT node, other, (w - min(w) OVER p) / (max(w) OVER p - min(w) OVER p) AS n FROM d WINDOW p AS (PARTITION BY node))
SELECT least(node, other) AS src, greatest(node, other) AS dst, round(CASE WHEN least(node, other) = greatest(node, other) THEN 1.0 ELSE avg(n) END, 6) AS weight
FROM n GROUP BY least(node, other), greatest(node, other)""")
def minmax_symmetric_norm(spark, sf_dir):
    return A.minmax_symmetric(_vectors(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


_GRAPH = f"{_PAIRS}, g AS (SELECT src, dst, weight FROM e WHERE src < dst AND weight > 0.2)"


def _graph(spark, sf_dir) -> DataFrame:
    return written(E.threshold(_edges(spark, sf_dir, loops=False, least=0.2), 0.2), "graph")


@query(f"""WITH {_GRAPH}, m AS (SELECT sum(weight) AS m FROM g),
d AS (SELECT label, sum(w) AS d FROM (SELECT src AS node, weight AS w FROM g UNION ALL SELECT dst, weight FROM g) JOIN v ON node = id GROUP BY label),
i AS (SELECT a.label, sum(weight) AS l FROM g JOIN v a ON src = a.id JOIN v b ON dst = b.id WHERE a.label = b.label GROUP BY a.label)
SELECT round(sum(coalesce(l, 0) / m - (d / (2 * m)) * (d / (2 * m))), 6) AS modularity FROM d LEFT JOIN i USING (label), m""")
def modularity_by_label(spark, sf_dir):
    membership = _vectors(spark, sf_dir).select(F.col("id").alias("node"), F.col("label").alias("community"))
    return A.modularity(_vectors(spark, sf_dir), membership, 0.2).select(F.round("modularity", 6).alias("modularity"))


_DEG = "dg AS (SELECT node, count(*) AS degree, sum(w) AS strength FROM (SELECT src AS node, weight AS w FROM g UNION ALL SELECT dst, weight FROM g) GROUP BY node)"


@query(f"WITH {_GRAPH}, {_DEG} SELECT node, degree, round(strength, 6) AS strength, round(degree / ((SELECT count(*) FROM dg) - 1.0), 6) AS centrality FROM dg")
def degree_centrality(spark, sf_dir):
    d = written(A.moments(_vectors(spark, sf_dir), 0.2, loops=False).select("node", F.col("n").alias("degree"), F.col("total").alias("strength")), "degrees")
    n = d.agg((F.count("*") - 1.0).alias("n"))
    return d.crossJoin(F.broadcast(n)).select("node", "degree", F.round("strength", 6).alias("strength"), F.round(F.col("degree") / F.col("n"), 6).alias("centrality"))


@query(f"WITH {_GRAPH}, {_DEG} SELECT src, dst, round(-1 / sqrt(a.degree * b.degree), 6) AS entry FROM g JOIN dg a ON src = a.node JOIN dg b ON dst = b.node")
def normalised_laplacian(spark, sf_dir):
    return A.laplacian(_vectors(spark, sf_dir), 0.2).withColumn("entry", F.round("entry", 6))


@query(f"WITH {_GRAPH} SELECT count(*) AS n_edges, round(coalesce(sum(weight), 0), 6) AS weight FROM g WHERE src % 3 = 0 AND dst % 3 = 0")
def induced_subgraph_strength(spark, sf_dir):
    """Edges within the chosen nodes are the pairs of their vectors; each counts at both of its ends."""
    m = A.moments(_vectors(spark, sf_dir).where("id % 3 = 0"), 0.2, loops=False)
    return m.agg(F.coalesce(F.sum("n") / 2, F.lit(0)).cast("long").alias("n_edges"), F.round(F.coalesce(F.sum(F.round(F.col("total") * A.ONE).cast("decimal(38,0)")) / 2 / A.ONE, F.lit(0)).cast("double"), 6).alias("weight"))


@query(f"WITH {_PAIRS} SELECT node, other, weight, rank FROM (SELECT node, other, weight, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other)::INT AS rank FROM s WHERE node <> other) WHERE rank <= 3")
def top3_neighbours(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    near = V.knn(v.withColumnRenamed("id", "qid"), v.withColumnRenamed("id", "iid"), 3, other=True)
    return near.select(F.col("qid").alias("node"), F.col("iid").alias("other"), F.col("sim").alias("weight"), "rank")


def _ranks_sql(weighted: bool) -> str:
    w = "weight" if weighted else "1.0"
    sql = f"WITH {_GRAPH}, a AS (SELECT src, dst, {w} AS w FROM g UNION ALL SELECT dst, src, {w} FROM g), o AS (SELECT src, sum(w) AS o FROM a GROUP BY src), n AS (SELECT count(*) AS n FROM o), r0 AS (SELECT src AS node, 1.0 / n AS r FROM o, n)"
    for t in range(1, 11):
        sql += f", r{t} AS (SELECT a.dst AS node, 0.15 / any_value(n) + 0.85 * sum(r * w / o) AS r FROM r{t - 1} JOIN a ON node = a.src JOIN o ON o.src = a.src, n GROUP BY a.dst)"
    return sql + " SELECT node, round(r, 6) AS rank FROM r10"


@query(_ranks_sql(False))
def pagerank_10_rounds(spark, sf_dir):
    return A.pagerank(_vectors(spark, sf_dir), 0.2, rounds=10).withColumn("rank", F.round("rank", 6))


@query(_ranks_sql(True))
def pagerank_weighted_10_rounds(spark, sf_dir):
    return A.pagerank(_vectors(spark, sf_dir), 0.2, rounds=10, weighted=True).withColumn("rank", F.round("rank", 6))


@query(f"""WITH RECURSIVE {_PAIRS}, g AS (SELECT src, dst FROM e WHERE src < dst AND weight > 0.35), a AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g),
c AS (SELECT src AS node, src AS root FROM a UNION SELECT a.dst, c.root FROM c JOIN a ON c.node = a.src)
SELECT node, min(root) AS component FROM c GROUP BY node""")
def connected_components(spark, sf_dir):
    return R.components(written(A.links(_vectors(spark, sf_dir), 0.35), "links"))


_CENT = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings),
dims AS (SELECT label, i, avg(vec[i]) AS x, sum(vec[i]) AS t FROM v, unnest(range(1, 65)) AS u(i) GROUP BY label, i),
c AS (SELECT label AS mind, list(x ORDER BY i) AS vec FROM dims GROUP BY label)"""


def _minds(spark, sf_dir) -> DataFrame:
    return V.mean_vectors(_vectors(spark, sf_dir), ["label"]).withColumnRenamed("label", "mind")


@query(f"WITH {_CENT} SELECT label, (i - 1)::INT AS dim, round(x, 6) AS mean, round(t, 6) AS total FROM dims")
def centroid_mean_vector(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    mean = V.mean_vectors(v, ["label"]).select("label", F.posexplode("vec").alias("dim", "mean"))
    total = V.mean_vectors(v, ["label"], how="sum").select("label", F.posexplode("vec").alias("dim", "total"))
    return mean.join(total, ["label", "dim"]).select("label", "dim", F.round("mean", 6).alias("mean"), F.round("total", 6).alias("total"))


@query(f"""WITH {_CENT}, s AS (SELECT mind AS qid, id AS iid, round(list_cosine_similarity(c.vec, v.vec), 6) + 0.0 AS sim FROM c, v)
SELECT * FROM (SELECT qid, iid, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, iid)::INT AS rank FROM s) WHERE rank <= 10""")
def knn_top10(spark, sf_dir):
    return V.knn(_minds(spark, sf_dir).withColumnRenamed("mind", "qid"), _vectors(spark, sf_dir).withColumnRenamed("id", "iid"), 10)


@query(f"""WITH {_CENT}, s AS (SELECT id, mind, round(list_cosine_similarity(c.vec, v.vec), 6) + 0.0 AS sim FROM c, v)
SELECT id, mind, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, mind) AS n FROM s) WHERE n = 1""")
def nearest_mind(spark, sf_dir):
    found = V.knn(_vectors(spark, sf_dir).withColumnRenamed("id", "qid"), _minds(spark, sf_dir).withColumnRenamed("mind", "iid"), 1)
    return found.select(F.col("qid").alias("id"), F.col("iid").alias("mind"), "sim")


@query(f"""WITH {_CENT}, s AS (SELECT id, max(round(list_cosine_similarity(c.vec, v.vec), 6)) AS sim FROM c, v GROUP BY id)
SELECT id // 5 AS segment, round(avg(sim), 6) AS score, round(1 / avg(sim), 4) AS distance FROM s GROUP BY id // 5""")
def mind_max_mean_score(spark, sf_dir):
    best = nearest_mind(spark, sf_dir)
    return best.groupBy(F.floor(F.col("id") / 5).alias("segment")).agg(F.round(F.avg("sim"), 6).alias("score"), F.round(1 / F.avg("sim"), 4).alias("distance"))


@query(f"""WITH {_CENT}, k AS (SELECT list(x ORDER BY i) AS vec FROM (SELECT i, avg(vec[i]) AS x FROM v, unnest(range(1, 65)) AS u(i) GROUP BY i))
SELECT id, round(list_cosine_similarity(v.vec, k.vec), 6) + 0.0 AS sim FROM v, k""")
def document_representativeness(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    mean = V.mean_vectors(v.withColumn("all", F.lit(1)), ["all"]).withColumnRenamed("vec", "mean")
    return v.crossJoin(F.broadcast(mean)).select("id", (F.round(V.cosine(F.col("vec"), F.col("mean")), 6) + 0.0).alias("sim"))


_ASSIGNED = f"""{_CENT}, s AS (SELECT id, label AS tag, mind AS cluster, row_number() OVER (PARTITION BY id ORDER BY round(list_cosine_similarity(c.vec, v.vec), 6) DESC, mind) AS n FROM c, v),
a AS (SELECT id, tag, cluster FROM s WHERE n = 1), n AS (SELECT tag, cluster, count(*) AS n FROM a GROUP BY ALL),
dom AS (SELECT cluster, tag, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, tag) AS r FROM n) WHERE r = 1)"""


def _assigned(spark, sf_dir) -> DataFrame:
    best = nearest_mind(spark, sf_dir).select("id", F.col("mind").alias("cluster"))
    return written(_vectors(spark, sf_dir).select("id", F.col("label").alias("tag")).join(best, "id"), "assigned")


@query(f"""WITH {_ASSIGNED}, t AS (SELECT tag, count(*) AS total FROM a GROUP BY tag)
SELECT tag, total, coalesce(max(dom.n), 0) AS best, round(100.0 * coalesce(max(dom.n), 0) / total, 6) AS recall FROM t LEFT JOIN dom USING (tag) GROUP BY tag, total""")
def per_tag_recall(spark, sf_dir):
    return M.tag_recall(_assigned(spark, sf_dir))


@query(f"""WITH {_ASSIGNED}, o AS (SELECT tag, cluster FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, cluster) AS r FROM dom) WHERE r = 1)
SELECT round(100.0 * count(o.tag) / count(*), 6) AS precision FROM a LEFT JOIN o ON a.tag = o.tag AND a.cluster = o.cluster""")
def label_precision_1(spark, sf_dir):
    return M.tag_precision_owned(_assigned(spark, sf_dir))


@query(f"WITH {_ASSIGNED} SELECT round(100.0 * sum((a.tag = dom.tag)::INT) / count(*), 6) AS precision FROM a JOIN dom USING (cluster)")
def label_precision_2(spark, sf_dir):
    return M.tag_precision_dominant(_assigned(spark, sf_dir))


@query(f"""WITH {_ASSIGNED}, f AS (SELECT cluster, avg((tag < 5)::INT) AS part, count(*) AS n FROM a GROUP BY cluster)
SELECT cluster, n, round(part, 6) AS part, part >= 0.25 AS chosen FROM f""")
def cluster_vote(spark, sf_dir):
    return M.cluster_vote(_assigned(spark, sf_dir).withColumn("vote", F.col("tag") < 5))


@query("""SELECT label, count(*) AS n, round(avg(n1), 6) AS mean, round(stddev_pop(n1), 6) AS pstdev, round(stddev_samp(n1), 6) AS stdev, round(var_samp(n1), 6) AS variance,
round(var_pop(n1), 6) AS pvariance, round(max(n1), 6) AS most, round(median(n1), 6) AS median, round(quantile_cont(n1, 0.75) - quantile_cont(n1, 0.25), 6) AS iqr
FROM (SELECT label, embedding[1]::DOUBLE AS n1 FROM embeddings) GROUP BY label""")
def distribution_statistics(spark, sf_dir):
    x = F.col("vec")[0].cast("double")
    r = lambda c, n: F.round(c, 6).alias(n)
    return _vectors(spark, sf_dir).groupBy("label").agg(
        F.count("*").alias("n"), r(F.avg(x), "mean"), r(F.stddev_pop(x), "pstdev"), r(F.stddev_samp(x), "stdev"), r(F.var_samp(x), "variance"), r(F.var_pop(x), "pvariance"),
        r(F.max(x), "most"), r(F.median(x), "median"), r(F.percentile(x, 0.75) - F.percentile(x, 0.25), "iqr"),
    )


@query("SELECT round(embedding[1]::DOUBLE, 1) + 0.0 AS bin, count(*) AS n FROM embeddings GROUP BY ALL")
def score_histogram(spark, sf_dir):
    return _vectors(spark, sf_dir).groupBy((F.round(F.col("vec")[0].cast("double"), 1) + 0.0).alias("bin")).count().withColumnRenamed("count", "n")


@query("""WITH v AS (SELECT vec_id AS id, embedding[1:4]::DOUBLE[] AS s FROM embeddings), x AS (SELECT id, s, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM v)
SELECT id, (list_position(s, list_max(s)) - 1)::BIGINT AS best, round(list_max(e) / list_sum(e), 6) AS probability FROM x""")
def softmax_argmax(spark, sf_dir):
    from ..functions import text as T

    s = F.slice(F.col("vec").cast("array<double>"), 1, 4)
    return _vectors(spark, sf_dir).select("id", T.argmax(s).cast("long").alias("best"), F.round(F.array_max(T.softmax(s)), 6).alias("probability"))


@query(f"""WITH {_ASSIGNED}, k AS (SELECT id // 10 AS grp, cluster, count(*) AS n FROM a GROUP BY ALL)
SELECT grp, cluster, n FROM k WHERE n > 1""")
def community_having(spark, sf_dir):
    a = _assigned(spark, sf_dir)
    return a.groupBy(F.floor(F.col("id") / 10).alias("grp"), "cluster").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""WITH {_ASSIGNED}, k AS (SELECT id // 10 AS grp, cluster, count(*) AS n FROM a GROUP BY ALL)
SELECT grp, cluster, n FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, cluster DESC) AS r FROM k) WHERE r = 1""")
def argmax_with_late_ties(spark, sf_dir):
    a = _assigned(spark, sf_dir)
    n = a.groupBy(F.floor(F.col("id") / 10).alias("grp"), "cluster").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), F.desc("cluster")))
    return n.withColumn("r", r).where("r = 1").drop("r")
