"""Further queries: phrase alignment, tags, placement, splits and pseudo data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens
from ..functions import vectors as V
from ..operators import property_graph as G
from ..operators import sequences as S
from ..sources.shared import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(r"""WITH h AS (SELECT page_id, string_split(regexp_extract(lower(url), '^[a-z]+://([^/:?#]*)', 1), '.') AS h FROM pages)
SELECT page_id, array_to_string(list_slice(h, greatest(len(h) - CASE WHEN length(h[len(h)]) = 2 AND h[len(h) - 1] IN ('ac', 'co', 'com', 'edu', 'go', 'gov', 'ne', 'net', 'or', 'org') THEN 2 ELSE 1 END, 1), len(h)), '.') AS domain FROM h""")
def registered_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tokens.registered_domain(F.col("url")).alias("domain"))


@query("""WITH w AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents), s AS (SELECT doc_id, w, list_slice(w, 3, 4) AS sub FROM w WHERE len(w) >= 4)
SELECT doc_id, i - 1 AS start FROM s, unnest(range(1, len(w))) AS u(i) WHERE w[i] = sub[1] AND w[i + 1] = sub[2]""")
def sublist_positions(spark, sf_dir):
    """Where a phrase (here the third and fourth word) stands in its text."""
    w = F.split(F.lower("text"), " ")
    d = table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).where(F.size("w") >= 4).withColumn("sub", F.slice("w", 3, 2))
    at = F.filter(F.transform("w", lambda x, i: F.when((x == F.col("sub")[0]) & (F.get(F.col("w"), i + 1) == F.col("sub")[1]), i)), lambda i: i.isNotNull())
    return d.select("doc_id", F.explode(at).alias("start")).select("doc_id", F.col("start").cast("long").alias("start"))


@query("""WITH n AS (SELECT user_id, date_trunc('day', ts) AS day, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, seen) AS r FROM n) WHERE r = 1""")
def same_time_majority(spark, sf_dir):
    """Rows of one time collapse to their commonest value."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return S.mode(e, ["user_id", "day"], "event_type", "event_id")


@query("""WITH n AS (SELECT p_brand AS tag, p_name AS other, count(*) AS n FROM part GROUP BY ALL)
SELECT tag, other, n, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, other) AS r FROM n) WHERE r <= 4""")
def top4_tags(spark, sf_dir):
    n = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("tag"), F.col("p_name").alias("other")).agg(F.count("*").alias("n"))
    return S.ranked(n, ["tag"], F.desc("n"), "other").where("rank < 4").withColumn("rank", F.col("rank") + 1)


@query("""WITH c AS (SELECT c_nationkey AS call, c_custkey AS grp, CASE WHEN c_acctbal > 8000 THEN 0 ELSE 1 END AS kind, c_acctbal AS v FROM customer)
SELECT call, grp, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY call ORDER BY kind, v DESC, grp) AS r FROM c) WHERE r <= 5""")
def first5_groups(spark, sf_dir):
    """The first five of each call, groups seen lately before the others."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("call"), F.col("c_custkey").alias("grp"), F.when(F.col("c_acctbal") > 8000, 0).otherwise(1).alias("kind"), F.col("c_acctbal").alias("v"))
    return S.ranked(c, ["call"], "kind", F.desc("v"), "grp").where("rank < 5").select("call", "grp", (F.col("rank") + 1).alias("rank"))


@query("""WITH v AS (SELECT vec_id AS id, vec_id // 6 AS grp, vec_id % 6 AS pos, embedding::DOUBLE[] AS vec FROM embeddings),
p AS (SELECT a.grp, row_number() OVER (PARTITION BY a.grp ORDER BY a.pos, b.pos) AS r, list_cosine_similarity(a.vec, b.vec) AS s FROM v a JOIN v b ON a.grp = b.grp AND a.pos < 3 AND b.pos >= 3)
SELECT grp, round(avg(s), 6) AS mean_all, round(avg(s) FILTER (r <= 3), 6) AS mean_first3 FROM p GROUP BY grp""")
def keyphrase_pair_score(spark, sf_dir):
    """Mean cosine of two phrase lists, of all pairs and of the first three."""
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 6).alias("grp"), (F.col("vec_id") % 6).alias("pos"), F.col("embedding").alias("vec"))
    a = v.where("pos < 3").select("grp", F.col("pos").alias("p"), F.col("vec").alias("a"))
    b = v.where("pos >= 3").select("grp", F.col("pos").alias("q"), F.col("vec").alias("b"))
    p = S.ranked(a.join(b, "grp").select("grp", "p", "q", V.cosine(F.col("a"), F.col("b")).alias("s")), ["grp"], "p", "q", name="r")
    return p.groupBy("grp").agg(F.round(F.avg("s"), 6).alias("mean_all"), F.round(F.avg(F.when(F.col("r") < 3, F.col("s"))), 6).alias("mean_first3"))


_NOUNS = "e AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


@query(f"""WITH {_NOUNS} SELECT p_partkey AS id, p_name AS phrase FROM part WHERE EXISTS (SELECT 1 FROM u WHERE a = split_part(p_name, ' ', 1) AND b = split_part(p_name, ' ', 2))""")
def noun_connectivity_filter(spark, sf_dir):
    """Phrases whose other words are neighbours of their first in a word graph."""
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    edges = p.select(w[0].alias("src"), w[1].alias("dst")).distinct()
    return G.within_neighbours(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("phrase")), edges)


@query("""WITH c AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS w FROM conversations), k AS (SELECT DISTINCT conv_id, unnest(w) AS x, turn FROM c)
SELECT a.conv_id, a.turn AS src, b.turn AS dst, count(*) AS n FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.x = b.x AND a.turn < b.turn GROUP BY ALL""")
def edge_inheriting_sentences(spark, sf_dir):
    """Sentences are linked if their terms are."""
    k = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split(F.lower("text"), " ")).alias("x")).distinct()
    a, b = k.withColumnRenamed("turn", "src"), k.withColumnRenamed("turn", "dst")
    return a.join(b, ["conv_id", "x"]).where("src < dst").groupBy("conv_id", "src", "dst").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS id, CASE WHEN md5('7-' || o_orderkey) < 'cccc' THEN 'train' ELSE 'test' END AS part FROM orders""")
def shuffled_split(spark, sf_dir):
    """A seeded split by hash: the same on every run and at every partitioning, without a sort."""
    part = F.when(F.md5(F.concat(F.lit("7-"), F.col("o_orderkey"))) < "cccc", "train").otherwise("test")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), part.alias("part"))


@query("""WITH g AS (SELECT i, 'please ' || ['send', 'review', 'update', 'check'][(i % 4 + 1)::INT] || ' the ' || ['report', 'plan', 'budget'][(i // 7 % 3 + 1)::INT] AS text, i % 2 AS y FROM range(100000) AS u(i))
SELECT text, y::INT AS label, count(*) AS n FROM g GROUP BY ALL""")
def pseudo_data(spark, sf_dir):
    """Made training sentences, repeats counted."""
    i = F.col("id")
    verb = F.element_at(F.array(*map(F.lit, ("send", "review", "update", "check"))), (i % 4 + 1).cast("int"))
    noun = F.element_at(F.array(*map(F.lit, ("report", "plan", "budget"))), (F.floor(i / 7) % 3 + 1).cast("int"))
    g = spark.range(100_000).select(F.concat(F.lit("please "), verb, F.lit(" the "), noun).alias("text"), (i % 2).cast("int").alias("label"))
    return g.groupBy("text", "label").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS w FROM conversations)
SELECT conv_id, turn, len(list_filter(w, lambda x: length(x) > 4)) AS n_subject, coalesce(length(list_filter(w, lambda x: length(x) > 4)[-1]), 0) AS last_length FROM w
WHERE len(list_filter(w, lambda x: length(x) > 4)) > 4 OR (len(list_filter(w, lambda x: length(x) > 4)) > 3 AND length(list_filter(w, lambda x: length(x) > 4)[-1]) > 4)""")
def subject_length_gate(spark, sf_dir):
    s = F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) > 4)
    n = F.size(s)
    last = F.coalesce(F.length(F.get(s, n - 1)), F.lit(0))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", n.cast("long").alias("n_subject"), last.cast("long").alias("last_length"))
    return rows.where("n_subject > 4 or (n_subject > 3 and last_length > 4)")


@query(r"SELECT conv_id, turn, array_to_string(regexp_extract_all(regexp_replace(strip_accents(lower(text)), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[^\s\p{P}\p{S}]+|[\p{P}\p{S}]'), ' ') AS tokens FROM conversations")
def basic_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(tokens.basic_tokens(F.col("text")), " ").alias("tokens"))


@query()
def synonym_substitution(spark, sf_dir):
    """Each vector replaced by one of its nearest others, chosen by hash from rank 2 to 10."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    near = V.knn(v, v.withColumnRenamed("qid", "iid"), 15)
    return near.where(F.col("rank") == 2 + F.pmod(F.xxhash64("qid"), F.lit(9))).select("qid", F.col("iid").alias("as"))


@query("""WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), n AS (SELECT conv_id, turn, len(w) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY len(w) DESC, turn) AS r FROM t)
SELECT conv_id, turn, n, (r - 1)::INT AS rank, max(n) OVER (PARTITION BY conv_id) > 1 AND n >= 40 AS kept FROM n""")
def singleton_group_gate(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    rows = S.ranked(table(spark, sf_dir, "conversations").select("conv_id", "turn", T.word_count(F.col("text")).cast("long").alias("n")), ["conv_id"], F.desc("n"), "turn")
    return rows.withColumn("kept", (F.max("n").over(w) > 1) & (F.col("n") >= 40))
