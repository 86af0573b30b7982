"""Composite and iterative queries: rows only, tested by brute force and on small fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import communities as C
from ..operators import detect, groups, models, recency, similarity
from ..operators import sequences as S
from ..sources.shared import new_path, table, written
from ..streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _sentences(spark, sf_dir) -> DataFrame:
    """Sentences of all conversations with their vectors: ``(meeting, node, seg_order, text, vec)``."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting"), F.col("turn").cast("int").alias("seg_order"), F.posexplode(F.split("text", r"(?<=[.?!]) ")).alias("p", "text")).where("text <> ''")
    return detect.embedded(S.ranked(c, ["meeting"], "seg_order", "p", name="node").drop("p"))


def _meeting_edges(spark, sf_dir) -> DataFrame:
    e = V.cosine_pairs(_sentences(spark, sf_dir), "node", "vec", ["meeting"], loops=False)
    return written(e.where("weight > 0.3").select(F.col("meeting").alias("grp"), "src", "dst", "weight"), "meeting_edges")


@query()
def meeting_groups(spark, sf_dir):
    """Which segments of a conversation discuss the same topic, in time order."""
    return groups.group_meetings(written(_sentences(spark, sf_dir), "sentences"))


def _method(name: str) -> None:
    def run(spark, sf_dir):
        return C.per_graph(_meeting_edges(spark, sf_dir), "grp", name)

    run.__name__ = f"graph_{name}"
    QUERIES[run.__name__] = run


for _name in C.METHODS:
    _method(_name)


@query()
def hierarchical_louvain(spark, sf_dir):
    return C.hierarchical(_meeting_edges(spark, sf_dir), "grp")


@query()
def modularity_targeted_pruning(spark, sf_dir):
    return C.modularity_search(_meeting_edges(spark, sf_dir), "grp")


@query()
def action_items(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"(?<=[.?!]) ")).alias("text"))
    made = s.withColumn("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("We should review and send "), "text")).otherwise(F.col("text")))
    return detect.action_items(made)


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, replace(trim(text), '.', '?') AS t FROM conversations) WHERE t LIKE '%?' AND len(string_split(t, ' ')) > 2")
def questions(spark, sf_dir):
    made = F.replace(F.trim("text"), F.lit("."), F.lit("?"))
    return table(spark, sf_dir, "conversations").where(detect.is_question(made)).select("conv_id", "turn")


_NER = """t AS (SELECT doc_id, i - 1 AS word_index, w[i] AS tok, CASE WHEN length(w[i]) > 8 THEN 'B-ORG' WHEN length(w[i]) > 6 THEN 'I-PER' ELSE 'O' END AS label, CASE WHEN length(w[i]) % 5 = 0 THEN 0.5 ELSE 0.999 END::DOUBLE AS score
FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents), unnest(range(1, len(w) + 1)) AS u(i))"""


@query(f"""WITH {_NER}, k AS (SELECT *, regexp_replace(label, '^[BI]-', '') AS kind FROM t WHERE label <> 'O' OR score < 0.995),
n AS (SELECT *, coalesce((word_index - lag(word_index) OVER w > 1 OR lag(kind) OVER w <> kind)::INT, 0) AS b FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY word_index)),
s AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY word_index) AS span FROM n)
SELECT doc_id, min(word_index)::BIGINT AS start, string_agg(tok, ' ' ORDER BY word_index) AS entity, kind AS label, round(avg(score), 4) AS score FROM s GROUP BY doc_id, span, kind""")
def entity_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.lower("text"), " ")).alias("word_index", "tok"))
    n = F.length("tok")
    t = d.select("doc_id", "word_index", "tok", F.when(n > 8, "B-ORG").when(n > 6, "I-PER").otherwise("O").alias("label"), F.when(n % 5 == 0, 0.5).otherwise(0.999).alias("score"))
    return detect.entity_spans(t, ["doc_id"], capitalise=False).select("doc_id", F.col("start").cast("long").alias("start"), "entity", "label", F.round("score", 4).alias("score"))


_RULE = (
    "CASE WHEN NOT regexp_matches(w, '[A-Za-z0-9]') THEN 'PUNC' WHEN regexp_matches(w, '^[0-9.,]+$') THEN 'NUM' WHEN lower(w) IN (" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS) + ") THEN 'O' "
    "WHEN regexp_matches(w, '^[A-Z]') THEN 'PROPN' WHEN regexp_matches(lower(w), '(ing|ed|ize|ise)$') THEN 'VERB' WHEN regexp_matches(lower(w), '(ous|ful|ive|able|al|ic)$') THEN 'ADJ' WHEN regexp_matches(lower(w), 'ly$') THEN 'ADV' ELSE 'NOUN' END"
)


@query(f"""SELECT conv_id, turn, array_to_string(regexp_extract_all(array_to_string(list_transform(string_split(text, ' '), lambda w: '<' || {_RULE} || '>'), ''), '(<ADJ>)*(<NOUN>|<PROPN>)+'), ' ') AS chunks FROM conversations""")
def noun_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(detect.chunks(detect.rule_tags(T.words(F.col("text")))), " ").alias("chunks"))


@query()
def packed_paragraphs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_sentences_with_delimiter(F.col("text"))).alias("pos", "text"))
    return detect.packed_paragraphs(d.withColumn("label", F.length("text") % 3), "doc_id")


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings),
n AS (SELECT a.id AS qid, b.label AS community, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 6) DESC, b.id) AS r FROM v a, v b WHERE a.id % 10 = 0 AND b.id % 10 <> 0),
c AS (SELECT qid, community, count(*) AS votes, min(r) AS best FROM n WHERE r <= 10 GROUP BY qid, community), f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, best) AS place FROM c)
SELECT qid, CASE WHEN votes >= 2 THEN community ELSE -1 END AS community FROM f WHERE place = 1""")
def community_placement(spark, sf_dir):
    """New vectors placed by the communities of their ten nearest known ones."""
    v = table(spark, sf_dir, "embeddings")
    new = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    known = v.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("iid"), F.col("embedding").alias("vec"), F.col("label").alias("community"))
    return recency.place(new, known)


@query()
def kmeans_clusters(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return models.kmeans(v).select("id", "cluster")


@query()
def gaussian_mixture(spark, sf_dir):
    v = models.pca(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), k=3)
    return models.gaussian_mixture(v, "pca").select("id", "cluster")


@query()
def lda_topics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return models.lda(d, rounds=5).select("doc_id", F.transform("topics", lambda x: F.round(x, 3)).cast("string").alias("topics"))


@query()
def extractive_summary(spark, sf_dir):
    return models.summaries(_sentences(spark, sf_dir).select("meeting", F.col("node").alias("pos"), "text", "vec"), "meeting")


@query()
def influential_nodes(spark, sf_dir):
    """Of each meeting's communities the node of the highest strength."""
    e = _meeting_edges(spark, sf_dir)
    of = C.per_graph(e, "grp", "louvain")
    ends = e.select("grp", F.explode(F.array("src", "dst")).alias("node"), "weight").groupBy("grp", "node").agg(F.sum("weight").alias("strength"))
    return S.first_of(of.join(ends, ["grp", "node"]), ["grp", "value"], F.desc("strength"), "node").select("grp", "value", "node", F.round("strength", 6).alias("strength"))


@query("""WITH c AS (SELECT (epoch_us(ts) // 3600000000)::BIGINT AS call, event_type AS community, count(*) AS n FROM events GROUP BY ALL)
SELECT community, call, coalesce(sum(n) OVER (PARTITION BY community ORDER BY call RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lc,
coalesce(sum(n) OVER (PARTITION BY community ORDER BY call RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gc FROM c""")
def recency_stream(spark, sf_dir):
    """The recency counters as a stream with state; the same rows as the batch form."""
    e = table(spark, sf_dir, "events")
    calls = e.groupBy(F.col("event_type").alias("community"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("call")).agg(F.count("*").alias("n"))
    source, out = new_path(spark, "calls"), new_path(spark, "recency")
    calls.repartition("community").write.parquet(source)  # a micro-batch reads all files, and a community's calls are put in order
    stream = spark.readStream.schema(calls.schema).parquet(source)
    streams.run_to_table(streams.recency(stream), out, new_path(spark, "checkpoint"))
    return spark.read.parquet(out)


@query("""WITH g AS (SELECT user_id, ts, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 120000000)::INT, 0) AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g)
SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, (epoch_us(max(ts)) + 120000000)::BIGINT AS end_us, count(*) AS n FROM s GROUP BY user_id, island""")
def session_stream(spark, sf_dir):
    """Sessions of 120 seconds from a stream of events, the last ones closed at its end."""
    e = streams.ended(table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")))
    source, out = new_path(spark, "events"), new_path(spark, "sessions")
    e.write.parquet(source)
    stream = spark.readStream.schema(e.schema).parquet(source)
    streams.run_to_table(streams.sessions(stream, "user_id"), out, new_path(spark, "checkpoint"))
    return spark.read.parquet(out).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def _contracted_sql(rounds: int = 10) -> str:
    sql = """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, CASE WHEN label < 3 THEN -1 - label ELSE vec_id END AS own FROM embeddings),
e AS (SELECT DISTINCT least(a.own, b.own) AS src, greatest(a.own, b.own) AS dst FROM v a JOIN v b ON a.id < b.id WHERE a.own <> b.own AND round(list_cosine_similarity(a.vec, b.vec), 6) > 0.2),
a AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), o AS (SELECT src, count(*) AS o FROM a GROUP BY src), n AS (SELECT count(*) AS n FROM o), r0 AS (SELECT src AS node, 1.0 / n AS r FROM o, n)"""
    for t in range(1, rounds + 1):
        sql += f", r{t} AS (SELECT a.dst AS node, 0.15 / any_value(n) + 0.85 * sum(r / o) AS r FROM r{t - 1} JOIN a ON node = a.src JOIN o ON o.src = a.src, n GROUP BY a.dst)"
    return sql + f" SELECT node, round(r, 6) AS rank FROM r{rounds} WHERE node < 0"


@query(_contracted_sql())
def entity_pagerank_of_groups(spark, sf_dir):
    """Rank of each label's contracted super-node among all nodes."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.when(F.col("label") < 3, -1 - F.col("label").cast("long")).alias("into"))
    return similarity.contracted_pagerank(v, 0.2, rounds=10).select("node", F.round("rank", 6).alias("rank"))
