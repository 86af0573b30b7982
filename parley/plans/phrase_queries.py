"""Queries of phrases, entities and what is kept between calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import phrases as P
from ..sources import artifacts
from ..sources.shared import new_path, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_stop = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
#: Tokens of the turns with a tag by length, and a span of up to three tokens at each.
_SPANS = """w AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS w FROM conversations),
t AS (SELECT conv_id, turn, i - 1 AS i, w[i] AS tok, CASE WHEN length(w[i]) > 6 THEN 'NN' WHEN length(w[i]) > 4 THEN 'JJ' ELSE 'O' END AS tag FROM w, unnest(range(1, len(w) + 1)) AS u(i)),
s AS (SELECT conv_id, turn, i AS a, i + length(tok) % 3 AS b FROM t WHERE length(tok) % 4 = 0)"""


def _tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), " ")).alias("i", "tok"))
    n = F.length("tok")
    return rows.select("conv_id", "turn", F.col("i").cast("long").alias("i"), "tok", F.when(n > 6, "NN").when(n > 4, "JJ").otherwise("O").alias("tag"))


def _spans(tokens):
    n = F.length("tok")
    return tokens.where(n % 4 == 0).select("conv_id", "turn", F.col("i").alias("a"), (F.col("i") + n % 3).cast("long").alias("b"))


@query(f"""WITH {_SPANS}, d AS (SELECT DISTINCT * FROM s),
k AS (SELECT * FROM d x WHERE NOT EXISTS (SELECT 1 FROM d y WHERE y.conv_id = x.conv_id AND y.turn = x.turn AND y.a <= x.a AND y.b >= x.b AND (y.a < x.a OR y.b > x.b))),
n AS (SELECT *, coalesce((a > lag(b) OVER o + 1)::INT, 0) AS new FROM k WINDOW o AS (PARTITION BY conv_id, turn ORDER BY a)),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY a) AS grp FROM n)
SELECT conv_id, turn, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY conv_id, turn, grp""")
def candidate_phrase_merge(spark, sf_dir):
    """Candidate phrases inside another are dropped, neighbours are merged."""
    return P.merge_spans(_spans(_tokens(spark, sf_dir)), ["conv_id", "turn"])


@query(f"""WITH {_SPANS}, k AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM t WHERE tag IN ('NN', 'JJ')),
r AS (SELECT *, min(i) OVER (PARTITION BY conv_id, turn, run) AS lo, max(i) OVER (PARTITION BY conv_id, turn, run) AS hi FROM k)
SELECT s.conv_id, s.turn, coalesce(l.lo, s.a) AS a, coalesce(h.hi, s.b) AS b FROM s LEFT JOIN r l ON l.conv_id = s.conv_id AND l.turn = s.turn AND l.i = s.a - 1
LEFT JOIN r h ON h.conv_id = s.conv_id AND h.turn = s.turn AND h.i = s.b + 1""")
def keyphrase_extension(spark, sf_dir):
    """Keyphrases grown to both sides over nouns and adjectives."""
    t = _tokens(spark, sf_dir)
    return P.extend_spans(_spans(t), t, ["conv_id", "turn"], ["NN", "JJ"])


@query(f"""WITH a AS (SELECT conv_id, turn, string_split(lower(text), '. ') AS ss FROM conversations), s AS (SELECT conv_id, turn, i - 1 AS pos, string_split(ss[i], ' ') AS w FROM a, unnest(range(1, len(ss) + 1)) AS u(i)),
k AS (SELECT *, coalesce(list_max(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains({_stop}, w[i]))), 0) AS last FROM s),
e AS (SELECT conv_id, turn, pos, w[1:last] AS w, CASE WHEN turn % 2 = 0 THEN 'O' ELSE 'ORG' END AS label FROM k)
SELECT conv_id, turn, pos, array_to_string(w, ' ') AS entity FROM e WHERE len(w) > 1 OR (len(w) = 1 AND (label <> 'O' OR length(w[1]) > 6))""")
def entity_noun_gate(spark, sf_dir):
    """Trailing stop-words popped; a single word without a label must be a noun."""
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), r"\. ")).alias("pos", "s"))
    e = s.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), P.trim_trailing(T.words(F.col("s")), T.STOP_WORDS).alias("w"), F.when(F.col("turn") % 2 == 0, "O").otherwise("ORG").alias("label"))
    tag = F.when(F.length(F.get("w", F.lit(0))) > 6, "NN").otherwise("JJ")
    return e.where(P.real_entity(F.col("w"), F.col("label"), tag)).select("conv_id", "turn", "pos", F.array_join("w", " ").alias("entity"))


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS phrase FROM documents)
SELECT DISTINCT phrase FROM w WHERE NOT list_contains({_stop}, phrase) AND regexp_matches(phrase, '[^!-/:-@\\[-`{{-~]')""")
def phrases_worth_keeping(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("phrase"))
    return d.where(P.worth_keeping(F.col("phrase"), T.STOP_WORDS)).distinct()


@query("SELECT lower(tok) AS token, max(score) AS score FROM (SELECT unnest(string_split(text, ' ')) AS tok, (doc_id % 1000)::DOUBLE AS score FROM documents) GROUP BY 1")
def token_max_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("tok"), (F.col("doc_id") % 1000).cast("double").alias("score"))
    return P.token_scores(d, "tok", "score")


@query("""WITH p AS (SELECT a.conv_id, a.turn, 1.0 / (1 + a.turn) AS cosine, 1.0 / (1 + b.turn) AS follows, length(a.text) AS n, length(b.text) AS m FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN greatest(n, m) > 2 * least(n, m) THEN 0.4 * cosine + 0.6 * (follows * 0.7) ELSE (cosine + follows * 0.7) / 2 END, 6) AS score FROM p""")
def sentence_pair_blend(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", (1.0 / (1 + F.col("turn"))).alias("cosine"), F.length("text").alias("n"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), (1.0 / (1 + F.col("turn"))).alias("follows"), F.length("text").alias("m"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(P.blended(F.col("cosine"), F.col("follows"), F.col("n"), F.col("m")), 6).alias("score"))


@query("""SELECT vec_id AS entity, ['ORG', 'PER', 'MISC', 'LOC'][(label % 4 + 1)::INT] AS kind FROM embeddings WHERE vec_id % 3 >= 1 AND label % 4 IN (0, 2) AND len(embedding) = (SELECT max(len(embedding)) FROM embeddings)""")
def entity_eligibility(spark, sf_dir):
    """Entities in two sentences or more, no persons and places, with whole vectors."""
    v = table(spark, sf_dir, "embeddings")
    kind = F.element_at(F.array(*map(F.lit, ("ORG", "PER", "MISC", "LOC"))), (F.col("label") % 4 + 1).cast("int"))
    width = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    e = v.select(F.col("vec_id").alias("entity"), kind.alias("label"), (F.col("vec_id") % 3 + 1).alias("n"), F.col("embedding").alias("vec"))
    return P.eligible_entities(e, width).select("entity", F.col("label").alias("kind"))


_RANKS = "w AS (SELECT DISTINCT conv_id, turn, length(x) AS r FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS x FROM conversations)), g AS (SELECT conv_id, turn, list(r) AS s FROM w GROUP BY ALL)"


@query(f"WITH {_RANKS} SELECT a.conv_id, a.turn AS x, b.turn AS y, len(list_intersect(a.s, b.s))::INT AS shared FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.turn < b.turn")
def rank_overlap(spark, sf_dir):
    """Groups of a meeting that share a rank are connected; those that share none make the colour graph."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.transform(F.split("text", " "), lambda x: F.length(x))).alias("r"))
    return P.rank_overlaps(rows, ["conv_id"], "turn", "r")


@query("SELECT user_id, max(ts) AS last, count(*) AS n FROM events GROUP BY user_id")
def context_between_calls(spark, sf_dir):
    """Users kept between three calls: each brings the users of a third of the hours, adds them to what is known of them, and saves."""
    root = new_path(spark, "artifacts")
    e = table(spark, sf_dir, "events").withColumn("call", F.pmod(F.hour("ts"), F.lit(3)))
    for call in range(3):
        new = e.where(F.col("call") == call).groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("n"))
        if artifacts.versions(spark, root, "users"):
            old = artifacts.load(spark, root, "users")
            new = new.unionByName(old.join(new.select("user_id"), "user_id", "left_semi")).groupBy("user_id").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
        users = artifacts.extended(spark, root, "users", new, ["user_id"])
    return users


@query("""WITH c AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT label, i, avg(v[i]) AS x FROM c, unnest(range(1, len(v) + 1)) AS u(i) GROUP BY label, i), m AS (SELECT label, list(x ORDER BY i) AS v FROM d GROUP BY label),
k AS (SELECT m.label, c.vec_id, round(list_cosine_similarity(m.v, c.v), 5) AS score FROM m JOIN c ON TRUE),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM k)
SELECT label, vec_id, score, rank FROM r WHERE rank <= 10""")
def keyphrases_by_entity(spark, sf_dir):
    """Each entity's mean vector and the ten phrases nearest to it."""
    v = table(spark, sf_dir, "embeddings")
    parts = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    # few entities: one row a label, of a checked number
    few = mean.count()
    if few > 10_000:
        raise ValueError(f"{few} entities are too many to send to every task; rank them with functions.vectors.knn")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    m, e = F.col("m"), F.transform("embedding", lambda x: x.cast("double"))
    score = F.round(dot(m, e) / F.sqrt(dot(m, m) * dot(e, e)), 5)
    rows = v.select("vec_id", "embedding").crossJoin(F.broadcast(mean)).select("label", "vec_id", score.alias("score"))
    r = rows.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")))
    return r.where("rank <= 10").select("label", "vec_id", "score", F.col("rank").cast("long").alias("rank"))
