"""Queries over conversations, events and the star schema: joins, windows, sets, graphs and recency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import property_graph as G
from ..operators import ranking as R
from ..operators import recency
from ..operators import sequences as S
from ..sources import requests
from ..sources.shared import new_path, table, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark, sf_dir, name) -> DataFrame:
    return table(spark, sf_dir, name)


# requests and responses


@query("""SELECT conv_id::VARCHAR AS context_id, (conv_id * 100 + turn)::VARCHAR AS id, trim(text) AS text, role AS spoken_by,
(row_number() OVER (PARTITION BY conv_id ORDER BY lpad(turn::VARCHAR, 4, '0')) - 1)::INT AS seg_order FROM conversations WHERE trim(text) <> ''""")
def request_decoder(spark, sf_dir):
    """Each conversation as a JSON request, decoded into its segments in order of start."""
    c = _t(spark, sf_dir, "conversations")
    seg = F.struct(
        (F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("id"), F.col("text").alias("originalText"), F.lpad(F.col("turn").cast("string"), 4, "0").alias("startTime"), F.col("role").alias("spokenBy")
    )
    body = c.groupBy("conv_id").agg(F.to_json(F.struct(F.struct(F.col("conv_id").cast("string").alias("contextId"), F.collect_list(seg).alias("segments")).alias("body"))).alias("value"))
    return requests.decode(body, "value").select("context_id", "id", "text", "spoken_by", "seg_order")


@query("SELECT conv_id::VARCHAR AS context_id, grp::INT AS grp, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM (SELECT *, turn // 2 AS grp FROM conversations) GROUP BY conv_id, grp")
def response_encoder(spark, sf_dir):
    """Groups encoded as the JSON response and read back from it."""
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("context_id"), F.floor(F.col("turn") / 2).cast("int").alias("group_id"), F.col("turn").cast("int").alias("pos"), F.col("turn").cast("string").alias("seg_id"))
    out = requests.encode(c)
    got = out.select("context_id", F.from_json("body", "struct<group:map<string,array<struct<id:string>>>>")["group"].alias("g")).select("context_id", F.explode("g").alias("grp", "segs"))
    return got.select("context_id", F.col("grp").cast("int").alias("grp"), F.array_join(F.transform("segs", lambda s: s["id"]), ",").alias("turns"))


@query("SELECT conv_id, turn // 2 AS grp, count(*) AS no_of_segment, arg_min(role, turn) AS author, count(DISTINCT role) AS authors FROM conversations GROUP BY ALL")
def topics_summary(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").withColumn("grp", F.floor(F.col("turn") / 2))
    return c.groupBy("conv_id", "grp").agg(F.count("*").alias("no_of_segment"), F.min_by("role", "turn").alias("author"), F.countDistinct("role").alias("authors"))


@query("""WITH p AS (SELECT conv_id, turn, 1.0 / (1 + length(text) % 97) AS distance, turn // 2 AS grp FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY distance, turn) AS r FROM p), g AS (SELECT conv_id, grp, min(r) AS r FROM o WHERE r <= 10 GROUP BY ALL)
SELECT conv_id, grp, (row_number() OVER (PARTITION BY conv_id ORDER BY r))::INT AS rank FROM g""")
def topic_pims(spark, sf_dir):
    """The ten nearest segments of each conversation, mapped to distinct groups in order of distance."""
    p = _t(spark, sf_dir, "conversations").select("conv_id", "turn", (1.0 / (1 + F.length("text") % 97)).alias("distance"), F.floor(F.col("turn") / 2).alias("grp"))
    top = S.ranked(p, ["conv_id"], "distance", "turn", name="r").where("r < 10")
    g = top.groupBy("conv_id", "grp").agg(F.min("r").alias("r"))
    return g.select("conv_id", "grp", F.row_number().over(Window.partitionBy("conv_id").orderBy("r")).alias("rank"))


@query("SELECT o_orderkey AS id, o_totalprice AS score, upper(o_orderpriority) AS label FROM orders")
def csv_source_and_sink(spark, sf_dir):
    """Rows written as CSV with a header and read again by schema."""
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.upper("o_orderpriority").alias("label"))
    path = new_path(spark, "csv")
    rows.write.option("header", True).csv(path)
    return requests.read_csv(spark, path, "id long, score double, label string")


@query("SELECT doc_id, split_part(text, ' ', 1) || '.' || split_part(text, ' ', 2) || '.' || split_part(text, ' ', 3) || '.' || split_part(text, ' ', 4) AS story, split_part(text, ' ', 5) AS cont1, split_part(text, ' ', 6) AS cont2, (doc_id % 2)::INT AS label FROM documents")
def story_reader(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    w = F.split("text", " ")
    rows = d.select("doc_id", *[F.coalesce(F.get(w, F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(6)], (F.col("doc_id") % 2).cast("int").alias("label"))
    return requests.stories(rows).select("doc_id", "story", "cont1", "cont2", "label")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, i AS line_no, trim(ls[i]) AS line FROM l, unnest(range(1, len(ls) + 1)) AS u(i)),
s AS (SELECT *, sum((line = '' OR line_no % 4 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS sentence FROM x)
SELECT doc_id, sentence::BIGINT AS sentence, string_agg(split_part(line, ' ', 1), ' ' ORDER BY line_no) AS words, string_agg(regexp_extract(line, '[^ ]*$'), ' ' ORDER BY line_no) AS labels FROM s WHERE line <> '' AND line_no % 4 <> 0 GROUP BY doc_id, sentence""")
def conll_sentences(spark, sf_dir):
    """Lines of ``word ... label``, every fourth a break, to sentences of words and labels."""
    d = _t(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), F.when((F.col("p") + 1) % 4 == 0, "").otherwise(F.trim("line")).alias("line"))
    s = requests.conll(lines, ["doc_id"])
    return s.select("doc_id", "sentence", F.array_join("words", " ").alias("words"), F.array_join("labels", " ").alias("labels"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND len(string_split(text, ' ')) > 6")
def chat_filter(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("message").alias("type"), F.when(F.col("role") == "user", F.col("role")).alias("user"), F.when(F.col("role") != "user", F.col("role")).alias("bot_id"), "text")
    return requests.chat_messages(c, least_words=6).select("conv_id", "turn")


# joins


@query("SELECT a.conv_id, a.turn AS src, b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn - a.turn BETWEEN 0 AND 1 AND a.turn <> b.turn")
def band_join_next_turn(spark, sf_dir):
    return S.next_within(_t(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", "turn")


@query("SELECT md5(text) AS a, md5(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS b, conv_id, turn FROM conversations QUALIFY lead(text) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL")
def adjacent_sentences(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("a"), F.md5(F.lead("text").over(w)).alias("b")).where("b is not null")


_INTERVALS = "i AS (SELECT o_custkey AS grp, o_orderkey AS id, o_orderdate AS s, o_orderdate + to_days((o_orderkey % 400)::INT) AS e, (o_orderkey % 3)::INT AS n FROM orders)"


@query(f"WITH {_INTERVALS} SELECT a.grp, a.id AS inner_id, b.id AS outer_id FROM i a JOIN i b ON a.grp = b.grp AND a.id <> b.id AND a.s BETWEEN b.s AND b.e AND a.e BETWEEN b.s AND b.e AND (a.n > 1 OR b.n > 1)")
def interval_containment(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.make_dt_interval(F.col("o_orderkey") % 400)).alias("end"), (F.col("o_orderkey") % 3).cast("int").alias("n"))
    return S.contained(o, ["grp"])


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0")
def lookup_chain(spark, sf_dir):
    """Two dictionary look-ups in a row."""
    c = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey")
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def key_intersection(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT '<CTX>-' || c_name AS entity FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_name LIKE 'Customer%'")
def new_entities_antijoin(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").where(F.col("c_name").startswith("Customer")).join(o, "c_custkey", "left_anti").select(F.concat(F.lit("<CTX>-"), "c_name").alias("entity"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(label, 'MISC') AS label FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS label FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def lookup_with_default(spark, sf_dir):
    n = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("label"))
    return _t(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("label", F.lit("MISC")).alias("label"))


@query("""WITH a AS (SELECT conv_id, turn, string_split(text, '. ') AS ss FROM conversations), s AS (SELECT conv_id, turn, i - 1 AS pos, ss[i] AS sent FROM a, unnest(range(1, len(ss) + 1)) AS u(i))
SELECT s.conv_id, s.turn, s.pos, min(c.turn) AS first_segment, max(c.turn) AS last_segment FROM s JOIN conversations c ON s.conv_id = c.conv_id AND contains(c.text, s.sent) GROUP BY s.conv_id, s.turn, s.pos""")
def containing_segment(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    s = c.select("conv_id", "turn", F.posexplode(F.split("text", r"\. ")).alias("pos", "sent")).withColumn("pos", F.col("pos").cast("long"))
    other = c.select("conv_id", F.col("turn").alias("t2"), F.col("text").alias("whole"))
    return s.join(other, "conv_id").where(F.contains("whole", F.col("sent"))).groupBy("conv_id", "turn", "pos").agg(F.min("t2").alias("first_segment"), F.max("t2").alias("last_segment"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT x.b AS src, y.b AS dst, count(DISTINCT x.l_orderkey) AS n FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.b < y.b GROUP BY x.b, y.b HAVING count(DISTINCT x.l_orderkey) > 1""")
def cooccurrence_pairs(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("b")), "l_partkey").select("l_orderkey", "b").distinct()
    pair = l.withColumnRenamed("b", "src").join(l.withColumnRenamed("b", "dst"), "l_orderkey").where("src < dst")
    return pair.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")


_MENTIONS = """m AS (SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN 'E' ELSE 'K' END || (l_partkey % 40) AS term, CASE WHEN l_partkey % 2 = 0 THEN 'entity' ELSE 'keyphrase' END AS kind, l_suppkey AS meeting_id, l_orderkey AS para_id, l_linenumber % 2 AS sent_id FROM lineitem)"""


@query(f"""WITH {_MENTIONS}, p AS (SELECT a.term AS src, b.term AS dst, a.kind AS ka, b.kind AS kb, a.meeting_id, a.para_id, a.sent_id AS sa, b.sent_id AS sb FROM m a JOIN m b ON a.meeting_id = b.meeting_id AND a.para_id = b.para_id
AND ((a.kind = 'entity' AND b.kind = 'keyphrase') OR (a.kind = b.kind AND a.term < b.term)))
SELECT src, dst, count(DISTINCT meeting_id) AS meet_ctr, count(DISTINCT (meeting_id, para_id)) AS para_ctr, count(DISTINCT (meeting_id, para_id, sa)) FILTER (sa = sb) AS sent_ctr FROM p GROUP BY src, dst, ka, kb
HAVING (ka <> 'keyphrase' OR count(DISTINCT (meeting_id, para_id, sa)) FILTER (sa = sb) >= 2) AND (kb <> 'keyphrase' OR count(DISTINCT (meeting_id, para_id, sa)) FILTER (sa = sb) >= 1)""")
def knowledge_graph_edges(spark, sf_dir):
    p = F.col("l_partkey") % 2 == 0
    m = _t(spark, sf_dir, "lineitem").select(
        F.concat(F.when(p, "E").otherwise("K"), F.col("l_partkey") % 40).alias("term"), F.when(p, "entity").otherwise("keyphrase").alias("kind"), F.col("l_suppkey").alias("meeting_id"), F.col("l_orderkey").alias("para_id"), (F.col("l_linenumber") % 2).alias("sent_id")
    )
    return G.cooccurring(m)


@query(f"WITH {_MENTIONS} SELECT term, count(DISTINCT meeting_id) AS meet_ctr, count(DISTINCT (meeting_id, para_id)) AS para_ctr, count(*) AS sent_ctr FROM m GROUP BY term")
def knowledge_graph_nodes(spark, sf_dir):
    p = F.col("l_partkey") % 2 == 0
    m = _t(spark, sf_dir, "lineitem").select(F.concat(F.when(p, "E").otherwise("K"), F.col("l_partkey") % 40).alias("term"), F.col("l_suppkey").alias("m"), F.col("l_orderkey").alias("p"), (F.col("l_linenumber") % 2).alias("s")).distinct()
    return m.groupBy("term").agg(F.countDistinct("m").alias("meet_ctr"), F.countDistinct("m", "p").alias("para_ctr"), F.count("*").alias("sent_ctr"))


@query("""WITH w AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS w FROM part)
SELECT id, w[i] AS token FROM w, unnest(range(1, len(w) + 1)) AS u(i) WHERE len(w) > 1 AND w[i] IN (SELECT lower(split_part(p_name, ' ', 2)) FROM part)""")
def phrase_token_expansion(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    w = F.split(F.lower("p_name"), " ")
    nouns = p.select(F.get(w, F.lit(1)).alias("token")).distinct()
    return p.where(F.size(w) > 1).select(F.col("p_partkey").alias("id"), F.explode(w).alias("token")).join(nouns, "token", "left_semi").select("id", "token")


@query("SELECT a.conv_id, a.turn AS x, b.turn AS y FROM (SELECT conv_id, turn, string_split(lower(text), ' ') AS w FROM conversations) a JOIN (SELECT conv_id, turn, string_split(lower(text), ' ') AS w FROM conversations) b ON a.conv_id = b.conv_id AND a.turn < b.turn AND NOT list_has_any(a.w, b.w)")
def disjoint_phrase_pairs(spark, sf_dir):
    w = F.split(F.lower("text"), " ")
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", w.alias("w"))
    a, b = c.select("conv_id", F.col("turn").alias("x"), F.col("w").alias("a")), c.select("conv_id", F.col("turn").alias("y"), F.col("w").alias("b"))
    return a.join(b, "conv_id").where((F.col("x") < F.col("y")) & ~F.arrays_overlap("a", "b")).select("conv_id", "x", "y")


@query("SELECT conv_id, turn, i AS pos, w[i + 1] AS word, length(w[i + 1]) AS len FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), unnest(range(0, len(w))) AS u(i)")
def zip_join(spark, sf_dir):
    w = F.split("text", " ")
    z = F.arrays_zip(w.alias("w"), F.transform(w, lambda x: F.length(x)).alias("n"))
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(z).alias("pos", "z"))
    return rows.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("z")["w"].alias("word"), F.col("z")["n"].cast("long").alias("len"))


# windows


_TURN_ISLANDS = """t AS (SELECT conv_id, length(text) % 3 AS topic, turn FROM conversations),
i AS (SELECT conv_id, topic, turn, sum(b) OVER (PARTITION BY conv_id, topic ORDER BY turn) AS island FROM
(SELECT *, coalesce((turn - lag(turn) OVER (PARTITION BY conv_id, topic ORDER BY turn) > 1)::INT, 0) AS b FROM t))"""


def _topic_turns(spark, sf_dir):
    """All turns, each with a topic; those of one topic are not in a row."""
    return _t(spark, sf_dir, "conversations").select("conv_id", (F.length("text") % 3).cast("long").alias("topic"), "turn")


@query(f"WITH {_TURN_ISLANDS} SELECT conv_id, topic::BIGINT AS topic, turn, island::BIGINT AS island FROM i")
def islands_by_turn(spark, sf_dir):
    return S.islands(_topic_turns(spark, sf_dir), ["conv_id", "topic"], "turn")


@query(f"WITH {_TURN_ISLANDS}, c AS (SELECT *, count(*) OVER (PARTITION BY conv_id, topic, island) AS n, max(island) OVER (PARTITION BY conv_id, topic) AS last FROM i) SELECT conv_id, topic::BIGINT AS topic, turn, island::BIGINT AS island FROM c WHERE last = 0 OR island < last OR n > 1")
def islands_by_turn_compat(spark, sf_dir):
    """The quirk kept: a trailing row after a break is dropped."""
    return S.islands(_topic_turns(spark, sf_dir), ["conv_id", "topic"], "turn", compat=True)


@query("""WITH g AS (SELECT user_id, ts, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 120000000)::INT, 0) AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, session HAVING count(*) > 1""")
def time_sessions_120s(spark, sf_dir):
    e = S.sessions(_t(spark, sf_dir, "events").select("user_id", "ts"), ["user_id"], "ts", 120)
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).where("n > 1")


@query("SELECT event_id, round(CASE WHEN row_number() OVER w >= 7 THEN avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 6 PRECEDING) END, 4) AS mean7 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def rolling7(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.round(S.rolling_mean(F.col("value"), ["user_id"], "event_id"), 4).alias("mean7"))


@query("""WITH g AS (SELECT o_custkey AS grp, o_orderkey AS ord, o_orderkey % 3 AS first, (o_orderkey // 8) % 3 AS last FROM orders), b AS (SELECT *, coalesce((lag(last) OVER (PARTITION BY grp ORDER BY ord) <> first)::INT, 0) AS b FROM g)
SELECT grp, ord, (sum(b) OVER (PARTITION BY grp ORDER BY ord))::BIGINT AS merged FROM b""")
def consecutive_merge(spark, sf_dir):
    g = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 3).alias("first"), (F.floor(F.col("o_orderkey") / 8) % 3).alias("last"))
    return S.merged_runs(g, ["grp"], "ord", "first", "last").select("grp", "ord", "merged")


@query("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) AS r FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY user_id, event_type)) WHERE r = 1")
def mode_first_seen(spark, sf_dir):
    return S.mode(_t(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def concatenated_texts(spark, sf_dir):
    return S.joined_text(_t(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS rank FROM conversations WHERE len(string_split(text, ' ')) > 10")
def rerank_after_filter(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").where(F.size(F.split("text", " ")) > 10).select("conv_id", "turn")
    return S.ranked(c, ["conv_id"], "turn")


@query("SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0, 4) AS minutes FROM events GROUP BY user_id")
def minutes_from_start(spark, sf_dir):
    m = lambda c: F.unix_micros(c.cast("timestamp"))
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.round((m(F.max("ts")) - m(F.min("ts"))) / 60000000.0, 4).alias("minutes"))


_WORDS = "w AS (SELECT doc_id, i, w[i] AS tok, CASE WHEN length(w[i]) > 6 THEN 'NN' WHEN length(w[i]) > 4 THEN 'JJ' ELSE 'O' END AS tag FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents), unnest(range(1, len(w) + 1)) AS u(i))"


def _tagged(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "tok"))
    n = F.length("tok")
    return d.select("doc_id", (F.col("p") + 1).alias("i"), "tok", F.when(n > 6, "NN").when(n > 4, "JJ").otherwise("O").alias("tag"))


@query(f"""WITH {_WORDS}, r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM w WHERE tag <> 'O'), n AS (SELECT *, max(CASE WHEN tag = 'NN' THEN i END) OVER (PARTITION BY doc_id, island) AS last_nn FROM r)
SELECT doc_id, island::BIGINT AS island, string_agg(tok, ' ' ORDER BY i) AS phrase FROM n WHERE i <= last_nn GROUP BY doc_id, island""")
def noun_phrase_runs(spark, sf_dir):
    """Runs of NN and JJ that hold an NN, trailing JJ left out."""
    w = Window.partitionBy("doc_id").orderBy("i")
    r = _tagged(spark, sf_dir).where("tag <> 'O'").withColumn("island", (F.col("i") - F.row_number().over(w)).cast("long"))
    r = r.withColumn("last_nn", F.max(F.when(F.col("tag") == "NN", F.col("i"))).over(Window.partitionBy("doc_id", "island"))).where("i <= last_nn")
    return S.joined_text(r, ["doc_id", "island"], "i", "tok").withColumnRenamed("tok", "phrase")


@query(f"""WITH {_WORDS}, g AS (SELECT *, CASE i % 3 WHEN 0 THEN 'B-' WHEN 1 THEN 'I-' ELSE 'I-' END || tag AS y, CASE WHEN i % 7 = 0 THEN 'O' WHEN tag = 'O' THEN 'O' ELSE 'I-' || tag END AS p FROM w),
l AS (SELECT doc_id, i, CASE WHEN tag = 'O' THEN 'O' ELSE y END AS y, p FROM g),
k AS (SELECT doc_id, i, 'y' AS src, y AS l FROM l UNION ALL SELECT doc_id, i, 'p', p FROM l),
o AS (SELECT *, lag(CASE WHEN l = 'O' THEN NULL ELSE l[3:] END) OVER (PARTITION BY src, doc_id ORDER BY i) AS before FROM k),
s AS (SELECT *, sum((l <> 'O' AND (l[1:2] = 'B-' OR before IS NULL OR before <> l[3:]))::INT) OVER (PARTITION BY src, doc_id ORDER BY i) AS island FROM o),
sp AS (SELECT src, doc_id, island, l[3:] AS kind, min(i) AS a, max(i) AS b FROM s WHERE l <> 'O' GROUP BY ALL),
j AS (SELECT count(*) AS tp FROM sp y JOIN sp p ON y.src = 'y' AND p.src = 'p' AND y.doc_id = p.doc_id AND y.kind = p.kind AND y.a = p.a AND y.b = p.b),
c AS (SELECT count(*) FILTER (src = 'y') AS gold, count(*) FILTER (src = 'p') AS found FROM sp)
SELECT tp, gold, found, round(tp / found, 6) AS precision, round(tp / gold, 6) AS recall, round(2 * tp / (gold + found), 6) AS f1 FROM j, c""")
def sequence_label_metrics(spark, sf_dir):
    i, o = F.col("i"), F.col("tag") == "O"
    rows = _tagged(spark, sf_dir).select("doc_id", "i", F.when(o, "O").otherwise(F.concat(F.when(i % 3 == 0, "B-").otherwise("I-"), "tag")).alias("label"), F.when((i % 7 == 0) | o, "O").otherwise(F.concat(F.lit("I-"), "tag")).alias("predicted"))
    return M.sequence(rows, "doc_id", "i")


@query("""SELECT sum((quality = 1 AND toxic = 1)::BIGINT)::BIGINT AS tp, sum((quality = 0 AND toxic = 1)::BIGINT)::BIGINT AS fp, sum((quality = 1 AND toxic = 0)::BIGINT)::BIGINT AS fn,
round(sum((quality = 1 AND toxic = 1)::BIGINT) / sum((toxic = 1)::BIGINT), 6) AS precision, round(sum((quality = 1 AND toxic = 1)::BIGINT) / sum((quality = 1)::BIGINT), 6) AS recall,
round(2 * sum((quality = 1 AND toxic = 1)::BIGINT) / (sum((quality = 1)::BIGINT) + sum((toxic = 1)::BIGINT)), 6) AS f1, round(sum((quality = toxic)::BIGINT) / count(*), 6) AS accuracy FROM labels""")
def binary_prf(spark, sf_dir):
    return M.binary(_t(spark, sf_dir, "labels"), "quality", "toxic")


# sort, limit, sets


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE r <= floor(n * 0.1)")
def top_percent_nodes(spark, sf_dir):
    own = Window.partitionBy("p_brand")
    p = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    p = p.withColumn("r", F.row_number().over(own.orderBy(F.desc("p_retailprice"), F.desc("p_partkey")))).withColumn("n", F.count("*").over(own))
    return p.where("r <= floor(n * 0.1)").select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def top10_by_distance(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(10)


@query("""WITH t AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r1 FROM t)
SELECT user_id, event_type, r2::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) AS r2 FROM a WHERE r1 <= 3) WHERE r2 <= 2""")
def two_stage_rerank(spark, sf_dir):
    """Values add up as decimals of ten places, so that equal sums are ties whatever order the rows come in; doubles that no decimal holds add up as they are."""
    exact = F.col("value").try_cast("decimal(28,10)")
    v = F.when(F.count(exact) == F.count("value"), F.sum(exact).cast("double")).otherwise(F.sum("value"))
    t = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), v.alias("v"))
    a = S.ranked(t, ["user_id"], F.desc("n"), "event_type", name="r1").where("r1 < 3")
    return S.ranked(a, ["user_id"], F.desc("v"), "event_type", name="r2").where("r2 < 2").select("user_id", "event_type", (F.col("r2") + 1).alias("rank"))


@query("SELECT conv_id, min(turn) AS first, count(*) AS n FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 20")
def latest_meetings(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first"), F.count("*").alias("n")).orderBy(F.desc("conv_id")).limit(20)


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def set_intersection(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(_t(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(_t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_dedup(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(_t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM (SELECT n_nationkey, list(DISTINCT c_mktsegment) AS s FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal < 0 GROUP BY ALL) a, (SELECT n_nationkey, list(DISTINCT c_mktsegment) AS s FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 GROUP BY ALL) b WHERE a.n_nationkey = b.n_nationkey AND list_has_all(b.s, a.s)")
def subset_test(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    sets = lambda owes, n: c.where((F.col("c_acctbal") < 0) == owes).groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias(n))
    both = sets(True, "a").join(sets(False, "b"), "c_nationkey").where(F.size(F.array_except("a", "b")) == 0)
    return both.select(F.col("c_nationkey").alias("x"), F.col("c_nationkey").alias("y"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem), d AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS f FROM l GROUP BY ALL)
SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY f, l_returnflag) AS flags FROM d GROUP BY l_orderkey""")
def ordered_distinct(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(F.transform(parts, lambda x: x["l_returnflag"])), ",").alias("flags"))


@query("SELECT key, value FROM (SELECT c_nationkey AS key, max(c_name) AS value FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier) GROUP BY c_nationkey) UNION ALL SELECT s_nationkey, max(s_name) FROM supplier GROUP BY s_nationkey")
def dict_merge(spark, sf_dir):
    """Two dictionaries merged, the last one's values winning."""
    a = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.max("c_name").alias("value"))
    b = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.max("s_name").alias("value"))
    return G.latest([a, b], ["key"])


# property graphs

_TRIPLES = """t AS (SELECT 'c' || c_custkey AS src, 'lives_in' AS rel, 'n' || c_nationkey AS dst FROM customer UNION SELECT 'o' || o_orderkey, 'ordered_by', 'c' || o_custkey FROM orders UNION SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey FROM nation)"""


def _triples(spark, sf_dir) -> DataFrame:
    k = lambda p, c: F.concat(F.lit(p), F.col(c))
    c = _t(spark, sf_dir, "customer").select(k("c", "c_custkey").alias("a"), k("n", "c_nationkey").alias("b"))
    o = _t(spark, sf_dir, "orders").select(k("o", "o_orderkey").alias("a"), k("c", "o_custkey").alias("b"))
    n = _t(spark, sf_dir, "nation").select(k("n", "n_nationkey").alias("a"), k("r", "n_regionkey").alias("b"))
    return G.triples(c, ("a", "lives_in", "b")).unionByName(G.triples(o, ("a", "ordered_by", "b"))).unionByName(G.triples(n, ("a", "part_of", "b")))


@query(f"WITH {_TRIPLES} SELECT * FROM t")
def property_graph_triples(spark, sf_dir):
    return _triples(spark, sf_dir)


@query(f"""WITH RECURSIVE {_TRIPLES}, x AS (SELECT 'r0' AS node, 0 AS depth UNION SELECT t.src, depth + 1 FROM x JOIN t ON t.dst = x.node WHERE depth < 2)
SELECT node, min(depth)::INT AS depth FROM x GROUP BY node""")
def recursive_expand(spark, sf_dir):
    back = _triples(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return R.expand(written(back, "triples"), spark.createDataFrame([("r0",)], "node string"), 2)


@query("SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, 'new' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 2 = 1)")
def upsert_antijoin(spark, sf_dir):
    known = _t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    new = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.lit("new").alias("name"))
    return G.upsert(G.upsert(known, new, ["key"]), new, ["key"])


@query(f"WITH {_TRIPLES}, n AS (SELECT src AS node FROM t UNION SELECT dst FROM t) SELECT md5(a.node) AS src_uid, rel, md5(b.node) AS dst_uid FROM t JOIN n a ON src = a.node JOIN n b ON dst = b.node WHERE rel = 'lives_in'")
def edge_upsert_by_key(spark, sf_dir):
    t = written(_triples(spark, sf_dir), "triples")
    nodes = t.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("uid", F.md5("node"))
    return G.linked(t.where("rel = 'lives_in'"), nodes, "node")


@query(f"WITH {_TRIPLES} SELECT a.src AS start, a.dst AS middle, b.dst AS \"end\" FROM t a JOIN t b ON a.dst = b.src AND a.rel = 'ordered_by' WHERE b.dst LIKE 'n%'")
def two_hop_adjacency(spark, sf_dir):
    t = written(_triples(spark, sf_dir), "triples")
    nodes = t.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("kind", F.substring("node", 1, 1))
    return G.two_hops(t, nodes, nodes, "ordered_by", "n")


# recency

_CALLS = "c AS (SELECT (epoch_us(ts) // 3600000000)::BIGINT AS call, event_type AS community, count(*) AS n FROM events GROUP BY ALL)"


def _calls(spark, sf_dir) -> DataFrame:
    call = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000)
    return _t(spark, sf_dir, "events").groupBy(call.alias("call"), F.col("event_type").alias("community")).agg(F.count("*").alias("n"))


@query(f"""WITH {_CALLS} SELECT community, call, n, coalesce(sum(n) OVER (PARTITION BY community ORDER BY call RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lc,
coalesce(sum(n) OVER (PARTITION BY community ORDER BY call RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gc FROM c""")
def recency_last5(spark, sf_dir):
    return recency.state_before(_calls(spark, sf_dir))


@query(f"""WITH {_CALLS}, g AS (SELECT DISTINCT (epoch_us(ts) // 3600000000)::BIGINT AS call, user_id % 3 AS grp, event_type AS community FROM events),
s AS (SELECT community, call, coalesce(sum(n) OVER (PARTITION BY community ORDER BY call RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS lc, coalesce(sum(n) OVER (PARTITION BY community ORDER BY call RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gc FROM c),
v AS (SELECT call, grp, sum(lc) AS lc, sum(gc) AS gc FROM g JOIN s USING (call, community) GROUP BY ALL),
k AS (SELECT call, grp, lc > 0 AS lately, (CASE WHEN lc > 0 THEN lc ELSE gc END)::BIGINT AS value FROM v)
SELECT *, (row_number() OVER (PARTITION BY call ORDER BY lately DESC, value DESC, grp))::INT AS rank FROM k""")
def recency_rank(spark, sf_dir):
    call = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000)
    groups = _t(spark, sf_dir, "events").select(call.alias("call"), (F.col("user_id") % 3).alias("grp"), F.col("event_type").alias("community")).distinct()
    return recency.rank_groups(groups, written(_calls(spark, sf_dir), "calls"))
