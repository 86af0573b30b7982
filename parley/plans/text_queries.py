"""Queries over text: cleaning, filters and scalar functions (tables ``documents`` and ``conversations``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keyphrases as K
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




def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _texts(name: str, column, sql: str) -> None:
    """A query that applies a text expression to every turn, and its digest."""

    def run(spark, sf_dir):
        return _turns(spark, sf_dir).select("conv_id", "turn", column(F.col("text")).alias("text"))

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"SELECT conv_id, turn, {sql} AS text FROM conversations"


_texts("split_text_prepare", T.split_text, "replace(CASE WHEN regexp_matches(trim(text), '[.?!]$') THEN trim(text) ELSE trim(text) || '.' END, '?.', '?')")
_table = "MAP {" + ", ".join(f"{_literal(k)}: {_literal(v)}" for k, v in T.contraction_table().items()) + "}"
_EXPAND = "array_to_string(list_transform(string_split({t}, ' '), lambda w: coalesce((" + _table + ")[w], w)), ' ')"


def _expand(t: str) -> str:
    return _EXPAND.replace("{t}", t)


#: Text with contractions, numbers and marks, made from the turns' own words.
_MADE = "replace(replace(replace(text, ' the ', ' don''t '), ' of ', ' 12 34 '), ' and ', ' they''re ')"


def _made(t):
    return F.replace(F.replace(F.replace(t, F.lit(" the "), F.lit(" don't ")), F.lit(" of "), F.lit(" 12 34 ")), F.lit(" and "), F.lit(" they're "))


_texts("contractions", lambda t: T.expand_contractions(_made(t)), _expand(_MADE))
_texts("contractions_leading_space", lambda t: T.expand_contractions(_made(t), leading_space=True), "' ' || " + _expand(_MADE))
_texts("contractions_lower", lambda t: T.expand_contractions(_made(t), lower=True), _expand(f"lower(trim({_MADE}))"))
_texts("unknown_punctuation", T.strip_punctuation, f"translate(text, {_literal(T.PUNCTUATION)}, '')")
_texts("unknown_punctuation_compat", lambda t: T.strip_punctuation(t, remove_punct=True, compat=True), "text")
_texts("number_mask", lambda t: T.mask_numbers(_made(t)), f"(SELECT substr(x, 3, length(x) - 4) FROM (SELECT regexp_replace(' ' || regexp_replace(' ' || {_MADE} || ' ', ' [0-9]+ ', ' XnumberX ', 'g') || ' ', ' [0-9]+ ', ' XnumberX ', 'g') AS x))")
_stop = "[" + ", ".join(_literal(w) for w in T.STOP_WORDS) + "]"
_texts("stop_words_interior", T.remove_stop_words, f"(SELECT array_to_string(list_transform(list_filter(list_zip(w, range(len(w))), lambda p: p[2] = 0 OR p[2] = len(w) - 1 OR NOT list_contains({_stop}, p[1])), lambda p: p[1]), ' ') FROM (SELECT string_split(text, ' ') AS w))")
_texts("custom_preprocess", lambda t: T.custom_preprocess(_made(t)), f"trim(regexp_replace(regexp_replace(translate(regexp_replace(lower({_MADE}), '[a-z0-9]*[0-9][a-z0-9]*', '', 'g'), '-''', '  '), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))")
_texts("clean_text_a", T.clean_a, "trim(regexp_replace(replace(regexp_replace(translate(regexp_replace(text, '[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}\\x{200D}]', '', 'g'), '“”‘’', '\"\"''''' ), 'https?://[^ \\t\\n\\r\\f]+', '__url__', 'g'), ':', '. '), '[ \\t\\n\\r\\f]+', ' ', 'g'))")
_texts("clean_text_b", T.clean_b, "trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \\t\\n\\r\\f]+', ' __url__ ', 'g'), '[^A-Za-z0-9_]', ' ', 'g'), ' +', ' ', 'g'))")
_texts("clean_text_c", T.clean_c, "trim(regexp_replace(regexp_replace(text, '[?!.]+', '.', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))")
_texts("sentence_boundary_repair", lambda t: T.repair_boundaries(F.replace(t, F.lit(". "), F.lit("."))), "regexp_replace(replace(text, '. ', '.'), '([a-z][.?])([A-Z])', '\\1 \\2', 'g')")
_texts("sentence_md5", lambda t: F.md5(t), "md5(text)")
_texts("apostrophe_rejoin", lambda t: T.rejoin_apostrophes(F.split(F.replace(_made(t), F.lit("'"), F.lit(" '")), " ")), f"replace(replace({_MADE}, '''', ' '''), ' ''', '''')")


@query("SELECT doc_id, (i - 1)::INT AS pos, s[i] || '. ' AS sentence FROM (SELECT doc_id, string_split(text, '. ') AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)")
def sentences_with_delimiter(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.split_sentences_with_delimiter(F.col("text"))).alias("pos", "sentence"))


@query("SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '\\n+'), lambda x: trim(x)), lambda x: x <> '')) AS paragraph FROM documents")
def split_articles(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.split_articles(F.col("text"))).alias("paragraph"))


@query("SELECT doc_id, len(string_split(text, ' ')) AS n_words FROM documents WHERE len(string_split(text, ' ')) > 10")
def word_count_gate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words")).where("n_words > 10")


@query("""WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents), h AS (SELECT *, round_even(len(w) / 2.0, 0)::BIGINT AS mid FROM w)
SELECT doc_id, md5(array_to_string(list_slice(w, 1, mid), ' ')) AS a, md5(array_to_string(list_slice(w, mid + 1, len(w)), ' ')) AS b FROM h WHERE len(w) > 250""")
def half_split(spark, sf_dir):
    parts = _docs(spark, sf_dir).where(T.word_count(F.col("text")) > 250).select("doc_id", T.halves(F.col("text")).alias("h"))
    return parts.select("doc_id", F.md5(F.col("h")[0]).alias("a"), F.md5(F.col("h")[1]).alias("b"))


@query("SELECT doc_id, len(string_split(text, '.')) - 1 AS stops, len(list_distinct(string_split(text, ' '))) AS distinct_words FROM documents WHERE len(string_split(text, '.')) - 1 >= 4 AND len(list_distinct(string_split(text, ' '))) > 20")
def token_gates(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", (F.size(F.split(t, r"\.")) - 1).cast("long").alias("stops"), F.size(F.array_distinct(T.words(t))).cast("long").alias("distinct_words")).where("stops >= 4 and distinct_words > 20")


@query("SELECT conv_id, turn FROM conversations WHERE trim(text) <> '' AND NOT contains(role, 'system')")
def transcriber_filter(spark, sf_dir):
    return _turns(spark, sf_dir).where((F.trim("text") != "") & ~F.contains("role", F.lit("system"))).select("conv_id", "turn")


_ROLE = "unnest(string_split(lower(text), ' ')) AS word FROM documents"


@query(f"SELECT word, count(*) AS n FROM (SELECT {_ROLE}) WHERE word NOT IN (SELECT unnest({_stop})) AND regexp_matches(word, '[a-z]') GROUP BY word HAVING count(*) > 10")
def stopword_antijoin(spark, sf_dir):
    words = _docs(spark, sf_dir).select(F.explode(T.words(F.lower("text"))).alias("word"))
    stop = spark.createDataFrame([(w,) for w in T.STOP_WORDS], "word string")
    return words.join(F.broadcast(stop), "word", "left_anti").where(F.col("word").rlike("[a-z]")).groupBy("word").agg(F.count("*").alias("n")).where("n > 10")  # the list is fixed and short


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE regexp_matches(word, '^[0-9]+$') GROUP BY word")
def digit_entities(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.explode(T.words(F.lower("text"))).alias("word")).where(F.col("word").rlike("^[0-9]+$")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, strpos(text, 'the') > 1 AS found, contains(text, 'the') AS fixed FROM conversations")
def keyphrase_in_segment(spark, sf_dir):
    """``found`` keeps the quirk that a match at the very start is missed."""
    return _turns(spark, sf_dir).select("conv_id", "turn", (F.locate("the", F.col("text")) > 1).alias("found"), F.contains("text", F.lit("the")).alias("fixed"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(text, 'tion') OR contains(text, 'ment') OR contains(text, 'heit')")
def any_keyphrase_in_sentence(spark, sf_dir):
    return _turns(spark, sf_dir).where(F.exists(F.array(*map(F.lit, ("tion", "ment", "heit"))), lambda k: F.contains(F.col("text"), k))).select("conv_id", "turn")


_phrase = "list_transform(string_split(lower(text), ' '), lambda x: x)"


@query(f"""WITH p AS (SELECT doc_id, {_phrase} AS w FROM documents),
k AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains({_stop}, w[i])) AS keep FROM p)
SELECT doc_id, CASE WHEN len(keep) = 0 THEN '' ELSE array_to_string(w[list_min(keep):list_max(keep)], ' ') END AS phrase FROM k""")
def strip_phrase_stop_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.strip_stop_words(T.words(F.lower("text"))), " ").alias("phrase"))


@query("""WITH l AS (SELECT doc_id, [CASE doc_id % 4 WHEN 0 THEN 'B-PER' WHEN 1 THEN 'O' WHEN 2 THEN 'I-LOC' ELSE 'O' END, CASE doc_id % 3 WHEN 0 THEN 'I-ORG' WHEN 1 THEN 'B-MISC' ELSE 'O' END] AS l FROM documents)
SELECT doc_id, (list_sort(list_transform(l, lambda x: list_position(['ORG', 'MISC', 'PER', 'LOC', 'O'], regexp_replace(x, '^[BI]-', ''))::VARCHAR || regexp_replace(x, '^[BI]-', '')))[1])[2:] AS label FROM l""")
def label_priority(spark, sf_dir):
    d = F.col("doc_id")
    a = F.when(d % 4 == 0, "B-PER").when(d % 4 == 1, "O").when(d % 4 == 2, "I-LOC").otherwise("O")
    b = F.when(d % 3 == 0, "I-ORG").when(d % 3 == 1, "B-MISC").otherwise("O")
    return _docs(spark, sf_dir).select("doc_id", T.label_priority(F.array(a, b)).alias("label"))


def _listed(words) -> str:
    return "[" + ", ".join(_literal(w) for w in words) + "]"


@query(f"""WITH w AS (SELECT conv_id, turn, string_split(lower(text), ' ') || CASE WHEN turn % 2 = 0 THEN ['we'] ELSE ['none'] END || CASE WHEN turn % 3 = 0 THEN ['you'] ELSE ['none'] END AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN list_has_any(w, {_listed(T.LETS)}) OR (list_has_any(w, {_listed(T.FIRST_PERSON)}) AND list_has_any(w, {_listed(T.SECOND_PERSON)})) THEN 2
  WHEN list_has_any(w, {_listed(T.SECOND_PERSON)}) THEN 1 ELSE 0 END AS flag FROM w""")
def assignee_flag(spark, sf_dir):
    t = F.col("turn")
    w = F.concat(T.words(F.lower("text")), F.array(F.when(t % 2 == 0, "we").otherwise("none")), F.array(F.when(t % 3 == 0, "you").otherwise("none")))
    return _turns(spark, sf_dir).select("conv_id", "turn", T.assignee_flag(w).alias("flag"))


@query("""WITH i AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM documents)
SELECT doc_id, array_to_string((ids || list_transform(range(32), lambda x: 0::BIGINT))[1:32], ' ') AS ids, list_sum(list_transform((ids || list_transform(range(32), lambda x: 0::BIGINT))[1:32], lambda x: x))::BIGINT AS total, least(len(ids), 32)::BIGINT AS mask FROM i""")
def pad_and_mask(spark, sf_dir):
    ids = F.transform(T.words(F.col("text")), lambda w: F.length(w))
    p, m = T.padded(ids, 32), T.attention_mask(ids, 32)
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(p.cast("array<string>"), " ").alias("ids"), add(p).alias("total"), add(m).alias("mask"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k, strftime(ts, '%Y-%m-%d %H:%M:%S:') || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') AS time FROM events")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), T.format_time(F.col("ts")).alias("time"))


@query("""WITH e AS (SELECT event_id, '["a", "b' || event_id || '"]' AS tags FROM events) SELECT event_id, json_extract_string(tags, '$[1]') AS second, 2::BIGINT AS n FROM e""")
def python_list_literals(spark, sf_dir):
    tags = F.concat(F.lit("['a', 'b"), F.col("event_id"), F.lit("']"))
    parsed = F.from_json(F.translate(tags, "'", '"'), "array<string>")
    return table(spark, sf_dir, "events").select("event_id", parsed[1].alias("second"), F.size(parsed).cast("long").alias("n"))


@query("SELECT conv_id, turn, round(1.0 / (CASE WHEN len(string_split(text, ' ')) < 40 THEN (turn + 1) * 0.1 ELSE (turn + 1) END), 6) AS distance FROM conversations")
def distance_projection(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(T.distance((F.col("turn") + 1).cast("double"), F.col("text")), 6).alias("distance"))


_TOK = f"""t AS (SELECT doc_id, i, ws[i] AS w FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS ws FROM documents), unnest(range(1, len(ws) + 1)) AS u(i)),
k AS (SELECT doc_id, i, w, length(w) >= 5 AND NOT list_contains({_stop}, w) AS kw FROM t)"""


def _tokens(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = K.tokens(docs, "doc_id")
    return t.withColumn("kw", (F.length("word") >= 5) & ~F.col("word").isin(*T.STOP_WORDS))


@query(f"""WITH {_TOK}, e AS (SELECT DISTINCT a.doc_id, least(a.w, b.w) AS src, greatest(a.w, b.w) AS dst FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.i - a.i BETWEEN 1 AND 2 WHERE a.kw AND b.kw AND a.w <> b.w)
SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst HAVING count(*) > 1""")
def word_cooccurrence_window(spark, sf_dir):
    e = K.cooccurrence(_tokens(spark, sf_dir), "doc_id", window=3)
    return e.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""WITH {_TOK}, r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM k WHERE kw),
p AS (SELECT doc_id, island, string_agg(w, ' ' ORDER BY i) AS phrase, count(*) AS n FROM r GROUP BY doc_id, island)
SELECT doc_id, phrase, n, count(*) AS times FROM p GROUP BY doc_id, phrase, n""")
def phrase_runs(spark, sf_dir):
    runs = K.phrase_runs(_tokens(spark, sf_dir), "doc_id")
    return runs.groupBy("doc_id", "phrase", "n").agg(F.count("*").alias("times"))


@query(f"""WITH {_TOK}, r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM k WHERE kw), last AS (SELECT doc_id, max(i) AS i FROM k GROUP BY doc_id),
p AS (SELECT r.doc_id, island, string_agg(w, ' ' ORDER BY r.i) AS phrase, max(r.i) AS e FROM r GROUP BY r.doc_id, island)
SELECT p.doc_id, phrase FROM p JOIN last USING (doc_id) WHERE e < last.i""")
def phrase_runs_compat(spark, sf_dir):
    """The quirk kept: a run at the very end of a text is never flushed."""
    return K.phrase_runs(_tokens(spark, sf_dir), "doc_id", compat=True).select("doc_id", "phrase")


def _textrank_sql(rounds: int = 10) -> str:
    sql = f"""WITH {_TOK}, g AS (SELECT DISTINCT a.doc_id, least(a.w, b.w) AS src, greatest(a.w, b.w) AS dst FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.i - a.i BETWEEN 1 AND 2 WHERE a.kw AND b.kw AND a.w <> b.w),
a AS (SELECT doc_id, src, dst FROM g UNION ALL SELECT doc_id, dst, src FROM g), o AS (SELECT doc_id, src, count(*) AS o FROM a GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM o GROUP BY doc_id),
r0 AS (SELECT doc_id, src AS node, 1.0 / n AS r FROM o JOIN n USING (doc_id))"""
    for t in range(1, rounds + 1):
        sql += f", r{t} AS (SELECT a.doc_id, a.dst AS node, 0.15 / any_value(n) + 0.85 * sum(r / o) AS r FROM r{t - 1} p JOIN a ON p.doc_id = a.doc_id AND p.node = a.src JOIN o ON o.doc_id = a.doc_id AND o.src = a.src JOIN n ON n.doc_id = a.doc_id GROUP BY a.doc_id, a.dst)"
    return sql + f" SELECT doc_id, node, round(r, 6) AS rank FROM r{rounds}"


@query(_textrank_sql())
def textrank_words(spark, sf_dir):
    return K.textrank(_tokens(spark, sf_dir), "doc_id", window=3, rounds=10).select("doc_id", "node", F.round("rank", 6).alias("rank"))


@query()
def keyphrases_top10(spark, sf_dir):
    """Per document the ten best phrases: words by rank, runs of them, single words that a phrase holds left out."""
    return K.keyphrases(_tokens(spark, sf_dir), "doc_id", top=10)
