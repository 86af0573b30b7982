"""The analytics library: queries against DuckDB, and operators that SQL can't express against brute force."""

import json
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from parley.functions import text as T
from parley.functions import vectors as V
from parley.operators import communities as C
from parley.operators import detect, edges, groups, keyphrases, models, property_graph, ranking, recency, similarity
from parley.operators import sequences as S
from parley.plans import vector_queries
from parley.plans.registry import QUERIES, SQL
from parley.sources import requests
from parley.streaming import streams
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def value(x):
    if x is None or x != x:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    return round(float(x), 6) if isinstance(x, (int, float, np.number)) else str(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    want, got = con.sql(SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda df: sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
    assert rows(want) == rows(got)


@pytest.mark.parametrize("name", ["keyphrases_top10", "lda_topics"])
def test_documents_of_every_language_get_rows(spark, con, name):
    """All with a run of kept words (or, for topics, a text) have a row, whatever their language."""
    got = {r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()}
    lang = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    assert {lang[i] for i in got} == set(lang.values()) and len(set(lang.values())) >= 4


def graph(pairs):
    return C.Graph(pd.DataFrame([(a, b, 1.0) for a, b in pairs], columns=["src", "dst", "weight"]))


CLIQUES = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]


@pytest.mark.parametrize("name", ["louvain", "chinese_whispers", "label_propagation", "girvan_newman", "louvain_lowest_of_5"])
def test_communities_of_two_cliques(name):
    assert C.METHODS[name](graph(CLIQUES)).tolist() == [0, 0, 0, 1, 1, 1]


def test_modularity_of_two_cliques():
    g = graph(CLIQUES)
    assert C.modularity(g.near, np.array([0, 0, 0, 1, 1, 1])) == pytest.approx(6 / 7 - 0.5)


def test_centralities_of_a_path():
    g = graph([(0, 1), (1, 2), (2, 3)])
    assert C.betweenness(g).tolist() == pytest.approx([0, 2 / 3, 2 / 3, 0])
    assert C.closeness(g).tolist() == pytest.approx([0.5, 0.75, 0.75, 0.5])
    assert C.current_flow_betweenness(g).tolist() == pytest.approx([0, 2 / 3, 2 / 3, 0])
    assert C.current_flow_closeness(g).tolist() == pytest.approx([1 / 6, 1 / 4, 1 / 4, 1 / 6])
    assert C.closeness_vitality(g)[0] == 6 and C.closeness_vitality(g)[1] == -np.inf
    assert len(set(C.colouring(graph([(0, 1), (1, 2), (0, 2)])).tolist())) == 3


def test_pagerank_until_it_settles(spark):
    e = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "src long, dst long")
    got = {r.node: r["rank"] for r in ranking.pagerank(e, rounds=None, tol=1e-6).collect()}
    assert sum(got.values()) == pytest.approx(1) and got[0] == pytest.approx(0.0375 * 3.55 / (1 - 0.85**2), abs=1e-4)


def test_pairs_are_the_same_in_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, rng.normal(size=8).tolist()) for i in range(90)] + [(90, 0, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, g int, vec array<double>")
    want = {(r.g, r.src, r.dst, r.weight) for r in V.cosine_pairs(df, group=["g"]).collect()}
    assert {(r.g, r.src, r.dst, r.weight) for r in V.cosine_pairs(df, group=["g"], block=7).collect()} == want
    assert len(want) == 46 * 47 // 2 + 45 * 46 // 2
    q = df.select(F.col("id").alias("qid"), "vec")
    i = df.select(F.col("id").alias("iid"), "vec")
    one = sorted(map(tuple, V.knn(q, i, 5).collect()))
    assert one == sorted(map(tuple, V.knn(q, i, 5, most_bytes=1000).collect()))


def test_islands_and_their_quirk(spark):
    df = spark.createDataFrame([("m", o) for o in (1, 2, 5)], "m string, o int")
    assert [r.island for r in S.islands(df, ["m"], "o").orderBy("o").collect()] == [0, 0, 1]
    assert [r.o for r in S.islands(df, ["m"], "o", compat=True).orderBy("o").collect()] == [1, 2]


def test_late_ties_go_to_the_later_community(spark):
    m = spark.createDataFrame([("m", 0, 0, 0), ("m", 1, 0, 0), ("m", 2, 0, 1), ("m", 3, 0, 1)], "meeting string, node int, seg_order int, community int")
    assert {r.community for r in groups.refine(m).collect()} == {1}


def test_containment(spark):
    g = spark.createDataFrame([("m", 0, 1), ("m", 0, 4), ("m", 1, 2), ("m", 1, 3), ("m", 2, 9), ("n", 0, 1), ("n", 1, 1)], "meeting string, grp int, seg_order int")
    got = {}
    for r in groups.merge_contained(g).collect():
        got.setdefault((r.meeting, r.grp), set()).add(r.seg_order)
    assert sorted(map(sorted, got.values())) == [[1], [1], [1, 2, 3, 4], [9]]


def test_text_quirks(spark):
    one = spark.createDataFrame([(" 12 34 ", "is the the point", "I don't know")], "a string, b string, c string").select(
        T.mask_numbers(F.lit("12 34 x 5")).alias("a"), T.remove_stop_words(F.col("b"), ["the", "is", "point"]).alias("b"), T.expand_contractions(F.col("c")).alias("c"),
        T.halves(F.lit(" ".join(["w"] * 251))).alias("h"), T.split_text(F.lit(" why? ")).alias("s"), T.repair_boundaries(F.lit("end.Next")).alias("r"),
    ).first()
    assert one.a == "XnumberX XnumberX x XnumberX" and one.b == "is point" and one.c == "I do not know"
    assert [len(h.split()) for h in one.h] == [126, 125] and one.s == "why?" and one.r == "end. Next"


def test_keyphrases_drop_words_of_phrases(spark):
    docs = spark.createDataFrame([(1, "alpha beta the gamma alpha beta the delta gamma")], "id int, text string")
    t = keyphrases.tokens(docs, "id").withColumn("kw", F.col("word") != "the")
    phrases = [r.phrase for r in keyphrases.keyphrases(t, "id").orderBy("rank").collect()]
    assert "alpha" not in phrases and any(" " in p for p in phrases)


def brute_recency(counts, window=5):
    out, lc, gc = {}, {}, {}
    calls = sorted({c for _, c in counts})
    for call in range(calls[0], calls[-1] + 1):
        now = {k: n for (k, c), n in counts.items() if c == call}
        for k in now:
            out[k, call] = (sum(lc.get(k, [])), gc.get(k, 0))
        for k in {*lc, *now}:
            lc[k] = ([*lc.get(k, []), now.get(k, 0)])[-window:]
            gc[k] = gc.get(k, 0) + now.get(k, 0)
    return out


def test_recency_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(2)
    counts = {(rng.choice("abc"), rng.randrange(30)): rng.randint(1, 9) for _ in range(45)}
    df = spark.createDataFrame([(k, c, n) for (k, c), n in counts.items()], "community string, call long, n long")
    want = brute_recency(counts)
    assert {(r.community, r.call): (r.lc, r.gc) for r in recency.state_before(df).collect()} == want
    for i, part in enumerate((df.where("call < 12"), df.where("call >= 12"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        streams.run_to_table(streams.recency(stream), f"{tmp_path}/out", f"{tmp_path}/check")
        got = {(r.community, r.call): (r.lc, r.gc) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        assert got == {k: v for k, v in want.items() if i or k[1] < 12}


def test_session_stream_and_upserts(spark, tmp_path):
    base = 1_700_000_000
    rows = [("u", base), ("u", base + 100), ("u", base + 400), ("v", base + 9000)]
    spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
    streams.run_to_table(streams.sessions(stream, "k"), f"{tmp_path}/out", f"{tmp_path}/c1")
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out").where("k = 'u'").collect()) == [1, 2]
    for _ in range(2):
        streams.upserting(stream.select("k"), f"{tmp_path}/table", ["k"], f"{tmp_path}/c2").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/table").collect()) == ["u", "v"]


def test_requests_from_files(spark, tmp_path):
    body = {"body": {"contextId": "C", "mindId": "M", "instanceId": "I", "segments": [{"id": "b", "originalText": " two ", "startTime": "2"}, {"id": "a", "originalText": "one", "startTime": "1"}, {"id": "x", "originalText": " ", "startTime": "0"}]}}
    (tmp_path / "a.json").write_text(json.dumps(body))
    (tmp_path / "b.json").write_text(json.dumps(json.dumps(body | {"body": body["body"] | {"contextId": "D"}})))
    (tmp_path / "c.json").write_text(json.dumps({"body": json.dumps(body["body"] | {"contextId": "E"})}))
    got = sorted((r.context_id, r.seg_order, r.id, r.text, r.mind_id) for r in requests.read_requests(spark, str(tmp_path)).collect())
    assert got == [(c, i, s, t, "m") for c in "CDE" for i, (s, t) in enumerate([("a", "one"), ("b", "two")])]


def test_topic_pims_last_group_wins(spark):
    v = json.dumps({"groups": {"g1": [{"recordingId": "r"}], "g2": [{"recordingId": "r"}, {"recordingId": "q"}]}, "pims": {"segments": [{"recordingId": "r", "distance": 2.0}]}})
    got = {(r.recording_id, r.grp, r.distance) for r in requests.read_topic_pims(spark.createDataFrame([(v,)], "value string")).collect()}
    assert got == {("r", "g2", 2.0), ("q", "g2", None)}


def test_conll_csv_and_graph_files(spark, tmp_path):
    (tmp_path / "x.conll").write_text("-DOCSTART- X O O\n\nEU NNP B-NP B-ORG\n. . O\n\nBlackburn\n")
    s = requests.read_conll(spark, f"{tmp_path}/x.conll").orderBy("sentence").collect()
    assert [(r.words, r.labels) for r in s] == [(["EU", "."], ["B-ORG", "O"]), (["Blackburn"], ["Blackburn"])]
    seg = json.dumps({"id": "s1", "originalText": 'say "hi",\nthere'}).replace('"', '""')
    (tmp_path / "e.csv").write_text(f'id,value,created_at,updated_at,deleted_at,deleted,transcript_id\n1,"{seg}",2019-08-06 18:15:00,2019-08-06 18:15:00,,false,t\n2,no json,2019-08-06 18:15:00,2019-08-06 18:15:00,,false,t\n')
    (r,) = requests.read_segment_export(spark, f"{tmp_path}/e.csv").collect()
    assert r.originalText == 'say "hi",\nthere' and r.transcript_id == "t"
    (tmp_path / "g.gexf").write_text('<gexf><graph><edges><edge id="0" source="a" target="b" weight="0.5" /><edge id="1" source="b" target="c" /></edges></graph></gexf>')
    assert {tuple(r) for r in requests.read_gexf_edges(spark, f"{tmp_path}/g.gexf").collect()} == {("a", "b", 0.5), ("b", "c", 1.0)}
    requests.write_text(spark.createDataFrame([("x",)], "text string"), f"{tmp_path}/t")
    requests.write_text(spark.createDataFrame([("y",)], "text string"), f"{tmp_path}/t")
    assert {r.value for r in spark.read.text(f"{tmp_path}/t").collect()} == {"x", "y"}


def test_detectors(spark):
    s = spark.createDataFrame([("We should review the quarterly budget numbers and will send follow up notes",), ("can you hear me will you need should review",), ("Nice weather",), ("What is it?",), ("Ok?",)], "text string")
    assert [r.assignee_flag for r in detect.action_items(s).collect()] == [0]
    assert [r.text for r in s.where(detect.is_question(F.col("text"))).collect()] == ["What is it?"]
    t = spark.createDataFrame([("d", 0, "new", "B-LOC", 0.9), ("d", 1, "york", "I-LOC", 0.7), ("d", 2, "and", "O", 0.999), ("d", 3, "acme", "B-ORG", 0.8)], "k string, word_index int, tok string, label string, score double")
    assert {(r.entity, r.label, r.score) for r in detect.entity_spans(t, ["k"]).collect()} == {("New York", "LOC", 0.8), ("Acme", "ORG", 0.8)}
    p = spark.createDataFrame([("d", 0, "em", "B-X", 0.9), ("d", 1, "##bed", "O", 0.4), ("d", 2, "x", "O", 1.0)], "k string, pos int, piece string, label string, score double")
    assert {(r.tok, r.label, r.score) for r in detect.word_scores(p, ["k"]).collect()} == {("embed", "B-X", 0.4), ("x", "O", 1.0)}


def test_classifier_learns(spark):
    rows = [(f"please send word{i}", 1.0) for i in range(40)] + [(f"nice day word{i}", 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, "text string, label double")
    out = models.classified(models.text_classifier(df, features=1 << 10), df)
    assert out.where((F.col("probability") > 0.5) == (F.col("label") == 1)).count() == 80


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "b"), (2, "b")], "k int, v string")
    once = property_graph.upsert(a, b, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, property_graph.upsert(once, b, ["k"]).collect())) == [(1, "a"), (2, "b")]


def test_top_fraction_with_ties(spark):
    e = spark.createDataFrame([(i, i + 1, float(i // 4)) for i in range(20)], "src int, dst int, weight double")
    assert sorted(r.src for r in edges.top_fraction(e, 0.25).collect()) == [12, 13, 16, 17, 18, 19]


def test_paragraphs_take_in_short_runs(spark):
    s = spark.createDataFrame([("d", i, f"s{i}", label) for i, label in enumerate("aabbbbcd")], "k string, pos int, text string, label string")
    assert [r.text for r in detect.packed_paragraphs(s, "k").orderBy("paragraph").collect()] == ["s0 s1 s2 s3 s4 s5 s6 s7"]


def test_library_needs_no_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['parley.llm'] = None; import __spark_entry__ as e; assert 'cosine_pairs' in e.queries() and e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_artifacts_are_versions(spark, tmp_path):
    from parley.sources import artifacts

    root = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    with pytest.raises(FileNotFoundError):
        artifacts.load(spark, root, "t")
    assert artifacts.save(df, root, "t") == 1 and artifacts.cached(spark, root, "t", lambda: 1 / 0).count() == 2
    (tmp_path / "t" / "v000000009").mkdir()  # a job that never ended
    out = artifacts.extended(spark, root, "t", spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), ["k"])
    assert {tuple(r) for r in out.collect()} == {(1, "a"), (2, "c"), (3, "d")} and artifacts.versions(spark, root, "t") == [1, 2]
    assert {tuple(r) for r in artifacts.load(spark, root, "t", 1).collect()} == {(1, "a"), (2, "b")}
    artifacts.reset(spark, root, "t")
    assert artifacts.versions(spark, root, "t") == []


def test_spans_and_entities(spark):
    from parley.operators import phrases as P

    spans = spark.createDataFrame([(1, 0, 4), (1, 1, 2), (1, 5, 6), (1, 9, 9), (2, 3, 3), (2, 3, 3)], "t long, a long, b long")
    assert sorted(map(tuple, P.merge_spans(spans, ["t"]).collect())) == [(1, 0, 6, 2), (1, 9, 9, 1), (2, 3, 3, 1)]
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate("N J O N O N N".split())], "t long, i long, tag string")
    grown = P.extend_spans(spark.createDataFrame([(1, 2, 2), (1, 4, 4), (1, 0, 6)], "t long, a long, b long"), tokens, ["t"], ["N", "J"])
    assert sorted(map(tuple, grown.collect())) == [(1, 0, 3), (1, 0, 6), (1, 3, 6)]
    rows = spark.createDataFrame([(["x", "of", "the"], "O", "JJ"), (["of"], "O", "NN"), (["y"], "O", "NN"), (["z"], "LOC", "JJ")], "w array<string>, label string, tag string")
    w = P.trim_trailing(F.col("w"), ["of", "the"])
    assert [tuple(r) for r in rows.select(w.alias("w"), P.real_entity(w, F.col("label"), F.col("tag"))).collect()] == [(["x"], False), ([], False), (["y"], True), (["z"], True)]
    vec = spark.createDataFrame([("a", "ORG", 2, [1.0, 2.0]), ("b", "PER", 5, [1.0, 2.0]), ("c", "ORG", 1, [1.0, 2.0]), ("d", "ORG", 2, [1.0, float("nan")]), ("e", "ORG", 2, [1.0])], "entity string, label string, n long, vec array<double>")
    assert [r.entity for r in P.eligible_entities(vec, 2).collect()] == ["a"]


def test_cleaning_strips_emoji(spark):
    assert spark.range(1).select(T.clean_a(F.lit("well \U0001f600\u2764\ufe0f done: ok"))).first()[0] == "well done. ok"


def test_malformed_rows_are_kept(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,v\n1,a\nno,b\n3,c\n")
    rows = requests.read_csv(spark, f"file://{tmp_path}/x.csv", "id long, v string", corrupt="bad").collect()
    assert [(r.id, r.v) for r in rows] == [(1, "a"), (None, "b"), (3, "c")] and [r.bad for r in rows] == [None, "no,b", None]


def test_streams_of_windows_requests_and_sessions(spark, tmp_path):
    """A stream that ends gives every session; windows and requests as in batch."""
    rows = [(u, i * 50 + (i // 5) * 500) for u in (1, 2) for i in range(20)]
    e = spark.createDataFrame(rows, "u long, s long").select("u", F.timestamp_seconds("s").alias("ts"))
    path = f"file://{tmp_path}"
    streams.ended(e).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("u long, ts timestamp").parquet(f"{path}/in")
    streams.run_to_table(streams.sessions(stream, "u"), f"{path}/out", f"{path}/c1")
    got = sorted((r.u, r.n) for r in spark.read.parquet(f"{path}/out").collect())
    assert got == sorted((u, 5) for u in (1, 2) for _ in range(4))
    streams.run_to_table(streams.windowed(stream, "u", width="10 minutes"), f"{path}/w", f"{path}/c2")
    want = {(r.u, r.w.start): r.n for r in e.groupBy("u", F.window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert {(r.u, r.start): r.n for r in spark.read.parquet(f"{path}/w").where("u is not null").collect()} == want


def test_every_query_has_sql_or_values_of_its_own():
    """What SQL can't express is named by a test that looks at its rows."""
    here = os.path.dirname(os.path.abspath(__file__))
    said = "".join(open(f"{here}/{f}", encoding="utf-8").read() for f in os.listdir(here) if f.endswith(".py"))
    assert [n for n in sorted(set(QUERIES) - set(SQL)) if n not in said] == []


def test_sums_that_are_equal_tie_in_any_order(spark, tmp_path):
    """0.1 + 0.2 and 0.3 are a tie, that goes to the smaller type; as doubles the first is more."""
    rows = [(1, "b", 0.1), (1, "b", 0.2), (1, "a", 0.3), (1, "a", 0.0), (2, "b", float("inf")), (2, "a", 1.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["two_stage_rerank"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(1, "a", 1), (1, "b", 2), (2, "b", 1), (2, "a", 2)}


def test_nearest_neighbours_with_many_ties_and_their_memory(monkeypatch):
    """Items pass in pieces: the best are those of the whole product, copies tie to the smaller id, and no piece is larger than its bound."""
    rng = np.random.default_rng(3)
    items = np.repeat(V._unit(pd.Series(list(rng.normal(size=(300, 8))))), 4, axis=0)
    asks, own = items[::7], np.arange(len(items))[::7]
    want = np.round(asks @ items.T, 6)
    want[np.arange(len(own)), own] = -np.inf
    want = np.argsort(-want, axis=1, kind="stable")[:, :6]
    monkeypatch.setattr(V, "CELLS", 172 * 50)
    x, y, w = V._nearest(asks, items, own, 6, 6)
    assert x.tolist() == np.repeat(np.arange(len(asks)), 6).tolist() and y.reshape(-1, 6).tolist() == want.tolist() and (np.diff(w.reshape(-1, 6)) <= 0).all()


def test_own_id_is_no_neighbour(spark):
    """Of five copies each has the three with the smallest other ids; nobody misses one for being its own neighbour."""
    v = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, vec array<double>")
    got = V.knn(v.withColumnRenamed("id", "qid"), v.withColumnRenamed("id", "iid"), 3, other=True).collect()
    assert {(r.qid, r.iid, r["rank"]) for r in got} == {(q, i, n + 1) for q in range(5) for n, i in enumerate([x for x in range(5) if x != q][:3])}


def test_statistics_of_all_pairs_are_those_of_the_matrix(spark):
    """Over several blocks, with copies, a zero vector and an opposite one."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(1100, 4))
    m[100:160], m[7], m[8] = m[99], 0, -m[99]
    v = spark.createDataFrame([(int(i) * 3, x.tolist()) for i, x in enumerate(m)], "id long, vec array<double>")
    u = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    w = np.round(u @ u.T, 6) + 0.0
    got = {r.node: r for r in similarity.quartiles(v).collect()}
    assert len(got) == len(m)
    for i, row in enumerate(w):
        assert (got[i * 3].q1, got[i * 3].q3) == pytest.approx(tuple(np.percentile(row, [25, 75])), abs=2e-6)
    some = {r.node: r for r in similarity.moments(v, 0.2, loops=False).collect()}
    for i, row in enumerate(w):
        on = (row > 0.2) & (np.arange(len(m)) != i)
        assert on.sum() == (some[i * 3].n if i * 3 in some else 0) and (not on.any() or some[i * 3].total == pytest.approx(row[on].sum(), abs=1e-4))
    counts = {r.weight: r.n for r in similarity.weight_counts(v).collect()}
    assert sum(counts.values()) == 1100 * 1101 // 2 and counts[1.0] >= 61 * 62 // 2


@pytest.mark.parametrize("name", ["cosine_node_iqr_prune", "cosine_node_q3_prune", "minmax_symmetric_norm", "neighbour_window_prune", "edge_percentile_prune", "topk_fraction_edges"])
def test_prunings_write_no_pairs(spark, name):
    """What goes to the shared folder is a row a vector, not one a pair."""
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(top) for f in fs)
    before = size()
    QUERIES[name](spark, SF).count()
    assert size() - before < 250_000  # 125,250 pairs take some 700 kB


def test_pagerank_of_groups_without_edges(spark):
    """F32: ranks from products equal those from an edge table, and no edge is written or shuffled."""
    rng = np.random.default_rng(5)
    rows = [(g, 100 * g + i, (np.zeros(4) if i == 3 else rng.normal(size=4)).tolist()) for g in range(3) for i in range(1 if g == 2 else 25)]
    v = spark.createDataFrame(rows, "grp int, id int, vec array<double>")
    edges = V.cosine_pairs(v, "id", "vec", ["grp"], loops=False).where("weight > 0.25")
    want = ranking.pagerank_of_graphs(edges, ["grp"], v.select("grp", F.col("id").alias("node")), rounds=10)
    want = {(r.grp, r.node): round(r["rank"], 9) for r in want.collect()}
    got = {(r.grp, r.node): round(r["rank"], 9) for r in similarity.pagerank_of_groups(v, ["grp"], 0.25).collect()}
    assert got == want and len(got) == len(rows)


def test_table_function_goes_by_rows(spark):
    """a row's result is no Arrow table of its own, and words between runs aren't sent to it."""
    plan = QUERIES["phrase_spans_by_sql"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan


@pytest.mark.parametrize("n", [42, 44])
def test_quartiles_are_those_of_sql_to_the_last_bit(spark, tmp_path, n):
    """an edge may weigh just what the cut is, so a cut that is off by its last bit keeps or drops it wrongly."""
    v = np.random.default_rng(n).normal(size=(n, 8))
    rows = [(i, [float(np.float32(x)) for x in r], 0) for i, r in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.sql(f"WITH {vector_queries._PAIRS} SELECT node, q1, q3 FROM st ORDER BY node").fetchall()
    vectors = vector_queries._vectors(spark, str(tmp_path))
    assert [tuple(r) for r in similarity.quartiles(vectors).orderBy("node").collect()] == want


@pytest.mark.parametrize("name", ["pagerank_10_rounds", "pagerank_weighted_10_rounds"])
def test_ranks_round_only_pairs_with_an_edge(spark, monkeypatch, name):
    """a round looks through its products for edges, it doesn't round and weigh every pair."""
    asked, products = [], V.products

    def spy(*args, **more):
        asked.append(more.get("above", more.get("heavy")))
        return products(*args, **more)

    monkeypatch.setattr(V, "products", spy)
    QUERIES[name](spark, SF).count()
    assert asked == [0.2] * 11


def test_heavy_pairs_are_those_of_the_matrix(spark, monkeypatch):
    """Over blocks and pieces of any size, with copies, a zero vector, and weights that equal the bound."""
    rng = np.random.default_rng(8)
    m = rng.integers(-3, 4, size=(1100, 3)).astype(float)
    m[5] = 0
    v = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(m)], "id long, vec array<double>")
    u = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    w = np.round(u @ u.T, 6) + 0.0
    for loops in (True, False):
        x, y = np.nonzero(np.triu(w >= 0.5, 0 if loops else 1))
        got = V.cosine_pairs(v, loops=loops, least=0.5).collect()
        assert sorted((r.src, r.dst, r.weight) for r in got) == sorted(zip(x.tolist(), y.tolist(), w[x, y].tolist()))
    monkeypatch.setattr(V, "CELLS", 50)
    monkeypatch.setattr(V, "TILE", 7)
    got = [np.concatenate(c) for c in zip(*V._heavy(u[:40], u, 0.5, 6))]
    x, y = np.nonzero(w[:40] >= 0.5)
    assert sorted(zip(*(c.tolist() for c in got))) == sorted(zip(x.tolist(), y.tolist(), w[x, y].tolist()))
    hit = w > 0.2
    assert (V._above(u, u, (u.astype(np.float32), u.astype(np.float32)), 0.2, 6) == hit).all()
    np.fill_diagonal(hit, False)
    out = hit.sum(1)
    rank = np.where(out > 0, 1 / (out > 0).sum(), 0)
    for _ in range(3):
        rank = np.where(out > 0, 0.15 / (out > 0).sum() + 0.85 * (hit @ (rank / np.maximum(out, 1))), 0)
    got = {r.node: r["rank"] for r in similarity.pagerank(v, 0.2, rounds=3).collect()}
    assert got == pytest.approx({int(i): rank[i] for i in np.nonzero(out)[0]}, rel=1e-9)


def test_laplacian_rounds_only_pairs_with_an_edge(spark, monkeypatch):
    """degrees are counted and edges found by looking through the products, not by rounding and summing every pair."""
    asked, products = [], V.products

    def spy(*args, **more):
        asked.append((more.get("above"), more.get("heavy")))
        return products(*args, **more)

    monkeypatch.setattr(V, "products", spy)
    QUERIES["normalised_laplacian"](spark, SF).count()
    assert asked == [(0.2, None), (None, 0.2)]


def test_normalised_pairs_come_in_order_of_weight(spark, monkeypatch):
    """in files of all pairs equal weights stand together; halves are rounded as SQL does it."""
    monkeypatch.setattr(V, "SPREAD", 1)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.random.default_rng(4).normal(size=(300, 8)))], "id long, vec array<double>")
    got = [r.weight for r in similarity.minmax_symmetric(v).collect()]
    assert len(got) == 300 * 301 // 2 and got == sorted(got)
    assert V._half_away(np.array([0.5, 2.5, -2.5, 1.4, np.nan]), 0).tolist()[:4] == [1.0, 3.0, -3.0, 1.0]
