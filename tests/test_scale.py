"""Queries whose work has to follow their input: the same results as by the plain way, and less that is moved."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import vectors as V
from parley.operators import edges as E
from parley.operators import keyphrases as K
from parley.operators import detect, punkt, ranking, relatedness, similarity, tagging, topics


@pytest.mark.parametrize("joined", [2, 5, 0])
def test_contracted_pagerank(spark, joined, monkeypatch):
    """Ranks of super-nodes as from the contracted edges, with several blocks and pieces, nodes without edges and a super-node that meets another one."""
    monkeypatch.setattr(similarity, "LARGE", 60)
    monkeypatch.setattr(V, "CELLS", 500)
    rng = np.random.default_rng(joined)
    x = rng.normal(size=(230, 5)) + (np.arange(230) % 7 == 0)[:, None] * 2
    x[11] = 0
    rows = [(i, [float(v) for v in x[i]], -1 - i % 6 if i % 6 < joined else None) for i in range(230)]
    v = spark.createDataFrame(rows, "id long, vec array<double>, into long")
    e = E.threshold(V.cosine_pairs(v, loops=False), 0.6)
    a, b = (v.select(F.col("id").alias(c), F.coalesce("into", "id").alias(y)) for c, y in (("src", "x"), ("dst", "y")))
    small = e.join(a, "src").join(b, "dst").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).where("src <> dst").distinct()
    want = {r.node: r["rank"] for r in ranking.pagerank(small, rounds=6).where("node < 0").collect()}
    got = {r.node: r["rank"] for r in similarity.contracted_pagerank(v, 0.6, rounds=6).collect()}
    assert got.keys() == want.keys() and len(got) == joined and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_above_is_the_rounded_cosine(spark):
    """Cosines at the bound itself, a little over it and a little under it."""
    at = [0.2, 0.2 + 4e-7, 0.2 + 6e-7, 0.2 - 4e-7, 0.200001, 0.3, -0.2, 0.2 + 5.1e-7]
    m = np.array([[1.0, 0.0]] + [[c, np.sqrt(1 - c * c)] for c in at])
    hit = V._above(m[:1], m, (m[:1].astype(np.float32), m.astype(np.float32)), 0.2, 6)[0]
    assert hit.tolist() == [True, *[bool(np.round(c, 6) > 0.2) for c in at]] and hit.sum() == 5


def test_words_and_abbreviations_of_odd_tokens(spark):
    """Words are counted as they stand first; the result is that of looking at each by itself."""
    texts = [("en", "(. \".\" etc.) Dr. Who! ‘Dr.’ says? it's U.S. Army 3.5, 12. may? «No.» a . b.\u0085 Dr"), ("en", None), (None, "  x. Y  "), ("de", "z.B. \n Haus. haus Das?! das ... Das"), ("de", " "), (None, "x. Y")]
    docs = spark.createDataFrame(texts * 3, "lang string, text string")
    s = docs.select("lang", F.transform(punkt._segments(F.col("text")), punkt._core).alias("c")).where(F.size("c") > 0).select("lang", F.posexplode("c").alias("i", "core"), "c")
    before = F.when(F.col("i") > 0, F.get("c", F.col("i") - 1))
    s = s.select("lang", punkt._type(F.col("core")).alias("type"), punkt._dotted(F.col("core")).alias("dot"), punkt._case(F.col("core")).alias("case"), F.coalesce(punkt._dotted(before) | before.rlike("[?!]$"), F.lit(True)).alias("starts"))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    want = s.groupBy("lang", "type").agg(F.count("*"), n(F.col("dot")), n(F.col("case") == "lower"), n((F.col("case") == "upper") & ~F.col("starts")))
    assert sorted(map(str, punkt._words(docs).collect())) == sorted(str(r).replace("count(1)", "n") for r in want.toDF("lang", "type", "n", "dotted", "lower", "upper_inside").collect())
    assert sorted(map(str, punkt.abbreviations(docs).collect())) == sorted(map(str, punkt.learn(docs).abbreviations.collect())) and punkt.abbreviations(docs.limit(0)).count() == 0


def test_relatedness_of_phrase_lists(spark):
    """As from a row for each phrase pair and vectors of all words; texts without phrases, with many, with single words, and repeated pairs."""
    nouns = ["engine", "mirror", "valve", "cat", "controller", "green", "The", "of", "is", "runs", "checks", ",", "."]
    rng = np.random.default_rng(3)
    rows = [("c", t, " ".join(rng.choice(nouns, size=[0, 1, 4, 30, 80][t % 5]))) for t in range(60)] + [("d", 0, None), ("d", 1, "engine")]
    key = ["conv_id", "turn"]
    texts = spark.createDataFrame(rows, "conv_id string, turn int, text string").select(*key, tagging.tokens(F.col("text")).alias("tokens"))
    texts = texts.withColumn("tags", tagging.penn_tags(F.col("tokens"))).cache()
    pieces = texts.select(*key, F.posexplode(relatedness.word_pieces(F.transform("tokens", F.lower))).alias("pos", "p")).select(*key, "pos", "p.piece")
    words = relatedness.word_vectors(detect.embedded(pieces, "piece"), key)
    own = relatedness.phrases(texts, key).orderBy("at")
    a = texts.select(F.col("conv_id").alias("conv_id_a"), F.col("turn").alias("turn_a"))
    b = texts.select(F.col("conv_id").alias("conv_id_b"), F.col("turn").alias("turn_b"))
    pairs = a.join(b, (F.col("conv_id_a") == F.col("conv_id_b")) & (F.abs(F.col("turn_a") - F.col("turn_b")) < 4))
    found = relatedness.phrase_lists(texts, key)
    assert {(r.conv_id, r.turn): r.ps for r in found.where(F.size("ps") > 0).collect()} == {(r.conv_id, r.turn): [x.phrase for x in sorted(r.ps)] for r in own.groupBy(*key).agg(F.collect_list(F.struct("at", "phrase")).alias("ps")).collect()}
    pairs = pairs.unionByName(pairs.limit(3))
    want = relatedness.relatedness(pairs, relatedness.phrase_vectors(own, words, key), key).collect()
    got = relatedness.relatedness_of_phrases(pairs, found, key).collect()
    names = lambda r: (r.conv_id_a, r.turn_a, r.conv_id_b, r.turn_b)
    assert [names(r) for r in sorted(got)] == [names(r) for r in sorted(want)] and len({r.score for r in want}) > 50
    assert all(x.score == pytest.approx(y.score, abs=2e-6) for x, y in zip(sorted(got), sorted(want)))


def test_phrase_ranks(spark, monkeypatch):
    """Graphs by the batch as from tables of edges: zero vectors, groups of one and of two.  Weights have no ties but 0, which products may tell apart by their last bits."""
    rng = np.random.default_rng(8)
    rows = [(g, i, [float(v) for v in rng.normal(0.3, 1, size=3) * (i % 8 != 6)]) for g, n in ((0, 1), (1, 2), (2, 9), (3, 40), (7, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "grp long, node int, vec array<double>")
    got = {(r.grp, r.node): r["rank"] for r in topics.phrase_ranks(df, "grp").collect()}
    monkeypatch.setattr(topics, "MOST", 4)
    want = {(r.grp, r.node): r["rank"] for r in topics.phrase_ranks(df, "grp").collect()}
    assert len(got) == len(rows) and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=3e-5) for k in want)  # tables stop at 1e-6 a node and round


def test_keyphrases_deal_tokens_once(spark, capsys):
    """One exchange; a run at the end, words that a longer phrase holds, texts without marked words."""
    rows = [(1, "alpha beta of alpha gamma of beta"), (2, "of of"), (3, "delta"), (4, None)]
    t = K.tokens(spark.createDataFrame(rows, "k int, text string"), "k").withColumn("kw", F.col("word") != "of")
    out = K.keyphrases(t, "k")
    out.explain()
    assert capsys.readouterr().out.count("Exchange ") == 1
    assert [(r.k, r["rank"], r.phrase) for r in sorted(out.collect())] == [(1, 1, "alpha gamma"), (1, 2, "alpha beta"), (3, 1, "delta")]
    assert {r.phrase for r in K.keyphrases(t, "k", compat=True).collect()} == {"alpha gamma", "alpha beta"}


def test_pairs_in_order_of_weight_are_the_same(spark):
    """F8: whatever is put in order at a time; with NaN, weights of 0, -1 and 1, pieces without pairs and names as ids."""
    rng = np.random.default_rng(2)
    w = np.round(rng.uniform(-1, 1, (7, 5)), 6)
    w[0, 0], w[1, 1], w[2, 2], w[3, 3], w[4] = np.nan, 0.0, -1.0, 1.0, 0.3
    ids = (np.array([f"a{i}" for i in range(7)], object), np.arange(5) * 10)
    pieces = []
    for first, last in ((0, 2), (2, 3), (3, 6), (6, 7)):
        x, y = np.nonzero(w[first:last] < 0.9) if first != 2 else (np.zeros(0, int),) * 2
        pieces.append(({"_id": ids[0][first:last]}, {"_id": ids[1]}, x, y, w[first:last][x, y]))
    pieces[0] = (*pieces[0][:2], *np.nonzero(np.ones((2, 5), bool)), w[:2].ravel())
    rows = lambda parts: sorted((a["_id"][i], int(b["_id"][j]), str(v)) for a, b, x, y, k in parts for i, j, v in zip(x, y, k))
    for run in (1, 9, 12, 1000):
        got = list(V._in_order(iter(pieces), 6, run))
        assert rows(got) == rows(pieces) and all(str(k.tolist()) == str(np.sort(k).tolist()) for *_, k in got)
    assert len(got) == 1 and list(V._in_order(iter(pieces[1:2]), 6)) == []

    m = rng.normal(size=(40, 3))
    m[5], m[6] = 0, -m[7]
    v = spark.createDataFrame([(f"n{i:02}", x.tolist()) for i, x in enumerate(m)], "id string, vec array<double>")
    u = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    want = {(f"n{i:02}", f"n{j:02}", float(np.round(u[i] @ u[j], 6) + 0.0)) for i in range(40) for j in range(i, 40)}
    for block in (7, 16384):
        got = V.cosine_pairs(v, block=block).collect()
        assert len(got) == len(want) and {(r.src, r.dst, r.weight) for r in got} == want
        assert {(r.src, r.dst, r.weight) for r in V.cosine_pairs(v, block=block, loops=False, least=0.5).collect()} == {p for p in want if p[0] < p[1] and p[2] >= 0.5}


def test_files_of_all_pairs_are_small(spark, tmp_path, monkeypatch):
    """F8: equal weights stand together where all pairs are written; 8.0 bytes a pair before were the weight alone."""
    monkeypatch.setattr(V, "SPREAD", 1)
    m = np.random.default_rng(3).normal(size=(3000, 64)).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, vec array<float>")
    V.cosine_pairs(v).write.parquet(f"{tmp_path}/pairs")
    size = sum(os.path.getsize(f"{tmp_path}/pairs/{f}") for f in os.listdir(tmp_path / "pairs") if f.endswith(".parquet"))
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 3000 * 3001 // 2 and size < 6 * 3000 * 3001 // 2
