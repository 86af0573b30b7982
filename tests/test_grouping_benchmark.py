"""The grouping benchmark and minds from a golden set, against brute force."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from parley.operators import grouping_benchmark as B
from parley.operators import metrics, minds
from parley.operators import sequences as S
from parley.plans import topic_queries as Q
from parley.plans.registry import QUERIES
from parley.sources.shared import new_path
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_most_matched():
    rng = np.random.default_rng(3)
    for _ in range(300):
        rows, columns = rng.integers(1, 6, 2)
        m = rng.integers(0, 7, (rows, columns))
        small = m if rows <= columns else m.T
        best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert metrics.most_matched(m) == best


def scores(rows):
    """n, tags, clusters and the four scores of (cluster, tag) pairs."""
    rank = lambda t: (t is not None, t)
    count, total, clusters = Counter(rows), Counter(t for _, t in rows), sorted({c for c, _ in rows})
    top = {c: min((t for d, t in count if d == c), key=lambda t: (-count[c, t], rank(t))) for c in clusters}
    recall = owned = 0
    for t in total:
        own = [c for c in clusters if top[c] == t]
        if own:
            home = min(own, key=lambda c: (-count[c, t], c))
            recall += count[home, t] / total[t]
            owned += count[home, t]
    m = np.array([[count[c, t] for t in total] for c in clusters])
    m = m if len(m) <= m.shape[1] else m.T
    matched = max(sum(m[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m.shape[1]), m.shape[0]))
    n = len(rows)
    return n, len(total), len(clusters), 100 * recall / len(total), 100 * owned / n, 100 * sum(count[c, top[c]] for c in clusters) / n, 100 * matched / n


def test_grouping_scores(spark):
    rng = np.random.default_rng(8)
    rows = [(k, int(rng.integers(1 + k % 5)), [None, "a", "b", "c", "d"][int(rng.integers(1 + k % 4, 5)) - 1]) for k in range(12) for _ in range(int(rng.integers(1, 40)))]
    found = metrics.grouping_scores(spark.createDataFrame(rows, "k int, cluster int, tag string"), ["k"]).collect()
    assert len(found) == 12
    for r in found:
        want = scores([(c, t) for k, c, t in rows if k == r.k])
        assert (r.n, r.tags, r.clusters) == want[:3]
        assert (r.recall, r.precision_owned, r.precision_dominant, r.matched) == pytest.approx(want[3:], abs=1e-5)


def dense(name, vec, order, phrases=None):
    """The graph of one meeting as a matrix; nan: no edge."""
    u = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-300)
    w, n = np.round(u @ u.T, 6), len(vec)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in sorted((j for j in range(n) if j != i), key=lambda j: (-w[i, j], j))[:3]:
            if i < j:
                near[i, j] = near[j, i] = True
    next_ = np.abs(order[:, None] - order[None, :]) <= 1
    if name == "kp":
        w = np.array([[np.mean([[p @ q for q in b] for p in a]) if a and b else 0 for b in phrases] for a in phrases])
    keep = {"ns": next_, "ns+norm": next_, "ns+norm+s5": next_, "ns_max": next_ | near}.get(name, np.ones((n, n), bool))
    if name not in B.NORMALISED:
        return np.where(keep, w, np.nan)
    x = np.where(keep, w, 0.0)
    for i, mean in enumerate(x.mean(1)):
        x[i, i] = mean
    lo, hi = x.min(1), x.max(1)
    x = np.where(hi > lo, (x - lo) / np.where(hi > lo, hi - lo, 1), 0)
    x = (x + x.T) / 2
    x[np.diag_indices(n)] = 1
    return np.where(x == 0, np.nan, x)


def test_graphs_of_conversations(spark):
    sentences, phrases = Q._conversation_sentences(spark, SF)
    rows, named = defaultdict(list), defaultdict(list)
    for r in sentences.orderBy("meeting", "node").collect():
        rows[r.meeting].append(r)
    for r in phrases.collect():
        v = np.array(r.vec, float)
        named[r.meeting, r.node].append(v / (np.linalg.norm(v) or 1))
    assert named
    found = defaultdict(dict)
    for r in B.graphs(sentences, phrases).collect():
        assert r.src <= r.dst and (r.src, r.dst) not in found[r.meeting, r.builder]
        found[r.meeting, r.builder][r.src, r.dst] = r.weight
    for m, own in rows.items():
        vec, order = np.array([r.vec for r in own], float), np.array([r.seg_order for r in own])
        for b in B.BUILDERS:
            want = dense(b, vec, order, [named[m, r.node] for r in own])
            edges = {(own[i].node, own[j].node): want[i, j] for i in range(len(own)) for j in range(i, len(own)) if not np.isnan(want[i, j])}
            got = {k: v for k, v in found[m, b].items() if abs(v) > 1e-9 or k in edges}
            assert got == pytest.approx({k: v for k, v in edges.items() if k in got or abs(v) > 1e-9}, abs=2e-6), (m, b)


def test_benchmark_finds_planted_topics(spark):
    rng = np.random.default_rng(1)
    rows = [(m, i, i // 2, (np.eye(8)[(i // 10) % 3] + rng.normal(0, 0.05, 8)).tolist(), f"t{(i // 10) % 3}") for m in ("a", "b") for i in range(30)]
    s = spark.createDataFrame(rows, "meeting string, node int, seg_order int, vec array<double>, tag string")
    found = B.benchmark(s, builders=("norm", "ns"), percentiles=(0, 70), resolutions=(1.0,)).collect()
    assert sorted((r.meeting, r.builder, r.percentile) for r in found) == [(m, b, v) for m in "ab" for b in ("norm", "ns") for v in (0.0, 70.0)]
    for r in found:
        assert (r.n, r.tags) == (30, 3)
        if (r.builder, r.percentile) == ("norm", 70.0):
            assert (r.clusters, r.recall, r.precision_owned, r.precision_dominant, r.matched) == (3, 100, 100, 100, 100)
    assert B.benchmark(s.limit(0), builders=("norm", "ns")).count() == 0
    with pytest.raises(ValueError, match="phrases"):
        B.graphs(s)
    with pytest.raises(ValueError, match="no such"):
        B.graphs(s, builders=("vanila",))


def test_nodes_that_lose_all_edges_stay(spark):
    edges = spark.createDataFrame([(1, "x", 0, 1, 0.9), (1, "x", 2, 3, 0.1), (1, "x", 4, 4, 0.0)], "meeting int, builder string, src int, dst int, weight double")
    of = {r.node: r.cluster for r in B.communities(edges, percentiles=(90,)).collect()}
    assert of[0] == of[1] and len(set(of.values())) == 4 and set(of) == {0, 1, 2, 3, 4}


@pytest.mark.parametrize(("name", "sentences"), [("grouping_benchmark_of_vectors", Q._tagged_sentences), ("grouping_benchmark_of_conversations", lambda s, d: Q._conversation_sentences(s, d)[0])])
def test_benchmark_queries(spark, name, sentences):
    """Every node is in one cluster of every graph, and the scores are those of the clusters."""
    size = Counter(r.meeting for r in sentences(spark, SF).select("meeting").collect())
    rows = QUERIES[name](spark, SF).collect()
    graphs = 6 * 4 if "vectors" in name else 7
    assert Counter(r.meeting for r in rows) == {m: graphs for m in size}
    for r in rows:
        assert r.n == size[r.meeting] and 1 <= r.clusters <= r.n
        assert 0 < r.precision_owned <= r.precision_dominant <= 100 and r.matched <= r.precision_dominant
        assert r.precision_owned <= r.matched and 0 < r.recall <= 100


def test_ranks_over_all(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(5))) for i in range(500)]
    found = S.ranked_over_all(spark.createDataFrame(rows, "id int, n int").repartition(7), F.desc("n"), "id", value="n").collect()
    before = 0
    for k, (i, n) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))):
        r = next(x for x in found if x.id == i)
        assert (r.rank, r.before) == (k, before)
        before += n


def test_mind_of_a_golden_set(spark):
    """Groups without repeated communities add nothing; the rest is ranked, cut and kept; calls enrich it."""
    rng = np.random.default_rng(6)
    at = lambda c: (np.eye(6)[c] + rng.normal(0, 0.05, 6)).tolist()
    known = [(f"e{c}-{i}", at(c), c) for c in range(5) for i in range(6)] + [(f"lone{c}", (-np.eye(6)[c]).tolist(), 10 + c) for c in range(6)]
    groups = [(g, at(c)) for g, c in enumerate([0] * 6 + [1] * 3 + [3] * 3 + [2])] + [(99, (-np.ones(6)).tolist())]
    k = spark.createDataFrame(known, "entity string, vec array<double>, community int")
    g = spark.createDataFrame(groups, "grp int, vec array<double>")
    ranks = minds.golden_ranks(g, k, k=5, share=0.8).orderBy("rank").collect()
    assert [(r.community, r.freq, r.rank, r.chosen) for r in ranks] == [(0, 6, 0, True), (1, 3, 1, True), (3, 3, 2, True), (2, 1, 3, False)]
    assert [r.share for r in ranks] == pytest.approx([6 / 13, 9 / 13, 12 / 13, 1], abs=1e-6)
    root = new_path(spark, "minds")
    state = minds.generate(spark, root, g, k, k=5, share=0.8)
    assert Counter(r.community for r in state.table("communities").collect()) == {0: 6, 1: 6, 3: 6}
    new = spark.createDataFrame([("q", (np.eye(6)[1] + 0.9 * np.eye(6)[0]).tolist()), ("r", np.eye(6)[3].tolist())], "qid string, vec array<double>")
    placed = {r.qid: (r.community, r.votes, r.weight) for r in minds.weighted_places(new, state, k=8).collect()}
    q = np.eye(6)[1] + 0.9 * np.eye(6)[0]
    near = sorted((e for e in known if e[2] in (0, 1, 3)), key=lambda e: -(q @ e[1]) / np.linalg.norm(e[1]))[:8]
    votes = Counter(c for _, _, c in near)
    assert votes[1] > votes[0] and 6 * votes[0] > 3 * votes[1]  # fewer entities, of a community more frequent
    assert placed["q"] == (0, votes[0], 6 * votes[0]) and placed["r"][0] == 3
    later = minds.enrich(spark, root, new.withColumnRenamed("qid", "entity"), 1)
    counters = {r.community: (r.total, list(r.recent)) for r in later.table("counters").collect()}
    assert counters == {0: (6, []), 1: (4, [1]), 3: (4, [1])}
    assert later.table("ranks").count() == 3
    empty = minds.generate(spark, new_path(spark, "minds"), g.limit(0), k)
    assert empty.table("communities").count() == 0 and minds.weighted_places(new, empty).count() == 0
