"""Word graphs ranked in all ways at once."""

import numpy as np
import pytest
from parley.operators import communities as C
from parley.operators import keyphrases as K


def _graph(seed: int, n: int, m: int) -> C.Graph:
    rng = np.random.default_rng(seed)
    e = np.unique(np.sort(rng.integers(0, n, (m, 2)), 1), axis=0)
    e = e[e[:, 0] != e[:, 1]]
    return C.Graph({"src": e[:, 0], "dst": e[:, 1]})


@pytest.mark.parametrize("seed", range(6))
def test_path_centralities(seed):
    g = _graph(seed, 5 + 7 * seed, 4 + 9 * seed)
    near, between = C.path_centralities(g)
    assert np.allclose(near, C.closeness(g)) and np.allclose(between, C.betweenness(g))


def test_current_flow():
    """Against sums over all pairs of nodes and the pseudo-inverse."""
    g = _graph(3, 12, 60)
    assert not C.parts(g).max()
    m = np.zeros((g.n, g.n))
    for x, y in zip(g.a, g.b):
        m[x, y] -= 1
        m[y, x] -= 1
        m[x, x] += 1
        m[y, y] += 1
    c, want = np.linalg.pinv(m), np.zeros(g.n)
    assert np.allclose(C._inverse_laplacian(g), c)
    for s in range(g.n):
        for t in range(s):
            potential = c[:, s] - c[:, t]
            through = [sum(abs(potential[v] - potential[u]) for u in range(g.n) if m[v, u] == -1) / 2 for v in range(g.n)]
            want += [0 if v in (s, t) else through[v] for v in range(g.n)]
    assert np.allclose(C.current_flow_betweenness(g), want * 2 / ((g.n - 1) * (g.n - 2)))


def test_one_pass_for_all_ways(spark):
    """the words are read, and a text's graph is made, once for all ways to normalise; each equals textrank's."""
    rng = np.random.default_rng(1)
    rows = [(t, p, f"w{rng.integers(0, 9)}", bool(rng.random() < 0.7)) for t in range(4) for p in range(30)]
    words = spark.createDataFrame(rows, "turn int, pos int, word string, kw boolean")
    got = K.word_ranks(words, "turn", window=4, normalise=K.NORMALISE)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroupsInPandas" not in plan
    for way in K.NORMALISE:
        one = {(r.turn, r.node): r["rank"] for r in K.textrank(words, "turn", window=4, normalise=way).collect()}
        assert one == {(r.turn, r.node): r[way or "rank"] for r in got.collect()}
