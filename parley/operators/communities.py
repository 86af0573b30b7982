"""Communities and centralities of many graphs at once: a graph is a group, and one task's arrays.

Groups are meetings or texts, so their size is bounded by what people say in one;
graphs of unbounded size are for ``ranking`` and ``edges``, which never gather one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Graph:
    """An undirected weighted graph; nodes are numbered in their own order."""

    def __init__(self, edges: pd.DataFrame | dict[str, np.ndarray]):
        m = len(edges["src"])
        w = np.asarray(edges["weight"], float) if "weight" in edges else np.ones(m)
        self.nodes, at = np.unique(np.concatenate([np.asarray(edges["src"]), np.asarray(edges["dst"])]), return_inverse=True)
        self.a, self.b, self.w = at[:m], at[m:], w
        self.n = len(self.nodes)
        self.near: list[dict[int, float]] = [{} for _ in range(self.n)]
        for x, y, v in zip(self.a.tolist(), self.b.tolist(), w.tolist()):
            self.near[x][y] = self.near[x].get(y, 0.0) + v
            if x != y:
                self.near[y][x] = self.near[y].get(x, 0.0) + v


def _degree(near: list[dict[int, float]], i: int) -> float:
    return sum(near[i].values()) + near[i].get(i, 0.0)


def modularity(near: list[dict[int, float]], of: np.ndarray, resolution: float = 1.0) -> float:
    degree = np.array([_degree(near, i) for i in range(len(near))])
    two_m = degree.sum()
    if not two_m:
        return 0.0
    c = of.tolist()
    inner = sum([v * (2 if i == j else 1) for i, links in enumerate(near) for j, v in links.items() if c[i] == c[j]])
    total = np.bincount(of, degree, minlength=int(of.max()) + 1 if len(of) else 0)
    return float(inner / two_m - resolution * ((total / two_m) ** 2).sum())


def _picker(at: list[int]) -> Callable[[list[int]], tuple[int, ...]]:
    """Takes the entries of a list at ``at``."""
    return itemgetter(*at) if len(at) > 1 else lambda x: tuple(x[j] for j in at)


def _level(near: list[dict[int, float]]) -> tuple[list[float], float, list[tuple]]:
    """What local moves read of a graph: the nodes' degrees, their sum, and each one's links to other nodes: what takes these nodes' communities, and weights."""
    degree = [_degree(near, i) for i in range(len(near))]
    others = [[j for j in links if j != i] for i, links in enumerate(near)]
    return degree, float(np.array(degree, float).sum()), [(_picker(at), [near[i][j] for j in at]) for i, at in enumerate(others)]


def louvain(graph: Graph, resolution: float = 1.0, seed: int = 0) -> np.ndarray:
    """Communities by local moves and contraction; nodes are visited in a seeded order, ties go to the smaller community."""
    rng = np.random.default_rng(seed)
    near, whole = graph.near, np.arange(graph.n)
    if not hasattr(graph, "level"):
        graph.level = _level(near)
    degree, two_m, links_of = graph.level
    while two_m:
        n = len(near)
        of, total = list(range(n)), degree.copy()
        moved_at_all = False
        while True:
            moved = 0
            for i in rng.permutation(n).tolist():
                pick, weights = links_of[i]
                near_of, links = pick(of), [0.0] * n
                for c, v in zip(near_of, weights):
                    links[c] += v
                own, d = of[i], degree[i]
                total[own] -= d
                best, gain = own, links[own] - resolution * total[own] * d / two_m
                for c in sorted(set(near_of)):
                    g = links[c] - resolution * total[c] * d / two_m
                    if g > gain + 1e-12:
                        best, gain = c, g
                total[best] += d
                if best != own:
                    of[i] = best
                    moved += 1
            moved_at_all |= moved > 0
            if not moved:
                break
        place = {c: k for k, c in enumerate(sorted(set(of)))}
        of = [place[c] for c in of]
        whole = np.array(of)[whole]
        if not moved_at_all or len(place) == n:
            break
        small: list[dict[int, float]] = [{} for _ in place]
        for i in range(n):
            for j, v in near[i].items():
                if j >= i:
                    x, y = of[i], of[j]
                    small[x][y] = small[x].get(y, 0.0) + v
                    if x != y:
                        small[y][x] = small[y].get(x, 0.0) + v
        near = small
        degree, two_m, links_of = _level(near)
    return _by_first(whole)


def _by_first(of: np.ndarray) -> np.ndarray:
    """Communities numbered by their first node."""
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(c, len(seen)) for c in of.tolist()], int)


def repeated_louvain(graph: Graph, times: int = 5, resolution: float = 1.0, seed: int = 0) -> np.ndarray:
    """Of several seeded runs the one with the lowest modularity below 1."""
    runs = {tuple(of.tolist()): of for of in (louvain(graph, resolution, seed + t) for t in range(times))}
    return min(runs.values(), key=lambda of: (modularity(graph.near, of), of.tolist())) if len(runs) > 1 else next(iter(runs.values()))


def chinese_whispers(graph: Graph, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """Each node takes the label of the largest weight around it, ties to the smaller label."""
    rng, of = np.random.default_rng(seed), np.arange(graph.n)
    for _ in range(rounds):
        before = of.copy()
        for i in rng.permutation(graph.n).tolist():
            score: dict[int, float] = {}
            for j, v in graph.near[i].items():
                if j != i:
                    score[of[j]] = score.get(of[j], 0.0) + v
            if score:
                of[i] = min(score, key=lambda c: (-score[c], c))
        if (of == before).all():
            break
    return _by_first(of)


def label_propagation(graph: Graph, rounds: int = 100) -> np.ndarray:
    """Labels of most neighbours, unweighted, in node order; ties keep the own label, else the largest wins."""
    of = np.arange(graph.n)
    for _ in range(rounds):
        moved = False
        for i in range(graph.n):
            count: dict[int, int] = {}
            for j in graph.near[i]:
                if j != i:
                    count[of[j]] = count.get(of[j], 0) + 1
            if count:
                top = max(count.values())
                if count.get(of[i], 0) < top:
                    of[i] = max(c for c, v in count.items() if v == top)
                    moved = True
        if not moved:
            break
    return _by_first(of)


def _components(near: list[dict[int, float]]) -> np.ndarray:
    of, c = np.full(len(near), -1), 0
    for s in range(len(near)):
        if of[s] < 0:
            todo = deque([s])
            of[s] = c
            while todo:
                for j in near[todo.popleft()]:
                    if of[j] < 0:
                        of[j] = c
                        todo.append(j)
            c += 1
    return of


def parts(graph: Graph) -> np.ndarray:
    """The connected part of each node, from 0."""
    return _components(graph.near)


def _shortest(near: list[dict[int, float]], s: int):
    """Order, path counts, predecessors and distances of a breadth-first walk."""
    n = len(near)
    dist, paths, before, order = [-1] * n, [0.0] * n, [[] for _ in range(n)], []
    dist[s], paths[s] = 0, 1.0
    todo = deque([s])
    while todo:
        i = todo.popleft()
        order.append(i)
        for j in near[i]:
            if j == i:
                continue
            if dist[j] < 0:
                dist[j] = dist[i] + 1
                todo.append(j)
            if dist[j] == dist[i] + 1:
                paths[j] += paths[i]
                before[j].append(i)
    return order, paths, before, dist


def betweenness(graph: Graph, of_edges: bool = False):
    """Share of shortest paths through each node (normalised), or through each edge."""
    n, near = graph.n, graph.near
    node, edge = np.zeros(n), {}
    for s in range(n):
        order, paths, before, _ = _shortest(near, s)
        credit = [0.0] * n
        for j in reversed(order):
            for i in before[j]:
                c = paths[i] / paths[j] * (1 + credit[j])
                credit[i] += c
                k = (min(i, j), max(i, j))
                edge[k] = edge.get(k, 0.0) + c
            if j != s:
                node[j] += credit[j]
    if of_edges:
        return edge
    return node / ((n - 1) * (n - 2)) if n > 2 else node


def closeness(graph: Graph) -> np.ndarray:
    out = np.zeros(graph.n)
    for s in range(graph.n):
        d = np.array(_shortest(graph.near, s)[3])
        r = d[d > 0]
        if len(r):
            out[s] = len(r) / r.sum() * (len(r) / (graph.n - 1))
    return out


def path_centralities(graph: Graph) -> tuple[np.ndarray, np.ndarray]:
    """``closeness`` and ``betweenness`` in one: shortest paths from all nodes at once, a product of matrices a step."""
    n = graph.n
    a = np.zeros((n, n))
    a[graph.a, graph.b] = a[graph.b, graph.a] = 1.0
    np.fill_diagonal(a, 0.0)
    dist, paths, front, far = np.where(np.eye(n) > 0, 0, -1), np.eye(n), np.eye(n), 0
    while True:
        step = front @ a
        new = (step > 0) & (dist < 0)
        if not new.any():
            break
        far += 1
        dist[new] = far
        front = np.where(new, step, 0.0)
        paths += front
    credit = np.zeros((n, n))
    for k in range(far, 0, -1):
        passed = np.divide(1 + credit, paths, out=np.zeros((n, n)), where=dist == k) @ a
        credit += np.where(dist == k - 1, paths * passed, 0.0)
    reached, total = (dist > 0).sum(1), np.where(dist > 0, dist, 0).sum(1)
    near = np.where(reached > 0, reached / np.maximum(total, 1) * (reached / max(n - 1, 1)), 0.0)
    between = credit.sum(0) - np.diag(credit)
    return near, between / ((n - 1) * (n - 2)) if n > 2 else between


def _wiener(near: list[dict[int, float]]) -> float:
    total = 0.0
    for s in range(len(near)):
        d = np.array(_shortest(near, s)[3])
        if (d < 0).any():
            return float("inf")
        total += d.sum()
    return total / 2


def closeness_vitality(graph: Graph) -> np.ndarray:
    """How much the sum of all distances shrinks without a node; minus infinity if the graph falls apart."""
    whole, out = _wiener(graph.near), np.zeros(graph.n)
    for s in range(graph.n):
        keep = [i for i in range(graph.n) if i != s]
        at = {i: k for k, i in enumerate(keep)}
        near = [{at[j]: v for j, v in graph.near[i].items() if j != s} for i in keep]
        out[s] = whole - _wiener(near)
    return out


def _inverse_laplacian(graph: Graph) -> np.ndarray:
    """The pseudo-inverse of a connected graph's Laplacian: only constants are taken to zero, so with their projection added it has an inverse."""
    m = np.zeros((graph.n, graph.n))
    other = graph.a != graph.b
    a, b, w = graph.a[other], graph.b[other], graph.w[other]
    np.add.at(m, (a, b), -w)
    np.add.at(m, (b, a), -w)
    np.fill_diagonal(m, -m.sum(1))
    return np.linalg.inv(m + 1 / graph.n) - 1 / graph.n


def current_flow_closeness(graph: Graph, inverse: np.ndarray | None = None) -> np.ndarray:
    """One by the sum of resistances to all others; zero unless the graph is connected."""
    if graph.n < 2 or _components(graph.near).max():
        return np.zeros(graph.n)
    c = _inverse_laplacian(graph) if inverse is None else inverse
    d = np.diag(c)
    r = d[:, None] + d[None, :] - 2 * c
    return 1 / r.sum(1)


def current_flow_betweenness(graph: Graph, inverse: np.ndarray | None = None) -> np.ndarray:
    """Current through each node when a unit flows between all pairs, normalised; zero unless connected."""
    n, out = graph.n, np.zeros(graph.n)
    if n < 3 or _components(graph.near).max():
        return out
    c = _inverse_laplacian(graph) if inverse is None else inverse
    i, j, v = (np.array(x) for x in zip(*[(i, j, v) for i in range(n) for j, v in graph.near[i].items() if i < j]))
    place, step = 2 * np.arange(n) - (n - 1), max(1, (1 << 20) // n)
    for first in range(0, len(v), step):
        s, d = i[first : first + step], j[first : first + step]
        row = v[first : first + step, None] * (c[s] - c[d])
        total = np.sort(row, axis=1) @ place  # the sum of |x - y| over all pairs: an entry counts by its place
        each = np.arange(len(s))
        for x in (s, d):  # pairs in which x itself is an end don't count
            np.add.at(out, x, (total - np.abs(row[each, x, None] - row).sum(1)) / 2)
    return out * 2 / ((n - 1) * (n - 2))


def girvan_newman(graph: Graph) -> np.ndarray:
    """The first split: edges of most shortest paths go until there is one part more."""
    g = Graph.__new__(Graph)
    g.n, g.nodes, g.near = graph.n, graph.nodes, [dict(x) for x in graph.near]
    parts = _components(g.near).max()
    while _components(g.near).max() == parts:
        edge = betweenness(g, of_edges=True)
        if not edge:
            break
        i, j = min(edge, key=lambda k: (-round(edge[k], 9), k))
        del g.near[i][j], g.near[j][i]
    return _components(g.near)


def colouring(graph: Graph) -> np.ndarray:
    """Greedy colours in depth-first order."""
    of = np.full(graph.n, -1)
    for s in range(graph.n):
        todo = [s]
        while todo:
            i = todo.pop()
            if of[i] >= 0:
                continue
            used = {of[j] for j in graph.near[i] if j != i}
            of[i] = next(c for c in range(graph.n + 1) if c not in used)
            todo += sorted((j for j in graph.near[i] if of[j] < 0), reverse=True)
    return of


METHODS: dict[str, Callable[[Graph], np.ndarray]] = {
    "louvain": louvain, "louvain_lowest_of_5": repeated_louvain, "chinese_whispers": chinese_whispers, "label_propagation": label_propagation, "girvan_newman": girvan_newman, "colouring": colouring,
    "betweenness": betweenness, "closeness": closeness, "closeness_vitality": closeness_vitality, "current_flow_closeness": current_flow_closeness, "current_flow_betweenness": current_flow_betweenness,
}


def per_graph(edges: DataFrame, group: str, method: str, **options) -> DataFrame:
    """``edges(group, src, dst[, weight])`` to ``(group, node, value)`` by one of METHODS; one group is one task's graph."""
    f = METHODS[method]
    kind, node = edges.schema[group].dataType.simpleString(), edges.schema["src"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = Graph(pdf)
        return pd.DataFrame({group: key[0], "node": g.nodes, "value": np.round(np.asarray(f(g, **options), float), 6)})

    return edges.groupBy(group).applyInPandas(run, f"{group} {kind}, node {node}, value double")


def hierarchical(edges: DataFrame, group: str, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """``(group, node, community, sub)``: Louvain, and Louvain again inside each community; sub is unique in the group."""
    kind, node = edges.schema[group].dataType.simpleString(), edges.schema["src"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = Graph(pdf)
        of, sub, n = louvain(g, resolution, seed), np.zeros(g.n, int), 0
        at = dict(zip(g.nodes.tolist(), of.tolist()))
        inner = pdf[[at[a] == at[b] for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist())]]
        for c in range(int(of.max()) + 1):
            own = np.flatnonzero(of == c)
            part = inner[[at[a] == c for a in inner["src"].tolist()]]
            inside = dict(zip(*(lambda h: (h.nodes.tolist(), louvain(h, resolution, seed).tolist()))(Graph(part)))) if len(part) else {}
            most = max(inside.values(), default=-1) + 1
            for i in own.tolist():
                k = g.nodes[i].item() if hasattr(g.nodes[i], "item") else g.nodes[i]
                if k not in inside:
                    inside[k], most = most, most + 1
                sub[i] = n + inside[k]
            n += most
        return pd.DataFrame({group: key[0], "node": g.nodes, "community": of, "sub": sub})

    return edges.groupBy(group).applyInPandas(run, f"{group} {kind}, node {node}, community int, sub int")


def modularity_search(edges: DataFrame, group: str, target: float = 0.4, start: int = 50, stop: int = 100, seed: int = 0) -> DataFrame:
    """``(group, v, modularity, node, community)``: edges under ever higher percentiles go until Louvain's modularity passes the target (or ``stop``)."""
    kind, node = edges.schema[group].dataType.simpleString(), edges.schema["src"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for v in range(start, stop):
            kept = pdf[pdf["weight"] >= np.percentile(pdf["weight"], v)]
            g = Graph(kept)
            of = louvain(g, seed=seed)
            q = modularity(g.near, of)
            out = pd.DataFrame({group: key[0], "v": v, "modularity": round(q, 6), "node": g.nodes, "community": of})
            if q > target:
                break
        return out

    return edges.groupBy(group).applyInPandas(run, f"{group} {kind}, v int, modularity double, node {node}, community int")
