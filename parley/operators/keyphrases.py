"""Word graphs, TextRank and phrases, for all texts at once: a graph is a group of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import communities as C
from .batches import per_group


def tokens(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, pos, word)``: lower-cased words of letters a to z, in order from 0."""
    w = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x != "")
    return docs.select(key, F.posexplode(w).alias("pos", "word"))


def cooccurrence(tokens_: DataFrame, key: str, window: int = 3) -> DataFrame:
    """Distinct undirected edges between different marked words (``kw``) less than ``window`` places apart in the whole token stream."""
    w = Window.partitionBy(key).orderBy("pos")
    ahead = F.array(*[F.when(F.lead("kw", k).over(w), F.lead("word", k).over(w)) for k in range(1, window)])
    pairs = tokens_.select(key, "word", "kw", ahead.alias("ahead")).where("kw")
    pairs = pairs.select(key, "word", F.explode("ahead").alias("other")).where("other is not null and word <> other")
    return pairs.select(key, F.least("word", "other").alias("src"), F.greatest("word", "other").alias("dst")).distinct()


def phrase_runs(tokens_: DataFrame, key: str, compat: bool = False) -> DataFrame:
    """``(key, start, phrase, n)``: the longest runs of marked words.  ``compat`` leaves out a run that ends the text."""
    w = Window.partitionBy(key).orderBy("pos")
    last = F.max("pos").over(Window.partitionBy(key))
    marked = tokens_.withColumn("last", last).where("kw").withColumn("island", F.col("pos") - F.row_number().over(w))
    runs = marked.groupBy(key, "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.first("last").alias("last"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("ws"))
    if compat:
        runs = runs.where("`end` < `last`")
    return runs.select(key, "start", F.array_join(F.transform("ws", lambda x: x["word"]), " ").alias("phrase"), F.size("ws").cast("long").alias("n"))


def _rank(at: np.ndarray, n: int, alpha: float, rounds: int | None, tol: float) -> np.ndarray:
    """Ranks of nodes 0 to n - 1, of which ``at`` has the sources of all edges, then their ends."""
    m = len(at) // 2
    a, b = at, np.concatenate([at[m:], at[:m]])
    degree = np.bincount(a, minlength=n)
    r = np.full(n, 1.0 / n)
    for _ in range(rounds or 100):
        new = (1 - alpha) / n + alpha * np.bincount(b, (r / degree)[a], minlength=n)
        moved, r = np.abs(new - r).sum(), new
        if rounds is None and moved < n * tol:
            break
    else:
        if rounds is None:
            raise RuntimeError("the ranks of a text's words still move after 100 rounds")
    return r


#: What ranks can be normalised by.
NORMALISE = (None, "degree", "closeness", "betweenness", "degree_bet")


def _centralities(at: np.ndarray, kinds: set[str]) -> dict[str, np.ndarray]:
    """Closeness and betweenness of the nodes in order: by current flow where the graph is connected, else by shortest paths.  One inverse, or one search for paths, serves both."""
    m = len(at) // 2
    g = C.Graph({"src": at[:m], "dst": at[m:]})
    if not C.parts(g).max():
        inverse = C._inverse_laplacian(g)
        flow = {"closeness": C.current_flow_closeness, "betweenness": C.current_flow_betweenness}
        return {k: flow[k](g, inverse) for k in kinds}
    return dict(zip(("closeness", "betweenness"), C.path_centralities(g)))


def word_ranks(tokens_: DataFrame, key: str, window: int = 3, rounds: int | None = None, alpha: float = 0.85, tol: float = 1e-4, normalise: Sequence[str | None] = (None,)) -> DataFrame:
    """``(key, node, rank, ...)``: PageRank of each text's word graph in one column for each way in ``normalise`` (named by it; None: ``rank``).

    Divided by ``degree`` or ``closeness`` (zero keeps the rank), times
    ``betweenness``, or divided by degree and betweenness together (``degree_bet``).  A text's graph is made once, and
    many texts pass in one batch.  Closeness and betweenness solve a system as large as the graph: they are for texts of some hundred different words.
    """
    unknown = [n for n in normalise if n not in NORMALISE]
    if unknown:
        raise ValueError(f"no way to normalise by {unknown[0]}")
    kinds = ({"closeness"} & set(normalise)) | ({"betweenness"} if {"betweenness", "degree_bet"} & set(normalise) else set())

    def run(of: tuple, own: dict[str, np.ndarray]) -> list:
        place: dict[str, int] = {}
        at = np.array([place.setdefault(w, len(place)) for w in own["src"].tolist() + own["dst"].tolist()])
        nodes = sorted(place)
        order = np.empty(len(nodes), int)
        order[[place[w] for w in nodes]] = np.arange(len(nodes))
        at = order[at]
        r, degree = _rank(at, len(nodes), alpha, rounds, tol), np.bincount(at, minlength=len(nodes))
        of_kind = _centralities(at, kinds) if kinds else {}
        out: list = [nodes]
        for n in normalise:
            if n == "degree":
                out.append(r / degree)
            elif n == "degree_bet":
                out.append(r / (degree + of_kind["betweenness"]))
            elif n == "closeness":
                out.append(r / np.where(of_kind[n] == 0, 1, of_kind[n]))
            else:
                out.append(r * of_kind[n] if n else r)
        return out

    columns = ", ".join(["node string", *[f"{n or 'rank'} double" for n in normalise]])
    return per_group(cooccurrence(tokens_, key, window), [key], run, columns, ["src", "dst"])


def textrank(tokens_: DataFrame, key: str, window: int = 3, rounds: int | None = None, alpha: float = 0.85, tol: float = 1e-4, normalise: str | None = None) -> DataFrame:
    """``(key, node, rank)``: PageRank of each text's word graph, normalised in one of the ways of ``word_ranks``."""
    return word_ranks(tokens_, key, window, rounds, alpha, tol, (normalise,)).withColumnRenamed(normalise or "rank", "rank")


def phrase_score(scores: Column, metric: str = "sum", normalise: bool = True) -> Column:
    """Sum or largest of the words' scores, by their number when there are more than three."""
    s = F.array_max(scores) if metric == "max" else F.aggregate(scores, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.lit(normalise) & (F.size(scores) > 3), s / F.size(scores)).otherwise(s)


def keyphrases(tokens_: DataFrame, key: str, top: int = 10, window: int = 3, metric: str = "sum", compat: bool = False) -> DataFrame:
    """``(key, rank, phrase, score)``: the best phrases of each text, by score and phrase descending.

    Single words that a longer phrase of the text holds are left out, words
    within a phrase count once.  Tokens are dealt by text once, marked words alone with their spelling; many texts pass in one batch.
    """
    def run(of: tuple, own: dict[str, np.ndarray]) -> list:
        pos, words = own["pos"].tolist(), own["word"].tolist()
        edges = sorted({(min(a, b), max(a, b)) for k in range(1, window) for a, b in zip(words, words[k:]) if a is not None and b is not None and a != b})
        nodes = sorted({w for e in edges for w in e})
        place = {w: i for i, w in enumerate(nodes)}
        at = np.array([place[e[0]] for e in edges] + [place[e[1]] for e in edges], int)
        ranks = dict(zip(nodes, _rank(at, len(nodes), 0.85, None, 1e-4).tolist())) if nodes else {}
        runs: list[list[str]] = []
        before = None
        for p, w in zip(pos, words):
            if w is not None:
                if before == p - 1:
                    runs[-1].append(w)
                else:
                    runs.append([w])
                before = p
        if compat and runs and before == pos[-1]:
            runs.pop()
        scores: dict[str, float] = {}
        for ws in {tuple(r) for r in runs}:
            each = [ranks.get(w, 0.0) for w in ws]
            score = (max(each) if metric == "max" else reduce(add, each, 0.0)) / (len(each) if len(each) > 3 else 1)
            phrase = " ".join(dict.fromkeys(ws))
            scores[phrase] = max(scores.get(phrase, score), score)
        held = {w for phrase in scores if " " in phrase for w in phrase.split(" ")}
        best = sorted(((score, phrase) for phrase, score in scores.items() if phrase not in held), reverse=True)[:top]
        return [np.arange(1, len(best) + 1, dtype=np.int32), [phrase for _, phrase in best], [score for score, _ in best]]

    marked = tokens_.select(key, "pos", F.when(F.col("kw"), F.col("word")).alias("word"))
    return per_group(marked, [key], run, "rank int, phrase string, score double", ["pos"]).withColumn("score", F.round("score", 6))
