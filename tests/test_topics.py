"""Tags, chunks, ranks of many graphs, and topics, against brute force."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from parley.functions import text as T
from parley.operators import chunking, detect, edges, intervals, ranking, relatedness, tagging, topics
from parley.operators.chunking import GRAMMARS
from parley.plans import topic_queries
from parley.plans.pipeline_queries import _sentences
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def brute_chunks(tags, grammar):
    """Chunks of a grammar by regular expressions over ``<TAG>`` strings, rule after rule, as token places."""
    chunks = []
    for line in filter(None, (x.strip() for x in grammar.splitlines())):
        body = re.sub(r"^\w+\s*:\s*", "", line)
        inner = re.sub(r"<([^<>]*)>", lambda m: "(?:<(?:" + m[1].replace(".", "[^<>]").replace("[^[^<>]", "[^.") + ")>)", re.sub(r"\s+", "", body[1:-1]))
        free = [True] * len(tags)
        for a, b in chunks:
            free[a:b] = [False] * (b - a)
        runs = [(a, b) for a, b in chunks] if body[0] == "}" else [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[f] for f in free))]
        new = [] if body[0] == "}" else list(chunks)
        for a, b in runs:
            text, at = "", {}
            for i in range(a, b):
                at[len(text)] = i
                text += f"<{tags[i]}>"
            at[len(text)] = b
            hits = [(at[m.start()], at[m.end()]) for m in re.finditer(inner, text) if m.end() > m.start()]
            if body[0] == "}":
                p = a
                for x, y in [*hits, (b, b)]:
                    if x > p:
                        new.append((p, x))
                    p = y
            else:
                new += hits
        chunks = sorted(new)
    return chunks


CHINKED = """words: {<.*>+}
}<VB.*|IN>+{
more: {<IN>}"""


@pytest.mark.parametrize("grammar", [*GRAMMARS.values(), CHINKED], ids=[*GRAMMARS, "chinked"])
def test_chunks(spark, grammar):
    rng = random.Random(3)
    common = ["NN", "NNS", "NNP", "JJ", "JJR", "IN", "VB", "VBD", "MD", "RB", "DT", "CD", ".", ",", "odd"]
    rows = [[rng.choice(common) for _ in range(rng.randint(0, 25))] for _ in range(400)] + [[], ["NN"] * 3000, ["VB", "NN"] * 800]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(-1, None)], "i int, tags array<string>")
    got = {r.i: [tuple(s) for s in r.spans] for r in df.select("i", chunking.chunk_spans(F.col("tags"), grammar).alias("spans")).collect()}
    assert got.pop(-1) == []
    assert got == {i: brute_chunks(r, grammar) for i, r in enumerate(rows)}


def test_joined_and_longest_first(spark):
    df = spark.createDataFrame([(["a", "B", "c", "d", "e"], ["NN", "JJ", "NN", "VB", "NN"])], "tokens array<string>, tags array<string>")
    spans = chunking.chunk_spans(F.col("tags"), "x: {<JJ>*<NN>}")
    r = df.select(spans.alias("s"), chunking.chunk_spans(F.col("tags"), "x: {<JJ>*<NN>}", joined=True).alias("j"), chunking.longest_first(spans).alias("l"), chunking.span_phrases(F.col("tokens"), spans).alias("p")).first()
    assert [tuple(x) for x in r.s] == [(0, 1), (1, 3), (4, 5)] and [tuple(x) for x in r.j] == [(0, 3), (4, 5)]
    assert [tuple(x) for x in r.l] == [(1, 3), (0, 1), (4, 5)] and r.p == ["a", "b c", "e"]
    with pytest.raises(ValueError, match="neither"):
        chunking.compiled("x: <NN>")


def test_tags(spark):
    text = "The quick dogs should not have eaten 12 large pizzas in Paris, don't you think?"
    r = spark.createDataFrame([(text,), (None,)], "t string").select(tagging.tokens(F.col("t")).alias("w")).select("w", tagging.penn_tags(F.col("w")).alias("tags")).collect()
    assert list(zip(r[0].w, r[0].tags)) == [
        ("The", "DT"), ("quick", "NN"), ("dogs", "NNS"), ("should", "MD"), ("not", "RB"), ("have", "VB"), ("eaten", "NN"), ("12", "CD"), ("large", "NN"), ("pizzas", "NNS"), ("in", "IN"), ("Paris", "NNPS"),
        (",", ","), ("don't", "VBP"), ("you", "PRP"), ("think", "VB"), ("?", ".")]
    assert r[1].tags == []


def test_all_grammars_on_every_turn(spark):
    rows = topic_queries.grammar_chunks(spark, SF).collect()
    want = set()
    for r in topic_queries._tagged(spark, SF).collect():
        for name, g in GRAMMARS.items():
            want |= {(r.conv_id, r.turn, name, a, b, " ".join(r.tokens[a:b]).lower()) for a, b in brute_chunks(r.tags, g)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def brute_ranks(nodes, arcs, alpha=0.85, rounds=1000):
    at, n = {x: i for i, x in enumerate(nodes)}, len(nodes)
    w = np.zeros((n, n))
    for a, b, x in arcs:
        w[at[a], at[b]] += x
        if a != b:
            w[at[b], at[a]] += x
    out = w.sum(1)
    r = np.full(n, 1 / n)
    for _ in range(rounds):
        r = (1 - alpha) / n + alpha * ((r / np.where(out > 0, out, 1)) * (out > 0) @ w + r[out <= 0].sum() / n)
    return dict(zip(nodes, r))


def test_ranks_of_many_graphs(spark):
    """Loops, repeated edges, nodes without edges, graphs of one node, a graph that holds most of the rows."""
    rng = random.Random(2)
    rows = [(g, rng.randrange(n), rng.randrange(n), rng.random()) for g, n, m in ((0, 60, 400), (1, 3, 4), (2, 1, 1), (3, 9, 5)) for _ in range(m)]
    alone = [(3, 100), (3, 101), (4, 0)]
    e = spark.createDataFrame(rows, "g int, src long, dst long, weight double")
    extra = spark.createDataFrame(alone, "g int, node long")
    for nodes in (None, extra):
        got = {(r.g, r.node): r["rank"] for r in ranking.pagerank_of_graphs(e, ["g"], nodes, tol=1e-7).collect()}
        want = {}
        for g in range(5):
            own = {x for h, a, b, _ in rows if h == g for x in (a, b)} | ({x for h, x in alone if h == g} if nodes is not None else set())
            want |= {(g, k): v for k, v in brute_ranks(sorted(own), [r[1:] for r in rows if r[0] == g]).items()} if own else {}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    fixed = {(r.g, r.node): r["rank"] for r in ranking.pagerank_of_graphs(e, ["g"], rounds=4).collect()}
    assert fixed[0, 5] == pytest.approx(brute_ranks(sorted({x for h, a, b, _ in rows if h == 0 for x in (a, b)}), [r[1:] for r in rows if r[0] == 0], rounds=4)[5])
    with pytest.raises(RuntimeError, match="still move"):
        ranking.pagerank_of_graphs(e, ["g"], tol=1e-30, most_rounds=6)
    assert ranking.pagerank_of_graphs(e.limit(0), ["g"]).count() == 0


def brute_summary(x, ratio):
    """Nearest unused sentences to centroids, which start evenly spread; assignment one row after the other."""
    k = max(1, int(len(x) * ratio))
    centre = [x[int(round(i))] for i in np.linspace(0, len(x) - 1, k)]
    for _ in range(20):
        of = [min(range(k), key=lambda c: (float(((v - centre[c]) ** 2).sum()), c)) for v in x]
        new = [np.mean([v for v, o in zip(x, of) if o == c], axis=0) if c in of else centre[c] for c in range(k)]
        if np.allclose(new, centre):
            break
        centre = new
    used = []
    for c in range(k):
        used.append(min((i for i in range(len(x)) if i not in used), key=lambda i: (float(((x[i] - centre[c]) ** 2).sum()), i)))
    return sorted(used)


@pytest.fixture(scope="module")
def groups(spark):
    return _sentences(spark, SF).select("meeting", "node", "text", "vec").toPandas().sort_values(["meeting", "node"])


def unit(rows):
    m = np.array([list(r) for r in rows], float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def test_topics(spark, groups):
    """The whole table: summary, chunks, pruned graph, ranks and the order by the summary's vector."""
    embed, got = detect.hashing_embedder(), {}
    for r in topic_queries.topic_extraction(spark, SF).collect():
        got.setdefault(r.grp, []).append((r["rank"], r.phrase, r.score))
    tagged = {r.text: (r.tokens, r.tags) for r in spark.createDataFrame(groups[["text"]].drop_duplicates()).select("text", tagging.tokens(F.col("text")).alias("tokens")).withColumn("tags", tagging.penn_tags(F.col("tokens"))).collect()}
    stop, want = set(T.STOP_WORDS), {}
    for grp, g in groups.groupby("meeting"):
        short = g.iloc[brute_summary(unit(g["vec"]), 0.3)]
        phrases = []
        for text in short["text"]:
            tokens, tags = tagged[text]
            runs = []
            for a, b in brute_chunks(tags, GRAMMARS["topic"]):
                if runs and runs[-1][1] == a:
                    runs[-1] = (runs[-1][0], b)
                else:
                    runs.append((a, b))
            for a, b in runs:
                p = " ".join(tokens[a:b]).lower()
                if p not in phrases and p not in stop and re.search(r"[^!-/:-@\[-`{-~ ]", p):
                    phrases.append(p)
        if not phrases:
            continue
        v = unit(embed(pd.Series([p + "." for p in phrases])))
        w = v @ v.T
        arcs = [(i, j, w[i, j]) for i in range(len(phrases)) for j in range(i, len(phrases)) if w[i, j] >= np.percentile(w[i], 75) - 1e-12]
        ranks = brute_ranks(range(len(phrases)), arcs)
        whole = unit(embed(pd.Series([" ".join(short["text"])])))[0]
        best = sorted(range(len(phrases)), key=lambda i: (-ranks[i], i))[:10]
        want[grp] = {phrases[i]: (ranks[i], float(v[i] @ whole)) for i in best}
    assert got.keys() == want.keys() and len(got) > 10
    exact = 0
    for grp, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, len(found) + 1)) and len(found) == min(5, len(want[grp]))
        assert all(a[2] >= b[2] for a, b in zip(found, found[1:]))
        # ranks that are equal but for rounding may leave a phrase out in one of the two
        exact += all(p in want[grp] and abs(want[grp][p][1] - s) < 1e-5 for _, p, s in found)
    assert exact >= 0.95 * len(got)


def test_topics_of_nothing(spark):
    none = spark.createDataFrame([], "grp long, pos int, text string, vec array<float>")
    assert topics.topics(none, "grp").count() == 0
    few = spark.createDataFrame([(1, 0, "", [0.0] * 64), (2, 0, "and of the", [0.0] * 64)], "grp long, pos int, text string, vec array<float>")
    assert topics.topics(few, "grp").count() == 0


def test_summaries(spark, groups):
    from parley.plans.pipeline_queries import extractive_summary

    got = {}
    for r in extractive_summary(spark, SF).collect():
        got.setdefault(r.meeting, []).append(r.pos)
    for grp, g in groups.groupby("meeting"):
        assert sorted(got[grp]) == [int(g["node"].iloc[i]) for i in brute_summary(unit(g["vec"]), 0.3)]


def test_quartiles_of_each_group(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, j, float(rng.random())) for g in range(2) for i in range(7) for j in range(i, 7)]
    e = spark.createDataFrame(rows, "g int, src int, dst int, weight double")
    got = {tuple(r)[:3] for r in edges.quartile_prune(e, ("g",)).collect()}
    for g in range(2):
        one = spark.createDataFrame([r[1:] for r in rows if r[0] == g], "src int, dst int, weight double")
        assert {x[1:] for x in got if x[0] == g} == {(r.src, r.dst) for r in edges.quartile_prune(one).collect()}


def replayed(rows):
    """Pruning while building, one node after the other, over a table of neighbours."""
    near, brought = {}, {}
    for a, b, w in rows:
        brought.setdefault(a, []).append((b, w))
    for a in sorted({x for r in rows for x in r[:2]}):
        near.setdefault(a, {})
        for b, w in brought.get(a, []):
            near[a][b] = w
            near.setdefault(b, {})[a] = w
        cut = np.percentile(sorted(near[a].values(), reverse=True), 75) if near[a] else 0
        for b in [b for b, w in near[a].items() if w < cut]:
            del near[a][b]
            near[b].pop(a, None)
    return {(a, b, w) for a in near for b, w in near[a].items() if a <= b}


def test_pruning_while_building(spark):
    rng = random.Random(8)
    graphs = {g: [(i, j, round(rng.random(), 2)) for i in range(n) for j in range(i + (not loops), n) if rng.random() < share] for g, (n, share, loops) in enumerate([(12, 1, True), (30, 1, True), (9, 1, False), (25, 0.4, True), (2, 1, True), (40, 0.2, False)])}
    e = spark.createDataFrame([(g, *r) for g, rows in graphs.items() for r in rows], "g int, src long, dst long, weight double").repartition(5)
    got = {tuple(r) for r in edges.incremental_quartile_prune(e, ["g"]).collect()}
    assert got == {(g, *r) for g, rows in graphs.items() for r in replayed(rows)}
    assert edges.incremental_quartile_prune(e.limit(0), ["g"]).count() == 0


def test_pruning_of_every_conversation(spark):
    from parley.functions import vectors as V

    pairs = V.cosine_pairs(_sentences(spark, SF), "node", "vec", ["meeting"]).toPandas()
    got = {(r.meeting, r.src, r.dst, r.weight) for r in topic_queries.incremental_q3_prune(spark, SF).collect()}
    assert got == {(m, *r) for m, p in pairs.groupby("meeting") for r in replayed(list(p[["src", "dst", "weight"]].itertuples(index=False, name=None)))}


def looped(spans, sizes, tolerance, start_only, once):
    """Every pair, over and over, until nothing moves; or once."""
    there, root, sizes = list(range(len(spans))), {}, list(sizes)

    def held(i, j):
        (a, b), (c, d) = spans[i], spans[j]
        return c - tolerance <= a <= d + tolerance and (start_only or c - tolerance <= b <= d + tolerance)

    again = True
    while again:
        again = False
        for i in list(there):
            for j in there:
                if i != j and i in there and held(i, j) and (once or sizes[i] > 1 or sizes[j] > 1):
                    root[i] = j
                    sizes[j] += sizes[i]
                    there.remove(i)
                    again = not once
                    break
            if again:
                break
    out = []
    for i in range(len(spans)):
        while i in root:
            i = root[i]
        out.append(i)
    return out


@pytest.mark.parametrize("once", [False, True])
@pytest.mark.parametrize("start_only", [False, True])
@pytest.mark.parametrize("tolerance", [0, 1])
def test_spans_in_others_like_all_pairs(once, start_only, tolerance):
    rng = random.Random(6)
    for _ in range(1500):
        n, wide, high = rng.randint(0, 14), rng.choice([1, 4, 20]), rng.choice([6, 30])
        spans = [(a, a + (rng.randrange(wide) if rng.random() < 0.7 else 0)) for a in (rng.randrange(high) for _ in range(n))]
        sizes = [1 if a == b else rng.randint(2, 4) for a, b in spans]
        assert intervals.into(spans, sizes, tolerance, start_only, once) == looped(spans, sizes, tolerance, start_only, once), (spans, sizes)


def test_many_spans():
    rng = random.Random(1)
    spans = [(a, a + rng.randrange(200)) for a in (rng.randrange(10**6) for _ in range(30_000))]
    to = intervals.into(spans, [2] * len(spans))
    left = sorted(spans[i] for i in set(to))
    assert all(a[1] < b[1] for a, b in zip(left, left[1:])) and all(spans[j][0] <= a and b <= spans[j][1] for (a, b), j in zip(spans, to))


def test_absorbed_topics_of_every_conversation(spark):
    import hashlib

    of, want = {}, {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        of.setdefault(r.conv_id, {}).setdefault(len(r.text) % 7, []).append(r)
    for c, topics_ in of.items():
        ids = sorted(topics_)
        spans = [(min(r.turn for r in topics_[i]), max(r.turn for r in topics_[i])) for i in ids]
        for i, j in zip(ids, looped(spans, [1] * len(ids), 0, True, True)):
            want.setdefault((c, ids[j]), []).append(topics_[i])
    got = {(r.conv_id, r.topic): (r.topics, r.turns, r.words) for r in topic_queries.absorbed_topics(spark, SF).collect()}
    words = lambda rows: hashlib.md5(" ".join(sorted({w for r in rows for w in r.text.split(" ")}, key=lambda w: w.encode())).encode()).hexdigest()
    assert got == {k: (len(v), sum(map(len, v)), words([r for x in v for r in x])) for k, v in want.items()}


def test_table_function(spark):
    """Like the DataFrame form for a key of any type; gaps, nulls, empty tables; arguments that don't fit are refused."""
    from parley.operators import keyphrases, table_functions

    table_functions.register(spark)
    rng = random.Random(3)
    rows = [(k, i, f"w{rng.randrange(9)}", rng.choice([True, True, False])) for k in range(40) for i in range(rng.randint(0, 30))]
    words = spark.createDataFrame([(float(k), *r) for k, *r in rows], "k double, pos int, word string, kw boolean").repartition(4)
    words.createOrReplaceTempView("test_words")
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM phrase_spans(TABLE(test_words), 'k')").collect())
    assert got == sorted(tuple(r) for r in keyphrases.phrase_runs(words, "k").collect()) and len(got) > 100
    spark.createDataFrame([("a", 0, "x", True), ("a", 2, "y", True), ("a", 3, "z", True), ("a", 4, "q", None), (None, 0, "n", True)], "k string, pos int, word string, kw boolean").createOrReplaceTempView("test_words")
    assert {tuple(r) for r in spark.sql("SELECT k, start, phrase, n FROM phrase_spans(TABLE(test_words), 'k')").collect()} == {("a", 0, "x", 1), ("a", 2, "y z", 2), (None, 0, "n", 1)}
    spark.sql("SELECT * FROM test_words WHERE pos > 9").createOrReplaceTempView("no_words")
    assert spark.sql("SELECT * FROM phrase_spans(TABLE(no_words), 'k')").count() == 0
    for bad, why in (("TABLE(test_words), 'other'", "lacks other"), ("TABLE(test_words), 5", "names the key"), ("'k', 'k'", "is a table")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM phrase_spans({bad})").collect()


def test_word_pieces_and_vectors(spark):
    df = spark.createDataFrame([(1, ["a", "abcdef", "abcdefg", "abcdefghi"])], "k int, t array<string>")
    rows = df.select("k", F.posexplode(relatedness.word_pieces(F.col("t"))).alias("pos", "p")).select("k", "pos", "p.word", "p.piece")
    assert [(r.word, r.piece) for r in rows.collect()] == [(0, "a"), (1, "abcdef"), (2, "abcd"), (2, "##efg"), (3, "abcd"), (3, "##efgh"), (3, "##i")]
    got = relatedness.word_vectors(rows.select("k", "pos", "piece", F.array(F.lit(1.0), F.col("pos").cast("double")).alias("vec")), ["k"]).collect()
    assert {(r.word, *r.vec) for r in got} == {(0, 1, 0), (1, 1, 1), (2, 2, 5), (3, 3, 15)}


def test_relatedness_of_all_turns(spark):
    """Pieces, phrases and pairs by plain loops, over every turn and the next."""
    embed, stop = detect.hashing_embedder(), set(T.STOP_WORDS)
    tagged = {(r.conv_id, r.turn): r for r in topic_queries._tagged(spark, SF).collect()}
    vec = {}

    def vectors_of(r):
        words = []
        for w in (t.lower() for t in r.tokens):
            pieces = [w] if len(w) <= 6 else [("##" if i else "") + w[i : i + 4] for i in range(0, len(w), 4)]
            for p in pieces:
                if p not in vec:
                    vec[p] = np.array(embed(pd.Series([p]))[0])
            words.append(sum(vec[p] for p in pieces))
        out = {}
        for name in relatedness.KINDS:
            runs = []
            for a, b in brute_chunks(r.tags, GRAMMARS[name]):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            for a, b in runs:
                w = [t.lower() for t in r.tokens]
                ok = [i for i in range(a, b) if w[i] not in stop and re.search(r"[^\W_]", w[i])]
                if ok:
                    a, b = ok[0], ok[-1] + 1
                    out.setdefault(" ".join(w[a:b]), (b - a, sum(words[a:b])))
        return out

    found = {k: vectors_of(r) for k, r in tagged.items()}
    got = {(r.conv_id, r.turn): r.score for r in topic_queries.sentence_relatedness(spark, SF).collect()}
    want = {}
    for (c, t), own in found.items():
        if (c, t + 1) not in found:
            continue
        sims = []
        for p, (n, v) in own.items():
            for q, (m, u) in found[c, t + 1].items():
                if (n == m == 1 and min(len(p), len(q)) >= 4) or (n > 1 and m > 1):
                    length = np.linalg.norm(v) * np.linalg.norm(u)
                    sims.append(float(v @ u) / length if length else 0.0)
        want[c, t] = float(np.mean(sims[:3])) if sims else 0.0
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-5) for k in want) and sum(x != 0 for x in got.values()) > 20
