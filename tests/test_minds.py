"""State kept between calls: versions, commits of several tables, and batches that are tried again."""

import random
from collections import Counter

import numpy as np
import pytest
from parley.operators import minds
from parley.sources import artifacts

SCHEMA = "entity string, vec array<double>"


def vector(rng, centre):
    v = np.eye(6)[centre] * 3 + rng.normal(0, 0.6, 6)
    return v.tolist()


@pytest.fixture(scope="module")
def mentions():
    """Known entities, and calls that mention new and known ones, some several times, some again later."""
    rng = np.random.default_rng(5)
    known = [(f"k{i}", vector(rng, i % 4), i % 4) for i in range(60)]
    calls = []
    for c in range(7):
        rows = [(f"n{c}-{i}", vector(rng, int(rng.integers(4)))) for i in range(6)] + [(f"k{i}", vector(rng, i % 4)) for i in range(c, 60, 9)]
        if c:
            rows += [(f"n{c - 1}-{i}", vector(rng, 0)) for i in range(3)]
        rows += [(f"odd{c}", vector(rng, 5)), rows[0], (f"n{c}-0", vector(rng, 1))]
        calls.append(rows)
    return known, calls


def brute(known, calls, k=10, least=2):
    """(communities, counters, vectors) after all calls, one entity after the other."""
    com = {e: c for e, _, c in known}
    vec = {e: np.array(v) for e, v, _ in known}
    total, recent = Counter(), {}
    for rows in calls:
        for e, v in rows:
            vec[e] = vec.get(e, 0) + np.array(v)
        unit = {e: v / np.linalg.norm(v) for e, v in vec.items()}
        placed = {}
        for e in sorted({e for e, _ in rows} - com.keys()):
            near = sorted(com, key=lambda o: (-round(float(unit[e] @ unit[o]), 6), o))[:k]
            votes = Counter(com[o] for o in near)
            most = max(votes.values())
            if most >= least:
                placed[e] = next(com[o] for o in near if votes[com[o]] == most)
        com |= placed
        for c, n in Counter(placed.values()).items():
            total[c] += n
            recent[c] = [*recent.get(c, []), n][-5:]
    return com, {c: (n, recent[c]) for c, n in total.items()}, vec


def found(state):
    com = {r.entity: r.community for r in state.table("communities").collect()}
    vec = {r.entity: np.array(r.vec) for r in state.table("entities").collect()}
    return com, {r.community: (r.total, list(r.recent)) for r in state.table("counters").collect()}, vec


def same(a, b):
    return a[:2] == b[:2] and a[2].keys() == b[2].keys() and all(np.allclose(a[2][e], b[2][e]) for e in b[2])


def seeded(spark, root, known):
    df = spark.createDataFrame(known, SCHEMA + ", community int")
    return minds.seed(spark, root, df, df)


def test_calls_add_up(spark, tmp_path, mentions):
    known, calls = mentions
    root = f"file://{tmp_path}/minds"
    seeded(spark, root, known)
    for i, rows in enumerate(calls):
        state = minds.enrich(spark, root, spark.createDataFrame(rows, SCHEMA), i)
    assert same(found(state), brute(known, calls)) and max(len(r) for _, r in found(state)[1].values()) == 5
    # a batch that is in the state already changes nothing, whatever it brings
    again = minds.enrich(spark, root, spark.createDataFrame(calls[0], SCHEMA), 3)
    assert again.number == state.number and same(found(artifacts.state(spark, root)), found(state))
    # earlier states stay as they were
    assert same(found(artifacts.state(spark, root, 3)), brute(known, calls[:2]))


@pytest.mark.parametrize("dies_at", [0, 1, 2, "manifest"])
def test_a_call_that_dies_between_tables(spark, tmp_path, mentions, monkeypatch, dies_at):
    """Readers see the state before; run again, the call counts once."""
    known, calls = mentions
    root = f"file://{tmp_path}/minds"
    seeded(spark, root, known)
    minds.enrich(spark, root, spark.createDataFrame(calls[0], SCHEMA), 0)
    write, renamed, n = type(spark.range(1)).write.fget, artifacts._renamed, [0]

    class Dies(Exception):
        pass

    class Writer:
        def __init__(self, df):
            self.df = df

        def parquet(self, path):
            if root in path:
                if n[0] == dies_at:
                    raise Dies
                n[0] += 1
            return write(self.df).parquet(path)

    def no_manifest(*args):
        raise Dies

    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "write", property(Writer))
        if dies_at == "manifest":
            m.setattr(artifacts, "_renamed", no_manifest)
        with pytest.raises(Dies):
            minds.enrich(spark, root, spark.createDataFrame(calls[1], SCHEMA), 1)
    assert artifacts._renamed is renamed and same(found(artifacts.state(spark, root)), brute(known, calls[:1]))
    assert same(found(minds.enrich(spark, root, spark.createDataFrame(calls[1], SCHEMA), 1)), brute(known, calls[:2]))


def test_a_stream_that_fails_and_starts_again(spark, tmp_path, mentions, monkeypatch):
    """The failure comes after the commit and before the stream has noted it: the batch runs twice and counts once."""
    known, calls = mentions
    root, source = f"file://{tmp_path}/minds", f"file://{tmp_path}/calls"
    seeded(spark, root, known)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        minds.enrich_stream(stream, root, f"file://{tmp_path}/checkpoint").awaitTermination()

    enrich = minds.enrich

    def fails(*args, **options):
        enrich(*args, **options)
        raise RuntimeError("lost")

    for i, rows in enumerate(calls[:3]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if i == 1:
            monkeypatch.setattr(minds, "enrich", fails)
            with pytest.raises(Exception, match="lost"):
                run()
            monkeypatch.setattr(minds, "enrich", enrich)
        run()
    assert same(found(artifacts.state(spark, root)), brute(known, calls[:3]))


def test_two_commits_on_one_state(spark, tmp_path):
    root, one = f"file://{tmp_path}/s", spark.createDataFrame([(1,)], "a int")
    empty = artifacts.state(spark, root)
    assert (empty.number, empty.batch, empty.paths) == (0, None, {})
    first = artifacts.commit(empty, root, {"a": one, "b": one}, 4)
    with pytest.raises(RuntimeError, match="another commit"):
        artifacts.commit(empty, root, {"a": one}, 5)
    second = artifacts.commit(first, root, {"a": one.union(one)})
    assert (second.number, second.batch) == (2, 4) and second.table("a").count() == 2 and second.paths["b"] == first.paths["b"]
    with pytest.raises(FileNotFoundError):
        artifacts.state(spark, root, 9)


def test_saves_at_once_get_versions_of_their_own(spark, tmp_path, monkeypatch):
    """The second to save sees the same last version, and still takes the next free number."""
    root, df = f"file://{tmp_path}/v", spark.createDataFrame([(1, "a")], "k int, v string")
    assert artifacts.save(df, root, "t") == 1
    monkeypatch.setattr(artifacts, "versions", lambda *a: [])
    assert artifacts.save(df.union(df), root, "t") == 2
    monkeypatch.undo()
    assert artifacts.versions(spark, root, "t") == [1, 2] and artifacts.load(spark, root, "t", 1).count() == 1
    rng = random.Random(1)
    new = [(rng.randrange(5), rng.choice("abc")) for _ in range(30)]
    out = {tuple(r) for r in artifacts.extended(spark, root, "t", spark.createDataFrame(new, "k int, v string"), ["k"]).collect()}
    assert out == {(k, max(v for x, v in new if x == k)) for k, _ in new}
