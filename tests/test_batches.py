"""Small groups by the batch, against grouping at the driver."""

import numpy as np
import pytest
from parley.operators import communities as C
from parley.operators import grouping_benchmark
from parley.operators.batches import per_group


@pytest.mark.parametrize("most", [3, 10000])
def test_groups_over_batches(spark, most):
    """A group may span batches; null keys are a group; groups that give nothing have no rows."""
    rows = [(None if i % 5 == 0 else i % 5, f"k{i % 2}", i, float(i)) for i in range(97)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    try:
        df = spark.createDataFrame(rows, "a int, b string, i int, x double")

        def run(key, own):
            assert (np.diff(own["i"]) > 0).all()
            return ([], []) if key[0] == 3 else ([own["x"].sum()], [len(own["i"])])

        got = {(r.a, r.b): (r.s, r.n) for r in per_group(df, ["a", "b"], run, "s double, n long", ["i"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for a, b, _, x in rows:
        if a != 3:
            s, n = want.get((a, b), (0.0, 0))
            want[a, b] = s + x, n + 1
    assert got == want
    assert per_group(df.where("false"), ["a", "b"], run, "s double, n long", ["i"]).count() == 0


def test_benchmark_exchanges_by_batch(spark):
    """no exchange with Python for each graph of a meeting and builder."""
    rng = np.random.default_rng(0)
    rows = [(m, 10 * m + i, i // 2, rng.normal(size=4).tolist(), i % 2) for m in range(3) for i in range(6)]
    df = spark.createDataFrame(rows, "meeting int, node int, seg_order int, vec array<double>, tag int")
    plan = grouping_benchmark.communities(grouping_benchmark.graphs(df, builders=("vanilla", "ns")))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    scores = grouping_benchmark.benchmark(df, builders=("vanilla", "ns"))
    assert "FlatMapGroupsInPandas" not in scores._jdf.queryExecution().toString()
    assert scores.count() == 6


def test_louvain_reads_a_graph_once():
    """what local moves read of a graph is made once, not for each seed and resolution."""
    g = C.Graph({"src": np.array([0, 0, 1, 2, 3]), "dst": np.array([1, 2, 2, 3, 4]), "weight": np.array([1.0, 1, 1, 0.1, 1])})
    first = C.repeated_louvain(g)
    level = g.level
    assert C.repeated_louvain(g, resolution=0.9).tolist() and g.level is level
    assert first.tolist() == [0, 0, 0, 1, 1]
