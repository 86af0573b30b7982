"""Rows and columns that no one expects: by value, for every operator that returns rows of documents, and for every stage."""

import pytest

from parley.llm import exact, lines, mixing, simhash, toxicity, winnow

NAMES = ["_id", "_sha", "_s", "_plan", "_kept", "toxic", "id", "hash", "key", "sha", "name", "plan", "fp", "root", "node", "stays", "h", "n", "row"]
LONG = " ".join(f"long{i % 5000}x{i // 7}" for i in range(60_000))


@pytest.fixture(scope="module")
def clashing(spark):
    """(doc_id, text, source) with nulls, ties, repeats, empty and very long texts, beside columns that operators might use."""
    near = " ".join(f"v{i}" for i in range(100))
    rows = [(None, "alone among the nulls", "a"), (1, "B c d", "a"), (1, "B c d", "a"), (2, "b C d", "b"), (3, None, None), (4, "", "a"), (5, LONG, "b"), (6, near, "a"), (7, near + " more", "a"), (8, LONG + " end", "b"), (9, " \n\t", "a")]
    more = ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(d, t, None, s, *["x"] * len(NAMES)) for d, t, s in rows], f"doc_id long, text string, lang string, source string, {more}").repartition(3).cache()


def ids(df):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in df.select("doc_id").collect())


def of(*x):
    return sorted((i is not None, i or 0) for i in x)


def test_exact(clashing):
    out = exact.deduplicated(clashing)
    assert out.columns == clashing.columns and ids(out) == of(None, 2, 4, 5, 6, 7, 8, 9)
    assert exact.deduplicated(clashing.limit(0)).count() == 0


def test_exact_with_shared_identifiers(spark, clashing):
    """Every identifier stands for many chunks: they are told apart."""
    from pyspark.sql import functions as F

    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.duplicates(clashing, lambda c: F.length(c).cast("long") % 2).collect()}
    assert rows == {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.duplicates(clashing).collect()}


@pytest.mark.parametrize("script", ["абвгдежзийклмнопрстуфхцчшщъыьэюя ", "的一是不了人我在有他这为之大来以个中上们，", "αβγδεζηθικλμνξοπρστυφχψω "])
def test_chunks_of_other_scripts_survive_a_shift(spark, script):
    import random

    rng = random.Random(1)
    text = "".join(rng.choice(script) for _ in range(40_000))
    from pyspark.sql import functions as F

    a, b = (set(r[0]) for r in spark.createDataFrame([(text,), ("x" + text,)], "t string").select(exact.chunks(F.col("t"))).collect())
    assert len(a & b) >= 0.8 * len(a) and len(a) > 10


def test_near_copies(clashing):
    out = simhash.one_of_each_group(clashing)
    assert out.columns == clashing.columns
    # 3, 4 and 9 have no words; a null id is the smallest
    assert ids(out) == of(None, 1, 1, 3, 5, 6) and simhash.one_of_each_group(clashing.limit(0)).count() == 0


def test_mixing(clashing):
    out = mixing.mixed(clashing)
    assert out.columns == [*clashing.columns, "copies"] and {r.copies for r in out.collect()} <= {1, 2}
    sizes = {r.doc_id: (r.size, r.source_size) for r in mixing.mix(clashing).collect()}
    assert sizes[3] == (0, 0) and sizes[9][0] == 0 and sizes[5][0] == 60_000 and mixing.mixed(clashing.limit(0)).count() == 0


def test_lines(clashing):
    out = {r.doc_id: r.text for r in lines.without_lines(clashing).where("doc_id > 1").collect()}
    assert lines.without_lines(clashing).columns == clashing.columns
    assert out[3] is None and out[4] == "" and out[5] == LONG and out[9] == " \n\t" and out[7] == out[6] + " more"


def test_toxicity(spark, clashing):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(40)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    out = toxicity.scored(clashing, labels)
    assert out.columns == [*clashing.columns, "held_out", "score", "predicted"] and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.collect())
    assert toxicity.without_toxic(clashing, labels).columns == clashing.columns and toxicity.without_toxic(clashing.limit(0), labels).count() == 0


def test_decontamination(spark, clashing):
    items = spark.createDataFrame([(1, "b c", "x"), (None, "v50 v51 v52", "x"), (2, None, "x"), (3, "", "x")], "item_id long, text string, doc_id string")
    out = winnow.uncontaminated(clashing, items)
    assert out.columns == clashing.columns and ids(out) == of(None, 3, 4, 5, 8, 9)
    hits = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in winnow.contamination(clashing, items).collect()}
    assert hits[6] == (100, 3, []) and hits[2] == (3, 2, [1]) and hits[3] == (0, 0, [])
    assert winnow.uncontaminated(clashing.limit(0), items).count() == 0


def test_pipeline_on_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
