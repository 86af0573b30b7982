"""A corpus pipeline: toxic documents go, copies go, near copies go, benchmark passages go, sources are mixed.

Each stage reads what the one before kept, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import exact, mixing, simhash, toxicity, winnow
from parley.llm._common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go.

    Null and empty texts get a score like any other; rows with equal texts go or stay alike; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal when A-Z is lower-cased the row with the largest doc_id stays.

    Null counts as empty; of rows that share that doc_id one stays; texts of any length are compared whole.
    """
    return exact.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays.

    Texts without words are copies of each other; a null doc_id is the smallest; rows that share a doc_id stay or go together.
    """
    return simhash.one_of_each_group(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go.

    A shorter item is one window; null and empty texts stay; repeated rows go or stay alike; texts are read whole.
    """
    return winnow.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies of each.

    Null texts have no words and are taken like their source; rows that share a doc_id, or have none, go together.
    """
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("mix_sources", mix_sources),
]

#: A trained classifier and SimHash fingerprints are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
