"""The operators of this subpackage as registered queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"), width=4, budget=4)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import duplicates

    return duplicates(table(spark, sf_dir, "documents")).drop("row")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnow import contamination

    hits = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"), window=20).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secrets

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), "n_unread")


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    found = archived(table(spark, sf_dir, "pages"), least=0)
    return found.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).withColumn("kept", F.array_join("kept", ","))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"), window=50).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), longest=5, least=100, top=2000).withColumn("rank", F.col("rank").cast("long"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"), min_docs=30, terms=50)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import packed, pieces

    parts = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)
    return packed(parts.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), 2048)


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_mix_sources, op3_exact_dedup, op4_secret_scan, op5_toxicity, op6_line_dedup, op7_suffix_array_dedup, op8_warc_archive, op9_benchmark_decontamination, op10_substring_dedup, op11_phrase_collocations, op12_source_divergence, op13_best_fit_packing)}
