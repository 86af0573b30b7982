"""Shared helpers: shared-folder tables, text normalisation, null-safe keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, written  # noqa: F401

#: Bytes A-Z to a-z, the rest unchanged.
LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Stands for a null doc_id wherever ids are compared: it counts as the smallest.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID))


def utf8(text: Column) -> Column:
    """The text's bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
