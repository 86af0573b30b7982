"""Exact dedup by content-defined chunk recipes, in built-in functions only.

A text is cut where its own characters say so, which makes equal passages equal
chunks.  Chunks are deduplicated: a chunk's identifier is its hash, and the
distinct chunks behind each hash are counted, so an identifier that stands for
two chunks is found and gets a number for each.  Documents are then compared by
their ordered identifier lists.  The text is moved once, as chunks that map-side
aggregation has already thinned out; a long document is never moved whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import id_key, lower_az, unused, written

#: A chunk ends before certain letters, or at 4,096 characters; it has 256 at least unless the text ends.  Latin: two
#: letters, after one of a class; Greek, Cyrillic, Hebrew, Arabic, Indic, kana, Han and Hangul: one of a few letters.
CUT = (
    r"(?s).{256,4095}?(?:[etaoinsr \n.,](?=[a-d][a-h])"
    r"|(?=[\u03b1\u03b5\u0430\u0432\u0440\u05d0\u05e8\u0627\u0631\u0915\u0930\u3042\u306e\u30a2\u30f3\u4e00\u4e0d\u6211\u662f\u7684\uac00-\uac1f\uc774]))|.{1,4096}"
)


def chunks(text: Column) -> Column:
    """The text's chunks in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def duplicates(docs: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(doc_id, row, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z only; null counts as
    empty.  Of equal texts the row with the largest doc_id stays, a null doc_id
    being the smallest; of rows that repeat this doc_id, one.  ``row`` numbers
    the rows.  An empty table gives an empty result; other columns are ignored,
    whatever their names; a text of any length is a list of chunks.  ``hashed``
    gives a chunk's identifier; chunks that share one are told apart.
    """
    text = lower_az(F.col("text"))
    # the text goes into the plan once, so that each use of it is not normalised anew
    recipes = docs.select("doc_id", text.alias("t")).select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.transform(chunks(F.col("t")), lambda c: hashed(c)).alias("recipe"))
    recipes = written(recipes.withColumn("row", F.monotonically_increasing_id()), "recipes")

    # a hash that stands for more than one chunk; there is hardly ever one
    distinct = docs.select(F.explode(chunks(text)).alias("chunk")).select(hashed(F.col("chunk")).alias("h"), "chunk").distinct()
    shared = written(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    if shared.limit(1).count():
        named = distinct.join(shared, "h").select("chunk", "h", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).alias("n"))
        named = written(named, "named")
        numbered = docs.select(F.col("text"), "doc_id").select(F.sha2(text, 256).alias("text_sha256"), F.posexplode(chunks(text)).alias("at", "chunk"))
        fixed = numbered.join(named, "chunk").select("text_sha256", "at", "n").distinct()
        suffix = fixed.groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("fix"))
        recipes = recipes.join(suffix, "text_sha256", "left")
    else:
        recipes = recipes.withColumn("fix", F.lit(None).cast("array<struct<at:int,n:int>>"))

    last = F.struct(id_key(F.col("doc_id")).alias("id"), F.col("row"))
    groups = recipes.groupBy("recipe", "fix").agg(F.max(last).alias("last"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups.select(F.col("recipe").alias("_r"), F.col("fix").alias("_f"), "last", "n"), "groups")
    joined = recipes.join(groups, (F.col("recipe") == F.col("_r")) & F.col("fix").eqNullSafe(F.col("_f")), "left")
    kind = docs.schema["doc_id"].dataType
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).when(F.col("last.id") != F.lit(-(2**63)), F.col("last.id").cast(kind))
    return joined.select("doc_id", "row", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.col("n").isNull() | (F.col("row") == F.col("last.row"))).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept, whatever their names; nulls, ties and empty tables as in ``duplicates``.

    Of rows that repeat a doc_id with equal texts one stays, any one.
    """
    key, sha = unused(docs, "key"), unused(docs, "sha")
    rows = written(duplicates(docs).select(id_key(F.col("doc_id")).alias(key), F.col("text_sha256").alias(sha), "kept"), "verdicts")
    by_row = rows.groupBy(key, sha).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    gone = by_row.where("not kept").select(key, sha)
    out = docs.join(gone, (id_key(F.col("doc_id")) == F.col(key)) & (F.sha2(lower_az(F.col("text")), 256) == F.col(sha)), "left_anti")
    if by_row.where("kept and n > 1").limit(1).count():
        out = out.withColumns({key: id_key(F.col("doc_id")), sha: F.sha2(lower_az(F.col("text")), 256)}).dropDuplicates([key, sha]).drop(key, sha)
    return out
