"""Phrases as spans of token places: merged, extended by tags, trimmed and judged; scores of tokens and sentence pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_spans(spans: DataFrame, text: list[str], start: str = "a", end: str = "b") -> DataFrame:
    """``(*text, a, b, n)``: spans inside another are dropped, and those that touch or overlap become one; ``n`` counts what went into it.

    ``end`` is inclusive.  One shuffle by text; repeated spans count once.
    """
    rows = spans.select(*text, F.col(start).alias("a"), F.col(end).alias("b")).distinct()
    before = Window.partitionBy(*text).orderBy("a", F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_most", F.max("b").over(before)).where("_most is null or b > _most")
    own = Window.partitionBy(*text).orderBy("a")
    rows = rows.withColumn("_new", F.coalesce((F.col("a") > F.lag("b").over(own) + 1).cast("int"), F.lit(0))).withColumn("_of", F.sum("_new").over(own))
    return rows.groupBy(*text, "_of").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n")).drop("_of")


def extend_spans(spans: DataFrame, tokens: DataFrame, text: list[str], tags: list[str]) -> DataFrame:
    """``(*text, a, b)``: each span of ``spans(*text, a, b)`` grown to both sides over tokens whose tag is one of ``tags``.

    ``tokens(*text, i, tag)``; runs of such tokens are found once and joined to
    what stands before and after a span.
    """
    w = Window.partitionBy(*text).orderBy("i")
    runs = tokens.where(F.col("tag").isin(tags)).withColumn("_of", F.col("i") - F.row_number().over(w))
    runs = runs.withColumn("lo", F.min("i").over(Window.partitionBy(*text, "_of"))).withColumn("hi", F.max("i").over(Window.partitionBy(*text, "_of")))
    left = runs.select(*text, (F.col("i") + 1).alias("a"), "lo")
    right = runs.select(*text, (F.col("i") - 1).alias("b"), "hi")
    grown = spans.join(left, [*text, "a"], "left").join(right, [*text, "b"], "left")
    return grown.select(*text, F.coalesce("lo", "a").alias("a"), F.coalesce("hi", "b").alias("b"))


def trim_trailing(words: Column, stop_words) -> Column:
    """Words up to the last one that is no stop-word; none if all are."""
    stop = F.array(*[F.lit(x) for x in stop_words])
    places = F.filter(F.transform(words, lambda w, i: F.when(~F.array_contains(stop, w), i + 1)), lambda i: i.isNotNull())
    return F.slice(words, F.lit(1), F.coalesce(F.try_element_at(places, F.lit(-1)), F.lit(0)))


def real_entity(words: Column, label: Column, tag: Column, nouns=("NN", "NNS", "NNP", "NNPS", "FW")) -> Column:
    """Whether an entity stays: one of no words doesn't; one word without a label must be a noun or foreign (``tag``: its tag)."""
    return (F.size(words) > 1) | ((F.size(words) == 1) & ((label != "O") | tag.isin(*nouns)))


def worth_keeping(phrase: Column, stop_words) -> Column:
    """No stop-word, and not of punctuation alone."""
    return ~phrase.isin(*stop_words) & phrase.rlike(r"[^!-/:-@\[-`{-~]")


def token_scores(tokens: DataFrame, token: str, score: str) -> DataFrame:
    """``(token, score)``: the largest score of each token, lower-cased."""
    return tokens.groupBy(F.lower(token).alias("token")).agg(F.max(score).alias("score"))


def blended(cosine: Column, follows: Column, n: Column, m: Column, weight: float = 0.7) -> Column:
    """One score of a sentence pair from its cosine and the probability that one follows the other, which is scaled by ``weight``.

    Where one is more than twice as long as the other the second counts 0.6, else both count the same.
    """
    scaled = follows * weight
    return F.when(F.greatest(n, m) > 2 * F.least(n, m), 0.4 * cosine + 0.6 * scaled).otherwise((cosine + scaled) / 2)


def eligible_entities(entities: DataFrame, width: int, least: int = 2, banned=("PER", "LOC")) -> DataFrame:
    """``entities(entity, label, n, vec)`` that are in ``least`` sentences or more, of another label than ``banned``, with a whole vector of ``width`` numbers."""
    whole = (F.size("vec") == width) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    return entities.where((F.col("n") >= least) & ~F.col("label").isin(*banned) & whole)


def rank_overlaps(groups: DataFrame, meeting: list[str], group: str, rank: str) -> DataFrame:
    """``(*meeting, x, y, shared)`` for the pairs x < y of a meeting's groups: how many ranks both have; 0 makes the complement, an edge of the colour graph."""
    rows = groups.select(*meeting, F.col(group).alias("x"), F.col(rank).alias("r")).distinct()
    names = rows.groupBy(*meeting, "x").agg(F.collect_set("r").alias("s"))
    other = names.select(*meeting, F.col("x").alias("y"), F.col("s").alias("t"))
    return names.join(other, meeting).where("x < y").select(*meeting, "x", "y", F.size(F.array_intersect("s", "t")).alias("shared"))
