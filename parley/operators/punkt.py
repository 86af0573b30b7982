"""Sentences by unsupervised boundary detection, after Kiss and Strunk (2006).

What ends with a period is counted over the whole corpus, by language: words that
nearly always have one and are short are abbreviations; words that follow sentence
ends more often than by chance start sentences; an abbreviation and a word that come together
more often than by chance aren't parted.  Learning is two aggregates, over words and over pairs at periods.
Splitting brings to each text only the places of those periods that end no sentence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Fixed values of the method: least scores of abbreviations, collocations and sentence starters.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
NUMBER = "##"
_OPEN, _CLOSE = "\"'“”‘’«»(\\[{", "\"'“”‘’«»)\\]},;:"


@dataclass
class Model:
    """What was learned, as tables: ``words(lang, type, lower, upper_inside)``, ``abbreviations(lang, type, score)``, ``starters(lang, type)``, ``collocations(lang, type, next)``."""

    words: DataFrame
    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame


def _segments(text: Column) -> Column:
    """The text in pieces of a word and the blanks before it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\s*\S+"), F.lit(0))


def _tokens(docs: DataFrame) -> DataFrame:
    """``(lang, t)``: the words of each text that has some, without the blanks before them."""
    return docs.select("lang", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0)).alias("t")).where(F.size("t") > 0)


def _core(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, r"^\s+", ""), f"^[{_OPEN}]+|[{_CLOSE}]+$", "")


def _dotted(core: Column) -> Column:
    return core.rlike(r"[^.]\.$")


def _type(core: Column) -> Column:
    bare = F.lower(F.when(_dotted(core), F.substr(core, F.lit(1), F.length(core) - 1)).otherwise(core))
    return F.when(bare.rlike("^[-+]?[0-9][0-9.,:/-]*$"), NUMBER).otherwise(bare)


def _case(core: Column) -> Column:
    return F.when(core.rlike(r"^\p{Lu}"), "upper").when(core.rlike(r"^\p{Ll}"), "lower")


def _together(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of two words that come a and b times among n, together ab times; 0 where that is no more than by chance."""
    log = lambda p: F.log(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12)))
    half = lambda k, m, p: k * log(p) + (m - k) * log(1 - p)
    a, b, ab, n = (x.cast("double") for x in (a, b, ab, n))
    p, p1, p2 = b / n, ab / a, (b - ab) / F.greatest(n - a, F.lit(1.0))
    ratio = -2 * (half(ab, a, p) + half(b - ab, n - a, p) - F.when(a == ab, 0.0).otherwise(half(ab, a, p1)) - F.when(b == ab, 0.0).otherwise(half(b - ab, n - a, p2)))
    return F.when(n * ab > a * b, ratio).otherwise(0.0)


def abbreviation_score(type_: Column, dotted: Column, n: Column, dots: Column, total: Column) -> Column:
    """How much a word looks like an abbreviation: nearly always before a period, short, with periods inside."""
    p, bare = dots / total, F.length(F.replace(type_, F.lit("."), F.lit("")))
    without = n - dotted
    ratio = -2 * (dotted * F.log(p) + without * F.log(1 - p) - dotted * F.log(F.lit(0.99)) - without * F.log(F.lit(0.01)))
    return ratio * F.exp(-bare) * (F.length(type_) - bare + 1) * F.pow(bare.cast("double"), -without.cast("double"))


def _words(docs: DataFrame) -> DataFrame:
    """``(lang, type, n, dotted, lower, upper_inside)``: equal words are counted as they stand, so each different one is looked at once."""
    marked = lambda t: F.contains(t, F.lit(".")) | F.contains(t, F.lit("?")) | F.contains(t, F.lit("!"))
    ended = lambda c: _dotted(c) | c.rlike("[?!]$")
    ends = F.transform("t", lambda t: F.when(marked(t), ended(_core(t))).otherwise(False))
    each = F.zip_with("t", F.concat(F.array(F.lit(True)), ends), lambda t, starts: F.struct(t.alias("token"), starts.alias("starts")))
    tokens = _tokens(docs).select("lang", F.inline(each)).where("token is not null")  # the last word's end has no word
    tokens = tokens.groupBy("lang", "token").agg(F.count("*").alias("n"), F.count_if(~F.col("starts")).alias("inside")).withColumn("core", _core(F.col("token")))
    kinds = tokens.select("lang", _type(F.col("core")).alias("type"), "n", "inside", _dotted(F.col("core")).alias("dot"), _case(F.col("core")).alias("case"))
    total = lambda n, where: F.sum(F.when(where, F.col(n)).otherwise(0))
    return kinds.groupBy("lang", "type").agg(F.sum("n").alias("n"), total("n", F.col("dot")).alias("dotted"), total("n", F.col("case") == "lower").alias("lower"), total("inside", F.col("case") == "upper").alias("upper_inside"))


def _totals(words: DataFrame) -> DataFrame:
    return words.groupBy(F.col("lang").alias("l0")).agg(F.sum("n").alias("total"), F.sum("dotted").alias("dots"))


def _sized(df: DataFrame, words: DataFrame) -> DataFrame:
    """With the sums over all words of the language."""
    return df.join(_totals(words), F.equal_null("lang", "l0")).drop("l0")


def _abbreviations(words: DataFrame) -> DataFrame:
    score = abbreviation_score(F.col("type"), F.col("dotted"), F.col("n"), F.col("dots"), F.col("total"))
    scored = _sized(words.where((F.col("dotted") > 0) & F.col("type").rlike(r"\p{L}")), words).where("dots < total").select("lang", "type", score.alias("score"))
    return scored.where(F.col("score") >= ABBREVIATION)


def abbreviations(docs: DataFrame) -> DataFrame:
    """``(lang, type, score)``: the abbreviations of ``docs(lang, text)`` alone, as ``learn`` finds them, from one pass over the texts."""
    return _abbreviations(written(_words(docs), "words"))


def learn(docs: DataFrame) -> Model:
    """A model of ``docs(lang, text)``; each language (null is one) is learned by itself.  All texts count, each row once."""
    words = written(_words(docs), "words")
    sized = lambda df: _sized(df, words)
    abbreviations = written(_abbreviations(words), "abbreviations")

    two = F.zip_with("t", F.slice("t", F.lit(2), F.size("t")), lambda t, after: F.struct(t.alias("token"), after.alias("after")))
    at = F.filter(two, lambda x: F.contains(x["token"], F.lit(".")) & x["after"].isNotNull())
    pairs = _tokens(docs).select("lang", F.inline(at)).groupBy("lang", "token", "after").agg(F.count("*").alias("n")).withColumn("core", _core(F.col("token"))).where(_dotted(F.col("core")))
    pairs = pairs.select("lang", _type(F.col("core")).alias("type"), _type(_core(F.col("after"))).alias("next"), "n").groupBy("lang", "type", "next").agg(F.sum("n").alias("ab"))
    known = abbreviations.select(F.col("lang").alias("l2"), F.col("type").alias("t2"), F.lit(True).alias("abbr"))
    pairs = written(pairs.join(known, F.equal_null("lang", "l2") & (F.col("type") == F.col("t2")), "left").select("lang", "type", "next", "ab", (F.coalesce("abbr", F.lit(False)) | (F.col("type") == NUMBER) | F.col("type").rlike(r"^\p{L}$")).alias("open")), "pairs")

    of = lambda name: words.select(F.col("lang").alias("l2"), F.col("type").alias("t2"), F.col("n").alias(name))
    sure = pairs.where("not open").groupBy("lang", F.col("next").alias("type")).agg(F.sum("ab").alias("ab")).where(F.col("type").rlike(r"\p{L}"))
    ends = pairs.where("not open").groupBy(F.col("lang").alias("l3")).agg(F.sum("ab").alias("ends"))
    starts = sized(sure.join(of("n"), F.equal_null("lang", "l2") & (F.col("type") == F.col("t2"))).join(ends, F.equal_null("lang", "l3")))
    starters = written(starts.where(_together(F.col("ends"), F.col("n"), F.col("ab"), F.col("total")) >= STARTER).select("lang", "type"), "starters")

    held = pairs.where(F.col("open") & F.col("next").rlike(r"\p{L}")).join(of("a"), F.equal_null("lang", "l2") & (F.col("type") == F.col("t2"))).drop("l2", "t2")
    held = sized(held.join(of("b"), F.equal_null("lang", "l2") & (F.col("next") == F.col("t2"))).drop("l2", "t2"))
    held = held.where(_together(F.col("a"), F.col("b"), F.col("ab"), F.col("total")) >= COLLOCATION).select("lang", "type", "next")
    first = starters.select(F.col("lang").alias("l2"), F.col("type").alias("t2"))
    collocations = written(held.join(first, F.equal_null("lang", "l2") & (F.col("next") == F.col("t2")), "left_anti"), "collocations")
    return Model(words.select("lang", "type", "lower", "upper_inside"), abbreviations, starters, collocations)


def open_periods(docs: DataFrame, key: str, model: Model) -> DataFrame:
    """``(key, at)``: the words (from 0) of each text whose period ends no sentence."""
    s = F.transform(_segments(F.col("text")), _core)
    at = F.transform("c", lambda c, i: F.struct(i.alias("at"), _dotted(c).alias("dot"), _type(c).alias("type"), _type(F.get("c", i + 1)).alias("next"), _case(F.get("c", i + 1)).alias("case"), F.get("c", i + 1).rlike(r"[\p{L}\p{N}]").alias("real")))
    rows = docs.select(key, "lang", s.alias("c")).select(key, "lang", F.inline(F.filter(at, lambda x: x["dot"] & x["next"].isNotNull())))
    rows = rows.withColumn("initial", F.col("type").rlike(r"^\p{L}$"))

    def marked(df: DataFrame, table: DataFrame, name: str, **on: str) -> DataFrame:
        """Left join on language and the columns named; ``name``: whether the table has it."""
        t = table.select(*[F.col(c).alias("_" + c) for c in table.columns], F.lit(True).alias(name))
        same = F.equal_null("lang", "_lang")
        for c, other in on.items():
            same = same & (F.col(other) == F.col("_" + c))
        return df.join(t, same, "left").drop("_lang", *("_" + c for c in on)).withColumn(name, F.coalesce(name, F.lit(False)))

    rows = marked(rows, model.abbreviations.select("lang", "type"), "abbr", type="type").where(F.col("abbr") | F.col("initial") | (F.col("type") == NUMBER))
    rows = marked(rows, model.collocations, "together", type="type", next="next")
    rows = marked(rows, model.starters, "starts", type="next")
    rows = marked(rows, model.words, "seen", type="next")
    upper = F.coalesce(F.col("case") == "upper", F.lit(False))
    # a capital on a word that has none inside sentences tells a start; a small letter tells none
    start = upper & (F.col("_lower") > 0) & (F.col("_upper_inside") == 0)
    small = F.coalesce(F.col("case") == "lower", F.lit(False)) | ~F.col("real")
    ends = F.when(F.col("together"), False).when(F.col("initial"), start).when(F.col("type") == NUMBER, ~small).otherwise(start | (upper & F.col("starts")))
    return rows.where(~F.coalesce(ends, F.lit(False))).select(key, "at")


def sentences(docs: DataFrame, key: str, model: Model | None = None) -> DataFrame:
    """``(key, pos, text)``: the sentences of ``docs(key, lang, text)``, in order from 0, without blanks at their ends.

    ``key`` is one of a kind.  Without a model one is learned from the texts
    themselves.  A sentence ends at ``?``, ``!`` or a period, with what closes
    behind it; empty and null texts have none.
    """
    model = model or learn(docs)
    none = open_periods(docs, key, model).groupBy(F.col(key).alias("_key")).agg(F.collect_list("at").alias("open"))
    rows = docs.select(key, _segments(F.col("text")).alias("s")).join(none, F.col(key) == F.col("_key"), "left")
    n = F.size("s")
    ended = lambda c: _dotted(c) | c.rlike("[?!]$")
    ends = F.filter(F.transform("s", lambda t, i: F.when(ended(_core(t)), i + 1)), lambda i: i.isNotNull())
    ends = F.array_except(ends, F.transform(F.coalesce("open", F.array().cast("array<int>")), lambda i: i + 1))
    ends = F.when(n > 0, F.array_sort(F.array_union(ends, F.array(n))))
    cut = rows.select(key, "s", ends.alias("ends"))
    start = lambda k: F.coalesce(F.get("ends", k - 1), F.lit(0))
    parts = F.transform("ends", lambda e, k: F.regexp_replace(F.array_join(F.slice("s", start(k) + 1, e - start(k)), ""), r"^\s+", ""))
    return cut.select(key, F.posexplode(parts).alias("pos", "text"))
