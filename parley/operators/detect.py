"""Detectors over sentences: questions, action items, entity spans, with pluggable models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as T

Embedder = Callable[[pd.Series], pd.Series]
Tagger = Callable[[pd.Series], pd.Series]
Classifier = Callable[[pd.Series], pd.Series]

#: Verbs that name something to be done, by the default classifier.
TO_DO = ("will", "should", "need", "must", "let's", "follow", "send", "schedule", "review", "update", "share", "prepare", "check")
#: Phrases that are never an action item.
OMITTED = ("can you hear",)
FIXED = ("follow up", "action item", "to do")
NEGATIONS = ("not", "n't", "never", "no", "just", "now")


def hashing_embedder(width: int = 64) -> Embedder:
    """A deterministic embedding: signed counts of hashed words, unit length.  Any function of a series of texts takes its place."""

    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        out = []
        for t in texts:
            v = np.zeros(width, np.float32)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % width] += 1 if h & 0x10000 else -1
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed


def embedded(df: DataFrame, text: str = "text", embedder: Embedder | None = None, name: str = "vec") -> DataFrame:
    f = embedder or hashing_embedder()

    def run(texts: pd.Series) -> pd.Series:
        return f(texts)

    return df.withColumn(name, pandas_udf(run, "array<float>")(F.col(text)))


def rule_tags(words: Column) -> Column:
    """A simple tagger as an expression: ``array<struct<tok, pos>>`` by endings, capitals and function words.  Real taggers plug in with the same type."""
    stop = F.array(*[F.lit(w) for w in T.STOP_WORDS])

    def tag(w: Column) -> Column:
        low = F.lower(w)
        return (
            F.when(~w.rlike("[A-Za-z0-9]"), "PUNC").when(w.rlike("^[0-9.,]+$"), "NUM").when(F.array_contains(stop, low), "O").when(w.rlike("^[A-Z]"), "PROPN")
            .when(low.rlike("(ing|ed|ize|ise)$"), "VERB").when(low.rlike("(ous|ful|ive|able|al|ic)$"), "ADJ").when(low.rlike("ly$"), "ADV").otherwise("NOUN")
        )

    return F.transform(words, lambda w: F.struct(w.alias("tok"), tag(w).alias("pos")))


def chunks(tags: Column, pattern: str = "(<ADJ>)*(<NOUN>|<PROPN>)+") -> Column:
    """Chunks of a grammar over tags, as the tags they match: the tags are one string, the grammar a regular expression."""
    line = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("<"), t["pos"], F.lit(">"))), "")
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(0))


def is_question(text: Column) -> Column:
    """Ends in ``?`` and has more than two words."""
    return F.trim(text).endswith("?") & (F.size(T.words(F.trim(text))) > 2)


def todo_probability(text: Column) -> Column:
    """The default classifier: a logistic function of the number of to-do words."""
    w = T.words(F.lower(text))
    n = F.size(F.filter(w, lambda x: F.array_contains(F.array(*[F.lit(t) for t in TO_DO]), x)))
    return 1 / (1 + F.exp(-(n * 2.0 - 1.5)))


def negated(words: Column, verb: Column) -> Column:
    """A negation within the three words before the verb."""
    at = F.array_position(words, verb).cast("int")
    before = F.slice(words, F.greatest(at - 3, F.lit(1)), F.greatest(F.least(at - 1, F.lit(3)), F.lit(0)))
    return (at > 0) & F.arrays_overlap(before, F.array(*[F.lit(n) for n in NEGATIONS]))


def action_items(sentences: DataFrame, text: str = "text", probability: Column | None = None) -> DataFrame:
    """Sentences that are action items, with subject and assignee flag added.

    Fixed phrases need a probability of 0.5, others 0.8 and no negation before
    the to-do word; omitted phrases never count.  The subject must have more than
    four words, or more than three if the last is longer than four letters.
    """
    low = F.lower(F.col(text))
    p = probability if probability is not None else todo_probability(F.col(text))
    any_of = lambda xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: F.contains(low, x))
    w = F.filter(F.split(low, "[^a-z']+"), lambda x: x != "")
    verb = F.get(F.filter(w, lambda x: F.array_contains(F.array(*[F.lit(t) for t in TO_DO]), x)), F.lit(0))
    gate = (any_of(FIXED) & (p >= 0.5)) | ((p >= 0.8) & ~F.coalesce(negated(w, verb), F.lit(False)))
    subject = T.strip_stop_words(w)
    n = F.size(subject)
    long_enough = (n > 4) | ((n > 3) & (F.length(F.get(subject, n - 1)) > 4))
    out = sentences.withColumn("probability", F.round(p, 6)).where(gate & ~any_of(OMITTED)).withColumn("_subject", subject)
    return out.where(long_enough).withColumn("subject", F.initcap(F.array_join("_subject", " "))).withColumn("assignee_flag", T.assignee_flag(w)).drop("_subject")


def entity_spans(tokens: DataFrame, key: list[str], least_o: float = 0.995, capitalise: bool = True) -> DataFrame:
    """``tokens(*key, word_index, tok, label, score)`` to spans of consecutive words with one kind of label: ``(*key, start, entity, label, score)``.

    Words labelled ``O`` stay only if their score is low.  A span's score is the mean.
    """
    kept = tokens.where((F.col("label") != "O") | (F.col("score") < least_o)).withColumn("kind", F.regexp_replace("label", "^[BI]-", ""))
    w = Window.partitionBy(*key).orderBy("word_index")
    new = F.coalesce(((F.col("word_index") - F.lag("word_index").over(w) > 1) | (F.lag("kind").over(w) != F.col("kind"))).cast("int"), F.lit(0))
    kept = kept.withColumn("_new", new).withColumn("span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.array_sort(F.collect_list(F.struct("word_index", "tok")))
    g = kept.groupBy(*key, "span", "kind").agg(F.min("word_index").alias("start"), words.alias("ws"), F.avg("score").alias("score"))
    entity = F.array_join(F.transform("ws", lambda x: x["tok"]), " ")
    return g.select(*key, "start", (F.initcap(entity) if capitalise else entity).alias("entity"), F.col("kind").alias("label"), F.round("score", 6).alias("score"))


def word_scores(subtokens: DataFrame, key: list[str]) -> DataFrame:
    """Word pieces to words: ``##`` pieces join the word before, its score is the least, its label the first."""
    w = Window.partitionBy(*key).orderBy("pos")
    starts = (~F.col("piece").startswith("##")).cast("int")
    rows = subtokens.withColumn("word_index", F.sum(starts).over(w) - 1)
    s = F.array_sort(F.collect_list(F.struct("pos", "piece", "label")))
    g = rows.groupBy(*key, "word_index").agg(s.alias("s"), F.min("score").alias("score"))
    return g.select(*key, "word_index", F.regexp_replace(F.array_join(F.transform("s", lambda x: x["piece"]), ""), "##", "").alias("tok"), F.col("s")[0]["label"].alias("label"), "score")


def packed_paragraphs(sentences: DataFrame, key: str, label: str = "label", least: int = 4) -> DataFrame:
    """``(key, paragraph, text)``: sentences of one label in a row, a run of fewer than ``least`` taking in the next."""
    kind = sentences.schema[key].dataType.simpleString()

    def run(of: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, held, last = [], [], None
        for _, row in pdf.sort_values("pos").iterrows():
            if held and row[label] != last and len(held) >= least:
                out.append(" ".join(held))
                held = []
            held.append(row["text"])
            last = row[label]
        if held:
            if len(held) < least and out:
                out[-1] += " " + " ".join(held)
            else:
                out.append(" ".join(held))
        return pd.DataFrame({key: of[0], "paragraph": range(len(out)), "text": out})

    return sentences.groupBy(key).applyInPandas(run, f"{key} {kind}, paragraph int, text string")


def keyphrase_score(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Mean cosine of all pairs of two lists of phrase vectors, none: 0; one row for each key of either."""
    from ..functions.vectors import cosine

    pair = a.select(*key, F.col("vec").alias("va")).join(b.select(*key, F.col("vec").alias("vb")), key).groupBy(*key).agg(F.avg(cosine(F.col("va"), F.col("vb"))).alias("s"))
    return a.select(*key).union(b.select(*key)).distinct().join(pair, key, "left").select(*key, F.round(F.coalesce("s", F.lit(0.0)), 6).alias("score"))
