"""How related two sentences are by their phrases: vectors of word pieces summed to words and to phrases, phrases compared by kind."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from . import chunking, detect

#: Chunk grammars whose phrases count, in order.
KINDS = ("noun_phrase", "noun_verb", "verb_noun")


def word_pieces(tokens: Column, most: int = 6, size: int = 4) -> Column:
    """``array<struct<word, piece>>``: tokens of more than ``most`` characters in pieces of ``size``, all but the first marked by ``##``. Real vocabularies plug in with the same type."""

    def cut(w: Column, i: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(w) - 1) / size).cast("int"), F.lit(0)))
        part = lambda k: F.concat(F.when(k > 0, F.lit("##")).otherwise(F.lit("")), F.substr(w, k * size + 1, F.lit(size)))
        many = F.transform(starts, lambda k: F.struct(i.alias("word"), part(k).alias("piece")))
        return F.when(F.length(w) > most, many).otherwise(F.array(F.struct(i.alias("word"), w.alias("piece"))))

    return F.flatten(F.transform(tokens, cut))


def word_vectors(pieces: DataFrame, key: list[str]) -> DataFrame:
    """``pieces(*key, pos, piece, vec)`` to ``(*key, word, vec)``: a piece marked by ``##`` belongs to the word before, vectors of a word's pieces add up."""
    w = Window.partitionBy(*key).orderBy("pos")
    rows = pieces.withColumn("word", F.sum((~F.col("piece").startswith("##")).cast("int")).over(w) - 1)
    return V.mean_vectors(rows, [*key, "word"], how="sum")


def phrases(texts: DataFrame, key: list[str], kinds=KINDS, stop_words=T.STOP_WORDS) -> DataFrame:
    """``texts(*key, tokens, tags)`` to ``(*key, at, start, end, phrase)``: chunks of each grammar in turn, adjacent ones joined, without stop-words at their ends.

    A phrase that comes again keeps its first place; one of stop-words or marks alone goes.
    """
    stop = F.array(*[F.lit(x) for x in stop_words])
    spans = F.concat(*[chunking.chunk_spans(F.col("tags"), chunking.GRAMMARS[k], joined=True) for k in kinds])
    rows = texts.select(*key, "tokens", F.posexplode(spans).alias("at", "s"))
    own = F.transform(F.slice("tokens", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")), F.lower)
    real = F.filter(F.transform("ws", lambda w, i: F.when(~F.array_contains(stop, w) & w.rlike(r"[\p{L}\p{N}]"), i)), lambda i: i.isNotNull())
    cut = rows.select(*key, "at", "s.start", own.alias("ws")).withColumn("real", real).where(F.size("real") > 0)
    a, b = F.array_min("real"), F.array_max("real")
    cut = cut.select(*key, F.struct("at", (F.col("start") + a).alias("start"), (F.col("start") + b + 1).alias("end")).alias("p"), F.array_join(F.slice("ws", a + 1, b - a + 1), " ").alias("phrase"))
    return cut.groupBy(*key, "phrase").agg(F.min("p").alias("p")).select(*key, "p.*", "phrase")


def phrase_vectors(found: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, at, phrase, n, vec)``: the sum of the vectors of each phrase's words; a word without a vector adds nothing."""
    each = found.select(*key, "at", "phrase", (F.col("end") - F.col("start")).alias("n"), F.explode(F.sequence("start", F.col("end") - 1)).alias("word"))
    return V.mean_vectors(each.join(words, [*key, "word"]), [*key, "at", "phrase", "n"], how="sum")


def relatedness(pairs: DataFrame, vectors: DataFrame, key: list[str], first: int = 3, least: int = 4) -> DataFrame:
    """``pairs`` of texts (each key column with ``_a`` and ``_b`` behind its name) with ``score``: the mean cosine of their first ``first`` phrase pairs.

    A phrase of one word meets only one of one word, both of ``least`` characters or
    more; longer ones meet longer ones.  Pairs come in the order of the first text's phrases, then the second's; none: 0.
    """
    names = [f"{k}_{x}" for x in "ab" for k in key]
    side = lambda x: vectors.select(*[F.col(k).alias(f"{k}_{x}") for k in key], *[F.col(c).alias(f"_{c}_{x}") for c in ("at", "phrase", "n", "vec")])
    met = pairs.select(*names).distinct().join(side("a"), [f"{k}_a" for k in key]).join(side("b"), [f"{k}_b" for k in key])
    short = (F.col("_n_a") == 1) & (F.col("_n_b") == 1) & (F.length("_phrase_a") >= least) & (F.length("_phrase_b") >= least)
    met = met.where(short | ((F.col("_n_a") > 1) & (F.col("_n_b") > 1)))
    order = F.row_number().over(Window.partitionBy(*names).orderBy("_at_a", "_at_b"))
    cos = F.coalesce(V.cosine(F.col("_vec_a"), F.col("_vec_b")), F.lit(0.0))
    score = met.withColumn("_r", order).where(F.col("_r") <= first).groupBy(*names).agg(F.avg(cos).alias("score"))
    return pairs.join(score, names, "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))


def phrase_lists(texts: DataFrame, key: list[str], kinds=KINDS, stop_words=T.STOP_WORDS) -> DataFrame:
    """``(*key, ps)``: the phrases of each row of ``texts(*key, tokens, tags)`` as an array, those of ``phrases`` in order.  Tokens hold no blanks; no row is shuffled."""
    stop = F.array(*[F.lit(x) for x in stop_words])
    spans = F.concat(*[chunking.chunk_spans(F.col("tags"), chunking.GRAMMARS[k], joined=True) for k in kinds])

    def trimmed(ws: Column) -> Column:
        real = F.filter(F.transform(ws, lambda w, i: F.when(~F.array_contains(stop, w) & w.rlike(r"[\p{L}\p{N}]"), i)), lambda i: i.isNotNull())
        return F.transform(F.array(real), lambda r: F.when(F.size(r) > 0, F.array_join(F.slice(ws, F.array_min(r) + 1, F.array_max(r) - F.array_min(r) + 1), " ")))[0]

    words = texts.select(*key, F.transform(spans, lambda s: F.transform(F.slice("tokens", s["start"] + 1, s["end"] - s["start"]), F.lower)).alias("ws"))
    return words.select(*key, F.array_distinct(F.filter(F.transform("ws", trimmed), lambda p: p.isNotNull())).alias("ps"))


def piece_cosines(pairs: DataFrame, key: list[str], embedder: detect.Embedder | None = None) -> DataFrame:
    """``pairs(*key, p, q)``, two lists of word pieces, to ``(*key, c)``: the cosine of the sums of their vectors, 0 where one is zero.  Each different piece of a batch is embedded once."""
    f = embedder or detect.hashing_embedder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            lists = [*b["p"], *b["q"]]
            codes, known = pd.factorize(np.concatenate([np.asarray(x, object) for x in lists]))
            m = np.array(f(pd.Series(known)).tolist(), np.float64)
            out = np.zeros((len(lists), m.shape[1]))
            np.add.at(out, np.repeat(np.arange(len(lists)), [len(x) for x in lists]), m[codes])
            v, w = out[: len(b)], out[len(b) :]
            length = np.linalg.norm(v, axis=1) * np.linalg.norm(w, axis=1)
            yield b[key].assign(c=np.where(length > 0, (v * w).sum(1) / np.where(length > 0, length, 1), 0.0))

    kinds = [f"{k} {pairs.schema[k].dataType.simpleString()}" for k in key]
    return pairs.select(*key, "p", "q").mapInPandas(run, ", ".join([*kinds, "c double"]))


def relatedness_of_phrases(pairs: DataFrame, found: DataFrame, key: list[str], first: int = 3, least: int = 4, embedder: detect.Embedder | None = None) -> DataFrame:
    """``relatedness`` of ``pairs`` by ``found``, the rows of ``phrase_lists``: the phrase pairs that count are chosen within a row, then only their vectors are made.

    A text's phrases are shuffled once for either side; no vector and no phrase pair is.
    """
    names = [f"{k}_{x}" for x in "ab" for k in key]
    alone = lambda p: ~F.contains(p, F.lit(" ")) & (F.length(p) >= least)
    many = lambda p: F.contains(p, F.lit(" "))
    side = lambda x, *columns: found.select(*[F.col(k).alias(f"{k}_{x}") for k in key], *columns)
    # of the second text only its first phrases of either kind can be among the first pairs
    second = side("b", F.slice(F.filter("ps", alone), 1, first).alias("_one"), F.slice(F.filter("ps", many), 1, first).alias("_many"))
    met = pairs.select(*names).distinct().join(side("a", F.col("ps").alias("_a")), [f"{k}_a" for k in key]).join(second, [f"{k}_b" for k in key])
    met = met.withColumn("_a", F.slice(F.filter("_a", lambda p: (alone(p) & (F.size("_one") > 0)) | (many(p) & (F.size("_many") > 0))), 1, first))
    each = lambda p: F.transform(F.when(many(p), F.col("_many")).otherwise(F.col("_one")), lambda q: F.struct(p.alias("p"), q.alias("q")))
    two = met.select(*names, F.inline(F.slice(F.flatten(F.transform("_a", each)), 1, first)))
    pieces = lambda p: F.transform(word_pieces(F.split(p, " ")), lambda x: x["piece"])
    score = piece_cosines(two.select(*names, pieces(F.col("p")).alias("p"), pieces(F.col("q")).alias("q")), names, embedder).groupBy(*names).agg(F.avg("c").alias("score"))
    return pairs.join(score, names, "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))
