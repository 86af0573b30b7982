"""How far the sources of a language differ in their words, and by which words.

Tasks count terms by source before anything is shuffled.  A language's kept terms
are then wide: one row a term, with an array that has a place for each source.
Higher-order functions turn such a row into what it adds to each pair of sources,
and the sums over terms are taken by map-side aggregation.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import LOWER_AZ, written

#: Terms that a task holds before it lets its counts go; bytes of a text that are split at once.
MOST_HELD, SLICE = 400_000, 1 << 22
#: Small shares are smoothed: this is added to each count; shares are whole numbers of a billionth.
PRIOR, SCALE = 5, 1_000_000_000
#: Parts of a language, so that the join with its sources has no hot key.
SALTS = 64
#: A-Z to a-z, other letters and all bytes over 127 stay, the rest are blanks.
_TERMS = bytes(b if chr(b).isalpha() and b < 128 or b > 127 else 32 for b in LOWER_AZ)


def _slices(raw: bytes) -> Iterator[bytes]:
    """Parts of a text of about SLICE bytes, cut at blanks."""
    a = 0
    while len(raw) - a > SLICE:
        b = raw.rfind(b" ", a, a + SLICE) + 1 or raw.find(b" ", a + SLICE) + 1 or len(raw)
        yield raw[a:b]
        a = b
    yield raw[a:]


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``, several rows for one key: occurrences of terms and the documents they are in.

    Null lang, source and text count as empty.  A term is a run of letters and of characters beyond ASCII, A-Z lower-cased.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def let_go() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                m = len(n)
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                cols = [pa.array([lang] * m, pa.string()), pa.array([source] * m, pa.string()), terms, pa.array(n.values(), pa.int64()), pa.array([in_docs[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3))):
                n, in_docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                size -= len(n)
                seen: set[bytes] = set()
                for part in _slices(text.as_py().encode().translate(_TERMS)):
                    words = part.split()
                    n.update(words)
                    seen.update(words)
                in_docs.update(seen)
                size += len(n)
                if size > MOST_HELD:
                    yield from let_go()
                    size = 0
        yield from let_go()

    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*named).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / total), exact whatever the counts."""
    whole = (n + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", whole, total.cast("decimal(20,0)"))


def divergence(docs: DataFrame, min_docs: int = 30, terms: int = 50) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each source against the others of its language, and its own terms.

    Part ``pair``: the summed differences of shares to each other source, all ranks;
    part ``term``: the ``terms`` terms whose share is most above the language's.  A language keeps terms of
    ``min_docs`` documents or more; with none kept, pairs have the value 0.  Groups without terms count; a
    language with one source has no pairs.  Ties go by item.  Repeated rows are documents of their own; an empty table gives no rows.
    """
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    # one shuffle: what is dealt by (lang, term) serves both aggregations
    counted = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    listed = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = written(listed.where(F.col("docs") >= min_docs).drop("docs"), "terms")

    sums = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kinds = kept.groupBy("lang").agg(F.count("*").alias("kinds"))
    n, smooth = F.coalesce("n", F.lit(0)), F.coalesce("kinds", F.lit(0)) * PRIOR
    sized = groups.join(sums, ["lang", "source"], "left").join(kinds, "lang", "left").select("lang", "source", n.alias("n"), smooth.alias("smooth"))
    total = F.col("n") + F.col("smooth")
    base = F.when(total > 0, _share(F.lit(0), total))  # the share of a term that a source doesn't have
    each = F.array_sort(F.collect_list(F.struct("source", total.alias("total"), base.alias("base"))))
    langs = written(sized.groupBy("lang").agg(each.alias("sources"), (F.sum("n") + F.max("smooth")).alias("total")), "languages")

    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of = F.map_from_entries("counts")
    place = lambda s: F.struct(s["source"].alias("source"), (of[s["source"]] > 0).alias("has"), F.coalesce(_share(of[s["source"]], s["total"]), s["base"]).alias("p"))
    whole = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    wide = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).select("lang", "term", F.transform("sources", place).alias("places"), _share(whole, F.col("total")).alias("q"))

    # what a term adds to the pairs (i, i + 1 + k) of sources
    first = wide.select("lang", F.col("places.p").alias("p"), F.posexplode("places.p").alias("i", "x"))
    added = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda y: F.abs(y - F.col("x")))
    apart = first.select("lang", "i", F.posexplode(added).alias("k", "d")).groupBy("lang", "i", "k").agg(F.sum("d").alias("value"))
    a = langs.select("lang", F.col("sources.source").alias("all"), F.posexplode("sources.source").alias("i", "a"))
    pairs = a.select("lang", "i", "a", F.posexplode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("k", "b"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pair = pairs.join(apart, ["lang", "i", "k"], "left").select("lang", F.inline(both), F.coalesce("value", F.lit(0)).alias("value"))

    above = F.filter("places", lambda s: s["has"] & (s["p"] > F.col("q")))
    term = wide.select("lang", F.inline(F.transform(above, lambda s: F.struct(s["source"].alias("source"), F.col("term").alias("item"), (s["p"] - F.col("q")).alias("value")))))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pair, "pair").unionByName(ranked(term, "term").where(F.col("rank") <= terms))
