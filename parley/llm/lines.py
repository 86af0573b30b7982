"""Line dedup over deletion neighbourhoods, in built-in functions only.

A line goes if an earlier line equals it or is one edit (a character replaced,
added or left out) away.  Two lines of equal length are one edit apart if they
are equal once the character at one place is left out of both; lines whose
lengths differ by one, if the longer equals the shorter once a character is left
out.  So each line emits its variants with one character left out as hashed
keys, equal keys meet, and the earliest line of a key is compared with the
others by edit distance.

Most lines have no such neighbour, and a screen finds them without variants: an
edit leaves the first or the second half of a line as it is, so a line whose
halves no other line of nearly its length has is out; what is left is screened
again by all but an eighth of it.  Only the eighth in which the edit must then be
is varied, a long one piece by piece, with the hashes of what stands around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import id_key, unused, written

#: Shorter lines go only if an earlier line equals them: one edit is too much of them.
MIN_CHARS = 20
#: Characters of the pieces that long lines are varied by.
PIECE = 64
#: Bits of the filter that keeps lines from being shuffled: 32 MB.
MOST_BITS = 1 << 28


def _lines(docs: DataFrame) -> DataFrame:
    """``(id, line_no, line)`` of all lines that aren't blank."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(id_key(F.col("doc_id")).alias("id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.trim("line") != "")


def _screen_keys(line: Column, n: Column) -> Column:
    """A line's first and second halves, as cut for itself and for a line shorter by one."""

    def half(m: Column, tag: Column) -> list[Column]:
        p = F.floor(m / 2).cast("int")
        return [F.xxhash64(F.lit("head"), tag, F.substring(line, F.lit(1), p)), F.xxhash64(F.lit("tail"), tag, F.substring(line, n - (m - p) + 1, m - p))]

    return F.array(*half(n, n), *half(n - 1, n - 1))


def _fine_keys(line: Column, n: Column, parts: int = 8) -> Column:
    """All of a line but one of its parts, as cut for itself and (``longer``) for a line shorter by one: (s, longer, start and length of the part).

    One edit leaves one of these as it is, and lies in the part left out.
    """

    def without(longer: bool, q: int) -> Column:
        m = n - 1 if longer else n
        a, b = F.floor(m * q / parts).cast("int"), F.floor(m * (q + 1) / parts).cast("int")
        s = F.xxhash64(F.lit(q), m, F.substring(line, F.lit(1), a), F.substring(line, n - (m - b) + 1, m - b))
        return F.struct(s.alias("s"), F.lit(longer).alias("longer"), (a + 1).alias("a"), (b - a + int(longer)).alias("n"))

    return F.array(*[without(longer, q) for longer in (False, True) for q in range(parts)])


def _shared(keys: DataFrame) -> DataFrame:
    """Those of ``keys(s, ...)``, rows of different lines, whose ``s`` more than one row has."""
    again = keys.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select(F.col("s").alias("_s"))
    return keys.join(again, F.col("s") == F.col("_s"), "left_semi")


def _pieces(part: Column, n: Column) -> Column:
    """The pieces of a part of a line, with the hashes of what stands before and after: of PIECE characters, and of one more."""

    def of(p: Column) -> Column:
        a = p * PIECE
        parts = [p.alias("p"), F.xxhash64(F.substring(part, F.lit(1), a)).alias("head"), F.substring(part, a + 1, F.lit(PIECE + 1)).alias("mid")]
        return F.struct(*parts, F.xxhash64(F.substring(part, a + PIECE + 1, n)).alias("tail"), F.xxhash64(F.substring(part, a + PIECE + 2, n)).alias("tail1"))

    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / PIECE), F.lit(0)).cast("int")), of)


def _variants(s: Column, longer: Column) -> Column:
    """(role, key, check) of a piece as it is and of its variants.

    Roles: 0, varied at a place, for lines of equal length; 1, varied, and 2, as
    it is, for lines whose lengths differ by one.
    """

    def key(role: int, same: str, at: Column, mid: Column, tail: Column) -> Column:
        by = (F.lit(same), s["p"], at, s["head"], mid, tail)
        return F.struct(F.lit(role).alias("role"), F.xxhash64(*by).alias("key"), F.hash(*by).alias("check"))

    def cut(i: Column, width: int) -> Column:
        return F.concat(F.substring(s["mid"], F.lit(1), i), F.substring(s["mid"], i + 2, F.lit(width) - i - 1))

    n = F.length(s["mid"])

    def places(most: int) -> Column:
        return F.slice(F.sequence(F.lit(0), F.lit(most)), F.lit(1), F.least(n, F.lit(most)))  # none of an empty piece

    same = F.transform(places(PIECE), lambda i: key(0, "s", i, cut(i, PIECE), s["tail"]))
    varied = F.transform(places(PIECE + 1), lambda i: key(1, "d", F.lit(-1), cut(i, PIECE + 1), s["tail1"]))
    whole = F.array(key(2, "d", F.lit(-1), F.substring(s["mid"], F.lit(1), F.lit(PIECE)), s["tail"]))
    return F.when(longer, varied).otherwise(F.concat(same, whole))


def _maybe_in(lines: DataFrame, h: Column, left: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``lines`` without most of those whose hash isn't in ``left(h)``: so few are left that their texts aren't all shuffled.

    The filter is an array of bits, 32 for each row of ``left`` and ``most_bits``
    at most; where that isn't enough to tell much, all lines go on to the join.
    """
    bits = 1 << 16
    n = left.count()
    while bits < 32 * n:
        bits *= 2
    if bits > most_bits:
        return lines

    def at(x: Column) -> Column:
        return F.pmod(x, F.lit(bits))

    def place(x: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at(x), F.lit(64)).cast("int"))

    words = left.select(F.shiftright(at(F.col("h")), 6).alias("id"), place(F.col("h")).alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    dense = lines.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    one = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("_bits"))
    one = written(one, "bits")  # one row of most_bits / 8 bytes at most
    kept = lines.join(F.broadcast(one), F.get("_bits", F.shiftright(at(h), 6).cast("int")).bitwiseAND(place(h)) != 0)
    return kept.select(*lines.columns)


def near_lines(docs: DataFrame, occurrences: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(h, h2)`` of the distinct lines that are one edit from an earlier line.

    ``occurrences``: distinct lines as ``(lid, h, h2, n, screen, id, line_no)``,
    lid a number of the line, the place being the first.
    """
    long_ = occurrences.where(F.col("n") >= min_chars)
    left = _shared(long_.select("lid", F.explode("screen").alias("s"))).select("lid").distinct()
    # the first places of the lines left, and then these lines' texts, numbered in the order of their places
    left = written(long_.join(left, "lid", "left_semi").select("h", "h2", "id", "line_no"), "screened")
    texts = _maybe_in(_lines(docs), F.xxhash64("line"), left).join(left, ["id", "line_no"]).where((F.xxhash64("line") == F.col("h")) & (F.hash("line") == F.col("h2"))).dropDuplicates(["h", "h2"])
    texts = texts.repartitionByRange("id", "line_no").sortWithinPartitions("id", "line_no").select("h", "h2", "line", F.monotonically_increasing_id().alias("no"))
    texts = written(texts, "texts")
    # few lines are left: a finer screen of these, again without loss; it tells in which part of a line the edit must be
    part = written(_shared(texts.select("no", F.explode(_fine_keys(F.col("line"), F.length("line"))).alias("f")).select("no", "f.*")), "parts")

    # few bytes, but much to do for each: dealt to as many tasks as shuffles have
    dealt = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    middle = part.join(texts.select("no", "line"), "no").select("no", "s", "longer", F.substring(F.col("line"), F.col("a"), F.col("n")).alias("part"))
    # a row for each piece, so that what stands around it is hashed once, not for each variant
    pieces = middle.repartition(dealt, "no", "s").select("no", "s", "longer", F.explode(_pieces(F.col("part"), F.length("part"))).alias("p"))
    varied = pieces.select("no", "s", F.explode(_variants(F.col("p"), F.col("longer"))).alias("v")).select("no", F.xxhash64("s", "v.key").alias("key"), "v.check", "v.role")
    # of a key, the earliest of either side: all lines varied at one place are one edit apart; a line left as it is
    # is one edit from each varied one.  A key has no more lines than there are characters
    of = Window.partitionBy("key", "check")
    low = [F.min(F.when(F.col("role") == r, F.col("no"))).over(of) for r in (0, 2, 1)]
    pair = varied.select("no", F.when(F.col("role") == 0, low[0]).when(F.col("role") == 1, low[1]).otherwise(low[2]).alias("low")).where("low < no").distinct()
    one, other = texts.select("no", "h", "h2", "line"), texts.select(F.col("no").alias("low"), F.col("line").alias("earlier"))
    checked = pair.join(one, "no").join(other, "low").where(F.levenshtein("line", "earlier", 1).between(0, 1))
    return checked.select("h", "h2").distinct()


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, n_lines, n_blank, n_equal, n_near, kept array<int>)`` for every row of ``docs``.

    Lines end at ``\\n``.  Blank lines are layout: they are counted and stay.  Any
    other line goes if an earlier one (by doc_id, null first, then line number)
    equals it, or, from ``min_chars`` characters on, is one edit away, whether or
    not that one stays.  ``kept`` numbers the lines that stay, blank ones left
    out.  Rows that repeat a doc_id are judged as one document.  A null text
    counts as empty, that is, as one blank line; texts and lines of any length
    count whole; other columns are ignored; an empty table gives an empty result.
    """
    n = F.length("line")
    seen = _lines(docs).select("id", "line_no", F.xxhash64("line").alias("h"), F.hash("line").alias("h2"), n.cast("int").alias("n"), F.when(n >= min_chars, _screen_keys(F.col("line"), n)).alias("screen"))
    seen = written(seen, "lines")
    least = F.struct("id", "line_no")
    firsts = seen.groupBy("h", "h2").agg(F.min(F.struct(least.alias("at"), "n", "screen")).alias("f"))
    firsts = written(firsts.select(F.monotonically_increasing_id().alias("lid"), "h", "h2", "f.at.id", "f.at.line_no", "f.n", "f.screen"), "firsts")
    near = written(near_lines(docs, firsts, min_chars), "near").withColumn("near", F.lit(True))
    marked = firsts.join(near, ["h", "h2"], "left").select("id", "line_no", F.col("near").isNotNull().alias("near"))
    own = marked.groupBy("id").agg(F.array_sort(F.collect_list(F.when(~F.col("near"), F.col("line_no")))).alias("kept"), F.sum(F.col("near").cast("long")).alias("n_near"))
    text = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    counts = docs.select("doc_id", id_key(F.col("doc_id")).alias("_id"), F.size(text).cast("long").alias("n_lines"), F.size(F.filter(text, lambda x: F.trim(x) == "")).cast("long").alias("n_blank"))
    joined = counts.join(own, F.col("_id") == F.col("id"), "left")
    kept = F.coalesce("kept", F.array().cast("array<int>"))
    n_near = F.coalesce("n_near", F.lit(0)).cast("long")
    return joined.select("doc_id", "n_lines", "n_blank", (F.col("n_lines") - F.col("n_blank") - n_near - F.size(kept)).cast("long").alias("n_equal"), n_near.alias("n_near"), kept.alias("kept"))


def without_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the text put together from its blank and kept lines, other columns as they are, whatever their names; a null text stays null.

    Ties, repeated rows, empty and long texts and empty tables are as in ``line_dedup``.
    """
    key, stays = unused(docs, "key"), unused(docs, "stays")
    kept = line_dedup(docs, min_chars).select(id_key(F.col("doc_id")).alias(key), F.col("kept").alias(stays)).dropDuplicates([key])
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    stay = F.filter(lines, lambda s: (F.trim(s["x"]) == "") | F.array_contains(F.col(stays), s["i"]))
    return docs.join(kept, id_key(F.col("doc_id")) == F.col(key)).withColumn("text", F.array_join(F.transform(stay, lambda s: s["x"]), "\n")).drop(key, stays)
