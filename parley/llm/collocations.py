"""Phrases whose words come together more often than their parts would by chance.

Texts are kept as shards: word numbers of some millions of words of one language.
Each shard is a count trie of its own, as deep as phrases are long, written in
depth-first order and cut by ranges of the hash of a node's path.  All shards'
runs of one range are merged, and nodes counted often enough remain.  That goes
in two rounds.  The first counts words and pairs, and tells every shard by a bit
a node which of its pairs remain; the second counts longer phrases, and only those
made of such pairs: no phrase is more frequent than the pairs in it.

A walk over the sorted nodes that remain gives the counts of a phrase's left
parts; right parts are suffix links, followed by a join.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import LOWER_AZ, written

#: Words of one shard; bytes of a text that are split at once; words whose nodes make up one range.
SHARD, SLICE, RANGE = 2_000_000, 1 << 22, 1_000_000
#: Ranges at most, however large the input.
MOST_RANGES = 1 << 20
#: Marks a word that was counted in the part of its text before, and is here for the phrases that it begins.
OLD = np.uint32(1 << 31)
_TO = bytearray(LOWER_AZ)
for _c in b".,;:!?\n\x0b\x0c\r":
    _TO[_c] = 10
_TO[9] = 32
_TO = bytes(_TO)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _parts(text: str, context: int) -> Iterator[tuple[list[bytes], int]]:
    """Words and line ends (also for other ends of a piece) of a text, a part at a time; how many of them were there before."""
    raw, a, before = text.encode().translate(_TO), 0, []
    while a < len(raw):
        b = len(raw)
        if b - a > SLICE:
            b = raw.rfind(b"\n", a, a + SLICE) + 1 or raw.rfind(b" ", a, a + SLICE) + 1
            if not b:
                m = re.compile(rb"[ \n]").search(raw, a + SLICE)
                b = m.end() if m else len(raw)
        words = [w for w in raw[a:b].replace(b"\n", b" \n ").split(b" ") if w]
        yield before + words, len(before)
        a, before, held = b, [], before + words
        for w in reversed(held[-context:] if context else []):
            if w == b"\n":
                break
            before.insert(0, w)
        del held


def shards(docs: DataFrame, longest: int) -> DataFrame:
    """``(shard, lang, n, words, x)``: sorted distinct words, and a text's words by their place among them from 1; 0 ends a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "lang", "n", "words", "x"]
        held: dict[str, tuple[_Ids, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}
        made = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=1).compress

        def let_go(lang: str) -> pa.RecordBatch:
            nonlocal made
            ids, xs = held.pop(lang)
            del sizes[lang]
            words = list(ids)[1:]
            order = sorted(range(len(words)), key=words.__getitem__)
            place = np.zeros(len(words) + 1, np.uint32)
            place[np.array(order, np.int64) + 1] = np.arange(1, len(words) + 1)
            x = np.concatenate(xs)
            x = place[x & ~OLD] | (x & OLD)
            made += 1
            row = [[made], [lang], [int(((x > 0) & (x < OLD)).sum())], [pack(b"\n".join(words[i] for i in order))], [pack(x.astype("<u4").tobytes())]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()))], names)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for words, old in _parts(text.as_py(), longest - 1):
                    if lang not in held:
                        held[lang], sizes[lang] = (_Ids({b"\n": 0}), []), 0
                    ids, xs = held[lang]
                    x = np.fromiter(map(ids.__getitem__, words), np.uint32, len(words))
                    x[:old] |= OLD
                    xs += [x, np.zeros(1, np.uint32)]
                    sizes[lang] += len(x) + 1
                    if sum(sizes.values()) > SHARD:
                        yield let_go(max(sizes, key=sizes.__getitem__))
        for lang in list(held):
            yield let_go(lang)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    return rows.mapInArrow(run, "shard long, lang string, n long, words binary, x binary")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


class Shard:
    """A shard's words, and its trie's nodes at each depth in the order of their paths."""

    def __init__(self, words: bytes, x: bytes):
        unpack = zstandard.ZstdDecompressor().decompress
        self.words = np.array([b"", *unpack(words).split(b"\n")], object)
        x = np.frombuffer(unpack(x), "<u4")
        self.fresh, self.x = x < OLD, (x & ~OLD).astype(np.int64)
        self.hash = np.fromiter(map(zlib.crc32, self.words), np.uint64, len(self.words))

    def nodes(self, depth: int, at: np.ndarray, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that start at ``at``: a place where each is, how often it is counted here, and which one each place has.

        ``prefix``: numbers of the phrases without the last word, in the order of their words.
        """
        key = self.x[at] if prefix is None else prefix * len(self.words) + self.x[at + depth - 1]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        return at[first], np.bincount(which, self.fresh[at + depth - 1], len(first)).astype(np.int64), which

    def ranges(self, depth: int, first: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(first), depth, np.uint64)
        for j in range(depth):
            h = _mixed(h + self.hash[self.x[first + j]])
        return (h % np.uint64(n)).astype(np.int64)

    def blocks(self, levels: list[tuple[int, np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Nodes of several depths, (depth, place, count), as one run for each range: words, paths, counts."""
        deep = max(d for d, *_ in levels)
        paths, counts, ranges = [], [], []
        for depth, first, count in levels:
            p = np.zeros((len(first), deep), np.int64)
            for j in range(depth):
                p[:, j] = self.x[first + j]
            paths.append(p)
            counts.append(count)
            ranges.append(self.ranges(depth, first, n))
        path, count, of = np.concatenate(paths), np.concatenate(counts), np.concatenate(ranges)
        order = np.lexsort((*path.T[::-1], of))
        path, count, of = path[order], count[order], of[order]
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else []
        pack = zstandard.ZstdCompressor(level=1).compress
        for a, b in zip(cuts[:-1], cuts[1:]):
            used, p = np.unique(path[a:b], return_inverse=True)
            if used[0]:  # 0 is no word, and is always there
                used, p = np.concatenate([[0], used]), p + 1
            yield int(of[a]), pack(b"\n".join(self.words[used[1:]])), pack(p.reshape(b - a, deep).T.astype("<u4").tobytes()), pack(count[a:b].astype("<u4").tobytes())


_BLOCKS = "shard long, lang string, range int, words binary, paths binary, counts binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["shard", "lang", "range", "words", "paths", "counts"])


def _tries(rows: DataFrame, levels: Callable[[Shard, pa.RecordBatch, int], list], n: int) -> DataFrame:
    """The serialised tries of shards: a row for each shard and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, lang = batch.column("shard")[i].as_py(), batch.column("lang")[i].as_py()
                shard = Shard(batch.column("words")[i].as_py(), batch.column("x")[i].as_py())
                made = [(name, lang, *b) for b in shard.blocks(levels(shard, batch, i), n)]
                if made:
                    yield _batch(made)

    return rows.mapInArrow(run, _BLOCKS)


def _pairs(shard: Shard) -> np.ndarray:
    return np.flatnonzero((shard.x[:-1] > 0) & (shard.x[1:] > 0))


def _merged(tries: DataFrame, least: int, bits: bool) -> DataFrame:
    """``(lang, words, a, shard, range, bits)``: nodes with a count of ``least`` or more in all shards together.

    With ``bits`` also a row for each shard and range, whose nodes of depth 2 they tell: whether each remains.
    """
    kind = "lang string, words array<string>, a long, shard long, range int, bits binary"
    fields = [("lang", pa.string()), ("words", pa.list_(pa.string())), ("a", pa.int64()), ("shard", pa.int64()), ("range", pa.int32()), ("bits", pa.binary())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [f for f, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        def settled(lang: str, at: int, runs: list[tuple[int, bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            # one numbering of all runs' words, in their order
            lists = [unpack(w).split(b"\n") for _, w, _, _ in runs]
            coded = pa.array([w for ws in lists for w in ws], pa.binary()).dictionary_encode()
            words = coded.dictionary
            order = np.array(words.to_pylist(), object).argsort(kind="stable") if len(words) else np.empty(0, np.int64)
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(1, len(words) + 1)
            rank = rank[coded.indices.to_numpy()]
            paths, counts, start = [], [], 0
            for ws, (_, _, p, c) in zip(lists, runs):
                counts.append(np.frombuffer(unpack(c), "<u4"))
                p = np.frombuffer(unpack(p), "<u4").reshape(-1, len(counts[-1]))
                paths.append(np.concatenate([[0], rank[start : start + len(ws)]])[p])
                start += len(ws)
            path, count = np.concatenate(paths, axis=1), np.concatenate(counts).astype(np.int64)
            # the runs are sorted: a stable sort merges them
            key = path[0]
            for c in path[1:]:
                key = np.unique(key, return_inverse=True)[1] * (len(words) + 1) + c
            merge = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], key[merge][1:] != key[merge][:-1]]))
            total = np.add.reduceat(count[merge], first)
            names = np.concatenate([[None], np.array([w.decode() for w in words.to_pylist()], object)[order]])
            left = np.flatnonzero(total >= least)
            for a in range(0, len(left), 10_000):
                some = left[a : a + 10_000]
                yield batch_of([(lang, [names[w] for w in p if w], int(n), None, None, None) for p, n in zip(path[:, merge[first[some]]].T.tolist(), total[some])])
            if bits:
                remains = np.empty(len(key), bool)
                remains[merge] = np.repeat(total >= least, np.diff(np.append(first, len(key))))
                ends, told = np.cumsum([len(c) for c in counts]), []
                for (shard, *_), a, b in zip(runs, [0, *ends[:-1]], ends):
                    two = remains[a:b][path[1, a:b] > 0]
                    if two.any():
                        told.append((None, None, None, shard, at, np.packbits(two).tobytes()))
                if told:
                    yield batch_of(told)

        key, runs = None, []
        for batch in batches:
            for shard, lang, at, words, paths, counts in zip(*(batch.column(i) for i in range(6))):
                new = lang.as_py(), at.as_py()
                if new != key:
                    if runs:
                        yield from settled(*key, runs)
                    key, runs = new, []
                runs.append((shard.as_py(), words.as_py(), paths.as_py(), counts.as_py()))
        if runs:
            yield from settled(*key, runs)

    return tries.repartition("lang", "range").sortWithinPartitions("lang", "range", "shard").mapInArrow(run, kind)


def frequent(docs: DataFrame, longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Every phrase of 1 to ``longest`` words that occurs ``least`` times or more in its language, as ``(lang, words, a)``; and ``(lang, n)``, all words."""
    own = written(shards(docs, longest), "shards")
    sizes = own.groupBy("lang").agg(F.sum("n").alias("n"))
    n = min(int((own.agg(F.sum("n")).first()[0] or 0) // RANGE) + 1, MOST_RANGES)

    def short(shard: Shard, batch: pa.RecordBatch, i: int) -> list:
        at = np.flatnonzero(shard.x > 0)
        two = _pairs(shard)
        return [(1, *shard.nodes(1, at)[:2]), (2, *shard.nodes(2, two, shard.x[two])[:2])]

    def long(shard: Shard, batch: pa.RecordBatch, i: int) -> list:
        at = _pairs(shard)
        first, _, which = shard.nodes(2, at, shard.x[at])
        of, remains = shard.ranges(2, first, n), np.zeros(len(first), bool)
        for told in batch.column("told")[i].as_py():
            here = np.flatnonzero(of == told["range"])
            remains[here] = np.unpackbits(np.frombuffer(told["bits"], np.uint8), count=len(here)).astype(bool)
        ok = np.zeros(len(shard.x), bool)
        ok[at] = remains[which]
        number = np.zeros(len(shard.x), np.int64)
        number[at] = which
        levels, live = [], np.flatnonzero(ok)
        for depth in range(3, longest + 1):
            live = live[live + depth - 1 < len(ok)]
            live = live[ok[live + depth - 2]]
            first, count, which = shard.nodes(depth, live, number[live])
            number[live] = which
            levels.append((depth, first[count > 0], count[count > 0]))
        return levels

    merged = written(_merged(_tries(own, short, n), least, longest > 2), "pairs")
    nodes = merged.where("shard IS NULL").select("lang", "words", "a")
    if longest > 2:
        told = merged.where("shard IS NOT NULL").groupBy("shard").agg(F.collect_list(F.struct("range", "bits")).alias("told"))
        nodes = nodes.unionByName(_merged(_tries(own.join(told, "shard"), long, n), least, False).select("lang", "words", "a"))
    return nodes, sizes


def _lefts(nodes: DataFrame) -> DataFrame:
    """Phrases of two words or more with ``lefts``: the counts of their first 2, 3, ... words but the last ones, by a walk in the order of paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk: list[tuple[str, list[str], int]] = []
        for batch in batches:
            lefts = []
            for lang, words, a in zip(*(batch.column(i).to_pylist() for i in range(3))):
                while walk and (walk[-1][0] != lang or words[: len(walk[-1][1])] != walk[-1][1]):
                    walk.pop()
                lefts.append([x[2] for x in walk])
                walk.append((lang, words, a))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lefts, pa.list_(pa.int64()))], ["lang", "words", "a", "lefts"])

    # dealt by the first two words: no group is larger than the phrases that begin with one pair
    own = nodes.where(F.size("words") >= 2).repartition("lang", F.col("words")[0], F.col("words")[1]).sortWithinPartitions("lang", "words")
    return own.select("lang", "words", "a").mapInArrow(run, "lang string, words array<string>, a long, lefts array<long>")


def _whole(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to ``longest`` words.

    A phrase counts ``least`` times or more; the score is that of its weakest cut, ``floor(1000 a n / (l r))``, ties to the first.
    A phrase goes if a longer one that holds it is counted at least ``percent`` (at most 100) hundredths as often.
    Null texts are empty, a null lang is ``und``; texts of any length are counted whole; repeated rows count each time; an empty table gives no rows.
    """
    nodes, sizes = frequent(docs, longest, least)
    nodes = written(nodes, "nodes")
    phrase = lambda w: F.array_join(w, " ")
    counts = nodes.select("lang", phrase("words").alias("link"), F.col("a").alias("c"))

    m = F.size("words")
    links = F.array_append(F.transform(F.sequence(F.lit(1), m - 1), lambda k: F.struct(k.alias("k"), phrase(F.slice("words", k + 1, m - k)).alias("link"))), F.struct(F.lit(0).alias("k"), F.col("words")[0].alias("link")))
    linked = _lefts(nodes).select("lang", phrase("words").alias("phrase"), m.alias("m"), "a", "lefts", F.inline(links)).join(counts, ["lang", "link"])
    found = linked.groupBy("lang", "phrase").agg(F.first("m").alias("m"), F.first("a").alias("a"), F.first("lefts").alias("lefts"), F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("of")).join(sizes, "lang")
    left = lambda k: F.when(k == 1, F.col("of")[F.lit(0)]).otherwise(F.get("lefts", k - 2))
    right = lambda k: F.col("of")[k]
    score = lambda k: F.call_function("div", _whole(F.lit(1000)) * _whole(F.col("a")) * _whole(F.col("n")), _whole(left(k)) * _whole(right(k)))
    cuts = F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda k: F.struct(score(k).alias("score"), k.alias("k"), left(k).alias("l"), right(k).alias("r")))
    scored = found.select("lang", "phrase", "a", "n", F.array_min(cuts).alias("cut"))

    # a phrase in a longer one is also in one that is a word longer and as frequent at least
    within = nodes.where(m >= 3).select("lang", "a", F.explode(F.array(phrase(F.slice("words", F.lit(1), m - 1)), phrase(F.slice("words", F.lit(2), m - 1)))).alias("phrase"))
    longer = within.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_whole(F.col("longer")) * 100 < _whole(F.col("a")) * percent))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
