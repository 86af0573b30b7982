"""Substring dedup: windows of words that start earlier elsewhere are removed.

First pass: a count-min sketch of all windows (see sketch.py) overestimates how
often each occurs.  Second pass: only windows estimated to repeat are grouped,
exactly, by 104 bits of hash; the earliest start of each stays.  What is
shuffled are runs of windows with one minimizer, once for each distinct run in a
task, so copies and common passages are thinned out before they meet.

A minimizer with very many different runs doesn't meet in one task: its windows
are grouped one by one.  It is told by a task that has many of its runs, which
then go to any task, or else by the task in which the rest of them meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .sketch import gathered, joined, maybe_repeated, minimizers, ordered, repeated_cells, runs

#: Words of the grams whose smallest hash stands for a window.
GRAM = 8
#: Runs of a minimizer that may meet in one task; beyond that its windows are grouped one by one.
CROWDED = 50_000
#: A task takes a minimizer for crowded at this part of the bound, in 200,000 runs of its own.
LOCALLY = 50
#: What rows of crowded minimizers are dealt by.
SALTS = 1 << 16


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and each text's number of words."""
    hashes, counts = [], []
    digest = xxhash.xxh3_64_intdigest
    for raw in texts:
        words = raw.split()  # at \x20 and \x09-\x0D
        counts.append(len(words))
        hashes.append(np.fromiter(map(digest, words), np.uint64, len(words)))
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.array(counts)


def windows_of(texts: list[bytes], window: int, wide: bool = True) -> tuple:
    """Keys, starts and ends of runs of windows, each text's first word, and hashes of all windows."""
    h, counts = _words(texts)
    first = np.cumsum(counts) - counts
    gram = min(GRAM, window)
    sizes = {1: h}
    n = 1
    while n * 2 <= window:
        sizes[n * 2] = joined(sizes[n], n)
        n *= 2

    def grams(size: int) -> np.ndarray:
        """Hashes of ``size`` words in a row, put together from powers of two."""
        out, done = None, 0
        for p in sorted((p for p in sizes if size & p), reverse=True):
            more = sizes[p][done : done + max(len(h) - size + 1, 0)]
            out = more if out is None else mixed_pair(out[: len(more)], more)
            done += p
        return out[: max(len(h) - size + 1, 0)]

    m = minimizers(grams(gram), window - gram + 1)
    whole = np.zeros(len(m), bool)
    for a, c in zip(first.tolist(), counts.tolist()):
        if c >= window:
            whole[a : a + c - window + 1] = True
    return (*runs(m, whole), first, counts, grams(window) if wide else None)


def mixed_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(5) + (b << np.uint64(3) | b >> np.uint64(61))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0xD6E8FEB86659FD93) ^ x >> np.uint64(27)


def _found(rows: DataFrame, window: int, held, distinct: bool, crowded: int = CROWDED) -> DataFrame:
    """Runs of windows estimated to repeat: once for each distinct one in a task with its earliest start, or each occurrence.

    Distinct ones of a minimizer that is crowded in its task carry a ``salt`` above 0; a row of 0 ``times`` tells the others.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bits = held.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, texts in gathered(batch.column(1)):
                keys, start, end, first, counts, h = windows_of(texts, window)
                ok = maybe_repeated(bits, keys)
                if ok.any():
                    start, end = start[ok], end[ok]
                    own = np.searchsorted(first + counts, start, side="right")
                    yield keys[ok], start, end, ids[at + own], start - first[own], h.astype("<u8").tobytes()

    def run_distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], list] = {}
        for keys, start, end, ids, pos, h in each(batches):
            for k, s, e, o, p in zip(keys.tolist(), start.tolist(), end.tolist(), ids.tolist(), pos.tolist()):
                x = (k, h[8 * s : 8 * e])
                had = seen.get(x)
                if had is None:
                    seen[x] = [o, p, 1]
                else:
                    had[2] = 2
                    if (o, p) < (had[0], had[1]):
                        had[0], had[1] = o, p
            if len(seen) > 200_000:
                yield flush(seen)
                seen = {}
        if seen:
            yield flush(seen)

    def flush(seen: dict) -> pa.RecordBatch:
        k = np.array([x[0] for x in seen])
        names, of, n = np.unique(k, return_inverse=True, return_counts=True)
        salt, many = np.zeros(len(k), np.int32), names[n > crowded // LOCALLY]
        runs_ = [x[1] for x in seen]
        for i in np.flatnonzero((n > crowded // LOCALLY)[of]).tolist():
            salt[i] = 1 + xxhash.xxh3_64_intdigest(runs_[i]) % SALTS
        v = [np.append(np.array(c), np.zeros(len(many), np.int64)) for c in zip(*seen.values())]
        cols = [pa.array(np.append(k, many)), pa.array(runs_ + [b""] * len(many), pa.binary()), pa.array(v[0]), *(pa.array(c.astype(np.int32)) for c in (v[1], v[2], np.append(salt, np.zeros(len(many), np.int32))))]
        return pa.RecordBatch.from_arrays(cols, ["k", "hashes", "ord", "start", "times", "salt"])

    def run_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for keys, start, end, ids, pos, h in each(batches):
            own = np.fromiter((digest(h[8 * s : 8 * e]) for s, e in zip(start.tolist(), end.tolist())), np.uint64, len(start))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own.view(np.int64)), pa.array(ids), pa.array(pos.astype(np.int32))], ["k", "h", "ord", "start"])

    if distinct:
        return rows.select("ord", "raw").mapInArrow(run_distinct, "k long, hashes binary, ord long, start int, times int, salt int")
    return rows.select("ord", "raw").mapInArrow(run_each, "k long, h long, ord long, start int")


def earliest(group: np.ndarray, hashes: list[bytes], ord_: np.ndarray, start: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """For each run of windows the parts (from, to, document, start of the run there) whose windows start there first."""
    sizes = np.array([len(x) // 8 for x in hashes])
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(hashes)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    h = np.frombuffer(b"".join(hashes), "<u8")
    pos = start[of] + at
    order = np.lexsort([pos, ord_[of], h, group[of]])
    g, hh = group[of][order], h[order]
    heads = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (hh[1:] != hh[:-1])]))
    lead = np.empty(len(order), np.int64)
    lead[order] = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
    doc, base = ord_[of][lead], pos[lead] - at
    out = []
    for a, n in zip(first.tolist(), sizes.tolist()):
        d, b = doc[a : a + n], base[a : a + n]
        cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (b[1:] != b[:-1])]))
        out.append(list(zip(cut.tolist(), [*cut[1:].tolist(), n], d[cut].tolist(), b[cut].tolist())))
    return out


def _resolved(found: DataFrame, crowded: int) -> DataFrame:
    """``(k, h, parts)`` of each distinct run that may occur again; runs of one minimizer are grouped in one task.

    Those of a crowded minimizer go on as ``(k, hashes, ord, start)``; a task holds no more than ``crowded`` of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("ord", pa.int64()), ("start", pa.int32())]))
        names = ["k", "h", "parts", "hashes", "ord", "start"]
        held: dict[int, dict[bytes, list[int]]] = {}
        last, size, split = None, 0, None

        def settle() -> pa.RecordBatch:
            flat = [(k, x, *v) for k, own in held.items() if len(own) > 1 or next(iter(own.values()))[2] > 1 for x, v in own.items()]
            parts = earliest(np.array([f[0] for f in flat]), [f[1] for f in flat], np.array([f[2] for f in flat]), np.array([f[3] for f in flat])) if flat else []
            rows = [[dict(zip(("a", "b", "ord", "start"), p)) for p in ps] for ps in parts]
            h, n = np.array([digest(f[1]) for f in flat], np.uint64).view(np.int64), len(flat)
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int64()), pa.array(h), pa.array(rows, kind), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names)

        def passed(rows: list[tuple]) -> pa.RecordBatch:
            k, x, o, p = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), kind), pa.array(x, pa.binary()), pa.array(o, pa.int64()), pa.array(p, pa.int32())], names)

        for batch in batches:
            on: list[tuple] = []
            for k, x, o, p, times, salt in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if not times:  # comes before all others of its minimizer
                    split = k
                    continue
                if salt or k == split:
                    on.append((k, x, o, p))
                    continue
                if k != last and size > CROWDED:
                    yield settle()
                    held, size = {}, 0
                last, size = k, size + 1
                own = held.setdefault(k, {})
                had = own.get(x)
                if had is None:
                    own[x] = [o, p, times]
                    if len(own) > crowded:
                        on += [(k, y, *v[:2]) for y, v in held.pop(k).items()]
                        split = k
                else:
                    had[2] = 2
                    if (o, p) < (had[0], had[1]):
                        had[0], had[1] = o, p
            if on:
                yield passed(on)
        if held:
            yield settle()

    dealt = found.repartition("k", "salt").sortWithinPartitions("k", "times")
    return dealt.mapInArrow(run, "k long, h long, parts array<struct<a:int,b:int,ord:long,start:int>>, hashes binary, ord long, start int")


def _by_window(split: DataFrame) -> DataFrame:
    """``(k, h, parts)`` of the runs ``split(k, hashes, ord, start)``: a part for each window, whose earliest start is an aggregate over all of its kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            hashes = batch.column(1).to_pylist()
            sizes = np.array([len(x) // 8 for x in hashes], np.int64)
            of = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            k, ord_, start = (batch.column(i).to_numpy()[of] for i in (0, 2, 3))
            h = np.fromiter(map(digest, hashes), np.uint64, len(hashes)).view(np.int64)[of]
            w = np.frombuffer(b"".join(hashes), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, h, at.astype(np.int32), w, ord_, (start + at).astype(np.int32))], ["k", "h", "at", "w", "ord", "start"])

    each = split.select("k", "hashes", "ord", "start").mapInArrow(run, "k long, h long, at int, w long, ord long, start int")
    first = each.groupBy("k", "w").agg(F.min(F.struct("ord", "start")).alias("first"))
    met = each.select("k", "h", "at", "w").distinct().join(first, ["k", "w"])
    part = F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"), F.col("first.ord").alias("ord"), (F.col("first.start") - F.col("at")).alias("start"))
    return met.groupBy("k", "h").agg(F.collect_list(part).alias("parts"))  # of one run: a window for each place of its gram


def removals(rows: DataFrame, window: int, crowded: int = CROWDED) -> DataFrame:
    """``rows(ord, raw)`` to ``(ord, spans)``: where windows start that start earlier elsewhere, as ranges (a, b)."""

    def keys_of(raws) -> Iterator[np.ndarray]:
        for _, texts in gathered(raws):
            yield windows_of(texts, window, wide=False)[0]

    held = rows.sparkSession.sparkContext.broadcast(repeated_cells(rows.select("raw"), keys_of))  # 32 MB
    resolved = written(_resolved(_found(rows, window, held, True, crowded), crowded), "resolved")
    parts = resolved.where("hashes IS NULL").select("k", "h", "parts").unionByName(_by_window(resolved.where("hashes IS NOT NULL")))
    parts = parts.select(F.col("k").alias("_k"), F.col("h").alias("_h"), "parts")
    hits = _found(rows, window, held, distinct=False).join(parts, (F.col("k") == F.col("_k")) & (F.col("h") == F.col("_h")))
    later = F.filter("parts", lambda p: (p["ord"] < F.col("ord")) | ((p["ord"] == F.col("ord")) & (p["start"] < F.col("start"))))
    spans = F.transform(later, lambda p: F.struct((F.col("start") + p["a"]).alias("a"), (F.col("start") + p["b"]).alias("b")))
    return hits.select("ord", spans.alias("spans")).where(F.size("spans") > 0).groupBy("ord").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_repeats(docs: DataFrame, window: int = 20, crowded: int = CROWDED) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row: the text without repeated windows, words joined by one space.

    A word goes if a window that covers it also starts earlier, in a document
    with a smaller doc_id (null: the smallest) or before in the same one; windows
    are judged on the input.  Rows that repeat a doc_id are documents of their
    own, in the order of their texts.  Null and empty texts have no words; texts
    of any length are read whole.  Other columns are ignored; an empty table
    gives an empty result.  ``crowded``: runs of a minimizer above which it is split; results don't depend on it.
    """
    rows = ordered(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, spans in zip(batch.column(1), batch.column(2)):
                words = raw.as_py().split()
                n = len(words)
                if spans.is_valid and len(spans):
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, spans.values.field("a").to_numpy(), 1)
                    np.add.at(edge, spans.values.field("b").to_numpy() + (window - 1), -1)
                    keep = np.cumsum(edge[:n]) == 0
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                out.append((n, n - len(words), b" ".join(words)))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    gone = removals(rows, window, crowded)
    both = rows.join(gone, "ord", "left").select("doc_id", "raw", "spans")
    return both.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept binary")
