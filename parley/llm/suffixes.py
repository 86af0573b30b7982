"""Suffix-array dedup: strings of 50 bytes that an earlier document holds are removed.

A count-min sketch (see sketch.py) first finds the segments, runs of windows
with one minimizer, that may occur twice.  Rows of (minimizer, hash of the
segment, document) meet by minimizer.  Every occurrence of a segment but the
earliest is hit as a whole, and told at once.  Only the earliest is open: its
windows may lie in another segment of an earlier document.  If its minimizer has
other segments, one copy of each is fetched, and all of a minimizer are sorted
together, by grouping (see gsaca.py); windows that are equal stand next to each
other in that order, and each learns the smallest document that holds it.

A row that holds a segment more than once tells its first place; the windows
that are hit there are looked up in the rest of its text at the end.

A minimizer with very many different segments is split: each of its windows is
then a segment of its own, dealt out by its own hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NULL_ID, id_key, utf8, written
from .grams import BASE, BLOCK, TABLE, Grams, joined_texts, powers
from .gsaca import suffix_array
from .sketch import maybe_repeated, mixed, packed, repeated_cells

#: Bytes of the grams whose smallest hash stands for a window.
GRAM = 32
#: Bytes of segments that are sorted together; those of one minimizer always are.
CHUNK = 200_000
#: Different segments of one minimizer, beyond which it is split.
CROWDED = 50_000


def _gram(window: int) -> int:
    return min(GRAM, max(window * 2 // 3, 1))


def _name(k: np.ndarray, n: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Minimizer (40 bits), number of windows and place of the gram (8 bits each) in one number that isn't negative."""
    return k << 16 | n << 8 | core


def _split(joint: bytes, window: int, keys: np.ndarray, start: np.ndarray, n: np.ndarray, core: np.ndarray, hot: np.ndarray) -> tuple:
    """Segments with a ``hot`` minimizer taken apart: each window a segment with a key of its own; in the order of their starts."""
    is_hot = np.isin(keys, hot)
    if not is_hot.any():
        return keys, start, n, core
    times = n[is_hot]
    at = np.repeat(start[is_hot], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    own = np.fromiter((xxhash.xxh3_64_intdigest(joint[a : a + window], 1) >> 24 for a in at.tolist()), np.int64, len(at))
    cold = ~is_hot
    out = [np.concatenate([x[cold], y]) for x, y in ((keys, own), (start, at), (n, np.ones_like(at)), (core, at))]
    order = np.argsort(out[1], kind="stable")
    return tuple(x[order] for x in out)


#: What a row tells: windows that an earlier document holds; a segment to be sorted; one more row with the id of that segment's row; a minimizer to be split.
HIT, SORT, TIE, SPLIT = 0, 1, 2, 3
_ROW = "name long, h long, ord long, row long, at long"


def _occurrences(rows: DataFrame, window: int, held, hot: np.ndarray) -> DataFrame:
    """``(name, h, ord, row, at)`` of the segments that may occur twice; ``at``: first window and, in bit 0, whether the row holds the segment again.

    Of a segment in a few texts only the occurrences with the smallest ord are
    told; the others are hit by it, and become one row for each run of segments:
    name is negative, h the number of windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, grams, digest = held.value, Grams(window, _gram(window)), xxhash.xxh3_64_intdigest
        for batch in batches:
            ids, rows_ = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            unique = batch.column(1).null_count > 0
            for at, joint, first, counts in joined_texts(batch.column(2)):
                keys, start, n, core = grams.segments(joint, first, counts)
                ok = maybe_repeated(bits, keys)
                keys, start, n, core = _split(joint, window, keys[ok], start[ok], n[ok], core[ok], hot) if len(hot) else (keys[ok], start[ok], n[ok], core[ok])
                if not len(keys):
                    continue
                h = np.fromiter(map(digest, [joint[s:e] for s, e in zip(start.tolist(), (start + n + (window - 1)).tolist())]), np.uint64, len(start)).view(np.int64)
                name, own = _name(keys, n, core - start), np.searchsorted(first, start, "right") - 1
                ord_, place = ids[at + own], start - first[own]
                order = np.lexsort([ord_, h, name])  # stable: places rise within a row
                a, b, o, r = name[order], h[order], ord_[order], own[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                heads = np.flatnonzero(new)
                later = o != o[heads][np.cumsum(new) - 1]
                # the first place in each row
                new[1:] |= r[1:] != r[:-1]
                heads = np.flatnonzero(new & ~later)
                again = np.zeros(len(order), bool)
                again[:-1] = ~new[1:]
                kept = order[heads]
                hit = np.sort(order[later])
                begin = np.concatenate([[True], (start[hit[1:]] != start[hit[:-1]] + n[hit[:-1]]) | (own[hit[1:]] != own[hit[:-1]])])[: len(hit)]
                from_ = hit[begin]
                to = hit[np.append(np.flatnonzero(begin)[1:], len(hit)) - 1] if len(hit) else hit
                pick = np.concatenate([kept, from_])
                told = [
                    np.concatenate([name[kept], ~(mixed(ord_[from_].view(np.uint64)) >> np.uint64(1)).view(np.int64)]),
                    np.concatenate([h[kept], start[to] + n[to] - start[from_]]),
                    ord_[pick],
                    np.concatenate([place[kept] << 1 | again[heads], place[from_] << 1]),
                ]
                row = pa.nulls(len(pick), pa.int64()) if unique else pa.array(rows_[at + own[pick]].astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in told[:3]), row, pa.array(told[3])], ["name", "h", "ord", "row", "at"])

    return rows.select("ord", "row", "raw").mapInArrow(run, _ROW)


def _judged(found: DataFrame, crowded: int) -> DataFrame:
    """``(fate, name, h, ord, row, at)``.

    HIT: ``h`` windows from ``at`` of the row are in an earlier document.  SORT:
    the first row of a segment whose minimizer has other segments.  TIE: another
    row with its ord, where ids repeat.  SPLIT: a minimizer with more than
    ``crowded`` segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.empty(0, np.int64)] * 5
        held, split = none, None

        def told(fate: int, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(cols[0]):
                row = pa.array(cols[3], mask=cols[3] == NULL_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), fate, np.int32)), *(pa.array(x) for x in cols[:3]), row, pa.array(cols[4])], ["fate", "name", "h", "ord", "row", "at"])

        def hits(cols: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
            zero = np.zeros(len(n), np.int64)
            yield from told(HIT, [zero, n, zero, np.where(cols[3] == NULL_ID, cols[2], cols[3]), cols[4]])

        def settled(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """The fate of whole minimizers, from the first row of each of their segments."""
            k = cols[0] >> 16
            if not len(k):
                return
            heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(heads, len(k)))
            differ = np.minimum.reduceat(cols[2], heads) != np.maximum.reduceat(cols[2], heads)
            yield from told(SORT, [x[np.repeat(differ & (size <= crowded), size)] for x in cols])
            yield from told(SPLIT, [x[heads[size > crowded]] for x in cols])

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4)]
            cols.insert(3, pc.fill_null(batch.column(3), NULL_ID).to_numpy(zero_copy_only=False))
            sure = int(np.searchsorted(cols[0], 0))  # negative names come first
            if sure:
                yield from hits([x[:sure] for x in cols], cols[1][:sure])
            skip = sure if split is None else max(sure, int(np.searchsorted(cols[0] >> 16, split, "right")))  # the rest of a minimizer that is split already
            if skip == len(cols[0]):
                continue
            split, n_held = None, len(held[0])
            cols = [np.concatenate([x, y[skip:]]) for x, y in zip(held, cols)]
            name, h, ord_ = cols[:3]
            new = np.concatenate([[True], (name[1:] != name[:-1]) | (h[1:] != h[:-1])])
            least = ord_[np.flatnonzero(new)][np.cumsum(new) - 1]
            later = ord_ != least
            yield from hits([x[later] for x in cols], name[later] >> 8 & 255)
            tie = ~new & ~later
            tie[:n_held] = False
            yield from told(TIE, [x[tie] for x in cols])
            cols = [x[new] for x in cols]
            k = cols[0] >> 16
            cut = int(np.searchsorted(k, k[-1]))
            yield from settled([x[:cut] for x in cols])
            held = [x[cut:] for x in cols]
            if len(held[0]) > crowded:
                yield from settled(held)
                split, held = int(k[-1]), none
        yield from settled(held)

    k = F.shiftright("name", 16)
    return found.repartition(k).sortWithinPartitions("name", "h", "ord").mapInArrow(run, f"fate int, {_ROW}")


def _fetched(jobs: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """``(name, h, ord, row, at, segment)`` of the segments to sort, cut out of the texts that hold them.

    All columns of ``texts`` are taken and all its rows kept until Python reads
    them: its exchange is then the one of the last join, and is made once.
    """
    by_text = jobs.groupBy(F.coalesce("row", "ord").alias("_row")).agg(F.collect_list(F.struct("name", "h", "ord", "at")).alias("jobs"))  # of one text: no more than its windows
    names = ["name", "h", "ord", "row", "at", "segment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            cut: list[bytes] = []
            for row, raw, jobs in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if not jobs.is_valid:
                    continue
                raw, jobs = unpack(raw.as_py()), jobs.values
                name, h, low, at = (jobs.field(i).to_numpy() for i in range(4))
                first = at >> 1
                cut += [raw[a:b] for a, b in zip(first.tolist(), (first + (name >> 8 & 255) + window - 1).tolist())]
                for c, x in zip(cols, (name, h, low, np.full(len(at), row), at)):
                    c.append(x)
            if cut:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in cols), pa.array(cut, pa.binary())], names)

    return texts.join(by_text, texts.row == F.col("_row"), "left").select("row", "doc_id", "raw", "jobs").mapInArrow(run, f"{_ROW}, segment binary")


def shared_windows(segments: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the range of windows outside of which none has the hash of a window of another segment; empty where all are so.

    What is left out has no equal, and needs no sort; what has one is decided by the sort.
    """
    sizes = np.array([len(x) for x in segments])
    first = np.cumsum(sizes) - sizes
    sums = np.zeros(int(sizes.sum()) + 1, np.uint64)
    n = len(sums) - 1
    up, down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
    np.cumsum(TABLE[np.frombuffer(b"".join(segments), np.uint8)] * down, out=sums[1:])
    h = (sums[window:] - sums[:-window]) * up[: n - window + 1]
    h ^= h >> np.uint64(32)
    times = sizes - window + 1
    of = np.repeat(np.arange(len(sizes)), times)
    at = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    h = h[first[of] + at]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    lo, hi = np.full(len(sizes), 1 << 62), np.zeros(len(sizes), np.int64)
    np.minimum.at(lo, of[again], at[again])
    np.maximum.at(hi, of[again], at[again] + 1)
    return np.minimum(lo, hi), hi


def earliest(segments: list[bytes], cores: list[int], least: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """For each segment the runs (from, to, smallest document) of its windows, from the sorted suffixes of all.

    All windows of a segment hold the gram that it was found by, at one place.
    This gram is sorted as one symbol, and the bytes compared in full.
    """
    sizes = np.array([len(x) + 1 for x in segments])
    first = np.cumsum(sizes) - sizes
    joint = b"\x00".join(segments) + b"\x00"
    gram = _gram(window)
    symbols: list[int] = []
    place: list[int] = []
    core: dict[bytes, int] = {}
    for a, x, c in zip(first.tolist(), segments, cores):
        symbols += x[:c]
        symbols.append(256 + core.setdefault(x[c : c + gram], len(core)))
        symbols += x[c + gram :]
        symbols.append(0)
        place += range(a, a + c + 1)
        place += range(a + c + gram, a + len(x) + 1)
    at_symbol = np.array(place)
    valid = np.zeros(len(joint), bool)
    valid[np.concatenate([np.arange(a, a + n - window) for a, n in zip(first.tolist(), sizes.tolist())])] = True
    order = at_symbol[np.array(suffix_array(symbols))]
    order = order[valid[order]]
    # equal windows are neighbours: the bytes are compared in full
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(joint, np.uint8), window)
    new = np.empty(len(order), bool)
    new[0] = True
    for a in range(1, len(order), 1 << 16):
        b = min(a + (1 << 16), len(order))
        new[a:b] = (view[order[a:b]] != view[order[a - 1 : b - 1]]).any(1)
    heads = np.flatnonzero(new)
    of = np.searchsorted(first, order, side="right") - 1
    lowest = np.minimum.reduceat(least[of], heads)
    at = np.empty(len(joint), np.int64)
    at[order] = np.repeat(lowest, np.diff(np.append(heads, len(order))))
    out = []
    for a, n in zip(first.tolist(), sizes.tolist()):
        x = at[a : a + n - window]
        cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        ends = np.append(cut[1:], len(x))
        out.append(list(zip(cut.tolist(), ends.tolist(), x[cut].tolist())))
    return out


def _resolved(segments: DataFrame, window: int) -> DataFrame:
    """``(name, h, row, at, skip, n)``: ``n`` windows, ``skip`` after ``at``, of a segment's row are in an earlier document, as its minimizer's sorted segments tell."""
    names_of = ["name", "h", "row", "at", "skip", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, int, bytes]] = []
        size, last = 0, None

        def settle() -> pa.RecordBatch:
            texts, out = [x[5] for x in held], []
            a, b = shared_windows(texts, window)
            few = np.flatnonzero(b > a).tolist()
            if few:
                cut = [texts[i][a[i] : b[i] + window - 1] for i in few]
                for i, parts in zip(few, earliest(cut, [(held[i][0] & 255) - a[i] for i in few], np.array([held[i][2] for i in few]), window)):
                    name, h, ord_, row, at, _ = held[i]
                    spans: list[list[int]] = []
                    for x, y, low in parts:
                        if low < ord_ and spans and spans[-1][1] == x:
                            spans[-1][1] = y
                        elif low < ord_:
                            spans.append([x, y])
                    out += [(name, h, row, at, int(a[i]) + x, y - x) for x, y in spans]
            cols = list(zip(*out)) if out else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names_of)

        for batch in batches:
            for x in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if size > CHUNK and x[0] >> 16 != last:
                    yield settle()
                    held, size = [], 0
                last = x[0] >> 16
                held.append(x)
                size += len(x[5])
        if held:
            yield settle()

    return segments.repartition(F.shiftright("name", 16)).sortWithinPartitions("name", "h").mapInArrow(run, "name long, h long, row long, at long, skip long, n long")


def _equal_too(raw: bytes, hit: np.ndarray, among: np.ndarray, window: int) -> None:
    """Windows of ``raw`` that equal one of ``among`` (both by place) are hit too."""
    data, grams = np.frombuffer(raw, np.uint8), Grams(window, window)
    view = np.lib.stride_tricks.sliding_window_view(data, window)

    def blocks() -> Iterator[tuple[int, np.ndarray]]:
        for a in range(0, len(hit), BLOCK):
            yield a, grams.hashes(data[a : min(a + BLOCK, len(hit)) + window - 1])

    at = np.flatnonzero(among)
    known, first = np.unique(np.concatenate([h[among[a : a + len(h)]] for a, h in blocks()]), return_index=True)
    for a, h in blocks():
        i = np.searchsorted(known, h).clip(max=len(known) - 1)
        same = np.flatnonzero(known[i] == h)
        same = same[(view[a + same] == view[at[first[i[same]]]]).all(1)]
        hit[a + same] = True


def _rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``(ord, row, doc_id, raw)`` and whether ids repeat: ord is the doc_id, null the smallest; row numbers the rows where ids repeat, else it is null."""
    rows = docs.select(id_key(F.col("doc_id")).alias("ord"), F.lit(None).cast("long").alias("row"), "doc_id", utf8(F.col("text")).alias("raw"))
    if docs.groupBy(id_key(F.col("doc_id")).alias("k")).count().where("count > 1").limit(1).count():
        return written(rows.withColumn("row", F.monotonically_increasing_id()), "numbered"), True
    return rows, False


def without_repeats(docs: DataFrame, window: int = 50, crowded: int = CROWDED) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept binary)`` for every row, the text as UTF-8 bytes.

    A byte goes if a string of ``window`` bytes that covers it also starts in a
    document with a smaller doc_id (null: the smallest); strings are judged on
    the input and never cross documents.  Rows that repeat a doc_id are neither
    before nor after each other: each is judged against smaller ids only.  Null
    counts as empty.  A text may have any length: it is read in blocks.  Equal
    segments are told by 104 bits of hash, the windows of different ones by
    their bytes.  Other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """
    if not 2 <= window <= 250:
        raise ValueError("a window has 2 to 250 bytes")
    rows, repeated = _rows(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keys_of(raws) -> Iterator[np.ndarray]:
        grams = Grams(window, _gram(window))
        for _, joint, first, counts in joined_texts(raws):
            yield grams.segments(joint, first, counts)[0]

    held = docs.sparkSession.sparkContext.broadcast(repeated_cells(rows.select("raw"), keys_of))  # 32 MB
    hot = np.empty(0, np.int64)
    judged = written(_judged(_occurrences(rows, window, held, hot), crowded), "judged")
    split = judged.where(F.col("fate") == SPLIT).select(F.shiftright("name", 16).alias("k")).distinct()
    if split.limit(1).count():
        # each has more than ``crowded`` different segments: one for 3 MB of text at most
        hot = np.array([r[0] for r in split.collect()], np.int64)
        judged = written(_judged(_occurrences(rows, window, held, hot), crowded), "judged")
    texts = packed(rows.select(F.coalesce("row", "ord").alias("ord"), "doc_id", "raw")).withColumnRenamed("ord", "row")
    jobs = judged.where(F.col("fate") == SORT)
    found = _resolved(_fetched(jobs, texts, window), window)
    ties = judged.where(F.col("fate") == TIE)
    if repeated and ties.limit(1).count():
        found = written(found, "sorted")
        also = ties.select(F.col("name").alias("_name"), F.col("h").alias("_h"), F.col("row").alias("_row"), F.col("at").alias("_at"))
        also = also.join(found, (F.col("name") == F.col("_name")) & (F.col("h") == F.col("_h"))).select("name", "h", F.col("_row").alias("row"), F.col("_at").alias("at"), "skip", "n")
        found = found.unionByName(also)
    hits = judged.where(F.col("fate") == HIT).select("row", "at", F.col("h").alias("n")).unionByName(found.select("row", (F.col("at") + F.col("skip") * 2).alias("at"), "n"))
    gone = hits.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("at", "n")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        def marked(size: int, at: np.ndarray, n: np.ndarray) -> np.ndarray:
            edge = np.zeros(size + 1, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n, -1)
            return np.cumsum(edge[:size]) > 0

        for batch in batches:
            out = []
            for raw, spans in zip(batch.column(2), batch.column(3)):
                raw = unpack(raw.as_py())
                n = len(raw)
                removed = runs_ = 0
                if spans.is_valid and len(spans):
                    at, times = (spans.values.field(i).to_numpy() for i in range(2))
                    hit = marked(n - window + 1, at >> 1, times)
                    if (at & 1).any():
                        _equal_too(raw, hit, marked(len(hit), at[at & 1 == 1] >> 1, times[at & 1 == 1]), window)
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
                    gone = marked(n, turn[::2], turn[1::2] - turn[::2] + (window - 1))
                    removed, runs_ = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((n, removed, runs_, raw))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    both = texts.join(gone, texts.row == F.col("_row"), "left").select("row", "doc_id", "raw", "spans")
    return both.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
