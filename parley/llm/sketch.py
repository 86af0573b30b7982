"""Count-min sketches over minimizers of windows.

A window (so many words or bytes in a row) is counted by its minimizer, the
smallest hash of the short grams in it (ties: the last).  Equal windows have
equal minimizers at equal places, so windows next to each other that share one
are counted once, and still no window's count is underestimated.

Every task makes a sparse sketch of its part.  Sketches are merged by shard, and
what remains is one bit for each cell: counted twice or more.  These bits have a
fixed size (``ROWS * CELLS / 8`` bytes, 32 MB), whatever the input; that is all
that is sent to every task.  A fuller sketch lets more windows through to the
exact pass and never loses one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NULL_ID, id_key, utf8, written

ROWS, CELLS, SHARD = 2, 1 << 27, 1 << 16
_ODD = (0x9E3779B1, 0x85EBCA6B)
AT_BITS = 24
#: Windows whose places are counted from one start, so that they fit AT_BITS; runs end there.
BLOCK = 1 << 23
#: Grams that are hashed together; longer batches are cut between documents.
MOST = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def joined(a: np.ndarray, by: int) -> np.ndarray:
    """Hashes of two grams next to each other, from hashes of grams of ``by`` units."""
    return mixed(a[:-by] * np.uint64(3) + (a[by:] << np.uint64(1) | a[by:] >> np.uint64(63))) if len(a) > by else a[:0]


def minimizers(grams: np.ndarray, w: int) -> np.ndarray:
    """For each w grams in a row the smallest hash, cut to 40 bits, and its place in the block from the end, in one number."""
    n = len(grams) - w + 1
    blocks = [_minimizers(grams[a : min(a + BLOCK, n) + w - 1], w) for a in range(0, n, BLOCK)]
    return np.concatenate(blocks) if len(blocks) > 1 else blocks[0] if blocks else np.empty(0, np.uint64)


def _minimizers(grams: np.ndarray, w: int) -> np.ndarray:
    low = np.uint64((1 << AT_BITS) - 1)
    m = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    done = 1
    while done * 2 <= w:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    return np.minimum(m[: len(m) - (w - done)], m[w - done :]) if w > done else m


def runs(m: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) of runs of windows with one minimizer; ``whole``: the windows that lie in one document."""
    ok = np.flatnonzero(whole)
    if not len(ok):
        return np.empty(0, np.int64), ok, ok
    x = m[ok]
    new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (ok[1:] != ok[:-1] + 1)]))
    last = np.append(new[1:], len(ok)) - 1
    return (x[new] >> np.uint64(AT_BITS)).astype(np.int64), ok[new], ok[last] + 1


def places(m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the minimizers of windows are: the index of their first gram."""
    low = np.uint64((1 << AT_BITS) - 1)
    return (low - (m[at] & low)).astype(np.int64) + at // BLOCK * BLOCK


def packed(rows: DataFrame) -> DataFrame:
    """``rows(ord, doc_id, raw)`` with the text compressed, for the one time that it is shuffled."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack(x.as_py()) for x in batch.column(2)], pa.binary())], ["ord", "doc_id", "raw"])

    return rows.select("ord", "doc_id", "raw").mapInArrow(run, f"ord long, doc_id {kind}, raw binary")


def cells(keys: np.ndarray) -> list[np.ndarray]:
    """The cell of each key in each row of the sketch."""
    return [((keys.astype(np.uint64) * np.uint64(odd) ^ keys.astype(np.uint64) >> np.uint64(13 + 6 * i)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64) for i, odd in enumerate(_ODD[:ROWS])]


def _sparse(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    for row, c in enumerate(cells(keys)):
        c.sort()
        new = np.concatenate([[True], c[1:] != c[:-1]])
        again = np.unique(c[~new])
        once = c[new]
        shards = np.unique(once // SHARD)
        cut1, cut2 = np.searchsorted(once, np.append(shards, shards[-1] + 1) * SHARD), np.searchsorted(again, np.append(shards, shards[-1] + 1) * SHARD)
        cut1[1:], cut2[1:] = np.searchsorted(once, (shards + 1) * SHARD), np.searchsorted(again, (shards + 1) * SHARD)
        low1, low2 = (once % SHARD).astype("<u2"), (again % SHARD).astype("<u2")
        start2 = np.searchsorted(again, shards * SHARD)
        ones = [low1[a:b].tobytes() for a, b in zip(cut1[:-1].tolist(), cut1[1:].tolist())]
        twos = [low2[a:b].tobytes() for a, b in zip(start2.tolist(), cut2[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shards), row, np.int32)), pa.array(shards.astype(np.int32)), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())], ["row", "shard", "once", "again"])


def repeated_cells(source: DataFrame, keys_of: Callable[[list[bytes]], Iterator[np.ndarray]]) -> np.ndarray:
    """One bit for each cell: whether the keys of all rows of ``source(raw)`` count it twice or more."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for keys in keys_of(batch.column(0)):
                held.append(keys)
                n += len(keys)
                if n > MOST:
                    yield from _sparse(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield from _sparse(np.concatenate(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by shard: one shard's counts are held at a time
        count, last = np.zeros(SHARD, np.uint8), None
        done: list[tuple[int, int, bytes]] = []

        def settled() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.int32()), pa.array([x[2] for x in done], pa.binary())], ["row", "shard", "bits"])

        for batch in batches:
            for row, shard, once, again in zip(*(batch.column(i) for i in range(4))):
                key = row.as_py(), shard.as_py()
                if key != last:
                    if last is not None:
                        done.append((*last, np.packbits(count > 1).tobytes()))
                        count[:] = 0
                    last = key
                at = np.frombuffer(once.as_buffer(), "<u2")
                count[at] = np.minimum(count[at] + 1, 2)
                count[np.frombuffer(again.as_buffer(), "<u2")] = 2
            if len(done) >= 64:
                yield settled()
                done = []
        if last is not None:
            done.append((*last, np.packbits(count > 1).tobytes()))
            yield settled()

    sparse = source.mapInArrow(part, "row int, shard int, once binary, again binary")
    merged = sparse.repartition("row", "shard").sortWithinPartitions("row", "shard").mapInArrow(merge, "row int, shard int, bits binary")
    got = merged.toArrow()  # at most ROWS * CELLS / 8 bytes
    bits = np.zeros((ROWS, CELLS // 8), np.uint8)
    for row, shard, x in zip(got["row"].to_pylist(), got["shard"].to_pylist(), got["bits"]):
        bits[row, shard * SHARD // 8 : (shard + 1) * SHARD // 8] = np.frombuffer(x.as_py(), np.uint8)
    return bits


def maybe_repeated(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's estimate is two or more."""
    left = np.arange(len(keys))
    for row in range(ROWS):
        c = cells(keys[left])[row]
        left = left[(bits[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(keys), bool)
    out[left] = True
    return out


def ordered(docs: DataFrame) -> DataFrame:
    """``(ord, doc_id, raw)``: every row with a number of its own that rises with doc_id, null first.

    doc_id is that number where no id is repeated.  Else rows are numbered in the
    order of doc_id and text: rows that repeat an id are documents of their own.
    """
    rows = docs.select(id_key(F.col("doc_id")).alias("ord"), "doc_id", utf8(F.col("text")).alias("raw"))
    if docs.groupBy(id_key(F.col("doc_id")).alias("k")).count().where("count > 1").limit(1).count():
        dealt = rows.repartitionByRange("ord", "raw").sortWithinPartitions("ord", "raw")
        rows = written(dealt.select(F.monotonically_increasing_id().alias("ord"), "doc_id", "raw"), "ordered")
    return rows


def gathered(raws, most: int = MOST) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch, a few at a time: (place of the first, the texts)."""
    held, n, first = [], 0, 0
    for i, raw in enumerate(raws):
        raw = raw.as_py()
        if held and n + len(raw) > 4 * most:
            yield first, held
            held, n, first = [], 0, i
        held.append(raw)
        n += len(raw)
    if held:
        yield first, held


__all__ = ["NULL_ID", "gathered", "joined", "maybe_repeated", "minimizers", "mixed", "ordered", "packed", "places", "repeated_cells", "runs"]
