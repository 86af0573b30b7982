"""Benchmark decontamination by winnowing.

The smallest k-gram hash of every sliding window of w k-grams is kept, so any
``k + w - 1`` words in a row that a document shares with a benchmark item hold a
kept fingerprint of both.  Fingerprints of the two sides are joined, and each
hit is extended over the windows of words around it, word by word.

The benchmark side is cut into blocks of a bounded size, and each block is held
in memory by every task: no document text is shuffled, however long the
benchmark is.  With one block, as usual, the whole is a single narrow pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._common import LOWER_AZ, utf8

#: Bytes of item texts in one block, which every task holds.
BLOCK_BYTES = 16 << 20
_BREAKS = bytes(c for c in range(128) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A))
#: Lower-cases A-Z and turns every byte that is in no word into a blank.
_TO_WORDS = bytes(32 if LOWER_AZ[c] in _BREAKS else LOWER_AZ[c] for c in range(256))
_NONE = np.uint64(2**64 - 1)
_P = 0x9E3779B97F4A7C15


def words_of(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the UTF-8 text, A-Z lower-cased."""
    return raw.translate(_TO_WORDS).split()


def _gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k ids in a row; _NONE where one of them is -1, a word the benchmark lacks."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(k):
        part = ids[i : i + n]
        h = (h ^ part.astype(np.uint64)) * np.uint64(_P)
        h ^= h >> np.uint64(29)
        known &= part >= 0
    return np.where(known, h >> np.uint64(1), _NONE)


def winnowed(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash (ties: the last) of every w in a row; _NONE is never kept."""
    if len(h) < w:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(h[::-1], w)
    at = len(h) - 1 - np.unique(np.arange(len(windows)) + windows.argmin(1))
    return at[h[at] != _NONE]


class Block:
    """Windows and fingerprints of some items; ``items``: (item_id, text bytes)."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int, k: int):
        self.window, self.k = window, k
        self.vocab: dict[bytes, int] = {}
        self.windows: dict[bytes, int] = {}
        self.lists: list[list[int]] = []
        prints: dict[int, set[int]] = {}
        found: dict[bytes, set[int]] = {}
        for item, raw in items:
            words = words_of(raw)
            if not words:
                continue
            ids = np.fromiter((self.vocab.setdefault(x, len(self.vocab)) for x in words), np.int32, len(words))
            m = min(window, len(ids))
            for s in range(len(ids) - m + 1):
                found.setdefault(ids[s : s + m].tobytes(), set()).add(item)
            h = _gram_hashes(ids, min(k, m))
            prints.setdefault(m, set()).update(h[winnowed(h, m - min(k, m) + 1)].tolist())
        same: dict[tuple, int] = {}
        for key, who in found.items():
            of = tuple(sorted(i for i in who if i is not None))
            if of not in same:
                same[of] = len(self.lists)
                self.lists.append(list(of))
            self.windows[key] = same[of]
        #: by words in a window: k, kept fingerprints sorted
        self.prints = {m: (min(k, m), np.array(sorted(x), np.uint64)) for m, x in prints.items()}

    def hits(self, raw: bytes) -> tuple[int, np.ndarray, set[int]]:
        """Number of words, which of them are hit, ids of items with occurring windows."""
        words = words_of(raw)
        hit, lists = np.zeros(len(words), bool), set()
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, len(words))
        for m, (k, prints) in self.prints.items():
            h = _gram_hashes(ids, k)
            at = winnowed(h, m - k + 1)
            if not len(at):
                continue
            near = np.minimum(np.searchsorted(prints, h[at]), len(prints) - 1)
            at = at[prints[near] == h[at]]
            starts = np.unique((at[:, None] - np.arange(m - k + 1)).ravel())
            for s in starts[(starts >= 0) & (starts <= len(ids) - m)].tolist():
                of = self.windows.get(ids[s : s + m].tobytes())
                if of is not None:
                    hit[s : s + m] = True
                    lists.add(of)
        return len(words), hit, {i for x in lists for i in self.lists[x]}


def _blocks(benchmark: DataFrame, limit: int) -> list[DataFrame]:
    """The items in blocks of about ``limit`` bytes of text at most (a longer item is a block)."""
    total, most = benchmark.agg(F.sum(F.octet_length("raw")), F.max(F.octet_length("raw"))).first()
    n = 1 if (total or 0) <= limit else 2 * (-(-total // limit)) + 1
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(n)) == i) if n > 1 else benchmark for i in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, items array<long>)`` for every row of ``docs``.

    An item of fewer than ``window`` words, but not none, is one window.  Null
    texts have no words; an item with a null id hits words, but isn't in
    ``items``, as nothing could name it; items with equal ids count once; an
    empty benchmark hits nothing.  Repeated rows of documents each get their row;
    an empty table gives an empty result; texts are read whole, of any length.
    Other columns are ignored.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), utf8(F.col("text")).alias("raw")).distinct()
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", utf8(F.col("text")).alias("raw"))
    sc = docs.sparkSession.sparkContext

    def one(part: DataFrame, spans: bool) -> DataFrame:
        held = sc.broadcast([(r[0], bytes(r[1])) for r in part.collect()])  # at most block_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(held.value, window, k)
            for batch in batches:
                out = [block.hits(x.as_py()) for x in batch.column(1)]
                cols = [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([int(x[1].sum()) for x in out], pa.int64()), pa.array([sorted(x[2]) for x in out], pa.list_(pa.int64()))]
                names = ["doc_id", "n_words", "n_hit", "items"]
                if spans:
                    cols += [pa.array([hashlib.sha256(x.as_py()).digest() for x in batch.column(1)], pa.binary()), pa.array([np.packbits(x[1]).tobytes() for x in out], pa.binary())]
                    names += ["text_key", "hit_bits"]
                yield pa.RecordBatch.from_arrays(cols, names)

        more = ", text_key binary, hit_bits binary" if spans else ""
        return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<long>{more}")

    parts = _blocks(rows, block_bytes)
    if len(parts) == 1:
        return one(parts[0], spans=False)

    # several blocks: a pass for each, then the bits of a document are put together
    passes = [one(p, spans=True).withColumn("pass", F.lit(i)) for i, p in enumerate(parts)]
    union = passes[0]
    for p in passes[1:]:
        union = union.unionByName(p)

    @F.udf("long")
    def either(bits: list) -> int:
        if not bits or not bits[0]:
            return 0
        return int(np.bitwise_count(np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in bits])).sum())

    together = union.groupBy("doc_id", "text_key", "n_words").agg(
        F.sum(F.when(F.col("pass") == 0, 1).otherwise(0)).alias("times"), F.collect_set("hit_bits").alias("bits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    return together.select("doc_id", "n_words", either("bits").alias("n_hit"), "items", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_n")).drop("_n")


def _clean(held, window: int, k: int):
    def clean(raw: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = Block(held.value, window, k)
        for texts in raw:
            yield pa.array([not block.hits(x.as_py())[1].any() for x in texts], pa.bool_())

    clean.__annotations__ = {"raw": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(clean, "boolean")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without a word that is hit, all columns kept, whatever their names; nothing is shuffled.

    Null and empty texts have no words and stay; repeated rows stay or go alike;
    an empty benchmark or table is as in ``contamination``.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), utf8(F.col("text")).alias("raw")).distinct()
    for part in _blocks(rows, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast([(r[0], bytes(r[1])) for r in part.collect()])  # at most block_bytes
        docs = docs.where(_clean(held, window, k)(utf8(F.col("text"))))
    return docs
