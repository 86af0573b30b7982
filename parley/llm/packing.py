"""Documents as token ids, packed into sequences of one size.

A document is its text's ids and an end mark.  Only longer ones are cut, and cuts
are counted from the document's end: all pieces but the first are full.  Pieces
are packed best-fit decreasing: longest first, each into the open sequence with
the least room that takes it, found in a segment tree over what room is left.

Pieces are dealt at random into groups of a few thousand, packed each on its own
as its rows stream by, sorted by length: a group's open sequences are all that a
task holds, and what a group wastes is a part of its last sequence.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import unused, written

#: Characters that are encoded together.
JOINT = 1 << 20
#: A run of blanks of this length goes another way: the faster library's regular expression would run out of stack.
_BLANKS = "[\\s]{2000}"


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encodes texts as ``tokenizers`` does with the file at ``path`` and ``add_special_tokens=False``.

    Byte-level BPE whose ids rise with the order of its merges has the same ids by
    ``tiktoken``, several times faster, and goes there; texts with an added
    token's string or a very long run of blanks and all other files go through ``tokenizers``.
    """
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def plain(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in slow.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, {x["content"] for x in spec.get("added_tokens", [])}
    wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model.get("type") != "BPE" or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or any(pre.get(k, True) != v for k, v in wanted.items()):
        return plain
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    at = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if at != sorted(at):
        return plain
    import tiktoken

    # bytes that stand for themselves, and the letters that stand for the others, in the order of the bytes
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
    known = tiktoken.registry.ENCODINGS  # kept while a worker process lives
    if path not in known:
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        known[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items()}, special_tokens={})
    fast, odd = known[path], re.compile("|".join([*map(re.escape, sorted(added)), _BLANKS]))
    return lambda texts: [plain([t])[0] if odd.search(t) else fast.encode_ordinary(t) for t in texts]


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: each row of ``docs`` as pieces of at most ``size`` ids.

    ``ids`` holds unsigned little-endian 32-bit numbers, the document's followed by
    ``end``.  Null and empty texts are one piece with ``end`` alone; rows that repeat a doc_id are
    documents of their own, null ids stay null.  Texts of any length are encoded whole. ``tokenizer``: a file that all executors can read.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)

        def cut(names: list, texts: list[str]) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], []]
            for name, ids in zip(names, encode(texts)):
                x = np.array([*ids, end], "<u4")
                edges = [0, *range(len(x) % size or size, len(x) + 1, size)] if len(x) > size else [0, len(x)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    for c, v in zip(cols, (name, k, a, b - a, x[a:b].tobytes())):
                        c.append(v)
            types = [names.type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids"])

        for batch in batches:
            names, first, held, n = batch.column(0), 0, [], 0
            for i, text in enumerate(batch.column(1)):
                held.append(text.as_py() or "")
                n += len(held[-1])
                if n > JOINT:
                    yield cut(names[first : i + 1], held)
                    first, held, n = i + 1, [], 0
            if held:
                yield cut(names[first:], held)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids binary")


class Rooms:
    """Open sequences by the room left in them; a segment tree tells which rooms there are."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def put(self, room: int, name: int) -> None:
        self.open.setdefault(room, []).append(name)
        i = room + self.leaves
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, name) of a sequence with the least room of ``need`` or more, which then isn't open any more."""
        tree, i = self.tree, need + self.leaves
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        name = self.open[room].pop()
        if not self.open[room]:
            tree[i] = 0
            while i > 1 and not tree[i ^ 1]:
                i >>= 1
                tree[i] = 0
        return room, name


def packed(parts: DataFrame, size: int = 2048, group: int = 5_000) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``: where each row of ``length`` ids lies.

    Places in a sequence are gapless from 0.  ``group``: about how many pieces are
    packed together.  Lengths are 1 to ``size``; ties go by the row's number. Rows of an empty table: none.
    """
    row, dealt = unused(parts, "_row"), unused(parts, "_group")
    kept = written(parts.withColumn(row, F.monotonically_increasing_id()), "pieces")
    groups = -(-kept.count() // group) or 1
    rows = kept.withColumn(dealt, F.pmod(F.xxhash64(row), F.lit(groups))).repartition(dealt).sortWithinPartitions(dealt, F.desc("length"), row)
    names = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rooms, last, new = Rooms(size), None, 0
        for batch in batches:
            ids, offsets = [], []
            for g, n in zip(batch.column(dealt).to_pylist(), batch.column("length").to_pylist()):
                if g != last:
                    rooms, last, new = Rooms(size), g, g << 32
                room, name = rooms.take(n) or (size, new)
                new += name == new
                if room > n:
                    rooms.put(room - n, name)
                ids.append(name)
                offsets.append(size - room)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

    more = F.lit(0).cast("long")
    return rows.mapInArrow(run, parts.select("*", more.alias("sequence_id"), more.alias("offset")).schema)


def sequences(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0) -> DataFrame:
    """``(sequence_id, length, ids, doc_ids)``: the packed sequences themselves, ids as in :func:`pieces`."""
    rows = packed(pieces(docs, tokenizer, size, end), size)
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", F.hex("ids").alias("ids"))))
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), held.alias("held")).select(
        "sequence_id", "length", F.unhex(F.array_join("held.ids", "")).alias("ids"), F.col("held.doc_id").alias("doc_ids"))
