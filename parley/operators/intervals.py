"""Spans that lie in others, by one walk over their names and a tree over their ends in place of comparing all pairs."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Spans:
    """Spans by number. Over their order by start lies a tree with the largest end and the smallest number of every part."""

    def __init__(self, spans: list[tuple]):
        order = sorted(range(len(spans)), key=lambda i: spans[i][0])
        self.starts = [spans[i][0] for i in order]
        self.leaves = 1
        while self.leaves < len(spans):
            self.leaves *= 2
        self.most, self.low, self.at = [None] * (2 * self.leaves), [len(spans)] * (2 * self.leaves), [0] * len(spans)
        for k, i in enumerate(order):
            self.at[i] = self.leaves + k
            self.most[self.leaves + k], self.low[self.leaves + k] = spans[i][1], i
        self.none = len(spans)
        for k in range(self.leaves - 1, 0, -1):
            self._join(k)

    def _join(self, k: int) -> None:
        a, b = self.most[2 * k], self.most[2 * k + 1]
        self.most[k] = b if a is None else a if b is None else max(a, b)
        self.low[k] = min(self.low[2 * k], self.low[2 * k + 1])

    def remove(self, n: int) -> None:
        k = self.at[n]
        self.most[k], self.low[k] = None, self.none
        while k := k // 2:
            self._join(k)

    def first(self, start, end, fits: Callable[[int], bool]) -> int | None:
        """The smallest number that fits of the spans that start at ``start`` or before and end at ``end`` or after."""
        upto, best, todo = bisect_right(self.starts, start), self.none, [(1, 0, self.leaves)]
        while todo:
            k, a, b = todo.pop()
            if a >= upto or self.low[k] >= best or self.most[k] < end:
                continue
            if k >= self.leaves:
                if fits(self.low[k]):
                    best = self.low[k]
                continue
            halves = [(2 * k, a, (a + b) // 2), (2 * k + 1, (a + b) // 2, b)]
            todo += halves if self.low[2 * k] >= self.low[2 * k + 1] else halves[::-1]
        return None if best == self.none else best


def into(spans: list[tuple], sizes: list[int], tolerance=0, start_only: bool = False, once: bool = False) -> list[int]:
    """For each of ``spans`` (start, end) the number of the one that it ends up in; its own if it stays.

    Spans come in the order of their numbers; one goes into the first other that
    holds it and is still there.  ``once``: whatever the sizes, one pass.  Else two of
    one row never join, and it goes on until nothing moves: one of one row that has taken others in may then hold those at its own place.
    """
    tree, parent, sizes = Spans([(a - tolerance, b + tolerance) for a, b in spans]), list(range(len(spans))), list(sizes)
    todo, waits = list(range(len(spans))), {}
    if not once:
        for i, n in enumerate(sizes):
            if n == 1:
                waits.setdefault(spans[i], []).append(i)
    while todo:
        i = heapq.heappop(todo)
        if parent[i] != i:
            continue
        a, b = spans[i]
        j = tree.first(a, a if start_only else b, lambda j, i=i: j != i and (once or sizes[i] > 1 or sizes[j] > 1))
        if j is None:
            continue
        parent[i] = j
        tree.remove(i)
        if not once:
            if sizes[j] == 1:  # it is no single row any more: those at its place may go into it now, or what it holds near it
                for x in waits.get(spans[j], ()) if not tolerance else (x for xs in waits.values() for x in xs):
                    if x != j and parent[x] == x:
                        heapq.heappush(todo, x)
                heapq.heappush(todo, j)
            sizes[j] += sizes[i]
    for i in range(len(spans)):
        root = i
        while parent[root] != root:
            root = parent[root]
        while parent[i] != root:
            parent[i], i = root, parent[i]
    return parent


def absorbed(spans: DataFrame, key: list[str], tolerance: float = 0, start_only: bool = False, once: bool = False) -> DataFrame:
    """``spans(*key, id, start, end, n)`` to ``(*key, id, into)``: which span of its key each one ends up in, see :func:`into`.

    ``start_only``: a span is held if its start is.  ``tolerance``: by how much it may
    reach over on either side.  ``id`` is one of a kind within its key, spans are taken in its order; a key's spans are in one task.
    """
    own = spans.select(*key, "id", "start", "end", "n").repartition(*key).sortWithinPartitions(*key, "id")
    k = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        schema = None

        def settled() -> pa.RecordBatch:
            to = into([r[k + 1 : k + 3] for r in held], [r[k + 3] for r in held], tolerance, start_only, once)
            cols = [*zip(*(r[: k + 1] for r in held)), [held[j][k] for j in to]]
            return pa.RecordBatch.from_arrays([pa.array(c, schema.field(min(i, k)).type) for i, c in enumerate(cols)], names=[*key, "id", "into"])

        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][:k] != row[:k]:
                    yield settled()
                    held = []
                held.append(row)
        if held:
            yield settled()

    return own.mapInArrow(run, own.select(*key, "id", F.col("id").alias("into")).schema)
