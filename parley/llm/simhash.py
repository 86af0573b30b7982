"""SimHash near-duplicates: a binary-trie self-join over fingerprints.

Two trie nodes are walked together; the bits in which their paths differ are
added up, and a pair of nodes is dropped as soon as the sum exceeds the budget.
Walked from the root, the budget prunes nothing near the top.  So the trie is
built once for each of ``budget + 1`` rotations of the fingerprint: cut into
that many blocks, two fingerprints within the budget have a rotation in which
the first j blocks differ in at most ``j * budget / blocks`` bits, for every j
(pigeonring principle).  The first block is thus equal, and the subtrees below
it are independent tasks.  A crowded subtree is dealt out once more by its
second block, one task for each pair of child nodes within the budget.

Within a task pairs are joined into a spanning forest, so equal or similar
fingerprints never leave it as all pairs; no link between classes is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER_AZ, id_key, unused, utf8, written
from .components import components

#: A subtree with more fingerprints is dealt out by its second block.
CROWDED = 1 << 17
#: Node pairs that one step of the walk holds.
CHUNK = 1 << 19
_M64 = (1 << 64) - 1


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``width``-word shingle of the text, repeats included."""
    words = raw.translate(LOWER_AZ).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[: n - width]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s : e - 1], 42) for s, e in zip(starts, ends[width - 1 :])), np.uint64, n - width + 1)


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority_bits(h: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; no hashes: zero."""
    n = len(h)
    if not n:
        return 0
    octets = np.ascontiguousarray(h).view(np.uint8).reshape(n, 8)
    if n < 400:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int32)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of each hash (splitmix64 finaliser)."""
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & _M64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, width: int = 4, extra: int = 0) -> DataFrame:
    """``(doc_id, fp long, more array<long>)`` for every row: the SimHash, and ``extra`` further words of it.

    A null or empty text has fingerprint zero.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, more = [], []
            for raw in batch.column(1):
                h = shingle_hashes(raw.as_py(), width)
                fps.append(majority_bits(h))
                more.append([majority_bits(_mixed(h, k)) for k in range(1, extra + 1)])
            signed = [np.array(x, np.uint64).view(np.int64).tolist() for x in more]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(signed, pa.list_(pa.int64()))], ["doc_id", "fp", "more"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8(F.col("text")).alias("raw")).mapInArrow(run, f"doc_id {kind}, fp long, more array<long>")


def _blocks(budget: int) -> list[int]:
    """Where each of budget + 1 blocks of the 64 bits starts, and 64."""
    return [i * 64 // (budget + 1) for i in range(budget + 2)]


def _allowed(budget: int, turn: int) -> list[int]:
    """For each depth, the most differing bits by then, the blocks taken from ``turn`` on."""
    cuts, n = _blocks(budget), budget + 1
    widths = [cuts[(turn + j) % n + 1] - cuts[(turn + j) % n] for j in range(n)]
    out = [0]
    for j, w in enumerate(widths):
        out += [(j + 1) * budget // n] * w
    return out


class _Forest:
    """Classes of 0..n-1, joined in bulk; each is named by its smallest member."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.of[i], self.of[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while (up := self.of[self.of]).tobytes() != self.of.tobytes():
                self.of = up


def walk(x: np.ndarray, nodes: np.ndarray, depth: int, differing: int, allowed: list[int], verify, forest: _Forest) -> None:
    """Walk pairs of trie nodes over the sorted ``x``, from the columns (lo, hi, lo2, hi2) of ``nodes`` on.

    A node is a range of ``x`` that shares its first ``depth`` bits.  Pairs left with few leaves are compared leaf by
    leaf: ``verify(i, j)`` says which are linked.
    """
    budget = allowed[-1]
    stack = [(nodes, depth, np.full(nodes.shape[1], differing))]
    while stack:
        nodes, depth, diff = stack.pop()
        if nodes.shape[1] > CHUNK:
            half = nodes.shape[1] // 2
            stack += [(nodes[:, :half], depth, diff[:half]), (nodes[:, half:], depth, diff[half:])]
            continue
        lo, hi, lo2, hi2 = nodes
        size = (hi - lo) * (hi2 - lo2)
        few = size <= 16
        if few.any():
            a, b, c, d = nodes[:, few]
            for first in range(0, len(a), CHUNK // 4):
                part = slice(first, first + CHUNK // 4)
                across = (d - c)[part]
                n = (b - a)[part] * across
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                across = np.repeat(across, n)
                i, j = np.repeat(a[part], n) + at // across, np.repeat(c[part], n) + at % across
                near = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
                i, j = i[near], j[near]
                if verify is not None and len(i):
                    ok = verify(i, j)
                    i, j = i[ok], j[ok]
                forest.join(i, j)
        big = ~few
        if not big.any():
            continue
        lo, hi, lo2, hi2, diff = lo[big], hi[big], lo2[big], hi2[big], diff[big]
        bit = np.uint64(1 << (63 - depth))
        above = np.uint64(_M64 ^ ((1 << (64 - depth)) - 1))
        mid, mid2 = np.searchsorted(x, (x[lo] & above) | bit), np.searchsorted(x, (x[lo2] & above) | bit)
        mid, mid2 = np.clip(mid, lo, hi), np.clip(mid2, lo2, hi2)
        cross = lo != lo2
        parts, diffs = [], []
        for a, b, c, d, e in (
            (lo, mid, lo2, mid2, diff),
            (mid, hi, mid2, hi2, diff),
            (lo, mid, mid2, hi2, diff + 1),
            (mid[cross], hi[cross], lo2[cross], mid2[cross], diff[cross] + 1),
        ):
            keep = (a < b) & (c < d) & (e <= allowed[depth + 1])
            parts.append(np.stack([a[keep], b[keep], c[keep], d[keep]]))
            diffs.append(e[keep])
        nodes = np.concatenate(parts, axis=1)
        if nodes.shape[1]:
            stack.append((nodes, depth + 1, np.concatenate(diffs)))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x if by % 64 == 0 else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def links(fps: DataFrame, budget: int = 4, total: int | None = None, crowded: int = CROWDED) -> DataFrame:
    """``fps(fp, more)``, fp distinct, to edges ``(a, b)`` between fingerprints that span every class.

    Two are linked if they differ in at most ``budget`` bits and, where ``total``
    is given, in at most ``total`` bits with the further words counted in.
    """
    cuts = _blocks(budget)
    turns = [{"turn": t, "by": cuts[t], "first": _width(cuts, t, budget), "second": _width(cuts, t + 1, budget)} for t in range(budget + 1)]

    def rotl(by: int):
        return F.col("fp") if not by else F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", 64 - by))

    keyed = fps.select(
        "fp", "more", F.explode(F.array(*[F.struct(F.lit(t["turn"]).alias("turn"), F.shiftrightunsigned(rotl(t["by"]), 64 - t["first"]).alias("k"), F.shiftrightunsigned(F.shiftleft(rotl(t["by"]), t["first"]), 64 - t["second"]).alias("u")) for t in turns])).alias("at")
    ).select("fp", "more", "at.*")
    # at most (budget + 1) * 2**13 rows, whatever the input
    hot = written(keyed.groupBy("turn", "k").count().where(F.col("count") > crowded).select("turn", "k", F.lit(True).alias("hot")), "roots")
    if budget and hot.limit(1).count():
        second = F.lit(max(t["second"] for t in turns))
        flips = F.transform(F.sequence(F.lit(0), second - 1), lambda b: F.col("u").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
        pairs = F.concat(F.array(F.struct(F.col("u").alias("p"), F.col("u").alias("q"))), F.transform(flips, lambda v: F.struct(F.least("u", v).alias("p"), F.greatest("u", v).alias("q"))))
        keyed = keyed.join(F.broadcast(hot), ["turn", "k"], "left").select("fp", "more", "turn", "k", F.explode(F.when(F.col("hot"), pairs).otherwise(F.array(F.struct(F.lit(-1).cast("long").alias("p"), F.lit(-1).cast("long").alias("q"))))).alias("pq")).select("fp", "more", "turn", "k", "pq.p", "pq.q")
    else:
        keyed = keyed.select("fp", "more", "turn", "k", F.lit(-1).cast("long").alias("p"), F.lit(-1).cast("long").alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        fp = rows.column("fp").to_numpy().view(np.uint64)
        key = [rows.column(c).to_numpy() for c in ("turn", "k", "p", "q")]
        words = len(rows.column("more")[0])
        more = rows.column("more").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(fp), words) if words else None
        turned = fp.copy()
        for t in turns:
            of = key[0] == t["turn"]
            turned[of] = _rotated(fp[of], t["by"])
        order = np.lexsort([turned, key[3], key[2], key[1], key[0]])
        turned, fp = turned[order], fp[order]
        key = [k[order] for k in key]
        more = more[order] if words else None
        # a crowded subtree's node pair is a task of its own; the other subtrees of a turn are walked together
        new = np.any([k[1:] != k[:-1] for k in (key[0], key[2], key[3])], axis=0) | ((key[1][1:] != key[1][:-1]) & (key[2][1:] >= 0))
        new = np.flatnonzero(np.concatenate([[True], new]))
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(fp)]):
            x, own = turned[lo:hi], more[lo:hi] if words else None
            t = turns[int(key[0][lo])]
            p, q, depth = int(key[2][lo]), int(key[3][lo]), t["first"]
            forest = _Forest(len(x))

            def verify(i, j, x=x, own=own):
                return np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(own[i] ^ own[j]).sum(1, dtype=np.int64) <= total

            if p < 0:
                cut = np.flatnonzero(np.concatenate([[True], key[1][lo + 1 : hi] != key[1][lo : hi - 1]]))
                ends = np.append(cut[1:], len(x))
                nodes = np.stack([cut, ends, cut, ends])[:, ends - cut > 1]
            elif p == q:
                nodes, depth = np.array([[0], [len(x)], [0], [len(x)]]), depth + t["second"]
            else:
                depth += t["second"]
                mid = int(np.count_nonzero(x >> np.uint64(64 - depth) == x[0] >> np.uint64(64 - depth)))
                nodes = np.array([[0], [mid], [mid], [len(x)]])[:, : mid < len(x)]
            walk(x, nodes, depth, int(p != q), _allowed(budget, t["turn"]), verify if total is not None and words else None, forest)
            linked = np.flatnonzero(forest.of != np.arange(len(x)))
            if len(linked):
                own_fp = fp[lo:hi].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own_fp[linked]), pa.array(own_fp[forest.of[linked]])], ["a", "b"])

    return keyed.repartition("turn", "k", "p", "q").mapInArrow(run, "a long, b long")


def _width(cuts: list[int], block: int, budget: int) -> int:
    block %= budget + 1
    return cuts[block + 1] - cuts[block]


def near_groups(docs: DataFrame, width: int = 4, budget: int = 4, extra: int = 0, total: int | None = None, crowded: int = CROWDED) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    component_id is the smallest doc_id reachable over links, the row's own
    included.  A null doc_id counts as the smallest.  Repeated rows each get
    their row; a row with a null or empty text has fingerprint zero and is linked
    like any other; texts of any length count whole; an empty table gives an
    empty result; columns other than doc_id and text are ignored.
    """
    prints = written(fingerprints(docs, width, extra), "prints")
    fps = written(prints.groupBy("fp").agg(F.min(id_key(F.col("doc_id"))).alias("least"), F.min("more").alias("more")), "fps")
    linked = components(links(fps.select("fp", "more"), budget, total, crowded))
    roots = fps.join(linked, fps.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    grouped = written(roots.groupBy("root").agg(F.min("least").alias("component")), "groups")
    of = written(roots.join(grouped, "root").select("fp", "component"), "classes")
    kind = prints.schema["doc_id"].dataType
    component = F.when(F.col("component") != F.lit(-(2**63)), F.col("component")).cast(kind)
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


#: 64-bit words of the fingerprints of whole sets, how many of them are joined by, and most differing bits in one and in all.
#: Of two sets of similarity 0.8 a bit differs with a probability of 0.151: a pair is missed by all joins, or by the
#: total, with one of 0.001.
WORDS, JOINED, WORD_BITS, ALL_BITS = 9, 4, 12, 120
#: Sets compared with each other in one step.
SETS = 128


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """The distinct shingle hashes of the text, sorted."""
    return np.unique(shingle_hashes(raw, width))


def _set_name(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), 7) - (1 << 63)


def _near(x: np.ndarray, y: np.ndarray, both: np.ndarray | int, least: float):
    return both >= least * (x + y - both) - 1e-9


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets, ``sets(node, hashes)``, have a similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                ok.append(bool(_near(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), least)))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    x, y = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _candidate_classes(nodes: DataFrame) -> DataFrame:
    """``(node, class)`` of ``nodes(node, words)`` that may be near another: the classes of the trie joins of JOINED words.

    Sets with an equal word are taken together without a look at the others.
    """
    edges = None
    for w in range(JOINED):
        own = nodes.select("node", F.get("words", F.lit(w)).alias("fp"), "words")
        fps = written(own.groupBy("fp").agg(F.min("words").alias("more"), F.count("*").alias("n"), F.min("node").alias("first")), "fps")
        near = links(fps.select("fp", F.filter("more", lambda x, i: i != w).alias("more")), WORD_BITS, ALL_BITS)
        first = fps.select(F.col("fp").alias("f"), "first")
        got = near.join(first, near.a == F.col("f")).select("b", F.col("first").alias("x")).join(first, F.col("b") == F.col("f")).select("x", F.col("first").alias("y"))
        same = own.join(fps.where("n > 1").select("fp", "first"), "fp").select(F.col("node").alias("x"), F.col("first").alias("y")).where("x <> y")
        edges = got.unionByName(same) if edges is None else edges.unionByName(got).unionByName(same)
    return written(components(edges.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("root", "class"), "classes")


def _linked_across(now: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` between different roots within the classes of ``now(node, class, root)``, as many as span them.

    Sets outside a class's largest root are compared with all of the class, SETS
    by SETS: a row for each set and block, not for each pair.
    """
    sizes = now.groupBy("class", "root").agg(F.count("*").alias("n"))
    of = sizes.groupBy("class").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    of = written(of.select("class", F.col("top.root").alias("top"), F.ceil(F.col("all") / SETS).alias("wide"), F.ceil((F.col("all") - F.col("top.n")) / SETS).alias("rest")), "open")
    rows = now.join(of, "class").withColumn("h", F.xxhash64("node"))
    right = rows.select("class", "node", "root", F.lit(1).alias("side"), F.pmod("h", "wide").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest") - 1)).alias("i"))
    left = rows.where("root <> top").select("class", "node", "root", F.lit(0).alias("side"), F.pmod("h", "rest").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)).alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def settled() -> Iterator[pa.RecordBatch]:
            if not sides[0] or not sides[1]:
                return
            all_ = np.concatenate([x[2] for x in sides[1]])
            owner = np.repeat(np.arange(len(sides[1])), [len(x[2]) for x in sides[1]])
            order = np.argsort(all_, kind="stable")
            all_, owner = all_[order], owner[order]
            n = np.array([len(x[2]) for x in sides[1]])
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    x = root[x]
                return x

            a, b = [], []
            for node, own, h in sides[0]:
                lo, hi = np.searchsorted(all_, h, "left"), np.searchsorted(all_, h, "right")
                times = hi - lo
                at = np.repeat(lo, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                both = np.bincount(owner[at], minlength=len(n))
                for k in np.flatnonzero(_near(len(h), n, both, least)).tolist():
                    x, y = find(own), find(sides[1][k][1])
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        a.append(node), b.append(sides[1][k][0])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for c, i, j, side, node, own, h in zip(*(batch.column(k) for k in range(7))):
                at = (c.as_py(), i.as_py(), j.as_py())
                if at != key:
                    yield from settled()
                    key, sides = at, ([], [])
                sides[side.as_py()].append((node.as_py(), own.as_py(), np.frombuffer(h.as_buffer(), np.uint64)))
        yield from settled()

    dealt = left.unionByName(right).join(sets, "node").select("class", "i", "j", "side", "node", "root", "hashes")
    return dealt.repartition("class", "i", "j").sortWithinPartitions("class", "i", "j").mapInArrow(run, "a long, b long")


def near_classes(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """``(id, node, root)`` for every row of ``docs``: rows with the same root are near copies, or linked by such.

    Texts are near when their sets of ``width``-word shingles have a similarity of
    ``least`` or more (with candidates chosen for 0.8 or more).  Candidates come
    from trie self-joins over words of the sets' fingerprints; each link is
    confirmed by the sets themselves.  A candidate class is first compared with
    three of its sets, then what is still apart.  Texts with equal sets are one,
    as all empty and null ones are.  A null doc_id counts as the smallest
    (``id``); repeated rows each get their row; an empty table gives an empty
    result; columns other than doc_id and text are ignored; a text may have any
    length.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(raw.as_py(), width) for raw in batch.column(1)]
            words = [[majority_bits(h if not k else _mixed(h, k)) for k in range(WORDS)] for h in sets]
            signed = np.array(words, np.uint64).reshape(len(words), WORDS).view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_set_name(h) for h in sets], pa.int64()), pa.array(signed, pa.list_(pa.int64()))], ["id", "node", "words"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(raw.as_py(), width) for raw in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_set_name(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "hashes"])

    rows = docs.select(id_key(F.col("doc_id")).alias("id"), utf8(F.col("text")).alias("raw"))
    prints = written(rows.mapInArrow(sketch, "id long, node long, words array<long>"), "prints")
    nodes = written(prints.groupBy("node").agg(F.min("id").alias("id"), F.min("words").alias("words")), "nodes")
    classes = _candidate_classes(nodes.select("node", "words"))
    wanted = nodes.join(classes, "node", "left_semi").select("id").distinct()
    sets = written(rows.join(wanted, "id", "left_semi").select("raw").mapInArrow(hashes, "node long, hashes binary").groupBy("node").agg(F.min("hashes").alias("hashes")), "sets")
    hub = classes.groupBy("class").agg(F.array_distinct(F.array(F.min("node"), F.max("node"), F.min_by("node", F.xxhash64("node")))).alias("hubs"))
    tried = classes.join(hub, "class").select(F.explode("hubs").alias("a"), F.col("node").alias("b")).where("a <> b")
    linked = written(_confirmed(tried, sets, least), "linked")
    root = written(components(linked), "roots")
    now = written(classes.join(root, "node", "left").select("node", "class", F.coalesce("root", "node").alias("root")), "now")
    more = written(_linked_across(now, sets, least), "more")
    root = written(components(linked.unionByName(more)), "roots")
    return prints.select("id", "node").join(root, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))


def one_of_each_group(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies, all columns kept: of each group of ``near_classes`` the smallest doc_id stays.

    Rows that share a doc_id stay or go together: they stay if one of them is to
    stay.  Nulls, empty texts and ties are as in ``near_classes``; extra columns
    may have any names.
    """
    grouped = written(near_classes(docs, width, least), "grouped")
    smallest = grouped.groupBy("root").agg(F.min("id").alias("least"))
    key = unused(docs, "key")
    gone = grouped.join(smallest, "root").groupBy("id").agg(F.max(F.col("id") == F.col("least")).alias("keep")).where("not keep").select(F.col("id").alias(key))
    return docs.join(written(gone, "gone"), id_key(F.col("doc_id")) == F.col(key), "left_anti")
