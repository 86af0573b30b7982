"""SimHash, exact, line, suffix-array and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from parley.llm import exact, gsaca, lines, simhash, sketch, substrings, suffixes
from parley.llm.grams import BLOCK, Grams
from parley.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute_fingerprint(text, width=4):
    w = WORD.findall(lower(text))
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, linked):
    of = list(range(len(ids)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                of[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        low[root(i)] = min(low.get(root(i), d), d)
    return [low[root(i)] for i in range(len(ids))]


def test_simhash_groups(docs, corpus):
    got = {r[0]: (r[1], r[2]) for r in simhash.near_groups(docs).collect()}
    fps = [brute_fingerprint(t) for _, t, *_ in corpus]
    ids = [c[0] for c in corpus]
    want = brute_components(ids, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert got == {d: (f"{f:016x}", c) for d, f, c in zip(ids, fps, want)}


@pytest.mark.parametrize("budget", [0, 1, 4, 9])
@pytest.mark.parametrize("crowded", [1 << 17, 3])
def test_trie_join_finds_every_class(spark, budget, crowded):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    x = [base, np.full(60, base[0]), np.full(60, base[1])]
    for y in x[1:]:
        for _ in range(budget + 1):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
    x = np.unique(np.concatenate(x))
    fps = spark.createDataFrame([(int(v), []) for v in x.view(np.int64)], "fp long, more array<long>")
    root = {r[0]: r[1] for r in components(simhash.links(fps, budget, crowded=crowded)).collect()}
    want = brute_components(x.view(np.int64).tolist(), lambda i, j: int(x[i] ^ x[j]).bit_count() <= budget)
    assert [root.get(v, v) for v in x.view(np.int64).tolist()] == want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(200, 260)] + [(7, 7), (8, 9), (9, 8)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 5 for i in [5, *range(200, 260)]} | {8: 8, 9: 8}


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(1)
    words = [f"v{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(5):
        near = list(base[i])
        near[100] = "changed"
        rows.append((100 + i, " ".join(near)))
    kept = {r[0] for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(30))


def test_exact_duplicates(docs, corpus):
    got = {r.doc_id: r for r in exact.duplicates(docs).collect()}
    by = {}
    for d, t, *_ in corpus:
        by.setdefault(lower(t), []).append(d)
    for d, t, *_ in corpus:
        g, r = by[lower(t)], got[d]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), d == max(g), hashlib.sha256(lower(t).encode()).hexdigest())


def test_chunks_are_the_text(spark):
    rng = random.Random(2)
    texts = ["", "x", "é" * 9000, "".join(rng.choice("abc defghé\n") for _ in range(30000))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact.chunks("t").alias("c")).collect()
    assert all("".join(r.c) == r.t for r in rows)
    assert len(rows[3].c) > 10


def test_exact_odd_rows(odd, empty):
    r = exact.duplicates(odd).collect()
    assert sum(x.kept for x in r) == 4 and len(r) == 6
    assert {(x.doc_id, x.keep_id, x.group_size) for x in r} == {(None, None, 1), (1, 2, 3), (1, 1, 1), (2, 2, 3), (3, 3, 1)}
    left = exact.deduplicated(odd)
    assert left.columns == odd.columns and sorted((x.doc_id or 0, x.text or "") for x in left.collect()) == sorted([(0, "some words that are here for everyone to read now"), (1, "other text"), (2, "b c d"), (3, "")])
    assert exact.duplicates(empty).count() == 0


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randint(0, rng.choice([1, 2, 4, 200])) for _ in range(rng.randint(0, 60))]
        assert gsaca.suffix_array(a) == sorted(range(len(a)), key=lambda i: a[i:])


def brute_bytes(rows, window):
    first = {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        for j in range(len(b) - window + 1):
            first.setdefault(b[j : j + window], d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - window + 1):
            if first[b[j : j + window]] < d:
                gone[j : j + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1])), kept)
    return out


def test_near_copies_against_brute_force(spark):
    """Pairs on both sides of a similarity of 0.8, a large group and a chain; every link is exact and none is missed."""
    rng = random.Random(8)
    fresh = iter(range(10**6))
    word = lambda: f"v{next(fresh)}"
    texts = []
    for k in range(60):  # 150 words; a changed word takes five shingles away
        base = [word() for _ in range(150)]
        other = list(base)
        for at in rng.sample(range(5, 140, 6), 3 + k % 4):
            other[at] = word()
        texts += [base, other]
    base = [word() for _ in range(300)]
    for _ in range(70):
        other = list(base)
        other[rng.randrange(300)] = word()
        texts.append(other)
    for _ in range(6):  # each is near the one before, the ends are far apart
        base = [*base[20:], *(word() for _ in range(20))]
        texts.append(base)
    rows = list(enumerate(" ".join(t) for t in texts))
    rng.shuffle(rows)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    similar = lambda x, y: 10 * len(x & y) >= 8 * len(x | y)
    ids = [i for i, _ in rows]
    want = brute_components(ids, lambda i, j: similar(sets[i], sets[j]))
    near = [len(a & b) / len(a | b) for a, b in (({tuple(x[i : i + 5]) for i in range(146)}, {tuple(y[i : i + 5]) for i in range(146)}) for x, y in zip(texts[:120:2], texts[1:120:2]))]
    assert sum(0.8 <= x <= 0.85 for x in near) >= 10 and sum(0.65 < x < 0.8 for x in near) >= 10
    kept = [r[0] for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(kept) == sorted(set(want))


@pytest.mark.parametrize("window", [50, 20])
def test_byte_strings_that_repeat(docs, corpus, window):
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in suffixes.without_repeats(docs, window).collect()}
    assert got == brute_bytes([(d, t) for d, t, *_ in corpus], window)


@pytest.mark.parametrize("crowded", [1, 3, 50_000])
def test_byte_strings_of_crowded_minimizers(spark, crowded):
    """One passage with many surroundings, runs of one byte, and texts longer than a block."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, long_ = letters(60), letters(3 * BLOCK)
    texts = [letters(rng.randint(0, 20)) + passage + letters(rng.randint(0, 20)) for _ in range(30)]
    texts += ["-" * 300 + letters(5), letters(9) + "-" * 120, long_, letters(70) + long_[BLOCK - 300 : BLOCK + 4000] + "x", "", None, "é" * 40, "é" * 41]
    rows = list(enumerate(texts))
    want = brute_bytes(rows, 50)
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 50, crowded).collect()}
    assert got == want and sum(x[1] > 0 for x in got.values()) > 30


def test_byte_strings_within_a_text_and_of_rows_that_share_an_id(spark):
    """A text that holds a segment many times; ids that repeat, so that several rows wait for one sort."""
    rng = random.Random(31)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core, other = letters(90), letters(400)
    rows = [(9, letters(30).join([core] * 40)), (3, "x" + core[4:80] + "y"), (9, core + letters(8)), (9, core + "zz"), (7, other * 3), (7, other * 3), (2, letters(5) + other[100:300]), (12, core * 2 + other), (None, other[350:]), (None, other[350:])]
    first = {}
    for d, t in rows:
        for j in range(len(t) - 49):
            first[t[j : j + 50]] = min(first.get(t[j : j + 50], 99), -1 if d is None else d)
    want = []
    for d, t in rows:
        gone = [False] * len(t)
        for j in range(len(t) - 49):
            if first[t[j : j + 50]] < (-1 if d is None else d):
                gone[j : j + 50] = [True] * 50
        want.append((-1 if d is None else d, sum(gone), "".join(c for c, g in zip(t, gone) if not g)))
    for parts, crowded in ((1, 50_000), (4, 50_000), (4, 2)):
        got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), 50, crowded).collect()
        assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_removed, bytes(x.kept).decode()) for x in got) == sorted(want)


def brute_words(rows, window):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            x = tuple(w[j : j + window])
            if x in seen:
                gone[j : j + window] = [True] * window
            seen.add(x)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g).encode())
    return out


@pytest.mark.parametrize("window", [20, 3])
def test_word_windows_that_repeat(docs, corpus, window):
    got = {r[0]: (r[1], r[2], bytes(r[3])) for r in substrings.without_repeats(docs, window).collect()}
    assert got == brute_words([(d, t) for d, t, *_ in corpus], window)


@pytest.mark.parametrize("crowded", [1, 20, 150, 50_000])
def test_word_windows_of_crowded_minimizers(spark, crowded):
    """Few words and one passage, with many surroundings: its minimizers have many runs, in every task."""
    rng = random.Random(4)
    some = lambda n, words="abcd": " ".join(rng.choice(words) for _ in range(n))
    passage = some(9, "efghij")
    texts = [f"{some(rng.randint(0, 9))} {passage} {some(rng.randint(0, 9))}" for _ in range(400)]
    texts += [some(300, "a"), some(200, "ab"), "b " + some(90, "a"), *texts[:20], passage, "", None, " ".join([passage] * 30)]
    rows = list(enumerate(texts))
    got = {r[0]: (r[1], r[2], bytes(r[3])) for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 10, crowded).collect()}
    assert got == brute_words(rows, 10) and sum(x[1] > 0 for x in got.values()) > 100


def test_runs_that_turn_out_crowded_where_they_meet(spark):
    """No task has many runs of a minimizer, but all together have: what each window is told is the same."""
    rng = random.Random(7)
    some = lambda n: [rng.randrange(50) for _ in range(n)]
    rows = [(k, np.array(some(rng.randint(1, 6)), "<i8").tobytes(), o, rng.randrange(9), 1 + o % 2, 0) for o in range(300) for k in (5, o % 90)]
    found = spark.createDataFrame(rows, "k long, hashes binary, ord long, start int, times int, salt int").repartition(8)

    def told(crowded):
        out = substrings._resolved(found, crowded)
        assert (out.where("hashes IS NOT NULL").count() > 250) == (crowded == 20)
        parts = out.where("hashes IS NULL").select("k", "h", "parts").unionByName(substrings._by_window(out.where("hashes IS NOT NULL")))
        return {(r.k, r.h, at): (p.ord, p.start + at) for r in parts.collect() for p in r.parts for at in range(p.a, p.b)}

    assert told(20) == told(50_000)


def test_repeats_of_odd_rows(odd, empty):
    r = {(x.doc_id, bytes(x.kept)) for x in substrings.without_repeats(odd, 2).collect()}
    assert r == {(None, b"some words that are here for everyone to read now"), (1, b"b c d"), (1, b""), (1, b"other text"), (2, b""), (3, b"")}
    got = sorted(((x.doc_id or 0, x.n_removed, bytes(x.kept)) for x in suffixes.without_repeats(odd, 3).collect()))
    # rows that share an id lose nothing to each other
    assert got == [(0, 0, b"some words that are here for everyone to read now"), (1, 0, b"b c d"), (1, 0, b"b c d"), (1, 3, b"ot text"), (2, 5, b""), (3, 0, b"")]
    assert substrings.without_repeats(empty).count() == 0 and suffixes.without_repeats(empty).count() == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**40, 5000)
    keys = np.concatenate([keys, keys[:50]])
    bits = np.zeros((sketch.ROWS, sketch.CELLS // 8), np.uint8)
    for row, c in enumerate(sketch.cells(keys)):
        n = np.bincount(c)
        at = np.flatnonzero(n > 1)
        np.bitwise_or.at(bits[row], at >> 3, (128 >> (at & 7)).astype(np.uint8))
    found = sketch.maybe_repeated(bits, keys)
    assert found[:50].all() and found[5000:].all() and found.mean() < 0.05


def brute_lines(rows, least=20):
    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    first, out = {}, {}
    ls = sorted((d, n, x) for d, t in rows for n, x in enumerate((t or "").split("\n")))
    for d, n, x in ls:
        if x.strip(" "):
            first.setdefault(x, (d, n))
    drop = {x for x, at in first.items() if len(x) >= least and any(near(x, y) and first[y] < at for y in first if y != x and len(y) >= least)}
    for d, t in rows:
        out[d] = [n for n, x in enumerate((t or "").split("\n")) if x.strip(" ") and first[x] == (d, n) and x not in drop]
    return out


def test_lines(spark, docs, corpus):
    rng = random.Random(6)
    rows = [(d, t) for d, t, *_ in corpus]
    for i in range(30):
        base = "".join(rng.choice("abcdef é") for _ in range(rng.choice([19, 20, 21, 63, 64, 65, 66, 130, 300])))
        p = rng.randrange(len(base))
        made = [base, base[:p] + base[p + 1 :], base[:p] + "Z" + base[p + 1 :], base[:p] + "Z" + base[p:], base[: p // 2] + "QQQ" + base[p // 2 :]]
        rng.shuffle(made)
        rows.append((2000 + i, "\n".join(made[:3])))
        rows.append((3000 + rng.randint(0, 900) * 40 + i, "\n".join(made[3:])))
    got = {r.doc_id: r for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lines(rows)
    assert {d: r.kept for d, r in got.items()} == want
    assert sum(r.n_near for r in got.values()) > 20
    assert all(r.n_lines == r.n_blank + r.n_equal + r.n_near + len(r.kept) for r in got.values())


def test_lines_of_odd_rows(odd, empty):
    assert lines.line_dedup(odd).count() == 6 and lines.line_dedup(empty).count() == 0
    assert lines.without_lines(odd).columns == odd.columns


def test_minimizers_of_a_text_of_over_2_to_the_24():
    rng = np.random.default_rng(6)
    passage = rng.integers(97, 123, 400, dtype=np.uint8)
    text = rng.integers(97, 123, (1 << 24) + 5000, dtype=np.uint8)
    spots = [1000, sketch.BLOCK - 200, (1 << 24) - 200, (1 << 24) + 2000]
    for a in spots:
        text[a : a + 400] = passage
    joint = text.tobytes()
    keys, start, n, core = Grams(50, 32).segments(joint, np.array([0]), np.array([len(joint)]))
    end = start + n
    assert (core >= start).all() and (core - start <= 50 - 32).all() and (core >= end - 1).all() and int(n.sum()) == len(joint) - 49
    of = lambda a: keys[np.searchsorted(end, np.arange(a, a + 351), side="right")].tolist()
    assert all(of(a) == of(spots[0]) for a in spots) and len(set(of(spots[0]))) > 5
    grams = np.tile(rng.integers(0, 2**63, 1000, dtype=np.uint64), (1 << 24) // 1000 + 20)
    key = sketch.minimizers(grams, 13) >> np.uint64(24)
    assert (key[1000:] == key[:-1000]).all()


def test_simhash_of_odd_rows(odd, empty):
    r = sorted((x.doc_id or 0, x.component_id or 0) for x in simhash.near_groups(odd).collect())
    assert r == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert simhash.near_groups(empty).count() == 0 and simhash.one_of_each_group(odd).columns == odd.columns
