"""Collocations, source divergence and packing against brute force, on odd rows and with small limits."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parley.llm import collocations, divergence, packing, queries

SCHEMA = "doc_id long, text string, lang string, source string"

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"long{i % 700}" + (". " if i % 97 == 0 else "") for i in range(30_000))
ODD = [
    (1, "The cat sat. The cat sat! the\tcat\nsat", "en", "a"), (1, "The cat sat. The cat sat! the\tcat\nsat", "en", "a"), (None, "the cat", None, None), (2, None, "en", "b"), (3, "", "und", "a"), (4, " .;\n ", "en", "c"),
    (5, LONG, "en", "a"), (6, "a a a a a a a a a", "en", "b"), (7, "é b \x01 c\x01 É b", "de", "b"), (8, "a \x01 b a \x01 b a \x01 b", "en", "b"), (9, "A B a b A b", "", "")]


@pytest.fixture(scope="module")
def rows(spark):
    """Odd rows, beside columns with names that operators use."""
    more = ["n", "words", "term", "x", "shard", "row", "_row", "_group", "rank", "length"]
    return spark.createDataFrame([(*r, *["x"] * len(more)) for r in ODD * 2], SCHEMA + "".join(f", `{c}` string" for c in more)).repartition(3).cache()


def counted(texts, longest):
    import re

    f, n = defaultdict(Counter), Counter()
    for lang, text in texts:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(AZ)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + m])] += 1
    return f, n


def brute_collocations(texts, longest, least, percent, top):
    f, n = counted(texts, longest)
    out = set()
    for lang, c in f.items():
        found = []
        own = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        for g, a in own.items():
            score, k = min((1000 * a * n[lang] // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            held = any(len(h) > len(g) and 100 * b >= percent * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in own.items())
            if not held:
                found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for rank, (score, a, g, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, g.decode(), -a, l, r, n[lang], -score))
    return out


@pytest.mark.parametrize(("longest", "least", "percent", "small"), [(5, 2, 100, False), (5, 2, 60, True), (2, 1, 100, True), (3, 40, 90, False)])
def test_collocations(rows, corpus, docs, monkeypatch, longest, least, percent, small):
    if small:  # many shards, and texts cut anywhere
        monkeypatch.setattr(collocations, "SHARD", 3_000)
        monkeypatch.setattr(collocations, "SLICE", 1_000)
        monkeypatch.setattr(collocations, "RANGE", 2_000)
    for df, texts in ((rows, [(r[2], r[1]) for r in ODD * 2]), (docs, [(r[2], r[1]) for r in corpus])):
        if least == 1 and df is rows:
            continue  # brute force is quadratic in phrases
        got = [tuple(r) for r in collocations.collocations(df, longest, least, percent, top=50).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_collocations(texts, longest, least, percent, 50)


def test_no_collocations(empty, rows):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(rows.where("doc_id IN (2, 3, 4)")).count() == 0
    assert collocations.collocations(rows, least=10**6).count() == 0


def brute_divergence(texts, min_docs, most):
    import re

    n, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in texts:
        w = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(AZ))
        n[lang or "", source or ""].update(w)
        docs[lang or ""].update(set(w))
    out = set()
    for lang in docs:
        kept = sorted(t for t, d in docs[lang].items() if d >= min_docs)
        sources = sorted(s for g, s in n if g == lang)
        counts = {s: [n[lang, s][t] for t in kept] for s in sources}
        share = lambda c: [1 + 10**9 * (x + 5) // (sum(c) + 5 * len(kept)) for x in c]
        p, q = {s: share(c) for s, c in counts.items()}, share([sum(x) for x in zip(*counts.values())])
        for s in sources:
            pair = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode()) for o in sources if o != s)
            term = sorted((b - a, t.encode()) for t, c, a, b in zip(kept, counts[s], p[s], q) if c and a > b)[:most]
            out |= {(lang, s, part, o.decode(), -v, i) for part, found in (("pair", pair), ("term", term)) for i, (v, o) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize(("min_docs", "terms", "held"), [(1, 4, 10), (3, 50, 10**6), (10**6, 5, 100)])
def test_divergence(rows, docs, corpus, monkeypatch, min_docs, terms, held):
    monkeypatch.setattr(divergence, "MOST_HELD", held)
    monkeypatch.setattr(divergence, "SLICE", 500)
    for df, texts in ((rows, ODD * 2), (docs, corpus)):
        got = [tuple(r) for r in divergence.divergence(df, min_docs, terms).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_divergence([(r[2], r[3], r[1]) for r in texts], min_docs, terms)


def test_no_divergence(empty):
    assert divergence.divergence(empty).count() == 0


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(BPE)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_has_the_ids_of_its_library(plain):
    """The faster way gives the same ids: every character in several places, marks in a text, long runs."""
    encode, every = packing.encoder(BPE), [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b 1{c}2 {c}.{c} !" for c in every[i : i + 64]) for i in range(0, len(every), 64)]
    texts += ["<|endoftext|> and <|endoftext|>", " " * 5000 + "a", "\n" * 3000, "a" * 20_000, "I'll we've ’s", "", "中文 \U0001f600‍"]
    assert encode(texts) == [plain(t) for t in texts]


def test_other_tokenizers_go_through_their_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["Some words, and MORE words.", "", "x" * 500]
    assert packing.encoder(path)(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def fewest(lengths, size):
    """Best-fit decreasing by looking at every open sequence."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else size) - n)
    return len(rooms)


def check_packing(rows, size):
    """Sequences are full without gaps, none is longer than ``size``; their number."""
    of = defaultdict(list)
    for r in rows:
        of[r.sequence_id].append((r.offset, r.length))
    for parts in of.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) <= size
    return len(of)


@pytest.mark.parametrize("size", [7, 64, 2048])
def test_packing(rows, plain, size):
    parts = packing.pieces(rows, BPE, size)
    got = packing.packed(parts, size, group=10**6).collect()
    want = Counter()
    for d, text, *_ in ODD * 2:
        ids = [*plain(text), 0]
        cut = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
        want.update((d, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(cut, cut[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == want
    assert check_packing(got, size) == fewest([r.length for r in got], size)
    whole = packing.sequences(rows, BPE, size).collect()
    assert sum(len(r.doc_ids) for r in whole) == len(got) and sum(r.length for r in whole) == sum(r.length for r in got)
    assert sorted(bytes(r.ids)[-4:] for r in whole if r.length < size) and all(len(r.ids) == 4 * r.length for r in whole)


def test_packing_in_groups(spark):
    """Many groups waste little, and repeated calls agree."""
    rng = np.random.default_rng(3)
    parts = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 100, 3000))], "doc_id long, length long").repartition(4)
    got = packing.packed(parts, 100, group=500).collect()
    assert len(got) == 3000 and check_packing(got, 100) <= 1.03 * fewest([r.length for r in got], 100)
    with pytest.raises(Exception):  # noqa: B017, PT011
        packing.packed(parts.withColumn("length", parts.length + 100), 100).collect()


def test_no_pieces(empty):
    assert packing.packed(packing.pieces(empty, BPE)).count() == 0 and packing.sequences(empty, BPE).count() == 0


def test_packing_query(spark, plain):
    sf = "/root/testdata/sf0.001"
    df = queries.op13_best_fit_packing(spark, sf)
    assert df.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    rows, want = df.collect(), set()
    for d, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = [*plain(text), 0]
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want |= {(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:] or [len(ids)]))} if len(ids) > 2048 else {(d, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))}
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    assert check_packing(rows, 2048) == fewest([r.length for r in rows], 2048)
