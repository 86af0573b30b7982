"""The registered queries themselves on whole tables: columns, types and digests, by brute force or SQL."""

import hashlib
import os
import re
import zlib

import duckdb
import pytest
import xxhash
from parley.llm import queries, sql

SF = "/root/testdata/sf0.001"
TYPES = {
    "op1_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op2_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op4_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_unread bigint",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_line_dedup": "doc_id bigint, n_lines bigint, n_blank bigint, n_equal bigint, n_near bigint, kept string",
    "op7_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_warc_archive": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9_benchmark_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op10_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op11_phrase_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
    "op13_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
}


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows_of(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == TYPES[name]
    return df.collect()


def test_all_are_here():
    assert set(queries.QUERIES) == set(TYPES) and set(sql.SQL) == set(TYPES) - {f"op{n}_{x}" for n, x in ((1, "simhash_near_dedup"), (4, "secret_scan"), (5, "toxicity"), (7, "suffix_array_dedup"), (13, "best_fit_packing"))}


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_like_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = [r.asDict() for r in rows_of(spark, name)]
    names = sorted(got[0])
    want = con.sql(f"SELECT {', '.join(names)} FROM ({sql.SQL[name]})").fetchall()
    shown = lambda rows: sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert shown([[r[n] for n in names] for r in got]) == shown(want)


def test_fingerprints(spark, texts):
    prints = {}
    for d, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(len(w) - 3, 1))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    of = {d: d for d in prints}
    while True:
        new = {d: min(of[e] for e in prints if (prints[d] ^ prints[e]).bit_count() <= 4) for d in prints}
        if new == of:
            break
        of = new
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows_of(spark, "op1_simhash_near_dedup")}
    assert got == {d: (f"{x:016x}", of[d]) for d, x in prints.items()}


def test_secrets(spark, texts):
    """Base spans by plain expressions over every row; they are among all spans."""
    kinds = (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16),
    )
    got = {r.doc_id: r for r in rows_of(spark, "op4_secret_scan")}
    assert len(got) == len(texts)
    for d, t in texts:
        base = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m))
        named = [f"{kinds[k][0]}:{s}:{e}" for s, k, e in base]
        r = got[d]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r.base_sha256 == sha(",".join(named)) and set(named) <= set(r.spans.split(",") if r.spans else [])


def test_scores(spark, texts):
    got = {r.doc_id: r for r in rows_of(spark, "op5_toxicity")}
    assert set(got) == {d for d, _ in texts}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for d, r in got.items())


def test_repeated_bytes(spark, texts):
    first = {}
    for d, t in sorted(texts):
        b = t.encode()
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], d)
    want = {}
    for d, t in texts:
        b = t.encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < d:
                gone[j : j + 50] = b"\1" * 50
        want[d] = (len(b), sum(gone), len(re.findall(rb"\x01+", gone)), sha(bytes(x for x, g in zip(b, gone) if not g)))
    assert {r.doc_id: tuple(r)[1:] for r in rows_of(spark, "op7_suffix_array_dedup")} == want
