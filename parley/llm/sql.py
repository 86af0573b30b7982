"""DuckDB SQL that gives the registered queries' rows, where SQL can."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS hash
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, source_size * 2.0::DOUBLE AS most,
         coalesce(sum(source_size * 2.0::DOUBLE) OVER o, 0) AS got,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest,
         (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS total
  FROM s WINDOW o AS (ORDER BY source_size * 2.0 / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT max((total - got) / rest) AS level FROM r),
t AS (
  SELECT source, source_size, least(most, weight * level)::DOUBLE AS target FROM r, lv),
a AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
         target - (CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END) * source_size AS need
  FROM t),
h AS (
  SELECT source, hash, sum(size) AS sz,
         coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d GROUP BY source, hash)
SELECT d.doc_id, d.size, a.source_size, a.target,
       (d.size * (a.whole + CASE WHEN a.need > 0 AND h.before + h.sz / 2.0 <= a.need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source
       JOIN h ON d.source IS NOT DISTINCT FROM h.source AND d.hash = h.hash
"""

OP3 = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

OP9 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM d, (SELECT DISTINCT m FROM bw) AS ms, unnest(range(1, len(w) - m + 2)) AS u(i)),
hits AS (SELECT dw.doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + m)) AS u(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS t
  FROM d, unnest(range(1, len(w) - 18)) AS u(i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM g),
gone AS (SELECT DISTINCT doc_id, p FROM r, unnest(range(i, i + 20)) AS u(p) WHERE n > 1),
lists AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce(array_to_string([w[p] FOR p IN range(1, len(w) + 1) IF NOT list_contains(ps, p)], ' '), '') END) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""

OP6 = r"""
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM a, unnest(range(1, len(ls) + 1)) AS u(i) WHERE trim(ls[i]) <> ''),
f AS (SELECT line, min((doc_id, line_no)) AS first FROM l GROUP BY line),
w AS (SELECT line, first, length(line) AS n FROM f WHERE length(line) >= 20),
v AS (SELECT line, first, n, i, hash(left(line, i) || substr(line, i + 2)) AS h FROM w, unnest(range(0, n)) AS u(i)),
s AS (SELECT line FROM (SELECT line, first, min(first) OVER (PARTITION BY h, i, n) AS low FROM v) WHERE low < first),
d AS (SELECT v.line AS longer, v.first AS f1, w.line AS shorter, w.first AS f2 FROM v JOIN w ON v.h = hash(w.line) AND v.n = w.n + 1),
near AS (SELECT line FROM s UNION SELECT longer FROM d WHERE f2 < f1 UNION SELECT shorter FROM d WHERE f1 < f2),
k AS (
  SELECT l.doc_id, l.line_no, (l.doc_id, l.line_no) = f.first AS own, l.line IN (FROM near) AS near
  FROM l JOIN f ON l.line = f.line),
g AS (
  SELECT doc_id, count(*) FILTER (NOT own) AS n_equal, count(*) FILTER (own AND near) AS n_near,
         coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (own AND NOT near), '') AS kept
  FROM k GROUP BY doc_id)
SELECT a.doc_id, len(ls)::BIGINT AS n_lines, len(list_filter(ls, lambda x: trim(x) = ''))::BIGINT AS n_blank,
       coalesce(n_equal, 0)::BIGINT AS n_equal, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(kept, '') AS kept
FROM a LEFT JOIN g USING (doc_id)
"""

OP8 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p),
b AS (
  SELECT *, list_transform(range(0, 160, 5), lambda i: (
      (((strpos('0123456789abcdef', substr(hex, (i // 4 + 1)::INT, 1)) - 1) * 16 + greatest(strpos('0123456789abcdef', substr(hex || '0', (i // 4 + 2)::INT, 1)) - 1, 0))
      >> (3 - i % 4)::INT) & 31)) AS fives
  FROM h)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(fives, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""

OP11 = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_AZ}) AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS (
  SELECT lang, list_slice(w, i, i + m - 1) AS g, count(*) AS a
  FROM w, unnest(range(1, 6)) AS x(m), unnest(range(1, len(w) - m + 2)) AS y(i) GROUP BY lang, g),
n AS (SELECT lang, sum(a) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT lang, g, a FROM f WHERE len(g) > 1 AND a >= 100),
k AS (
  SELECT c.lang, c.g, c.a, n.n, k, x.a AS l, y.a AS r, (1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a) AS score
  FROM c JOIN n USING (lang), unnest(range(1, len(c.g))) AS u(k)
       JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, k) JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, k + 1, len(c.g))),
s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
gone AS (
  SELECT DISTINCT b.lang, list_slice(b.g, i, i + m - 1) AS g, b.a
  FROM c b, unnest(range(2, len(b.g))) AS x(m), unnest(range(1, len(b.g) - m + 2)) AS y(i)),
o AS (SELECT lang, g, max(a) AS longer FROM gone GROUP BY lang, g),
z AS (
  SELECT s.lang, array_to_string(s.g, ' ') AS phrase, s.a, l, r, n, score
  FROM s LEFT JOIN o ON s.lang = o.lang AND s.g = o.g WHERE o.longer IS NULL OR 100 * o.longer < 100 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM z QUALIFY rank <= 2000
"""

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
ng AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
nl AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(ng.total, 0) + 5 * v.v) AS p
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang
         LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
         LEFT JOIN ng ON ng.lang = g.lang AND ng.source = g.source),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (max(nl.total) + 5 * max(v.v)) AS q
  FROM c JOIN nl USING (lang) JOIN v USING (lang) GROUP BY lang, term),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
       LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM z WHERE part = 'pair' OR rank <= 50
"""

SQL = {"op11_phrase_collocations": OP11, "op12_source_divergence": OP12, "op6_line_dedup": OP6, "op8_warc_archive": OP8, "op10_substring_dedup": OP10, "op2_mix_sources": OP2, "op3_exact_dedup": OP3, "op9_benchmark_decontamination": OP9}
