"""DuckDB SQL of the queries over whole tables that SQL can express in reasonable time at small scale."""

from __future__ import annotations

DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
terms AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms GROUP BY ALL),
groups_ AS (SELECT DISTINCT lang, source FROM docs),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups_ g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n,
         1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p
  FROM grid),
totals AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM grid GROUP BY lang, term),
wholes AS (
  SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM totals),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT s.lang, s.source, t.source AS item, sum(((s.p - t.p) * (s.p - t.p)) // t.p) AS value
    FROM shares s JOIN shares t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
firsts AS (
  SELECT s.lang, s.source, s.term AS item, ((s.p - w.q) * (s.p - w.q)) // w.q AS value
  FROM shares s JOIN wholes w ON s.lang = w.lang AND s.term = w.term WHERE s.n > 0 AND s.p > w.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM firsts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200"""


#: CRC-32 of a text of ASCII characters, by the reversed polynomial, and the damaged rows by it. Then a forward program over
#: (cost, audit, repaired text) of four states, row by row; insertions stand before each row and at the end.
REPAIR_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT),
                         lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE kind <> 0),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS trimmed FROM damaged),
faults AS (
  SELECT c, conv_id, k, turn, role, text, left(role, 1) AS i, trimmed = '' AS blank, trimmed <> '' AND again AS duplicate,
         trimmed <> '' AND NOT again AND right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated,
         lag(left(role, 1)) OVER (PARTITION BY c ORDER BY k) || left(role, 1) AS pair FROM placed),
totals AS (
  SELECT c, any_value(conv_id) AS conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY c),
steps AS (
  SELECT 0 AS c, 0 AS k, 0 AS s, 0 AS cost, '' AS audit, [''] AS said WHERE FALSE
  UNION ALL SELECT c, 0, s, CASE s WHEN 0 THEN 0 WHEN 2 THEN 3 ELSE 6 END, CASE s WHEN 0 THEN '' WHEN 2 THEN 'I' ELSE 'II' END,
         CASE s WHEN 0 THEN [] WHEN 2 THEN ['user:'] ELSE ['user:', 'assistant:'] END
  FROM totals, (SELECT unnest([0, 2, 3]) AS s)
  UNION ALL
  SELECT c, k, s, cost, audit, said FROM (
    SELECT x.c, x.k, y.s, y.cost, y.audit, y.said, row_number() OVER (PARTITION BY x.c, y.s ORDER BY y.cost, y.audit) AS best
    FROM (
      SELECT p.c, f.k, e.s, p.cost + e.cost AS cost, p.audit || e.letter AS audit, CASE WHEN e.letter = 'D' THEN p.said ELSE p.said || [e.said] END AS said
      FROM steps p JOIN faults f ON f.c = p.c AND f.k = p.k + 1,
      LATERAL (
        SELECT p.s AS s, 4 AS cost, 'D' AS letter, '' AS said
        UNION ALL SELECT CASE WHEN p.s = 2 THEN 3 ELSE 2 END, CASE WHEN f.truncated THEN 6 ELSE 3 END, 'R', CASE WHEN p.s = 2 THEN 'assistant:' ELSE 'user:' END || f.text WHERE NOT f.blank AND NOT f.duplicate
        UNION ALL SELECT CASE f.i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE WHEN f.truncated THEN 3 ELSE 0 END, 'K', f.role || ':' || f.text
        WHERE NOT f.blank AND NOT f.duplicate AND (f.i = 's' AND p.s = 0 OR f.i = 'u' AND p.s <> 2 OR f.i = 'a' AND p.s = 2)) e) x,
    LATERAL (
      SELECT x.s AS s, x.cost AS cost, x.audit AS audit, x.said AS said
      UNION ALL SELECT CASE WHEN x.s = 2 THEN 3 ELSE 2 END, x.cost + 3, x.audit || 'I', x.said || [CASE WHEN x.s = 2 THEN 'assistant:' ELSE 'user:' END]
      UNION ALL SELECT CASE WHEN x.s = 2 THEN 2 ELSE 3 END, x.cost + 6, x.audit || 'II', x.said || CASE WHEN x.s = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END) y)
  WHERE best = 1),
chosen AS (
  SELECT t.*, s.cost, s.audit, s.said, row_number() OVER (PARTITION BY t.c ORDER BY s.cost, s.audit) AS best
  FROM totals t JOIN steps s ON s.c = t.c AND s.k = t.n AND s.s IN (0, 3))
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN (SELECT * FROM chosen WHERE best = 1) d ON d.conv_id IS NOT DISTINCT FROM i.conv_id"""

LINKS_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding, list_transform(embedding, lambda x: x::DOUBLE) AS e,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, FALSE) AND label IS NOT NULL AS fits
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND a.fits AND b.fits
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reached AS (
  SELECT vec_id, vec_id AS other FROM vectors
  UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM vectors v LEFT JOIN counted c ON c.a = v.vec_id
JOIN (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id) r ON r.vec_id = v.vec_id"""
