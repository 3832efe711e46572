"""DuckDB SQL that each corpus query is checked against, where SQL can express it."""

from __future__ import annotations

from motorlake.llm.mixing import SEED, offset_of

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""

MIX = rf"""
WITH d AS (
  SELECT doc_id, text, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS INTEGER)] AS w
  FROM d GROUP BY k),
l AS (
  SELECT *, CAST(sum(source_size) OVER () AS HUGEINT)
              - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM s),
c AS (SELECT *, 3 * CAST(source_size AS HUGEINT) * w_left < words_left * w AS capped FROM l),
f AS (SELECT words_left AS wl, w_left AS fl FROM c WHERE NOT capped ORDER BY source_size / w, k LIMIT 1),
t AS (
  SELECT k, source_size,
         CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(wl AS DOUBLE) * CAST(w AS DOUBLE) / CAST(fl AS DOUBLE) END AS target
  FROM c LEFT JOIN f ON true),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS share,
         CAST(row_number() OVER (PARTITION BY d.k ORDER BY d.size, md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), md5(coalesce(d.text, ''))) AS DOUBLE) AS n
  FROM d JOIN t USING (k))
SELECT doc_id, size, source_size, target,
       CAST(floor(n * share + {offset_of(SEED)!r}) - floor((n - 1.0) * share + {offset_of(SEED)!r}) AS BIGINT) * size AS taken
FROM r
"""

DECONTAMINATE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM documents),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w)),
v AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM v)),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, n_shingles, CAST(count(*) AS DOUBLE) / CAST(n_shingles AS DOUBLE) AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING count(*) * 10 >= n_shingles * 8
"""

_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})"
_BY_KIND = "\nUNION ALL ".join(
    f"SELECT r, '{kind}' AS kind, {number} AS no, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d"
    for number, (kind, pattern) in enumerate(_PLAIN.items())
)

PII = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({_BY_KIND}),
one AS (SELECT r, kind, no, generate_subscripts(m, 1) AS n, unnest(m) AS v, unnest(g[1:len(m)]) AS gl FROM k WHERE len(m) > 0),
placed AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits,
                  CAST(sum(length(gl) + length(v)) OVER (PARTITION BY r, kind ORDER BY n) AS BIGINT) AS stop FROM one),
base AS (
  SELECT r, kind, no, stop - length(v) AS start, stop,
         kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN digits ELSE lower(v) END AS entity
  FROM placed
  WHERE CASE kind
    WHEN 'ip' THEN regexp_full_match(v, '{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}')
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum([
      CAST(substr(reverse(digits), i + 1, 1) AS INT) * (1 + i % 2)
      - CASE WHEN i % 2 = 1 AND CAST(substr(reverse(digits), i + 1, 1) AS INT) > 4 THEN 9 ELSE 0 END
      for i in range(length(digits))]) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    ELSE TRUE END),
prose AS (
  SELECT r, t, CASE WHEN len(m) = 0 THEN t ELSE array_to_string([g[i] || CASE WHEN i > len(m) THEN '' ELSE repeat('@', length(m[i])) END for i in range(1, len(g) + 1)], '') END AS p
  FROM k JOIN d USING (r) WHERE kind = 'email'),
word AS (
  SELECT r, generate_subscripts(w, 1) AS n, unnest(w) AS word, unnest(g[1:len(w)]) AS gap
  FROM (SELECT r, regexp_extract_all(p, '\p{{L}}{{3,}}') AS w, string_split_regex(p, '\p{{L}}{{3,}}') AS g FROM prose) WHERE len(w) > 0),
placed_word AS (
  SELECT r, lower(word) AS term, stop - length(word) AS start, stop
  FROM (SELECT *, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY r ORDER BY n) AS BIGINT) AS stop FROM word)),
has_term AS (SELECT DISTINCT r, term FROM placed_word),
has_entity AS (SELECT DISTINCT r, entity FROM base),
pair AS (
  SELECT entity, term, count(*) AS both_n FROM has_entity JOIN has_term USING (r) JOIN d USING (r)
  GROUP BY entity, term HAVING count(DISTINCT t) >= 2),
dft AS (SELECT term, count(*) AS df FROM has_term GROUP BY term),
dfe AS (SELECT entity, count(DISTINCT r) AS de FROM base GROUP BY entity),
told AS (
  SELECT DISTINCT term FROM pair JOIN dft USING (term) JOIN dfe USING (entity), (SELECT CAST(count(*) AS DOUBLE) AS n FROM d)
  WHERE ln(n / de) > 0 AND (ln(n / de) + ln(both_n / df)) / ln(n / de) >= 0.6),
span AS (SELECT r, kind, no, start, stop FROM base
         UNION ALL SELECT r, 'term', 4, start, stop FROM placed_word JOIN told USING (term)),
per AS (
  SELECT r, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY no, start) AS spans,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY no, start) FILTER (WHERE kind <> 'term') AS own,
         count(*) FILTER (WHERE kind = 'email') AS e, count(*) FILTER (WHERE kind = 'ip') AS i,
         count(*) FILTER (WHERE kind = 'card') AS c, count(*) FILTER (WHERE kind = 'phone') AS p, count(*) FILTER (WHERE kind = 'term') AS m
  FROM span GROUP BY r)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone,
       sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(m, 0) AS n_term
FROM d LEFT JOIN per USING (r)
"""

#: Bit by bit, since DuckDB has no crc32: a step of -1 shifts, any other takes in a byte.
_CRC32 = """list_reduce(
    list_concat([4294967295::BIGINT], flatten([[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(conv_id::VARCHAR, '')])),
    lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END)"""

TRIE = rf"""
WITH t AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, CAST(xor({_CRC32}, 4294967295) % 9 AS BIGINT) AS h FROM t),
c AS (SELECT h.conv_id, list_concat(coalesce(b.own[:h.h], []), h.own[h.h + 1:]) AS seq FROM h LEFT JOIN t AS b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM c),
n AS (SELECT depth, seq[:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CASE WHEN len(seq) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
      FROM m GROUP BY depth, seq[:depth]),
k AS (SELECT depth - 1 AS depth, p[:depth - 1] AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(p[depth].t) ELSE 0 END AS own FROM n LEFT JOIN k USING (depth, p)),
u AS (SELECT unnest(range(0, depth + 1)) AS d, p, own, n_children FROM f),
s AS (SELECT d AS depth, p[:d] AS p, CAST(sum(own) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM u GROUP BY 1, 2)
SELECT f.conv_id, f.depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM f JOIN s USING (depth, p) LEFT JOIN n AS g ON g.depth = f.depth - 1 AND g.p = f.p[:f.depth - 1]
"""
