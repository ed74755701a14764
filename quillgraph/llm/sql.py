"""DuckDB SQL of the operators that SQL can express."""

QUALITY_RULES_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tri AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w),
ls AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM w LEFT JOIN ls USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 10 * n_symbols > word_chars AS f2,
         n_dup_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines AS f3, word_chars > 20 * n_words AND n_words > 0 AS f4, word_chars < 2 * n_words AS f5,
         10 * n_capitals > 4 * word_chars AS f6
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
       NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5 OR f6) AS kept,
       CAST(f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT + 64 * f6::INT AS BIGINT) AS failed_bits
FROM f
"""

NEAR_DEDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(len(ws), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id WHERE r.c < p.b),
k AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

LINE_DEDUP_SQL = r"""
WITH p AS (
  SELECT doc_id, i, part, trim(part, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t
  FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
l AS (
  SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n,
         len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w FROM p WHERE t <> ''),
g AS (
  SELECT doc_id, k, n, t AS a, lead(t) OVER o AS b, lead(t, 2) OVER o AS c, w AS wa, lead(w) OVER o AS wb FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
win AS (
  SELECT doc_id, k, 3 AS width, a || chr(10) || b || chr(10) || c AS x FROM g WHERE c IS NOT NULL
  UNION ALL SELECT doc_id, k, 2, a || chr(10) || b FROM g WHERE b IS NOT NULL AND (wa + wb > 50 OR n = 2 AND wa + wb >= 10)
  UNION ALL SELECT doc_id, k, 1, a FROM g WHERE wa > 50 OR n = 1 AND wa >= 10),
f AS (SELECT *, first_value(doc_id) OVER q AS fd, first_value(k) OVER q AS fk FROM win WINDOW q AS (PARTITION BY width, x ORDER BY doc_id, k)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN fd = doc_id THEN greatest(k, fk + width) ELSE k END, k + width)) AS k FROM f WHERE fd <> doc_id OR fk <> k),
m AS (SELECT doc_id, count(*) AS m FROM gone GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1),
kept AS (
  SELECT p.doc_id, string_agg(p.part, chr(10) ORDER BY p.i) AS text
  FROM p LEFT JOIN l ON l.doc_id = p.doc_id AND l.i = p.i LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.k = l.k WHERE gone.k IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(m.m, 0) AS BIGINT) AS n_removed,
       CASE WHEN m.m IS NULL THEN d.text WHEN m.m = n.n THEN '' ELSE kept.text END AS text
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

PII_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k(rank, kind, pattern) AS (VALUES
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'),
  (1, 'ip', '[0-9]+(?:\.[0-9]+){3}'),
  (2, 'card', '[0-9](?:[\x20-]?[0-9])+'),
  (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
  (4, 'iban', 'IBAN[\x20:#=]{0,3}[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}'),
  (5, 'login', '://[A-Za-z0-9._~%!$&''()*+,;=-]+(?::[A-Za-z0-9._~%!$&''()*+,;=-]*)?@[A-Za-z0-9.-]+[A-Za-z0-9]'),
  (6, 'secret', '(?:[tT]oken|TOKEN|[pP]assword|PASSWORD|[pP]asswd|PASSWD|[sS]ecret|SECRET|[aA]pi_key|API_KEY|[aA]pikey|APIKEY|[aA]pi-key|API-KEY|[aA]ccess_key|ACCESS_KEY)[\x20\t]{0,3}[=:][\x20\t]{0,3}(?:"[A-Za-z0-9+/_.=-]{16,}"|''[A-Za-z0-9+/_.=-]{16,}''|[A-Za-z0-9+/_.=-]{16,})')),
p AS (
  SELECT doc_id, rank, kind, unnest(parts) AS part, unnest(range(len(parts))) AS i
  FROM (SELECT doc_id, rank, kind, string_split(regexp_replace(text, '(' || pattern || ')', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM d, k)
  WHERE len(parts) > 1),
q AS (
  SELECT doc_id, rank, kind, i, CASE WHEN i > 0 THEN split_part(part, chr(2), 1) ELSE '' END AS m, CASE WHEN i > 0 THEN split_part(part, chr(2), 2) ELSE part END AS rest FROM p),
r AS (
  SELECT doc_id, rank, kind, i, m, rest, sum(length(m) + length(rest)) OVER (PARTITION BY doc_id, rank ORDER BY i) - length(m) - length(rest) AS pos FROM q),
v AS (
  SELECT doc_id, rank, kind, pos, m, pos + length(m) - CASE WHEN rank = 6 AND regexp_matches(m, '["'']$') THEN 1 ELSE 0 END AS stop, left(rest, 1) AS after,
         CASE rank WHEN 4 THEN regexp_extract(m, '^IBAN[\x20:#=]{0,3}(.*)$', 1) WHEN 5 THEN substr(m, 4) WHEN 6 THEN regexp_replace(m, '^[^=:]*[=:][\x20\t]{0,3}["'']?|["'']$', '', 'g') ELSE m END AS val
  FROM r WHERE i > 0),
n AS (
  SELECT *, regexp_replace(val, '[^0-9]', '', 'g') AS digits, replace(val, ' ', '') AS account FROM v),
good AS (
  SELECT doc_id, rank, kind, stop - length(val) AS start, stop FROM n
  WHERE CASE rank
    WHEN 1 THEN len(list_filter(string_split(val, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INT) > 255)) = 0
    WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(digits)), lambda j: CASE WHEN j % 2 = 0 THEN CAST(substr(digits, length(digits) - j, 1) AS INT)
      ELSE (2 * CAST(substr(digits, length(digits) - j, 1) AS INT)) // 10 + (2 * CAST(substr(digits, length(digits) - j, 1) AS INT)) % 10 END)) % 10 = 0
    WHEN 3 THEN length(digits) BETWEEN 10 AND 15
    WHEN 4 THEN NOT regexp_matches(after, '[A-Za-z0-9]') AND list_reduce(list_prepend(0, list_transform(string_split(substr(account, 5) || left(account, 4), ''), lambda c: CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ord(c) - 48 ELSE ord(c) - 55 END AS INT))),
      lambda s, c: (s * CASE WHEN c < 10 THEN 10 ELSE 100 END + c) % 97) = 1
    ELSE true END)
SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < 4), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank), '') AS spans,
       count(*) FILTER (rank = 4) AS n_iban, count(*) FILTER (rank = 5) AS n_login, count(*) FILTER (rank = 6) AS n_secret
FROM d LEFT JOIN good USING (doc_id) GROUP BY d.doc_id
"""
