"""DuckDB SQL of the longer oracles of this subpackage."""

from __future__ import annotations

#: CRC-32 of the decimal form of an identifier, bit by bit.
CRC32_SQL = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({id} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(
      list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, step: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

OP12 = f"""
WITH split AS (
  SELECT doc_id, {CRC32_SQL.format(id="doc_id")} AS h,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
sized AS (SELECT *, len(words) AS n, h // 10 AS g FROM split),
planted AS (
  SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sized),
counted AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM planted),
word AS (
  SELECT doc_id, n, i,
         CASE WHEN h % 10 = 0 AND i >= a THEN words[1 + a + (i - a) % p] ELSE words[1 + i] END AS w
  FROM counted, unnest(range(n)) AS t(i)),
equal_pair AS (
  SELECT x.doc_id, x.n, x.i, y.i - x.i AS q
  FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal_pair)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length),
best AS (
  SELECT * FROM run
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
listed AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
  FROM run GROUP BY doc_id),
gone AS (
  SELECT DISTINCT doc_id, i FROM run, unnest(range(start + period, start + length)) AS t(i)),
kept AS (
  SELECT word.doc_id, string_agg(w, ' ' ORDER BY word.i) AS collapsed
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start,
       CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP13 = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32_SQL.format(id="conv_id")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, t.k, t.role, t.text FROM conv c JOIN turns t ON t.conv_id = c.base AND t.k <= c.h
  UNION ALL
  SELECT c.conv_id, t.k + 1000000, t.role, t.text FROM conv c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h),
numbered AS (
  SELECT conv_id, text, sha256(concat(length(role), ':', role, text)) AS own,
         row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth
  FROM rebuilt),
prefix AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS key, '' AS text FROM conv
  UNION ALL
  SELECT n.conv_id, n.depth, sha256(p.key || n.own), n.text
  FROM prefix p JOIN numbered n ON n.conv_id = p.conv_id AND n.depth = p.depth + 1),
last AS (SELECT conv_id, max(depth) AS depth FROM prefix GROUP BY conv_id),
node AS (
  SELECT p.key, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(length(p.text)) AS chars,
         string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (p.depth = l.depth) AS ends
  FROM prefix p JOIN last l ON l.conv_id = p.conv_id GROUP BY p.key, p.depth),
child AS (
  SELECT n.*, up.key AS parent_key
  FROM node n LEFT JOIN prefix up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1),
children AS (SELECT parent_key, count(*) AS n_children FROM child GROUP BY parent_key),
counted AS (
  SELECT c.*, coalesce(k.n_children, 0) AS n_children FROM child c LEFT JOIN children k ON k.parent_key = c.key),
below AS (
  SELECT up.key AS top, count(*) FILTER (c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.chars) AS saved
  FROM counted c JOIN prefix up ON up.conv_id = c.conv_id AND up.depth <= c.depth GROUP BY up.key)
SELECT CAST(c.conv_id AS BIGINT) AS conv_id, CAST(c.depth AS BIGINT) AS depth,
       CAST(p.conv_id AS BIGINT) AS parent_conv_id, CAST(c.n_convs AS BIGINT) AS n_convs,
       CAST(c.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256
FROM counted c JOIN below b ON b.top = c.key LEFT JOIN node p ON p.key = c.parent_key
"""

#: Windows of 50 words that also start in a smaller document.
OP1 = """
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
window_at AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS w
  FROM split, unnest(range(1, len(words) - 48)) AS t(i) WHERE len(words) >= 50),
first AS (SELECT w, min(doc_id) AS first_doc FROM window_at GROUP BY w HAVING count(*) > 1),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS places FROM (
    SELECT doc_id, unnest(range(i, i + 50)) AS p FROM window_at JOIN first USING (w) WHERE doc_id > first_doc)
  GROUP BY doc_id),
judged AS (
  SELECT s.doc_id, words, places,
         CASE WHEN places IS NULL THEN words
              ELSE list_filter(words, lambda w, i: NOT list_contains(places, i)) END AS kept
  FROM split s LEFT JOIN gone g ON g.doc_id = s.doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM judged
"""

#: Strings of 100 bytes that also start earlier; two hexadecimal digits are a byte.
OP5 = """
WITH coded AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
window_at AS (
  SELECT doc_id, i, sha256(substr(h, 2 * i + 1, 200)) AS w FROM coded, unnest(range(n - 99)) AS t(i) WHERE n >= 100),
first AS (SELECT w, min({'d': doc_id, 'i': i}) AS start FROM window_at GROUP BY w HAVING count(*) > 1),
later AS (
  SELECT doc_id, i FROM window_at JOIN first USING (w) WHERE doc_id > start.d OR (doc_id = start.d AND i > start.i)),
edge AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS opens FROM later),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM edge),
span AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, span),
kept AS (
  SELECT doc_id, a AS cut, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM span
  UNION ALL
  SELECT c.doc_id, c.n, coalesce(max(s.b), 0) FROM coded c LEFT JOIN span s ON s.doc_id = c.doc_id GROUP BY c.doc_id, c.n),
rest AS (
  SELECT k.doc_id, string_agg(substr(h, CAST(2 * k.start + 1 AS BIGINT), CAST(2 * (cut - k.start) AS BIGINT)), '' ORDER BY cut, k.start) AS h
  FROM kept k JOIN coded c ON c.doc_id = k.doc_id GROUP BY k.doc_id),
counted AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(r.h, ''))) AS kept_sha256
FROM coded c LEFT JOIN counted x ON x.doc_id = c.doc_id LEFT JOIN rest r ON r.doc_id = c.doc_id
"""
