"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = """l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"""

MIX = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 2 AS cap FROM src),
filled AS (SELECT *, cap / weight AS fill, CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS budget FROM weighed),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY fill, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled),
targets AS (
  SELECT source, source_size, rank, weight, least(cap, weight * (SELECT level FROM levels WHERE level <= fill ORDER BY fill, rank LIMIT 1)) AS target
  FROM levels),
queued AS (
  SELECT doc_id, size, source_size, target, rank, weight,
         sum(size) OVER (PARTITION BY rank ORDER BY CAST(('0x' || substr(md5(concat(doc_id, '|17')), 1, 8)) AS BIGINT), doc_id
                         ROWS UNBOUNDED PRECEDING) AS queued
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT doc_id, rank, size, CAST(queued + source_size * k AS DOUBLE) / weight AS finish FROM queued, (VALUES (0), (1)) turn(k) WHERE size > 0),
running AS (
  SELECT doc_id, rank, finish, sum(size) OVER (ORDER BY finish, rank, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM turns),
taken AS (
  SELECT doc_id, count(*) AS passes FROM running
  WHERE upto <= (SELECT floor(sum(size) * CAST(1.5 AS DOUBLE)) FROM sizes) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(t.passes, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id"""

LINE_DEDUP = f"""
WITH {LINES},
keyed AS (SELECT *, translate(trim(line, {TRIM}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_without = lambda chars: f"length(t) - length(regexp_replace(t, '{chars}', '', 'g'))"

RULES = f"""
WITH {LINES},
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
repeats AS (
  SELECT doc_id, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS at FROM again WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[ \\x09-\\x0D]', '', 'g')) AS word_chars, {_without('[#*$%&|<>]')} AS n_symbols,
         {_without('[A-Z]')} AS n_upper, {_without('!')} AS n_exclamations, {_without('[0-9]')} AS n_digits,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN lines ON d.doc_id = lines.doc_id LEFT JOIN repeats ON d.doc_id = repeats.doc_id),
f AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
                 + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 15 * n_words)::INT
                 + 64 * (2 * n_upper > word_chars)::INT + 128 * (10 * n_exclamations > n_words)::INT + 256 * (2 * n_digits > word_chars)::INT
                 AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f"""
