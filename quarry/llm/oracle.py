"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_OP3 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d
), windows AS (
  SELECT k, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] AS t
  FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), counted AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, t) AS n FROM windows
), repeated AS (
  SELECT k, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM counted WHERE n >= 2) GROUP BY k
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
         length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters,
         length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks
  FROM w LEFT JOIN repeated USING (k)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * n_dup_lines > n_lines OR (2 * n_upper > n_letters AND n_letters > 0) OR 3 * n_marks > n_words) AS kept
FROM f
"""

# All pairs of documents that share a shingle, then everything reachable over links.
_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, array_to_string(ws, ' ') AS shingle FROM w WHERE len(ws) BETWEEN 1 AND 4
    UNION ALL SELECT doc_id, array_to_string(ws[i:i + 4], ' ') FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5))
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(id, other) AS (
  SELECT a, b FROM edges UNION SELECT id, b FROM reach JOIN edges ON other = a
), least_ AS (SELECT id, min(other) AS other FROM reach GROUP BY id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id, coalesce(other, doc_id) >= doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON id = doc_id
"""

SQL: dict[str, str] = {"op1_near_dedup": _OP1, "op3_quality_rules": _OP3}
