"""DuckDB SQL for the registered queries: written from the operators' definitions, not generated from their plans."""

from __future__ import annotations

_FILES = """files AS (
  SELECT doc_id AS id, 'file' AS kind, 'doc_' || doc_id || '.' || ext AS name,
         '/' || source || '/' || lang || '/doc_' || doc_id || '.' || ext AS path, ext AS extension, n_chars AS size,
         1700000000000 + doc_id * 3600000 AS modified, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS attributes
  FROM (SELECT *, ['txt', 'md', 'py', 'csv', 'pdf'][doc_id % 5 + 1] AS ext FROM documents)
)"""
_CHUNKS = """chunks AS (
  SELECT doc_id * 100000 + i - 1 AS chunk_id, doc_id AS item_id, lines[i] AS text
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
  WHERE trim(lines[i], ' ') <> ''
)"""
_DOCS = f"""{_CHUNKS}, docs AS (
  SELECT chunk_id, item_id, text, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS tokens FROM chunks
), stats AS (SELECT count(*) AS n_rows, avg(len(tokens)) AS mean FROM docs)"""
_USES = """uses AS (
  SELECT event_id, user_id AS item_id, epoch_us(ts) // 1000 AS used_at, 'q ' || event_type || ' ' || (event_id % 5) AS query_key,
         CASE event_type WHEN 'purchase' THEN 'primary' WHEN 'click' THEN 'reveal' ELSE 'copy' END AS use,
         CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'click' THEN 0.5 ELSE 0.3 END AS weight
  FROM events WHERE event_type IN ('purchase', 'click', 'view')
), decayed AS (
  SELECT item_id, count(*) AS uses, max(used_at) AS last_used_at,
         sum(weight * exp(ln(2) / 1209600000.0 * (used_at - 1706745600000))) AS frecency FROM uses GROUP BY item_id
), pins AS (SELECT item_id, min(used_at) AS pinned_at FROM uses WHERE item_id % 17 = 0 GROUP BY item_id)"""
_FRECENCY = f"WITH {_USES} SELECT item_id, uses, last_used_at, round(frecency, 6) AS frecency FROM decayed"
_LEARNED = f"""{_USES}, learned AS (
  SELECT query_key, item_id, count(*) AS uses, max(used_at) AS last_used_at FROM (
    SELECT DISTINCT event_id, item_id, used_at, rtrim(query_key[1:n], ' ') AS query_key
    FROM (SELECT *, unnest(range(1, least(length(query_key), 32) + 1)) AS n FROM uses WHERE use = 'primary')
  ) WHERE query_key <> '' GROUP BY query_key, item_id
)"""

_NAME_ITEMS = """names AS (
  SELECT p_partkey AS id, p_name AS name, lower(p_name) AS name_key, '/' || replace(p_brand, '#', '-') || '/' || lower(p_type) || '/' || p_name AS path,
         1700000000000 + p_size * 86400000::BIGINT AS modified, CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS attributes FROM part
), asked(query_id, key) AS (
  VALUES ('n1', 'red bolt'), ('n2', 'blue'), ('n3', 'gea'), ('n4', 'gizmo cold'), ('n5', 'hot rd'), ('n6', 'smal ring'), ('n7', 'brand small widget')
)"""


def _bm25(terms: str, select: str, head: str = "") -> str:
    """terms: rows (query_id, term, pattern kind, words) with tf computed by list functions."""
    return f"""WITH {_DOCS}, terms AS ({terms}), found AS (
  SELECT query_id, term, n_terms, chunk_id, item_id, len(tokens) AS len,
         CASE kind WHEN 'word' THEN len(list_filter(tokens, lambda t: t = w1))
                   WHEN 'prefix' THEN len(list_filter(tokens, lambda t: starts_with(t, w1)))
                   ELSE len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = w1 AND tokens[i + 1] = w2)) END AS tf
  FROM docs, terms
), matched AS (SELECT * FROM found WHERE tf > 0), per_term AS (SELECT query_id, term, count(*) AS n FROM matched GROUP BY ALL
), scored AS (
  SELECT query_id, chunk_id, item_id, count(*) AS m, max(n_terms) AS n_terms,
         sum(CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_rows - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS s
  FROM matched JOIN per_term USING (query_id, term), stats GROUP BY query_id, chunk_id, item_id
){head} {select}"""


def _words(batch: dict[str, list[str]]) -> str:
    rows = [f"('{q}', {k}, 'word', '{w}', '', {len(ws)})" for q, ws in batch.items() for k, w in enumerate(ws)]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS v(query_id, term, kind, w1, w2, n_terms)"


_ALL = "SELECT query_id, chunk_id, round(-s, 6) AS score FROM scored WHERE m = n_terms"
_TOP = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(-s, 9), chunk_id) AS r FROM scored WHERE m = n_terms{more})"""

_LANE = (
    "WITH strict AS ("
    + _bm25(_words({"p1": ["thing", "stea", "tion", "eran"], "p2": ["queue", "ciones", "boar"], "p3": ["eder", "ching"]}), "SELECT query_id, chunk_id, item_id, -s AS score FROM scored WHERE m = n_terms")
    + "), pairs AS ("
    + _bm25(_words({"p1": ["thing", "stea", "tion", "eran"], "p2": ["queue", "ciones", "boar"]}), "SELECT query_id, chunk_id, item_id, -(m - 1) * s AS score FROM scored WHERE m >= 2")
    + """), hits AS (
  SELECT *, 0 AS step, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id) AS r FROM strict
  UNION ALL SELECT *, 1, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id) FROM pairs
), placed AS (
  SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY step, r) AS best, row_number() OVER (PARTITION BY query_id, item_id ORDER BY step, r) AS n FROM hits WHERE r <= 120
), one AS (SELECT *, count(*) FILTER (step = 0) OVER (PARTITION BY query_id) AS n_strict FROM placed WHERE n = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY step, r, item_id) AS rank_no FROM one WHERE step = 0 OR n_strict < 30)
SELECT query_id, item_id, CAST(rank_no AS INT) AS rank_no, round(0.4 + 0.5 * greatest(least(score / best, 1.0), 0.0), 6) AS confidence, step FROM ranked WHERE rank_no <= 30"""
)

_SIM = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
_PAIRS = f"""pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity, a.label AS ql, b.label AS cl
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, chunk_id) AS rank_no FROM pairs)"""

_CATALOGUE = f"""{_FILES}, cat AS (SELECT id, path, kind, extension, size, modified, id + 7000 AS file, attributes FROM files
), seen AS (
  SELECT CASE WHEN id % 10 = 2 THEN '/moved' || path ELSE path END AS path, extension, size + CASE WHEN id % 10 = 3 THEN 1 ELSE 0 END AS size, modified, file, id % 10 = 5 AS written FROM cat WHERE id % 10 <> 1
  UNION ALL SELECT path || '.new', extension, size, modified, file + 500000000, false FROM cat WHERE id % 10 = 4
)"""
_MERGED = f"""{_CATALOGUE}, merged AS (
  SELECT coalesce(c.id, m.id, 9999999 + row_number() OVER (PARTITION BY c.id IS NULL AND m.id IS NULL ORDER BY s.path)) AS id, s.path,
         CASE WHEN c.id IS NOT NULL THEN 'updated' WHEN m.id IS NOT NULL THEN 'moved' ELSE 'inserted' END AS action,
         c.id IS NOT NULL AND (s.written OR s.size <> c.size OR s.modified <> c.modified) AS invalid
  FROM seen s LEFT JOIN cat c ON s.path = c.path
  LEFT JOIN cat m ON c.id IS NULL AND s.file = m.file AND s.size = m.size AND s.modified = m.modified AND m.path NOT IN (SELECT path FROM seen)
)"""

_LANES = f"""{_FILES}, ranked AS (
  SELECT 'q' || (id % 3) AS query_id, id AS item_id, name, CASE WHEN id % 4 = 0 THEN path END AS path, id,
         row_number() OVER (PARTITION BY id % 3 ORDER BY size, id) AS r1, row_number() OVER (PARTITION BY id % 3 ORDER BY -modified, id) AS r2,
         row_number() OVER (PARTITION BY id % 3 ORDER BY modified * 7919 % 10007, id) AS r3 FROM files
), lanes AS (
  SELECT query_id, item_id, name, path, 'names' AS lane, 0 AS l, r1 AS r, 1.0 / (60 + r1) AS part, CASE WHEN id % 50 = 0 THEN 'exact' ELSE 'prefix' END AS match FROM ranked WHERE r1 <= 60
  UNION ALL SELECT query_id, item_id, name, path, 'contents', 1, r2, 1.0 / (60 + r2), 'content' FROM ranked WHERE r2 <= 60
  UNION ALL SELECT query_id, item_id, name, path, 'meaning', 2, r3, 2.0 / (60 + r3), 'meaning' FROM ranked WHERE r3 <= 60
), shown AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY round(part, 12) DESC, l, r) AS n FROM lanes
), fused AS (
  SELECT query_id, item_id, sum(part) AS score, bool_or(match = 'exact') AS intent, max(1.0 / (1 + r)) AS confidence,
         max(lane) FILTER (n = 1) AS lane, max(match) FILTER (n = 1) AS match, max(name) AS title, max(path) AS subtitle,
         max(l) FILTER (n = 1) AS sl, max(r) FILTER (n = 1) AS sr FROM shown GROUP BY query_id, item_id
), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY intent DESC, round(score, 12) DESC, sl, sr, item_id) AS position FROM fused)"""

_IMAGES = f"""{_FILES}, img AS (
  SELECT id, path, id % 6 < 3 AS read, id % 4 <> 3 AND id % 8 <> 1 AS unit, id % 10 <> 7 AS known, ['indexed', 'empty', 'skipped', 'failed'][id % 4 + 1] AS state,
         id % 10 <> 7 AND id % 11 <> 0 AND id % 17 <> 0 AND id % 7 <> 6 AS fresh FROM files
)"""
_NAME_ITEMS_ONLY = _NAME_ITEMS[: _NAME_ITEMS.index("), asked")] + ")"

SQL = {
    "text_name_tokens": r"""
SELECT page_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url,
  '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS tokens,
  CASE WHEN regexp_matches(url, '(?s)^.+\.[\p{L}\p{N}]{0,5}$') THEN regexp_replace(url, '\.[\p{L}\p{N}]{0,5}$', '') ELSE url END AS stem
FROM pages""",
    "text_path_parts": "SELECT p_partkey AS id, 'brand ' || regexp_extract(p_brand, '[0-9]+') || ' ' || lower(p_type) AS path_parts FROM part",
    "text_fold": rf"SELECT conv_id, turn, trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g')) AS key FROM conversations",
    "text_token_estimate": r"""
SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda r: (length(r) + 4) // 5)), 0)
  + length(regexp_replace(text, '[\p{L}\p{N}\s]+', '', 'g')) AS BIGINT) AS tokens FROM documents""",
    "text_snippets": r"""
SELECT conv_id, turn, CASE WHEN length(t) >= 160 THEN t[1:160] || '…' ELSE t END AS snippet
FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)""",
    "text_fingerprints": f"""
WITH {_FILES} SELECT id, size || ':' || modified AS fingerprint, 'title: ' || CASE WHEN id % 3 = 0 THEN 'none' ELSE name END || ' | text: ' || path AS prompt, sha256(path) AS digest FROM files""",
    "document_kinds": f"""
WITH {_FILES} SELECT CASE extension WHEN 'txt' THEN 'prose' WHEN 'md' THEN 'markdown' WHEN 'py' THEN 'code:python' WHEN 'csv' THEN 'data' ELSE 'none' END AS kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1""",
    "filter_metadata": f"WITH {_FILES} SELECT id, path, modified FROM files WHERE extension = 'csv' AND modified >= epoch_ms(TIMESTAMP '2023-11-16') AND modified < epoch_ms(TIMESTAMP '2024-01-01')",
    "filter_folder": f"WITH {_FILES} SELECT id, path FROM files WHERE starts_with(path, '/src1/en/') AND extension = 'md'",
    "filter_component": f"WITH {_FILES} SELECT id, path FROM files WHERE path LIKE '%/fr/%'",
    "filter_page": f"WITH {_FILES} SELECT id, name FROM files WHERE extension = 'md' ORDER BY name, id LIMIT 25",
    "location_rules": f"""
WITH {_FILES} SELECT id, covered, covered AND NOT starts_with(path, '/src1/en/') AS content
FROM (SELECT *, starts_with(path, '/src1/') OR (starts_with(path, '/src2/') AND NOT starts_with(path, '/src2/de/')) AS covered FROM files)""",
    "names_tiers": f"""
WITH {_NAME_ITEMS}, hits AS (
  SELECT query_id, id, path, modified, attributes, CASE WHEN name_key = key THEN 1.0::DOUBLE ELSE 0.80 + 0.12 * length(key) / greatest(length(name_key), length(key), 1) END AS base,
         CASE WHEN name_key = key THEN 'exact' ELSE 'prefix' END AS match
  FROM names, asked WHERE starts_with(name_key, key)
)
SELECT query_id, id, round(base, 6) AS base, match, round(base + CASE WHEN 1703456000000 - modified < 259200000 THEN 0.04 WHEN 1703456000000 - modified < 2592000000 THEN 0.02 ELSE 0 END
  - CASE WHEN attributes & 3 <> 0 THEN 0.15 ELSE 0 END - least(greatest(length(path) - length(replace(path, '/', '')) - 4, 0) * 0.004, 0.04), 6) AS score FROM hits""",
    "names_tokens": f"""
WITH {_NAME_ITEMS}, split AS (
  SELECT id, name_key, string_split(name_key, ' ') AS t, list_concat(string_split(name_key, ' '), [string_split(name_key, ' ')[1][1] || string_split(name_key, ' ')[2][1]]) AS nt,
         ['brand', regexp_extract(path, '-([0-9]+)/', 1), string_split(path, '/')[3]] AS ft FROM names
), two AS (
  SELECT query_id, id, string_split(key, ' ') AS q, nt, ft, name_key, key FROM split, asked WHERE NOT starts_with(name_key, key)
), judged AS (
  SELECT *, list_bool_and(list_transform(q, lambda x: len(list_filter(nt, lambda n: starts_with(n, x))) > 0)) AS all_in_name,
         list_bool_or(list_transform(q, lambda x: len(list_filter(nt, lambda n: starts_with(n, x))) > 0)) AS some_in_name,
         list_bool_and(list_transform(q, lambda x: len(list_filter(list_concat(nt, ft), lambda n: starts_with(n, x))) > 0)) AS all_anywhere FROM two
)
SELECT query_id, id, NOT all_in_name AS by_folder FROM judged WHERE all_in_name OR (len(q) > 1 AND some_in_name AND all_anywhere)""",
    "bm25_all_terms": _bm25(_words({"c1": ["the", "of"], "c2": ["tion", "and"], "c3": ["que", "de", "la"], "c4": ["der", "die"]}), _ALL),
    "bm25_top": _bm25(_words({"t1": ["thing"], "t2": ["tion", "edth"], "t3": ["quand"]}), "SELECT query_id, chunk_id, round(-s, 6) AS score FROM ranked WHERE r <= 10", _TOP.format(more="")),
    "bm25_prefix": _bm25(
        "SELECT * FROM (VALUES ('x1', 0, 'prefix', 'thi', '', 1), ('x2', 0, 'prefix', 'ing', '', 1), ('x3', 0, 'prefix', 'ere', '', 1)) AS v(query_id, term, kind, w1, w2, n_terms)", _ALL
    ),
    "bm25_two_of": _bm25(_words({"p1": ["thing", "stea", "tion", "eran"], "p2": ["queue", "ciones", "boar"]}), "SELECT query_id, chunk_id, round(-(m - 1) * s, 6) AS score FROM scored WHERE m >= 2"),
    "bm25_phrase": _bm25(
        "SELECT * FROM (VALUES ('f1', 0, 'phrase', 'of', 'the', 1), ('f2', 0, 'phrase', 'in', 'the', 1), ('f3', 0, 'phrase', 'license', 'version', 1)) AS v(query_id, term, kind, w1, w2, n_terms)", _ALL
    ),
    "contents_lane": _LANE,
    "bm25_filtered": _bm25(_words({"c1": ["the", "and"]}), "SELECT query_id, chunk_id, round(-s, 6) AS score FROM ranked WHERE r <= 20", _TOP.format(more=" AND item_id % 5 = 1")),
    "vector_top_k": f"WITH {_PAIRS} SELECT query_id, chunk_id, round(similarity, 5) AS similarity, rank_no FROM ranked WHERE rank_no <= 10",
    "vector_normalize": """
SELECT vec_id AS chunk_id, round(embedding[1]::DOUBLE / n, 6) AS first, round(embedding[32]::DOUBLE / n, 6) AS last
FROM (SELECT *, sqrt(list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)""",
    "vector_two_tier": """
WITH live AS (SELECT vec_id AS chunk_id, CASE WHEN vec_id % 10 = 3 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS v FROM embeddings WHERE vec_id % 10 <> 7),
pairs AS (SELECT a.vec_id AS query_id, chunk_id, list_dot_product(a.embedding::DOUBLE[], v::DOUBLE[]) AS similarity FROM embeddings a, live WHERE a.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, chunk_id) AS rank_no FROM pairs)
SELECT query_id, chunk_id, round(similarity, 5) AS similarity, rank_no FROM ranked WHERE rank_no <= 5""",
    "vector_rebuild": """
WITH g AS (SELECT label, count(*) AS stored, count(*) FILTER (vec_id % 3 = 0) AS delta, count(*) FILTER (vec_id % 4 = 0) AS stale FROM embeddings GROUP BY label)
SELECT label, CASE WHEN label % 2 <> 0 THEN stored * 100 >= 2000
  ELSE (delta * 100 >= 2000 AND delta * 1000 >= stored * 70) OR stale * 60 * 5 >= greatest(stored * 70, 1) END AS due FROM g""",
    "vector_sequence": "SELECT vec_id AS chunk_id, 500 + row_number() OVER (ORDER BY label, vec_id) AS seq FROM embeddings",
    "vector_pending": f"""
WITH {_CHUNKS} SELECT count(*) FILTER (item_id % 6 = 0) AS done, count(*) FILTER (item_id % 6 = 3) AS failed, count(*) FILTER (item_id % 3 <> 0) AS pending FROM chunks""",
    "meaning_lane": f"""
WITH {_PAIRS}, kept AS (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS best FROM ranked WHERE rank_no <= 90 AND similarity >= 0.15)
SELECT query_id, chunk_id // 4 AS item_id, round(max(similarity), 5) AS confidence FROM kept WHERE similarity >= best - 0.15 GROUP BY 1, 2""",
    "usage_frecency": _FRECENCY,
    "usage_stream_fold": _FRECENCY,
    "usage_learned": f"""
WITH {_LEARNED} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY uses DESC, last_used_at DESC, item_id) AS rank_no FROM learned) WHERE rank_no <= 5""",
    "usage_suggestions": f"""
WITH {_USES}, both_ AS (
  SELECT item_id, 0 AS tier, pinned_at::DOUBLE AS sort FROM pins
  UNION ALL SELECT item_id, 1, -round(ln(frecency), 9) FROM decayed WHERE item_id NOT IN (SELECT item_id FROM pins)
)
SELECT item_id, tier, rank_no, CAST(round(1 - 0.01 * (rank_no - 1), 6) AS DOUBLE) AS score
FROM (SELECT *, row_number() OVER (ORDER BY tier, sort, item_id) AS rank_no FROM both_) WHERE rank_no <= 20""",
    "usage_signals": f"""
WITH {_LEARNED}, s AS (
  SELECT d.item_id AS id, p.item_id IS NOT NULL AS pinned, frecency, coalesce(l.uses, 0) AS query_uses
  FROM decayed d LEFT JOIN pins p USING (item_id) LEFT JOIN learned l ON l.item_id = d.item_id AND l.query_key = 'q purchase'
)
SELECT id, pinned, round(frecency, 6) AS frecency, query_uses,
       round(CASE WHEN pinned THEN 0.05 ELSE 0 END + least(0.025 * ln(1 + frecency), 0.08) + CASE WHEN query_uses > 0 THEN least(0.12 + 0.08 * ln(query_uses), 0.35) ELSE 0 END, 6) AS prior FROM s""",
    "usage_pruned": f"WITH {_USES} SELECT item_id, uses, last_used_at FROM decayed WHERE last_used_at >= 1706400000000",
    "inventory_merge": f"WITH {_MERGED} SELECT id, path, action, invalid, CASE WHEN action <> 'inserted' AND NOT invalid THEN 'indexed' END AS content_state FROM merged",
    "inventory_counts": f"WITH {_MERGED} SELECT action, count(*) AS n, count(*) FILTER (invalid) AS invalid FROM merged GROUP BY action",
    "inventory_removed": f"WITH {_FILES} SELECT id, path FROM files WHERE id % 10 = 1 AND NOT starts_with(path, '/src1/') AND NOT starts_with(path, '/src2/en/')",
    "cascade_delete": f"""
WITH {_CHUNKS}, {_USES}
SELECT 'chunks' AS part, count(*) AS n FROM chunks WHERE item_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0)
UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT chunk_id FROM chunks WHERE item_id % 4 = 0)
UNION ALL SELECT 'usage', count(*) FROM decayed WHERE item_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0)
UNION ALL SELECT 'pins', count(*) FROM pins WHERE item_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0)""",
    "scan_exclusions": f"""
WITH {_FILES}, f AS (SELECT *, '/r' || (id % 20) || ['/node_modules', '/build', '/venv', '/docs', '/Private', '/keep/target'][id % 6 + 1] AS folder FROM files),
dirs AS (SELECT DISTINCT folder FROM f),
ruled_dirs AS (SELECT folder, CASE WHEN folder LIKE '%/Private' THEN 'name:private' WHEN folder LIKE '%/node_modules' THEN 'default:node_modules' WHEN folder = '/r2/venv' THEN 'default:venv'
  WHEN folder IN ('/r1/build', '/r3/build', '/r7/build') THEN 'build:build' WHEN folder = '/r5/docs' THEN 'path:/r5/docs' END AS rule FROM dirs),
ruled AS (
  SELECT coalesce(rule, 'kept') AS rule FROM ruled_dirs
  UNION ALL SELECT CASE WHEN rule IS NOT NULL THEN 'below' WHEN extension = 'pdf' THEN 'extension:.pdf' ELSE 'kept' END FROM f JOIN ruled_dirs USING (folder)
  UNION ALL SELECT CASE WHEN (SELECT count(*) FROM dirs WHERE folder = '/r2/venv') > 0 THEN 'below' ELSE 'kept' END
  UNION ALL SELECT 'kept' FROM range(3)
)
SELECT rule, count(*) AS n FROM ruled GROUP BY rule""",
    "scan_roots": f"""
WITH {_FILES}, p AS (SELECT path FROM files WHERE id % 5 = 0 UNION SELECT regexp_replace(path, '/[^/]*$', '') FROM files WHERE id % 40 = 0)
SELECT path FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE starts_with(a.path, b.path || '/'))""",
    "nearest_repository": f"""
WITH {_FILES} SELECT id, CASE WHEN starts_with(path, '/src1/en/') THEN '/src1/en' WHEN starts_with(path, '/src1/') THEN '/src1' WHEN starts_with(path, '/src3/fr/') THEN '/src3/fr' END AS repository FROM files""",
    "content_candidates": "SELECT doc_id AS id FROM documents WHERE doc_id % 6 IN (0, 1, 2, 3) AND doc_id % 13 <> 0",
    "content_counts": f"""
WITH {_FILES} SELECT count(*) AS total, count(*) FILTER (id % 6 > 2) AS read, count(*) FILTER (id % 6 = 2) AS skipped, count(*) FILTER (id % 6 = 1) AS failed
FROM files WHERE extension IN ('md', 'txt') AND starts_with(path, '/src1')""",
    "retrieval_metrics": f"""
WITH {_PAIRS}, r AS (SELECT query_id, chunk_id, ql = cl AS judged, chunk_id % 3 = 0 AS related, row_number() OVER (PARTITION BY query_id ORDER BY rank_no) AS place FROM ranked WHERE rank_no <= 11 AND query_id <> chunk_id),
f AS (SELECT query_id, count(*) FILTER (judged AND NOT related AND place <= 1) AS h1, count(*) FILTER (judged AND NOT related AND place <= 3) AS h3, count(*) FILTER (judged AND NOT related) AS hk,
  min(place) FILTER (judged AND NOT related) AS first, sum(CASE WHEN NOT judged THEN 0 WHEN related THEN 1.0 ELSE 3.0 END / log2(place + 1)) AS dcg FROM r WHERE place <= 10 GROUP BY query_id),
j AS (SELECT query_id, chunk_id % 3 = 0 AS related, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id % 3 = 0, chunk_id) AS place FROM pairs WHERE ql = cl AND query_id <> chunk_id),
i AS (SELECT query_id, count(*) FILTER (NOT related) AS rel, sum(CASE WHEN related THEN 1.0 ELSE 3.0 END / log2(place + 1)) FILTER (place <= 10) AS idcg FROM j GROUP BY query_id)
SELECT query_id, round(coalesce(h1, 0) / greatest(1, least(rel, 1)), 6) AS recall_1, round(coalesce(h3, 0) / greatest(1, least(rel, 3)), 6) AS recall_3, round(coalesce(hk, 0) / greatest(1, least(rel, 10)), 6) AS recall_k,
  round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg, CASE WHEN first = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS top_1 FROM i LEFT JOIN f USING (query_id)""",
    "latency_percentiles": """
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99
FROM events GROUP BY event_type""",
    "generation_validity": """
SELECT count(*) FILTER (vec_id % 200 <> 1) AS done, count(*) FILTER (vec_id % 200 = 1) AS failed, 0::BIGINT AS pending, 1.0::DOUBLE AS self_recall,
  count(*) FILTER (vec_id % 200 = 1) * 100 <= count(*) AS valid FROM embeddings""",
    "chunk_refs": f"""
WITH {_CHUNKS}, ids AS (SELECT * FROM (VALUES (0, 300000), (1, 1), (2, 100000), (3, 99999999999), (4, 0), (5, 200000)) AS v(position, chunk_id))
SELECT CAST(position AS INTEGER) AS position, CAST(chunk_id AS BIGINT) AS chunk_id, text[1:40] AS excerpt FROM ids JOIN chunks USING (chunk_id)""",
    "fusion_rrf": f"""
WITH {_LANES} SELECT query_id, position, item_id, round(score, 9) AS score, intent, round(confidence, 6) AS confidence, lane, match, title, subtitle FROM placed WHERE position <= 30""",
    "result_violations": """
SELECT 'q' AS query_id, doc_id AS item_id, CASE doc_id % 9 WHEN 0 THEN 'unknown action' WHEN 1 THEN 'repeated action' WHEN 2 THEN 'empty title' WHEN 3 THEN 'confidence' ELSE 'primary not offered' END AS problem FROM documents WHERE doc_id % 9 <= 4
UNION ALL SELECT 'q', doc_id, 'unsafe primary' FROM documents WHERE doc_id % 9 = 4""",
    "change_hints": """
SELECT '/u/' || user_id AS path, bool_or(event_id % 2 = 0) AS recursive, bool_or(event_id % 3 = 0) AS content, count(*) AS hints FROM events WHERE event_type IN ('click', 'purchase', 'signup') GROUP BY 1""",
    "change_passes": """
WITH h AS (SELECT ts, event_type = 'error' AS lost FROM events WHERE event_type IN ('click', 'purchase', 'signup', 'error')),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 300 MILLISECOND THEN 0 ELSE 1 END AS new FROM h),
s AS (SELECT *, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pass FROM g)
SELECT min(ts) AS start, count(*) AS hints, bool_or(lost) AS rescan FROM s GROUP BY pass""",
    "image_states": f"""
WITH {_IMAGES} SELECT id, CASE WHEN id % 12 = 3 THEN 'skipped' WHEN id % 12 = 4 THEN 'failed' WHEN id % 5 = 4 THEN 'not-indexed' WHEN unit AND id % 3 = 0 THEN 'indexed' WHEN unit AND id % 3 = 1 THEN 'failed' ELSE 'pending' END AS image_state FROM img""",
    "image_counts": f"""
WITH {_IMAGES} SELECT count(*) FILTER (read AND unit AND id % 3 = 0) AS indexed, count(*) FILTER (read AND unit AND id % 3 = 2) AS pending, count(*) FILTER (read AND unit AND id % 3 = 1) + count(*) FILTER (id % 12 = 4) AS failed,
  count(*) FILTER (id % 12 = 3) AS skipped FROM img""",
    "ocr_counts": f"""
WITH {_IMAGES} SELECT CASE WHEN fresh THEN state ELSE 'pending' END AS state, count(*) AS n FROM img WHERE read AND unit AND starts_with(path, '/src1') GROUP BY 1""",
    "ocr_candidates": f"""
WITH {_IMAGES} SELECT id, id * 10 AS chunk_id FROM img WHERE read AND unit AND id % 13 <> 0 AND id % 7 <> 6 AND (NOT known OR id % 11 = 0 OR id % 17 = 0 OR state = 'failed' OR (state = 'indexed' AND id % 9 = 0))""",
    "code_candidates": f"WITH {_FILES} SELECT id, path FROM files WHERE extension = 'py' AND id % 4 <> 0 AND id % 13 <> 0 AND id % 6 <> 0 AND id % 3 <> 0",
    "code_context": f"""
WITH {_FILES}, kept AS (SELECT id, path, id % 6 = 4 AS stored, path = '/src1/en' OR starts_with(path, '/src1/en/') AS below FROM files)
SELECT id, CASE WHEN stored THEN 'rust' WHEN id % 3 = 0 THEN 'python' END AS language, CASE WHEN below THEN NULL WHEN stored THEN '/new' WHEN id % 3 = 0 THEN '/r' END AS repository,
  CASE WHEN below THEN NULL WHEN stored OR id % 3 = 0 THEN path WHEN id % 3 = 1 THEN '/old' END AS context_path FROM kept""",
    "code_search_context": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE lower(p_name) || ' brand ' || regexp_extract(p_brand, '[0-9]+') || ' ' || lower(p_type) || ' ' || p_name || ' ' || CASE WHEN p_partkey % 2 = 0 THEN 'rust' ELSE '' END END AS context FROM part""",
    "item_status": """
SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'error' WHEN doc_id % 4 IN (0, 1) THEN 'pending' ELSE 'indexed' END AS status,
  CAST((doc_id % 2 = 0)::INT + 2 * (doc_id % 3 = 0)::INT + 4 * (doc_id % 5 = 0 AND doc_id % 7 <> 0)::INT AS INT) AS attributes FROM documents""",
    "skip_reasons": """
SELECT CASE WHEN doc_id % 5 = 4 THEN 'unsupported' WHEN strlen(text) > 4000 THEN 'too_large' WHEN doc_id % 9 = 0 THEN 'binary' ELSE 'read' END AS reason, count(*) AS n FROM documents GROUP BY 1""",
    "content_same": f"""
WITH {_CHUNKS} SELECT item_id AS id, NOT ((item_id % 10 IN (3, 4) OR item_id % 10 = 5) AND min(chunk_id) = item_id * 100000) AS same FROM chunks GROUP BY item_id""",
    "offered_actions": """
WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN ['reveal', 'pin'] ELSE ['reveal', 'open', 'copy_path', 'pin'] END
  ELSE CASE WHEN doc_id % 4 = 0 THEN ['reveal', 'pin'] ELSE ['open', 'reveal', 'copy_path', 'pin'] END END AS l FROM documents)
SELECT 'q' AS query_id, doc_id AS item_id, CAST(unnest(range(len(l))) AS INT) AS place, unnest(l) AS action FROM a""",
    "user_exclusions": f"""
WITH {_FILES} SELECT id, path FROM files WHERE starts_with(path, '/src3/de/') OR starts_with(path, '/src1/en/') OR starts_with(path, '/src2/en/') OR extension = 'csv'""",
    "location_states": f"""
WITH {_FILES}, r AS (SELECT * FROM (VALUES ('/src0'), ('/src1'), ('/src2'), ('/none')) AS v(path)), n AS (
  SELECT r.path, count(f.id) AS n FROM r LEFT JOIN files f ON starts_with(f.path, r.path || '/') AND f.id % 50 = 0 AND NOT starts_with(f.path, '/src2/') GROUP BY r.path)
SELECT path, CASE WHEN path = '/none' THEN 'not_available' WHEN n > 0 THEN 'partial' ELSE 'ok' END AS state, n AS unlisted FROM n""",
    "index_records": """
WITH g AS (SELECT label AS generation, count(*) AS n FROM embeddings GROUP BY label), m AS (SELECT max(generation) AS new FROM g WHERE generation % 3 <> 0 AND generation <> 0)
SELECT generation, CASE WHEN generation = new THEN 'active' WHEN generation = 0 AND new IS NOT NULL THEN 'retired' WHEN generation = 0 THEN 'active' ELSE 'building' END AS state,
  CASE WHEN generation = coalesce(new, 0) THEN 'g' || generation END AS file, CASE WHEN generation = coalesce(new, 0) THEN 'ready' END AS index FROM g, m""",
    "space_keys": "SELECT vec_id AS chunk_id, 'mock@r' || label || '/pre1/search@' || label || '/d' || len(embedding) || '/l2' AS space FROM embeddings",
    "names_learned": f"""
WITH {_NAME_ITEMS_ONLY}, asked(query_id, key) AS (VALUES ('u1', 'red'), ('u2', 'zzz'), ('u3', 'red bolt')), judged AS (
  SELECT query_id, id, name, path, modified, attributes, id % 100 = 7 AND query_id <> 'u3' AS learned, id % 100 = 7 AS signal, t,
    CASE WHEN query_id = 'u3' THEN CASE WHEN name_key = key THEN 1.0::DOUBLE WHEN starts_with(name_key, key) THEN 0.80 + 0.12 * length(key) / length(name_key) WHEN contains(' ' || name_key || ' ', ' red bolt ') THEN -1 END
      WHEN name_key = key THEN 1.0 WHEN starts_with(name_key, key) THEN 0.80 + 0.12 * length(key) / length(name_key)
      WHEN len(list_filter(t, lambda x: starts_with(x, key))) > 0 THEN CASE WHEN starts_with(t[1], key) THEN 0.78 ELSE 0.70 END + 0.08 * length(key) / length(name_key) END AS found
  FROM (SELECT *, string_split(name_key, ' ') AS t FROM names), asked
), based AS (
  SELECT *, CASE WHEN found IS NULL THEN 0.6 ELSE found END AS base, CASE WHEN found IS NULL THEN 'suggestion' WHEN found = 1.0 THEN 'exact' ELSE 'prefix' END AS match FROM judged WHERE found IS NOT NULL OR learned
), prior AS (
  SELECT *, base + CASE WHEN 1703456000000 - modified < 259200000 THEN 0.04 WHEN 1703456000000 - modified < 2592000000 THEN 0.02 ELSE 0 END
    - CASE WHEN attributes & 3 <> 0 THEN 0.15 ELSE 0 END - least(greatest(length(path) - length(replace(path, '/', '')) - 4, 0) * 0.004, 0.04) AS p FROM based
), head AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, length(name), id) AS n FROM prior
), scored AS (
  SELECT *, p + CASE WHEN signal THEN CASE WHEN id % 200 = 7 THEN 0.05 ELSE 0 END + least(0.025 * ln(3), 0.08) + least(0.12 + 0.08 * ln(3), 0.35) ELSE 0 END AS s FROM head WHERE n <= 50 OR learned
)
SELECT query_id, id, CAST(rank_no AS INT) AS rank_no, round(base, 6) AS base, round(s, 6) AS score, match
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, length(name), id) AS rank_no FROM scored) WHERE rank_no <= 10""",
    "embed_chunks": """
SELECT conv_id, turn, CASE WHEN bad THEN NULL ELSE 768 END AS dims, CASE WHEN bad THEN NULL ELSE 1.0::DOUBLE END AS norm, CASE WHEN bad THEN 'empty_input' END AS error_code
FROM (SELECT *, turn = 2 OR text IS NULL OR trim(text) = '' AS bad FROM conversations)""",
    "item_lookup": f"""
WITH {_FILES}, s AS (SELECT *, string_split(path, '/')[2] AS source FROM files)
SELECT id, path, items FROM s JOIN (SELECT source, count(*) AS items FROM s GROUP BY source) USING (source) WHERE id IN (3, 30) OR path = '/src1/en/doc_0.txt' OR name = 'doc_7.csv'""",
}
