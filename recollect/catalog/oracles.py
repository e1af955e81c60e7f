"""The same results in DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# The ECMAScript white-space class, as RE2 spells it.
_WS = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def _units(text: str) -> str:
    return rf"(length({text}) + len(regexp_extract_all({text}, '[\x{{10000}}-\x{{10ffff}}]')))"


def _words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{_WS}]+'))"


def _tokens(text: str) -> str:
    return f"((5 * {_units(text)} + 2 * {_words(text)} + 19) // 20)::BIGINT"


def _trim(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[{_WS}]+', ''), '[{_WS}]+$', '')"


def _grams(text: str) -> str:
    """Distinct word n-grams of a text as a list."""
    w = f"list_filter(string_split_regex(lower({text}), '[{_WS}]+'), lambda x: x <> '')"
    return f"""(SELECT CASE WHEN len(w) = 0 THEN [''] WHEN len(w) < n THEN list_distinct(w)
        ELSE list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) END
        FROM (SELECT w, CASE WHEN len(w) >= 8 THEN 5 ELSE 3 END AS n FROM (SELECT {w} AS w)))"""


_NOTES = """notes AS (
  SELECT doc_id AS id, source AS project, 'manual' AS kind, text, lang, NULL::VARCHAR AS file_path,
         NULL::INTEGER AS line_start, NULL::INTEGER AS line_end, sha256(text) AS content_hash FROM documents)"""

_TURNS = """turns AS (
  SELECT conv_id * 100000 + turn AS id, 'talk' AS project, 'code' AS kind, text, role,
         'conv/' || conv_id AS file_path, (turn * 5 + 1)::INTEGER AS line_start,
         (turn * 5 + 8)::INTEGER AS line_end, sha256(text) AS content_hash FROM conversations)"""

_HEADER = """'[' || id || '] (' || CASE WHEN coalesce(file_path, '') <> '' AND line_start IS NOT NULL
    THEN file_path || ':' || line_start || '-' || coalesce(line_end::VARCHAR, 'null') ELSE kind END || ') '"""

# -- reads ------------------------------------------------------------------

ORACLES["list_newest"] = """
SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, value
FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20"""

ORACLES["list_third_page"] = """
SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, event_type
FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100"""

ORACLES["point_get"] = """
SELECT doc_id AS id, source AS project, sha256(text) AS content_hash FROM documents WHERE source = 'src3' AND doc_id = 23"""

ORACLES["get_by_ids"] = """
SELECT item_id AS pos, doc_id AS id, source AS project, 'manual' AS kind, sha256(d.text) AS content_hash
FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 37 ORDER BY pos"""

ORACLES["ids_for_project"] = "SELECT doc_id AS id FROM documents WHERE source = 'src5' ORDER BY id"

ORACLES["vectors_for_project"] = """
SELECT vec_id AS id, len(embedding)::INTEGER AS dim,
       round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS norm
FROM embeddings WHERE label = 2"""

ORACLES["chunks_for_file"] = f"""
WITH {_TURNS} SELECT id, file_path, content_hash, line_start, line_end FROM turns WHERE file_path = 'conv/7'"""

ORACLES["ingested_files"] = "SELECT DISTINCT 'conv/' || conv_id AS file_path FROM conversations"

ORACLES["file_gate"] = """
WITH long AS (SELECT page_id, CASE WHEN page_id % 10 = 3 THEN repeat(html, ceil(600000.0 / greatest(length(html), 1))::BIGINT) ELSE html END AS t FROM pages),
  raw AS (SELECT page_id, CASE WHEN page_id % 7 = 2 THEN t || chr(0) ELSE t END AS t FROM long)
SELECT page_id, octet_length(encode(t))::BIGINT AS size, octet_length(encode(t)) > 524288 AS too_large, contains(t, chr(0)) AS binary
FROM raw"""

ORACLES["path_patterns"] = r"""
SELECT page_id, (regexp_full_match(path, '[^/]*\.example\.[^/]*/e[^/]/.*') OR contains(path, 'ththth'))
    AND NOT (regexp_full_match(path, '.*#top') OR contains(path, 'page=2')) AS keep
FROM (SELECT page_id, regexp_extract(url, '^https?://(.*)$', 1) AS path FROM pages)"""

ORACLES["ignored_paths"] = r"""
WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://(.*)$', 1) AS path FROM pages),
  places AS (SELECT path, n, n < len(s) AS folder, array_to_string(s[1:n], '/') AS place, s[n] AS name
             FROM (SELECT path, string_split(path, '/') AS s FROM p), range(1, 40) r(n) WHERE n <= len(s)),
  judged AS (
    SELECT path, place,
      -- The last rule that matches decides; a folder's own rules come after those above it.
      CASE WHEN starts_with(place, 'ththin.example.com/en/') AND name = '671?utm_source=feed' THEN false
           WHEN starts_with(place, 'ththin.example.com/en/')
                AND regexp_matches(substr(place, 23), '(^|/)6[^/][^/][^/]*(/|$)') THEN true
           WHEN starts_with(place, 'blog.ththan.example.net/') AND regexp_matches(substr(place, 25), '^en/[^/][0-5][^/]*(/|$)') THEN false
           WHEN folder AND starts_with(place, 'blog.ththan.example.net/') AND regexp_matches(substr(place, 25), '(^|/)en(/|$)') THEN false
           WHEN starts_with(place, 'blog.ththan.example.net/') THEN true
           WHEN regexp_matches(place, '^m\.[^/]*\.net/(.*/)?[^/]*#top(/|$)') THEN false
           WHEN regexp_matches(place, '(^|/)[0-4][^/]*\.html(/|$)') THEN true
           WHEN folder AND regexp_matches(place, '^[^/]*\.net/fr(/|$)') THEN true
           WHEN regexp_matches(place, '(^|/)[^/]*#top(/|$)') THEN true
           WHEN regexp_matches(place, '(^|/)spam-farm\.[^/]*(/|$)') THEN true
           ELSE false END AS bad
    FROM places)
SELECT path AS rel_path, bool_or(bad) AS ignored FROM judged GROUP BY path"""

ORACLES["first_files"] = """
SELECT 'site/' || page_id || '/page.html' AS rel_path FROM pages ORDER BY rel_path LIMIT 100"""

# -- writes as transformations -----------------------------------------------

ORACLES["assign_ids"] = """
SELECT 999 + row_number() OVER (ORDER BY source, doc_id) AS id, source AS project, doc_id AS seq FROM documents"""

ORACLES["remove_many"] = """
SELECT doc_id AS id, source AS project FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)"""

ORACLES["update_ranges"] = f"""
WITH {_TURNS}
SELECT id, file_path, (line_start + d)::INTEGER AS line_start, (line_end + d)::INTEGER AS line_end,
       CASE d WHEN 3 THEN '2024-02-02' ELSE '2024-01-01' END AS updated
FROM (SELECT *, CASE WHEN role = 'assistant' THEN 3 ELSE 0 END AS d FROM turns)"""

ORACLES["migrate_v1"] = """
SELECT doc_id AS id, 'default' AS project, 'manual' AS kind, lang || '|' || source AS tags, sha256(text) AS text_hash,
       n_chars::FLOAT::DOUBLE AS second, '2024-05-06T07:08:09.123Z' AS created_at, true AS same_time
FROM documents"""

ORACLES["decode_tags"] = """
SELECT doc_id, CASE WHEN lang = 'en' THEN source || '|b' ELSE '' END AS tags FROM documents"""

# -- aggregates -----------------------------------------------------------------

ORACLES["count_all"] = "SELECT count(*) AS n FROM documents"
ORACLES["count_project"] = "SELECT count(*) AS n FROM documents WHERE source = 'src7'"
ORACLES["project_counts"] = "SELECT source AS project, count(*) AS count FROM documents GROUP BY source ORDER BY source"
ORACLES["distinct_projects"] = "SELECT DISTINCT source AS project FROM documents ORDER BY project"
ORACLES["max_id"] = "SELECT coalesce(max(doc_id), 0) AS max_id FROM documents"

ORACLES["project_sizes"] = """
SELECT d.project, d.count, coalesce(e.indexed, 0) AS indexed
FROM (SELECT source AS project, count(*) AS count FROM documents GROUP BY source) d
LEFT JOIN (SELECT 'src' || label AS project, count(*) AS indexed FROM embeddings GROUP BY label) e USING (project)"""

ORACLES["index_digest"] = """
WITH ids AS (SELECT source AS project, doc_id * 97 AS id FROM documents),
  blocks AS (SELECT project, id // 4096 AS block, sha256(string_agg(id::VARCHAR, ',' ORDER BY id)) AS item FROM ids GROUP BY ALL),
  shelves AS (SELECT project, block // 4096 AS shelf, sha256(string_agg(item, ',' ORDER BY block)) AS item FROM blocks GROUP BY ALL)
SELECT project, substr(sha256(string_agg(item, ',' ORDER BY shelf)), 1, 16) AS digest FROM shelves GROUP BY project"""

ORACLES["value_percentiles"] = """
WITH ranked AS (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r,
         count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, p::INTEGER AS percent, value FROM ranked, (VALUES (50), (95), (99)) AS v(p)
WHERE r = greatest(ceil(p * n / 100.0), 1)"""

ORACLES["exact_duplicates"] = """
SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id
FROM documents GROUP BY text HAVING count(*) > 1"""

# -- scalar functions -------------------------------------------------------------

ORACLES["estimate_tokens"] = f"""
SELECT doc_id, {_units('text')}::BIGINT AS units, {_words('text')}::BIGINT AS words, {_tokens('text')} AS tokens FROM documents"""

ORACLES["content_hashes"] = "SELECT conv_id, turn, sha256(text) AS content_hash FROM conversations"

ORACLES["hit_costs"] = f"""
WITH {_NOTES}, {_TURNS},
  rows AS (SELECT * EXCLUDE (lang) FROM notes UNION ALL BY NAME SELECT * EXCLUDE (role) FROM turns),
  headed AS (SELECT id, {_HEADER} AS header, text FROM rows)
SELECT id, header, {_tokens('(header || text)')} AS cost FROM headed"""

ORACLES["parse_tags"] = f"""
WITH raw AS (SELECT doc_id, upper(lang) || ', ' || source || ', ' || lang || ',  ,' || chr(9) || ', ' || split_part(text, chr(10), 1) AS r
             FROM documents),
  tags AS (SELECT doc_id, tag, min(place) AS first_place FROM (
     SELECT doc_id, unnest(string_split_regex(lower(r), '[,{_WS}]+')) AS tag,
            generate_subscripts(string_split_regex(lower(r), '[,{_WS}]+'), 1) AS place FROM raw)
     WHERE tag <> '' GROUP BY doc_id, tag)
SELECT doc_id, string_agg(tag, '|' ORDER BY first_place) AS tags FROM tags GROUP BY doc_id"""

ORACLES["normalize_project"] = """
SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE 'default' END AS project FROM documents"""

ORACLES["detect_language"] = """
WITH names AS (SELECT page_id, url || e AS path FROM pages, (VALUES (''), ('.go'), ('.TSX'), ('.pyi'), ('.mjs'), ('.md'), ('.')) AS v(e))
SELECT page_id, path, CASE lower(regexp_extract(path, '([^.]*)$', 1)) WHEN 'go' THEN 'go'
    WHEN 'js' THEN 'js' WHEN 'jsx' THEN 'js' WHEN 'mjs' THEN 'js' WHEN 'cjs' THEN 'js'
    WHEN 'ts' THEN 'ts' WHEN 'tsx' THEN 'ts' WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python' ELSE 'text' END AS lang
FROM names"""

ORACLES["normalize_newlines"] = r"""
SELECT doc_id, sha256(regexp_replace(text, '\. ', '.' || chr(10), 'g')) AS hash FROM documents"""

ORACLES["embed_texts"] = f"""
WITH {_TURNS}, texts AS (
  SELECT id, file_path || ':' || line_start || '-' || line_end || ' ' || role ||
         CASE WHEN role <> 'user' THEN ' ' || role ELSE '' END || chr(10) || text AS t FROM turns)
SELECT id, sha256(t) AS hash, sha256(substr(t, 1, 1200)) AS clip_hash, ((length(t) + 299) // 300)::INTEGER AS windows,
  sha256(array_to_string(list_transform(range(0, length(t), 300), lambda i: sha256(substr(t, i + 1, 300))), ',')) AS windows_hash FROM texts"""

ORACLES["shingle_counts"] = f"SELECT doc_id, len({_grams('text')})::INTEGER AS shingles FROM documents"

ORACLES["neighbour_jaccard"] = f"""
WITH g AS (SELECT conv_id, turn, {_grams('text')} AS a,
                  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations),
  pairs AS (SELECT conv_id, turn, a, {_grams('following')} AS b FROM g WHERE following IS NOT NULL),
  counted AS (SELECT conv_id, turn, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS common FROM pairs)
SELECT conv_id, turn, round(common::DOUBLE / (na + nb - common), 9) AS similarity FROM counted"""

ORACLES["cosine_to_next"] = """
SELECT a.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""

ORACLES["vector_codec"] = """
SELECT vec_id AS id, (4 * len(embedding))::INTEGER AS bytes,
       round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS norm FROM embeddings"""


def _vectors(name: str, source: str, key: str, text: str) -> str:
    """CTEs for hashed word-count vectors: rows of (key, dim, v), v as stored in float32."""
    return f"""{name}_words AS (
    SELECT {key}, unnest(regexp_extract_all(lower({text}), '[^{_WS}]+')) AS w FROM {source}),
  {name}_hashed AS (SELECT {key}, w, count(*) AS n, md5(w) AS h FROM {name}_words GROUP BY {key}, w),
  {name}_counts AS (
    SELECT {key}, ('0x' || substr(h, 1, 8))::UBIGINT % 384 AS dim,
           sum(CASE WHEN substr(h, 9, 1) IN ('0','2','4','6','8','a','c','e') THEN n ELSE -n END)::BIGINT AS c
    FROM {name}_hashed GROUP BY ALL),
  {name}_norms AS (SELECT {key}, sqrt(sum(c * c)::DOUBLE) AS norm FROM {name}_counts GROUP BY {key}),
  {name} AS (SELECT {key}, dim, (c / norm)::FLOAT AS v FROM {name}_counts JOIN {name}_norms USING ({key}) WHERE c <> 0)"""


ORACLES["hash_embedding"] = f"""
WITH {_NOTES}, {_vectors('vec', 'notes', 'id', 'text')},
  sums AS (SELECT id, count(*) AS occupied, sum(round(v::DOUBLE * 1000000)::BIGINT * (dim::BIGINT + 1))::BIGINT AS weighted FROM vec GROUP BY id)
SELECT id, coalesce(occupied, 0)::INTEGER AS occupied, coalesce(weighted, 0)::BIGINT AS weighted FROM notes LEFT JOIN sums USING (id)"""

# -- search -----------------------------------------------------------------------

_ASKED = """WITH scored AS (
  SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INTEGER AS rank FROM scored)"""

ORACLES["knn_top_k"] = f"{_ASKED} SELECT query_id, rank, id, round(s, 6) AS score FROM ranked WHERE rank <= 10"

ORACLES["knn_cells"] = f"{_ASKED} SELECT query_id, rank, id, round(s, 6) AS score FROM ranked WHERE rank <= 5 AND s >= 0.9"

_KNN = """WITH scored AS (
  SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s
  FROM embeddings e JOIN embeddings q USING (label)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INTEGER AS rank FROM scored)"""

ORACLES["knn_per_project"] = f"{_KNN} SELECT query_id, rank, id, round(s, 6) AS score FROM ranked WHERE rank <= 5"

ORACLES["knn_min_score"] = f"""{_KNN},
  cut AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS candidates FROM ranked WHERE rank <= 12)
SELECT query_id, id, candidates, round(s, 6) AS score FROM cut WHERE s >= 0.3"""


def _recall(
    rows: str, project: str, min_score: str, select: str, fetch: int | None = None, source: str | None = None,
    asked: str | None = None,
) -> str:
    """The whole pipeline: score, keep the best of equal texts, filter, decide duplicates in rank
    order, pack. Without ``fetch`` all rows are candidates.

    ``dups`` lists, per candidate, the better-ranked candidates it duplicates; ``fold``
    walks the ranks and keeps a candidate when none of those has been kept.
    """
    source = source or (_NOTES if rows == "notes" else _TURNS)
    asked = asked or f"SELECT item_id AS query_id, text, {project} AS project FROM benchmark"
    cut = f"WHERE near <= {fetch}" if fetch else ""
    return f"""WITH RECURSIVE {source},
  asked AS ({asked}),
  {_vectors('vec', rows, 'id', 'text')},
  {_vectors('qvec', 'asked', 'query_id', 'text')},
  dots AS (SELECT a.query_id, v.id, sum(q.v::DOUBLE * v.v::DOUBLE) AS s
           FROM asked a JOIN qvec q USING (query_id) JOIN {rows} r USING (project) JOIN vec v ON v.id = r.id AND v.dim = q.dim GROUP BY ALL),
  scored AS (SELECT a.query_id, r.id, r.content_hash, round(coalesce(s, 0), 9) + 0.0 AS score
             FROM asked a JOIN {rows} r USING (project) LEFT JOIN dots d ON d.query_id = a.query_id AND d.id = r.id),
  texts AS (SELECT query_id, id, score FROM scored
            QUALIFY row_number() OVER (PARTITION BY query_id, content_hash ORDER BY score DESC, id) = 1),
  nearest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS near FROM texts),
  fetched AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS candidates FROM nearest {cut}),
  cands AS MATERIALIZED (
    SELECT query_id, id, score, candidates, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn
    FROM fetched WHERE {min_score}),
  used AS (SELECT DISTINCT id FROM cands),
  grams AS (SELECT id, unnest({_grams('text')}) AS g FROM {rows} WHERE id IN (SELECT id FROM used)),
  sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
  common AS (SELECT a.id AS x, b.id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id
             JOIN {rows} ra ON ra.id = a.id JOIN {rows} rb ON rb.id = b.id AND rb.project = ra.project GROUP BY ALL),
  alike AS (SELECT x, y FROM common JOIN sizes sx ON sx.id = x JOIN sizes sy ON sy.id = y
            WHERE common.n::DOUBLE / (sx.n + sy.n - common.n) >= 0.85
            UNION SELECT a.id, b.id FROM {rows} a JOIN {rows} b ON a.project = b.project AND a.content_hash = b.content_hash AND a.id < b.id
            UNION SELECT a.id, b.id FROM {rows} a JOIN {rows} b ON a.file_path = b.file_path AND a.id < b.id
                  AND a.line_start <= b.line_end AND b.line_start <= a.line_end),
  dups AS (SELECT l.query_id, l.rn, list(b.rn) AS better FROM cands l
           JOIN (SELECT x AS id, y AS other FROM alike UNION ALL SELECT y, x FROM alike) p ON p.id = l.id
           JOIN cands b ON b.query_id = l.query_id AND b.id = p.other AND b.rn < l.rn GROUP BY l.query_id, l.rn),
  fold(query_id, rn, kept) AS (
    SELECT query_id, 0::BIGINT, []::BIGINT[] FROM asked
    UNION ALL
    SELECT f.query_id, c.rn, CASE WHEN list_has_any(f.kept, coalesce(d.better, []::BIGINT[])) THEN f.kept ELSE list_append(f.kept, c.rn) END
    FROM fold f JOIN cands c ON c.query_id = f.query_id AND c.rn = f.rn + 1
    LEFT JOIN dups d ON d.query_id = c.query_id AND d.rn = c.rn),
  final AS (SELECT query_id, arg_max(kept, rn) AS kept FROM fold GROUP BY query_id),
  surviving AS (SELECT c.* FROM cands c JOIN final f USING (query_id) WHERE list_contains(f.kept, c.rn)),
  headed AS (SELECT s.query_id, s.id, s.score, s.candidates, {_HEADER} || text AS line FROM surviving s JOIN {rows} USING (id)),
  costed AS (SELECT query_id, id, score, candidates, {_tokens('line')} AS cost FROM headed),
  packed AS (SELECT *, row_number() OVER w AS rank, (sum(cost) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS running_tokens,
                    count(*) OVER (PARTITION BY query_id) AS survivors
             FROM costed WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id))
{select}"""


_NOTE_PROJECT = "'src' || (item_id % 20)"

ORACLES["recall_notes"] = _recall(
    "notes", _NOTE_PROJECT, "true",
    "SELECT query_id, rank::INTEGER AS rank, id, score, cost, running_tokens FROM packed WHERE running_tokens <= 2000",
)

ORACLES["recall_notes_stats"] = _recall(
    "notes", f"CASE WHEN item_id % 5 = 4 THEN 'nowhere' ELSE {_NOTE_PROJECT} END",
    "(query_id % 5 <> 3 OR score >= 0.99)",
    """, looked AS (SELECT query_id, max(candidates) AS candidates FROM fetched GROUP BY query_id)
SELECT a.query_id, coalesce(max(l.candidates), 0) AS candidates, coalesce(max(survivors), 0) AS survivors,
       count(*) FILTER (running_tokens <= 2000) AS returned,
       coalesce(sum(cost) FILTER (running_tokens <= 2000), 0)::BIGINT AS tokens_used,
       count(*) FILTER (running_tokens > 2000) AS truncated
FROM asked a LEFT JOIN looked l USING (query_id) LEFT JOIN packed p ON p.query_id = a.query_id GROUP BY a.query_id""",
)

ORACLES["recall_turns"] = _recall(
    "turns", "'talk'", "score >= 0.02",
    "SELECT query_id, rank::INTEGER AS rank, id, score, cost FROM packed WHERE rank <= 10", 400,
)

ORACLES["dedup_greedy"] = _recall("notes", _NOTE_PROJECT, "true", "SELECT query_id, id, score FROM packed", 400)

_COMMON = """sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
  common AS (SELECT a.id AS x, b.id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
  alike AS (SELECT x, y, common.n::DOUBLE / (sx.n + sy.n - common.n) AS similarity
            FROM common JOIN sizes sx ON sx.id = x JOIN sizes sy ON sy.id = y
            WHERE common.n::DOUBLE / (sx.n + sy.n - common.n) >= 0.85)"""

ORACLES["similar_notes"] = f"""
WITH sets AS (SELECT doc_id AS id, list_sort({_grams('text')}) AS g FROM documents),
  firsts AS (SELECT min(id) AS id, g FROM sets GROUP BY g),
  grams AS (SELECT id, unnest(g) AS g FROM firsts), {_COMMON}
SELECT x AS a, y AS b, round(similarity, 9) AS similarity FROM alike"""

ORACLES["dedup_long_list"] = f"""
WITH RECURSIVE {_NOTES}, {_TURNS},
  rows AS (SELECT id, text, content_hash, file_path, line_start, line_end FROM notes
           UNION ALL SELECT -id - 1, text, content_hash, file_path, line_start, line_end FROM turns),
  cands AS MATERIALIZED (
    SELECT *, (((id * 7919) % 1000 + 1000) % 1000) / 1000 AS score,
      row_number() OVER (ORDER BY (((id * 7919) % 1000 + 1000) % 1000) / 1000 DESC, id) AS rn FROM rows),
  grams AS MATERIALIZED (SELECT id, unnest({_grams('text')}) AS g FROM rows), {_COMMON},
  pairs AS (SELECT x, y FROM alike
            UNION SELECT a.id, b.id FROM rows a JOIN rows b ON a.content_hash = b.content_hash AND a.id < b.id
            UNION SELECT a.id, b.id FROM rows a JOIN rows b ON a.file_path = b.file_path AND a.id < b.id
                  AND a.line_start <= b.line_end AND b.line_start <= a.line_end),
  dups AS MATERIALIZED (SELECT l.rn, list(b.rn) AS better FROM cands l JOIN (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs) p ON p.x = l.id
           JOIN cands b ON b.id = p.y AND b.rn < l.rn GROUP BY l.rn),
  fold(rn, kept) AS (
    SELECT 0::BIGINT, []::BIGINT[]
    UNION ALL
    SELECT c.rn, CASE WHEN list_has_any(f.kept, coalesce(d.better, []::BIGINT[])) THEN f.kept ELSE list_append(f.kept, c.rn) END
    FROM fold f JOIN cands c ON c.rn = f.rn + 1 LEFT JOIN dups d ON d.rn = c.rn)
SELECT id, score FROM cands WHERE list_contains((SELECT arg_max(kept, rn) FROM fold), rn)"""

ORACLES["overlap_pairs"] = f"""
WITH {_TURNS}
SELECT x.id AS a, y.id AS b FROM turns x JOIN turns y ON x.file_path = y.file_path AND x.id < y.id
  AND x.line_start <= y.line_end AND y.line_start <= x.line_end"""

_FLOOD = f"""{_NOTES},
  first AS (SELECT arg_min(text, id) AS text, arg_min(content_hash, id) AS content_hash FROM notes),
  flood AS (SELECT * REPLACE ('all' AS project) FROM notes UNION ALL BY NAME
            SELECT n.* REPLACE (n.id + 10000000 AS id, 'all' AS project, f.text AS text, f.content_hash AS content_hash) FROM notes n, first f)"""

ORACLES["recall_copies"] = _recall(
    "flood", "", "true", "SELECT query_id, rank::INTEGER AS rank, id, score, cost FROM packed WHERE rank <= 20", 400,
    _FLOOD, "SELECT 0::BIGINT AS query_id, text, 'all' AS project FROM first",
)

ORACLES["recall_same_id"] = _recall(
    "notes", "", "true",
    """SELECT 'src' || (query_id // 1000000) AS project, query_id % 1000000 AS query_id, rank::INTEGER AS rank, id, score
FROM packed WHERE rank <= 3""",
    asked="""SELECT item_id + 1000000 * p AS query_id, text, 'src' || p AS project
           FROM benchmark, (VALUES (1::BIGINT), (2::BIGINT)) v(p)""",
)

ORACLES["pack_budget"] = f"""
WITH {_NOTES}, headed AS (SELECT substr(project, 4)::BIGINT AS query_id, id, {_HEADER} || text AS line FROM notes),
  costed AS (SELECT query_id, id, {_tokens('line')} AS cost FROM headed),
  packed AS (SELECT query_id, row_number() OVER w AS rank, id, cost, (sum(cost) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS running_tokens
             FROM costed WINDOW w AS (PARTITION BY query_id ORDER BY id))
SELECT query_id, rank::INTEGER AS rank, id, cost, running_tokens FROM packed WHERE running_tokens <= 5000"""

# -- ingestion --------------------------------------------------------------------

_NEXT = f"""{_TURNS},
  next AS (SELECT rel_path, p AS ordinal, content, role AS lang, sha256(content) AS content_hash,
                  (p * 5 + 1)::INTEGER AS start_line, (p * 5 + 8)::INTEGER AS end_line
           FROM (SELECT 'conv/' || conv_id AS rel_path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, role,
                        CASE WHEN length(text) > 400 THEN text || ' (edited)' ELSE text END AS content
                 FROM conversations WHERE role <> 'system'))"""

_DIFF = f"""WITH {_NEXT},
  fresh AS (SELECT *, row_number() OVER (PARTITION BY rel_path, content_hash ORDER BY ordinal) AS k FROM next),
  known AS (SELECT *, row_number() OVER (PARTITION BY file_path, content_hash ORDER BY id) AS k FROM turns),
  diff AS (SELECT coalesce(f.rel_path, s.file_path) AS rel_path, coalesce(f.content_hash, s.content_hash) AS content_hash,
             CASE WHEN s.id IS NULL THEN 'created' WHEN f.rel_path IS NULL THEN 'stale'
                  WHEN f.start_line = s.line_start AND f.end_line = s.line_end THEN 'unchanged' ELSE 'moved' END AS status,
             s.id, f.start_line, f.end_line
           FROM fresh f FULL JOIN known s ON s.file_path = f.rel_path AND s.content_hash = f.content_hash AND s.k = f.k)"""

ORACLES["ingest_diff"] = f"""{_DIFF}
SELECT rel_path, content_hash, status, coalesce(id, -1) AS id, coalesce(start_line, -1) AS start_line, coalesce(end_line, -1) AS end_line
FROM diff"""

ORACLES["ingest_totals"] = f"""{_DIFF},
  files AS (SELECT rel_path, count(*) FILTER (status <> 'stale') AS chunks, count(*) FILTER (status <> 'unchanged') AS touched FROM diff GROUP BY rel_path)
SELECT (SELECT count(*) FROM files WHERE chunks > 0) AS "filesScanned",
       (SELECT count(*) FROM files WHERE chunks > 0 AND touched > 0) AS "filesChanged",
       (SELECT count(*) FROM files WHERE chunks = 0) AS "filesDeleted",
       count(*) FILTER (status = 'created') AS "chunksCreated", count(*) FILTER (status = 'moved') AS "chunksUpdated",
       count(*) FILTER (status = 'unchanged') AS "chunksUnchanged", count(*) FILTER (status = 'stale') AS "chunksDeleted",
       count(*) FILTER (status <> 'stale') AS "totalChunks" FROM diff"""

ORACLES["stale_chunks"] = f"""
WITH {_NEXT} SELECT id, file_path FROM turns t
WHERE NOT EXISTS (SELECT 1 FROM next n WHERE n.rel_path = t.file_path AND n.content_hash = t.content_hash)"""

ORACLES["vanished_files"] = """
SELECT DISTINCT 'c/' || o_custkey AS file_path FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)"""

ORACLES["range_overlaps"] = f"""
WITH {_TURNS}
SELECT a.id, (SELECT count(*) FROM turns b WHERE b.file_path = a.file_path AND b.id <> a.id
              AND a.line_start <= b.line_end AND b.line_start <= a.line_end) AS overlaps FROM turns a"""

# Windows of 60 lines, 48 apart. "cut" is the last blank line among a window's
# last eight, the first line excepted; the window then ends before it.
_WINDOWS = f"""files AS (
    SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS lines FROM documents
    WHERE regexp_matches(text, '[^{_WS}]')),
  flagged AS (SELECT doc_id, lines, len(lines)::INTEGER AS n,
                     list_transform(lines, lambda l: NOT regexp_matches(l, '[^{_WS}]')) AS blank FROM files),
  win(doc_id, s, e, n) AS (
    SELECT doc_id, NULL::INTEGER, -1, n FROM flagged
    UNION ALL
    SELECT doc_id, s, CASE WHEN cut IS NULL THEN e ELSE cut - 1 END, n FROM (
      SELECT doc_id, s, e, n, list_max(list_filter(range(greatest(e - 7, s + 1), e + 1), lambda i: blank[i + 1]))::INTEGER AS cut
      FROM (SELECT w.doc_id, f.blank, f.n, CASE WHEN w.s IS NULL THEN 0 ELSE least(w.s + 48, w.e + 1) END AS s,
                   least(CASE WHEN w.s IS NULL THEN 0 ELSE least(w.s + 48, w.e + 1) END + 59, f.n - 1) AS e
            FROM win w JOIN flagged f USING (doc_id) WHERE w.e < w.n - 1))),
  chunks AS (SELECT doc_id, s, e, array_to_string(lines[s + 1 : e + 1], chr(10)) AS content FROM win JOIN flagged USING (doc_id)
             WHERE s IS NOT NULL)"""

ORACLES["line_windows"] = f"""
WITH RECURSIVE {_WINDOWS}
SELECT 'doc/' || doc_id || '.txt' AS rel_path, (s + 1)::INTEGER AS start_line, (e + 1)::INTEGER AS end_line, sha256(content) AS hash
FROM chunks WHERE regexp_matches(content, '[^{_WS}]')"""

ORACLES["chunk_languages"] = f"""
WITH RECURSIVE {_WINDOWS}
SELECT 'text' AS lang, count(*) AS chunks FROM chunks WHERE regexp_matches(content, '[^{_WS}]')
UNION ALL SELECT 'go', count(*) + count(DISTINCT conv_id) FROM conversations"""

# Each function is a comment line and three lines of code, a blank line between two.
ORACLES["code_chunks"] = r"""
WITH parts AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
         '// Turn' || turn || ' is said by the ' || role || '.' || chr(10) || 'func Turn' || turn || '(w Writer) {' || chr(10) ||
         chr(9) || 'w.Say("' || replace(regexp_replace(text, '[\\"]', '''', 'g'), chr(10), ' { ') || '")' || chr(10) || '}' AS body
  FROM conversations)
SELECT 'talk/' || conv_id || '.go' AS rel_path, 0 AS ordinal, 1 AS start_line, 1 AS end_line, 'preamble' AS unit_kind, '' AS unit,
       sha256('package talk') AS hash FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL
SELECT 'talk/' || conv_id || '.go', k::INTEGER, (5 * k - 3)::INTEGER, (5 * k + 1)::INTEGER, 'func', 'Turn' || turn, sha256(chr(10) || body) FROM parts"""

# A preamble of four lines, then per month a decorator, a class and its method: six lines, a blank line between two.
_QUOTES = '"' * 3
ORACLES["python_chunks"] = f"""
WITH months AS (SELECT o_orderstatus || '/' || substr(o_orderpriority, 1, 1) AS module, strftime(o_orderdate, '%Y%m') AS month, count(*) AS n
                FROM orders GROUP BY ALL),
  parts AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY month) AS k,
         '@register' || chr(10) || 'class Month' || month || ':' || chr(10) || '    {_QUOTES}Orders (of the month.{_QUOTES}' || chr(10) || chr(10) ||
         '    def count(self):' || chr(10) || '        return ' || n AS body FROM months)
SELECT 'orders/' || module || '.py' AS rel_path, 0 AS ordinal, 1 AS start_line, 4 AS end_line, 'preamble' AS unit_kind, '' AS unit,
       sha256('{_QUOTES}Orders {{' || chr(10) || 'by month.{_QUOTES}' || chr(10) || 'import base' || chr(10)) AS hash FROM (SELECT DISTINCT module FROM months)
UNION ALL
SELECT 'orders/' || module || '.py', k::INTEGER, (7 * k - 2)::INTEGER, (7 * k + 3)::INTEGER, 'class', 'Month' || month, sha256(body) FROM parts"""

ORACLES["ts_chunks"] = r"""
WITH parts AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
         '/** ' || role || ' */' || chr(10) || 'export const turn' || turn || ': (w: Writer) => Promise<void> = async (w) => {' || chr(10) ||
         '  await w.say("' || replace(regexp_replace(text, '[\\"]', '''', 'g'), chr(10), ' { ') || '");' || chr(10) || '};' AS body
  FROM conversations)
SELECT 'talk/' || conv_id || '.ts' AS rel_path, 0 AS ordinal, 1 AS start_line, 1 AS end_line, 'preamble' AS unit_kind, '' AS unit,
       sha256('import { Writer } from ''./writer'';') AS hash FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL
SELECT 'talk/' || conv_id || '.ts', k::INTEGER, (5 * k - 3)::INTEGER, (5 * k + 1)::INTEGER, 'function', 'turn' || turn, sha256(chr(10) || body) FROM parts"""

ORACLES["go_forms"] = r"""
WITH forms(ordinal, start_line, end_line, unit_kind, name, body) AS (VALUES
    (0, 1, 2, 'preamble', '', 'package s;'), (1, 3, 5, 'struct', 'A#', 'type A# struct {;	x int;}'),
    (2, 6, 7, 'interface', 'B#', 'type B# interface {;}'), (3, 8, 8, 'type', 'C#', 'type C# = int'),
    (4, 9, 12, 'block', '', 'var (;	a = 1;);const D# = 2'), (5, 13, 14, 'func', 'E#', 'func E#() {;}'),
    (6, 15, 16, 'method', 'F#', 'func (r *A#) F#() {;}'))
SELECT 's' || s_suppkey || '.go' AS rel_path, ordinal, start_line, end_line, unit_kind, replace(name, '#', s_suppkey::VARCHAR) AS unit,
       sha256(replace(replace(replace(body, '#', s_suppkey::VARCHAR), ';', chr(10)), '\t', chr(9))) AS hash
FROM supplier, forms"""

# Pieces of 160 lines, 140 apart, until one reaches the end.
ORACLES["oversize_pieces"] = """
WITH files AS (SELECT page_id, length(html) // 10 + 2 AS n FROM pages),
  starts AS (SELECT page_id, n, unnest(range(0, n, 140)) AS before FROM files)
SELECT 'p' || page_id || '.go' AS rel_path, (row_number() OVER (PARTITION BY page_id ORDER BY before) - 1)::INTEGER AS ordinal,
       (before + 1)::INTEGER AS start_line, least(n, before + 160)::INTEGER AS end_line, 'func' AS unit_kind, 'Big' AS unit
FROM starts WHERE before = 0 OR before + 20 < n"""
