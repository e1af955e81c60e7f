"""The corpus operators as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import (
    counts,
    decontaminate,
    filter_audit,
    langid,
    license,
    mixing,
    neighbours,
    quality,
    repeats,
    simhash,
    token_files,
    warc,
    whitening,
)
from recollect.llm.base import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    rows = langid.languages_of(docs, pages, Scratch(spark))
    is_doc = F.col("kind") == "document"
    return rows.select(
        F.when(is_doc, F.col("id")).alias("doc_id"), F.when(~is_doc, F.col("id")).alias("page_id"), "lang",
        F.round("confidence", 4).alias("confidence"), "text_lang", "declared",
    )  # fmt: skip


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license.scanned(table(spark, sf_dir, "documents"))
    return rows.withColumn("n_found", F.size("detections").cast("long")).drop("detections")


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), Scratch(spark)).drop("url")


ORACLES["op3_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (SELECT *, octet_length(encode(html)) AS n, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), Scratch(spark))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.without_repeats(table(spark, sf_dir, "documents"), Scratch(spark))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.scored(table(spark, sf_dir, "documents"), Scratch(spark))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("distance", 4).alias("distance"),
    )  # fmt: skip


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
    return rows.select(
        "doc_id", simhash.hexadecimal("fp").alias("fingerprint"), F.col("first.doc_id").alias("component_id")
    )


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.drop("row").withColumn("score", F.round("score", 6))


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = mixing.mixed(docs, Scratch(spark))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLES["op10_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(concat_ws(':', '17', coalesce(doc_id::VARCHAR, 'null'))) AS shuffle FROM documents
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k
  FROM d GROUP BY source
), w AS (SELECT *, CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM t
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM t) * CAST(1.5 AS DOUBLE)
      - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER o AS place
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), v AS (SELECT arg_min(level, place) FILTER (level * weight <= cap) AS due FROM l
), g AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, due * weight), cap::DOUBLE) AS target FROM l, v
), r AS (
  SELECT d.*, g.source_size, g.target,
    sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id ROWS UNBOUNDED PRECEDING) AS reached
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), p AS (SELECT *, (reached + epoch * source_size) / target AS finish FROM r, (VALUES (0), (1)) e(epoch) WHERE size > 0
), c AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, doc_id NULLS LAST, epoch ROWS UNBOUNDED PRECEDING) AS upto
  FROM p
), k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM c WHERE upto <= (SELECT sum(size) * CAST(1.5 AS DOUBLE) FROM d) GROUP BY doc_id)
SELECT r.doc_id, r.size, r.source_size, r.target, coalesce(k.taken, 0) AS taken FROM r LEFT JOIN k ON r.doc_id = k.doc_id
"""


@query
def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark))


ORACLES["op11_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and([coalesce(isfinite(c), false) FOR c IN embedding])
    AND list_bool_or([c <> 0 FOR c IN embedding])
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS least FROM r GROUP BY a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(least(c.least, e.vec_id), e.vec_id) AS component_id,
  coalesce(least(c.least, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), g AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id
), w AS (
  SELECT d.*, regexp_extract_all(t, '[^ 	-]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(words) < 50 AS a,
    100 * len(list_distinct(words)) < 65 * len(words) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > first, false) AS e
  FROM w LEFT JOIN g ON w.doc_id = g.doc_id
), m AS (
  SELECT part, a, b, c, d, e, a::INT + b::INT + c::INT + d::INT + e::INT AS fails, count(*) AS n,
    count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS o FROM l p, l q, l r, l s, l t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), k AS (
  SELECT m.*, o, least(CASE WHEN a THEN instr(o, 'A') ELSE 9 END, CASE WHEN b THEN instr(o, 'B') ELSE 9 END,
    CASE WHEN c THEN instr(o, 'C') ELSE 9 END, CASE WHEN d THEN instr(o, 'D') ELSE 9 END,
    CASE WHEN e THEN instr(o, 'E') ELSE 9 END) AS r
  FROM m, o
), z AS (
  SELECT k.*, s, substr(o, s, 1) AS x,
    CASE substr(o, s, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS failed
  FROM k, range(1, 6) y(s)
), u AS (
  SELECT part, o AS filter_order, s::INT AS step, x, coalesce(sum(n) FILTER (r > s), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (r = s), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failed AND r < s), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed AND fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (r = s), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (r = s), 0)::BIGINT AS toxic_lost
  FROM z GROUP BY part, o, s, x
)
SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM u
"""


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), Scratch(spark))
