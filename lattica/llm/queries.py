"""Queries of the training-data operators over the tables in a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, htmltext, jaccard, langid, linededup, mixing, nndescent, quality, substrings, warc
from .common import read_table
from .sampling import fold


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(read_table(spark, sf_dir, "pages"), keep=("page_id", "url"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")), keep=("doc_id",))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), keep=("doc_id",))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many of them went, and length and digest of the text that stays."""
    out = linededup.dedup_lines(read_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars_kept"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit(docs), keep=("doc_id",))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard.link(read_table(spark, sf_dir, "documents"), k=4, percent=85)
    return linked.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_quality, op3_nn_descent, op4_decontaminate, op5_mix, op6_line_dedup, op7_warc, op8_language_id, op9_suffix_dedup, op10_jaccard_join)}

OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT) AS h FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM h GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total,
  coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
c AS (SELECT *, 3 * source_size * rest < w * (total - before) AS capped FROM o),
l AS (SELECT any_value(total) - coalesce(sum(3 * source_size) FILTER (WHERE capped), 0) AS left_over, coalesce(sum(w) FILTER (WHERE NOT capped), 1) AS share FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * left_over AS DOUBLE) / CAST(share AS DOUBLE) END AS target FROM c, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT h.doc_id, h.size, h.h, p.*, target - whole * p.source_size AS need,
  sum(h.size) OVER (PARTITION BY p.source ORDER BY h.h) AS upto, sum(h.size) OVER (PARTITION BY p.source, h.h) AS tied
  FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source),
e AS (SELECT *, min(CASE WHEN upto >= need THEN h END) OVER (PARTITION BY source) AS edge FROM q)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN edge IS NULL THEN 0 WHEN h < edge THEN 1 WHEN h = edge AND upto - need <= need - (upto - tied) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""

OP7_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS winner FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha, CAST(1 + (5 * i) // 4 AS INTEGER), 2) AS INTEGER) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN winner <> page_id OR page_id IS NULL AND winner IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN winner <> page_id OR page_id IS NULL THEN winner END AS refers_to
FROM w
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
r(n, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n WHERE r.c < e.b),
m AS (SELECT n, min(c) AS c FROM r GROUP BY n)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN m ON n = vec_id
"""

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[x:x + least(10, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS x FROM i WHERE len(w) > 0)),
q AS (SELECT DISTINCT k FROM p),
o AS (SELECT r, k, x, array_to_string(w[x:x + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS x FROM d, q WHERE len(w) >= k)),
h AS (SELECT o.r, o.x, o.k, p.item FROM o JOIN p ON o.k = p.k AND o.s = p.s),
c AS (SELECT r, count(DISTINCT y) AS n_hit FROM (SELECT r, unnest(range(x, x + k)) AS y FROM h) GROUP BY r),
n AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)
"""

OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[x:x + 3], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS x FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(m, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.m WHERE r.c < e.b)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT m, min(c) AS c FROM r GROUP BY m) ON m = doc_id
"""

ORACLE_SQL = {"op3_nn_descent": OP3_SQL, "op4_decontaminate": OP4_SQL, "op5_mix": OP5_SQL, "op7_warc": OP7_SQL, "op10_jaccard_join": OP10_SQL}
