"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact, htmltext, jaccard, licenses, linededup, packing, quality, secrets, substring


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(_documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_documents(spark, sf_dir))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_documents(spark, sf_dir))


_OP2 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS unit
  FROM documents),
w AS (
  SELECT doc_id, unit, line, regexp_extract_all(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM l),
p AS (SELECT doc_id, unit, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
s AS (
  SELECT doc_id, unit, n, i, count(*) OVER f AS k, string_agg(word, ' ') OVER f AS h
  FROM p WINDOW f AS (PARTITION BY doc_id, unit ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
t AS (SELECT DISTINCT doc_id, unit, h FROM s WHERE k = 5 OR (n < 5 AND i = 0)),
c AS (SELECT doc_id, unit, count(*) AS n FROM t GROUP BY doc_id, unit),
x AS (
  SELECT a.doc_id AS ad, a.unit AS au, b.doc_id AS bd, b.unit AS bu, count(*) AS k
  FROM t a JOIN t b ON a.h = b.h AND (b.doc_id, b.unit) < (a.doc_id, a.unit) GROUP BY ALL),
g AS (
  SELECT DISTINCT ad AS doc_id, au AS unit
  FROM x JOIN c ca ON ca.doc_id = ad AND ca.unit = au JOIN c cb ON cb.doc_id = bd AND cb.unit = bu
  WHERE 100 * k >= 80 * (ca.n + cb.n - k)),
m AS (SELECT l.doc_id, l.unit, l.line, g.doc_id IS NOT NULL AS gone FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.unit = l.unit)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY unit) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_OP5 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY normal) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(normal) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY normal ORDER BY chars DESC, doc_id)
"""


_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
s AS (
  SELECT doc_id, n, i, count(*) OVER f AS k, string_agg(word, ' ') OVER f AS h
  FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
t AS (SELECT DISTINCT doc_id, h FROM s WHERE k = 5 OR (n < 5 AND i = 0)),
c AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM x JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b
  WHERE 100 * k >= 80 * (ca.n + cb.n - k)),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.m),
g AS (SELECT d, min(m) AS m FROM r GROUP BY d)
SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id
FROM documents JOIN g ON d = doc_id LEFT JOIN c USING (doc_id)
"""

_OP8 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
s AS (
  SELECT doc_id, i, word, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS h
  FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT doc_id, i, word, (n = 35 AND count(*) OVER (PARTITION BY h, n) > 1)::INT AS again FROM s),
c AS (
  SELECT doc_id, i, word,
         max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM r),
d AS (
  SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept
  FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_line_dedup": op2_line_dedup,
        "op3_quality": op3_quality,
        "op4_license_scan": op4_license_scan,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_html": op7_html,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_packing": op9_packing,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _OP2, "op5_exact_dedup": _OP5, "op6_jaccard_join": _OP6, "op8_substring_dedup": _OP8}
