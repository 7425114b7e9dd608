"""Query of line deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sha256, table
from .line_dedup import KEEP, is_kept, keep_bitmaps, kept_text, lines_of, with_bitmaps


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = with_bitmaps(docs, keep_bitmaps(docs))
    n = F.size(lines_of(F.col("text")))
    dropped = F.when(F.col(KEEP).isNull(), 0).otherwise(F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~is_kept(i))))
    return cut.select("doc_id", n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), sha256(kept_text(F.col("text"))).alias("kept_sha256"))


SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first_doc, false) AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key AND length(k.key) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES = {"op2_line_dedup": SQL}
