"""Query of the fixity audit, and the SQL that checks it.

Both replicas are made from pages. The second has damage that follows from each record's URL: one in 16 has lost its
payload's end, one in 16 is missing, and one in 16 has another header. The audit must find all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, table
from .warc import audit_records, manifest


def damaged(pages: DataFrame) -> DataFrame:
    kind = F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 1)
    html = F.coalesce("html", F.lit(""))
    cut = F.when(kind == "0", F.expr("left(coalesce(html, ''), length(coalesce(html, '')) div 2)")).otherwise(html)
    return pages.where(kind != "1").withColumn("html", cut).withColumn("url", F.when(kind == "2", F.concat("url", F.lit("#x"))).otherwise(F.col("url")))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    with Scratch(spark) as keep:
        held, other = (keep(manifest(x, keep=keep)) for x in (pages, damaged(pages)))
        found = checkpointed(audit_records(held, other, keep))
    return found.select(
        F.col("key").alias("page_id"), F.col("file").alias("file_no"), F.col("begin").alias("begin_byte"), F.col("end").alias("end_byte"),
        "digest", "found_digest", "damage",
    )


SQL = r"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, left(md5(url), 1) AS kind FROM a),
b AS (SELECT page_id, CASE kind WHEN '2' THEN url || '#x' ELSE url END AS url, CASE kind WHEN '0' THEN left(html, length(html) // 2) ELSE html END AS html FROM d WHERE kind <> '1'),
sides AS (SELECT 'a' AS side, page_id, url, html FROM a UNION ALL SELECT 'b', page_id, url, html FROM b),
h AS (SELECT *, md5(url || chr(10) || html) AS h, chr(13) || chr(10) AS nl FROM sides),
r AS (
  SELECT side, page_id, 'WARC/1.0' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>'
         || nl || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || 'WARC-Target-URI: ' || regexp_replace(url, '[\r\n]', ' ', 'g')
         || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(html) || nl || nl || html || nl || nl AS rec
  FROM h),
m AS (
  SELECT side, page_id, page_id // 1024 AS file_no, sha256(rec) AS digest, strlen(rec) AS size,
         sum(strlen(rec)) OVER (PARTITION BY side, page_id // 1024 ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS end_byte
  FROM r)
SELECT x.page_id, x.file_no, (x.end_byte - x.size)::BIGINT AS begin_byte, x.end_byte::BIGINT AS end_byte, x.digest, y.digest AS found_digest,
       CASE WHEN y.digest IS NULL THEN 'missing' ELSE 'altered' END AS damage
FROM (SELECT * FROM m WHERE side = 'a') x LEFT JOIN (SELECT * FROM m WHERE side = 'b') y USING (page_id)
WHERE y.digest IS DISTINCT FROM x.digest
"""

QUERIES = {"op4_warc_fixity": op4_warc_fixity}
ORACLES = {"op4_warc_fixity": SQL}
