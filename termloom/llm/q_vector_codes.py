"""Query of vector code compression, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .vector_codes import compress


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


SQL = r"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS x FROM kept, range(16) AS r(p)),
flat AS (SELECT rid, p, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS y FROM parts),
c0 AS (SELECT p, rid - 1 AS e, x FROM parts WHERE rid <= 64),
d0 AS (SELECT v.rid, v.p, c.e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM parts AS v JOIN c0 AS c ON c.p = v.p),
a0 AS (SELECT rid, p, e, d FROM d0 QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, e) = 1),
m1 AS (SELECT p, e, list(floor_mean ORDER BY j) AS x FROM (
  SELECT a.p, a.e, u.j, CASE WHEN sum(u.y) % count(*) < 0 THEN sum(u.y) // count(*) - 1 ELSE sum(u.y) // count(*) END AS floor_mean
  FROM a0 AS a JOIN flat AS u ON u.rid = a.rid AND u.p = a.p GROUP BY ALL) GROUP BY ALL),
c1 AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c0 AS c LEFT JOIN m1 AS m ON m.p = c.p AND m.e = c.e),
d1 AS (SELECT v.rid, v.p, c.e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM parts AS v JOIN c1 AS c ON c.p = v.p),
a1 AS (SELECT rid, p, e, d FROM d1 QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, e) = 1),
m2 AS (SELECT p, e, list(floor_mean ORDER BY j) AS x FROM (
  SELECT a.p, a.e, u.j, CASE WHEN sum(u.y) % count(*) < 0 THEN sum(u.y) // count(*) - 1 ELSE sum(u.y) // count(*) END AS floor_mean
  FROM a1 AS a JOIN flat AS u ON u.rid = a.rid AND u.p = a.p GROUP BY ALL) GROUP BY ALL),
c2 AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c1 AS c LEFT JOIN m2 AS m ON m.p = c.p AND m.e = c.e),
d2 AS (SELECT v.rid, v.p, c.e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM parts AS v JOIN c2 AS c ON c.p = v.p),
a2 AS (SELECT rid, p, e, d FROM d2 QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, e) = 1),
final AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS y FROM c2)),
done AS (SELECT rid, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM done JOIN kept USING (rid), final
"""

QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES = {"op13_vector_codes": SQL}
