"""Query of phrase mining, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .phrases import collocations


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).withColumnRenamed("part", "lang")


SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]')) AS piece
        FROM documents WHERE text IS NOT NULL)),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 6) AS d(m))
  GROUP BY ALL HAVING count(*) >= 100),
split AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE m > 1),
inner_parts AS (
  SELECT DISTINCT s.lang, array_to_string(w[i : i + t - 1], ' ') AS phrase, s.a
  FROM (SELECT *, unnest(range(1, m - t + 2)) AS i FROM split, range(2, 5) AS d(t) WHERE t < m) AS s),
cuts AS (
  SELECT s.lang, s.phrase, s.a, k, l.a AS l, r.a AS r, total.n, (1000::HUGEINT * s.a * total.n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM split) AS s
  JOIN grams AS l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1 : k], ' ')
  JOIN grams AS r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[k + 1 : s.m], ' ')
  JOIN total ON total.lang = s.lang
  WHERE NOT EXISTS (SELECT 1 FROM inner_parts AS p WHERE p.lang = s.lang AND p.phrase = s.phrase AND p.a >= s.a)),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest QUALIFY rank <= 2000
"""

QUERIES = {"op12_phrase_mining": op12_phrase_mining}
ORACLES = {"op12_phrase_mining": SQL}
