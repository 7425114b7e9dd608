"""Query of the license scan, and the SQL that checks it.

The SQL compares words directly: each diagonal on which a gram stands is laid over its template, shifted by up to the
template's slack, and what agrees is counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .licenses import COVER, DENSITY, TEMPLATES, K, scan_licenses, slack


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


VALUES = ", ".join(f"('{name}', '{label}', '{text}', {exact}, {slack(len(text.split()))})" for name, (label, text, exact) in TEMPLATES.items())
SQL = rf"""
WITH templates AS (
  SELECT tpl, label, exact, slack, tw, len(tw) AS n, least({K}, len(tw)) AS k
  FROM (SELECT *, string_split(body, ' ') AS tw FROM (VALUES {VALUES}) AS v(tpl, label, body, exact, slack))),
texts AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS d1, unnest(w[2:]) AS d2, unnest(w[3:]) AS d3 FROM texts),
base AS (
  SELECT p.doc_id, t.label, p.i - 1 AS first, 1.0::DOUBLE AS cover
  FROM places p JOIN templates t ON t.exact AND p.d1 = t.tw[1] AND p.d2 = t.tw[2] AND (t.n = 2 OR p.d3 = t.tw[3])),
starts AS (SELECT tpl, k, unnest(range(1, n - k + 2)) AS j, tw FROM templates WHERE NOT exact),
anchors AS (SELECT DISTINCT p.doc_id, s.tpl, p.i - s.j AS diag FROM places p JOIN starts s ON p.d1 = s.tw[s.j] AND p.d2 = s.tw[s.j + 1] AND p.d3 = s.tw[s.j + 2]),
laid AS (
  SELECT a.doc_id, a.tpl, a.diag, s.j, h.shift, a.diag + h.shift + s.j AS i
  FROM anchors a JOIN starts s USING (tpl) JOIN (SELECT tpl, unnest(range(-slack, slack + 1)) AS shift FROM templates) h USING (tpl) JOIN texts x USING (doc_id)
  WHERE a.diag + h.shift + s.j >= 1 AND x.w[a.diag + h.shift + s.j] = s.tw[s.j] AND x.w[a.diag + h.shift + s.j + 1] = s.tw[s.j + 1] AND x.w[a.diag + h.shift + s.j + 2] = s.tw[s.j + 2]),
own AS (SELECT doc_id, tpl, diag, count(*) FILTER (WHERE shift = 0) AS own FROM laid GROUP BY doc_id, tpl, diag),
used AS (
  SELECT l.doc_id, l.tpl, l.diag, o.own, t.n, t.label, t.slack, t.n - {K} + 1 AS n_grams, l.i, l.j
  FROM laid l JOIN own o USING (doc_id, tpl, diag) JOIN templates t USING (tpl)
  WHERE l.shift = 0 OR o.own < {COVER} * (t.n - {K} + 1)),
spans AS (
  SELECT doc_id, tpl, diag, own, n, label, slack, count(DISTINCT j) / n_grams AS cover, min(i) - 1 AS first, max(i) + {K - 2} AS last,
         len(list_distinct(flatten(list([i, i + 1, i + 2])))) AS of_text, len(list_distinct(flatten(list([j, j + 1, j + 2])))) AS of_template
  FROM used GROUP BY doc_id, tpl, diag, own, n, label, slack, n_grams),
good AS (SELECT * FROM spans WHERE of_template >= {COVER} * n AND of_text >= {DENSITY} * (last - first + 1)),
best AS (
  SELECT * FROM good g WHERE NOT EXISTS (
    SELECT 1 FROM good o WHERE o.doc_id = g.doc_id AND o.tpl = g.tpl AND abs(o.diag - g.diag) <= 2 * g.slack
      AND (o.cover > g.cover OR o.cover = g.cover AND (o.own > g.own OR o.own = g.own AND o.diag < g.diag)))),
named AS (SELECT doc_id, label, true AS exact, first, cover FROM base UNION ALL SELECT doc_id, label, false, first, cover FROM best),
found AS (
  SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(first) FILTER (WHERE exact) AS first_word, max(first) FILTER (WHERE exact) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
  FROM named GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM texts t LEFT JOIN found USING (doc_id)
"""

QUERIES = {"op10_license_scan": op10_license_scan}
ORACLES = {"op10_license_scan": SQL}
