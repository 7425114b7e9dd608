"""Queries of traversals with evaluations and of the positional index, and the SQL that checks each."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import text_index as I
from ..operators import traversal as T
from .contract import query
from .iterate import checkpoint_folder


@query(
    "traverse_pruned",
    "SELECT origin, node, array_to_string(path, '>') AS path FROM walk WHERE node[1] IN ('C', 'S') OR node[1] = 'N' AND stopped",
    ctes="""
walk AS (
  SELECT r.node AS origin, r.node, [r.node] AS path, FALSE AS stopped FROM roots AS r WHERE facet = 'fid0'
  UNION ALL
  SELECT w.origin, b.dst, list_append(w.path, b.dst), b.dst[1] = 'N' AND b.dst[2:]::INT % 3 = 0
  FROM walk AS w JOIN broader AS b ON b.src = w.node AND b.facet = 'fid0' WHERE NOT w.stopped)""",
    recursive=True,
)
def traverse_pruned(g):
    """Walks down from the regions to customers and suppliers; they end at every third nation, which is given then."""
    of_third = F.col("node").startswith("N") & (F.substring("node", 2, 20).cast("int") % 3 == 0)
    leaf = F.array_contains("labels", "customer") | F.array_contains("labels", "supplier")
    stops = g.concepts.where(of_third)
    evaluated = T.pruned_at(T.evaluation(g.concepts, leaf | of_third), stops)
    start = g.roots.where("facet = 'fid0'").select("node")
    found = T.traverse(start, g.edges.where("facet = 'fid0'"), evaluated)
    return found.select("origin", "node", F.array_join("path", ">").alias("path"))


@query(
    "traverse_evaluated",
    """SELECT w.node, array_to_string(path, '>') AS path FROM walk AS w JOIN concepts AS c ON c.node = w.node
WHERE label = 'nation' AND facet = 'fid0' AND w.node IN (SELECT src FROM broader WHERE dst[1] = 'S')""",
    ctes="""
walk AS (
  SELECT r.node, [r.node] AS path FROM roots AS r
  UNION ALL SELECT b.dst, list_append(w.path, b.dst) FROM walk AS w JOIN broader AS b ON b.src = w.node)""",
    recursive=True,
)
def traverse_evaluated(g):
    """Walks whose last node has a label, a property and an edge to a supplier: three evaluations in one."""
    to_suppliers = T.by_edge(g.concepts, g.edges.where("dst LIKE 'S%'"), "out", ["IS_BROADER_THAN"])
    evaluated = T.all_of(T.by_label(g.concepts, "nation"), T.by_property(g.concepts, "facets", "fid0"), to_suppliers)
    found = T.traverse(g.roots.select("node"), g.edges.where("facet IS NULL"), evaluated)
    return found.select("node", F.array_join("path", ">").alias("path"))


@query(
    "phrase_index",
    r"""SELECT doc_id::VARCHAR AS doc, (len(flat) - len(replace(flat, ' ' || p || ' ', ' ' || repeat('x', len(p) - 1) || ' ')))::BIGINT AS n
FROM (SELECT doc_id, ' ' || replace(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ', '  ') || ' ' AS flat FROM documents), phrase
WHERE contains(flat, ' ' || p || ' ')""",
    ctes=r"""
first AS (SELECT string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents
  WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE len(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) > 2)),
phrase AS (SELECT w[1] || '  ' || w[2] AS p FROM first)""",
)
def phrase_index(g):
    """Documents that hold the first two words of the first document with more than two, and how often, from the index alone."""
    docs = g.table("documents")
    path = f"{checkpoint_folder(g.spark)}/index-{uuid4()}"
    I.write_index(docs, "doc_id", "text", path)
    long = docs.select("doc_id", I.tokens(F.col("text")).alias("w")).where(F.size("w") > 2)
    first = long.orderBy("doc_id").select(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("p")).first()
    found = I.find_phrase(I.read_index(g.spark, path), first["p"] if first else "")
    return found.groupBy("doc").agg(F.count("*").alias("n"))
