"""One-hop queries over the graph's tables.

concepts: node, labels, pref_name and further properties; edges: src, dst, type, facet (null: all facets);
roots: facet, node; facets: facet, name, grp, source_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOLLOW = "HOLLOW"


def has_label(label: str, labels: str = "labels") -> Column:
    return F.array_contains(labels, label)


def scan(concepts: DataFrame, label: str) -> DataFrame:
    """Nodes that bear label."""
    return concepts.where(has_label(label))


def lookup(nodes: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of nodes whose column equals a key; a key with several rows raises an error when it is read."""
    hits = nodes.join(keys.select(F.col(key).alias("__key")).distinct().hint("merge"), nodes[column] == F.col("__key"), "left_semi")
    # the join has dealt and sorted the rows by column, so they are counted as they come
    return hits.withColumn("__n", F.count("*").over(W.partitionBy(column))).where(F.when(
        F.col("__n") > 1, F.raise_error(F.concat(F.lit("more than one node for "), F.col(column).cast("string"))).isNull(),
    ).otherwise(True)).drop("__n")


def expand(edges: DataFrame, nodes: DataFrame, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(node, other, type): edges of the given types that leave, reach or touch nodes."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    out, into = e.select(
        F.col("src").alias("node"), F.col("dst").alias("other"), "type",
    ), e.select(F.col("dst").alias("node"), F.col("src").alias("other"), "type")
    both = {"out": out, "in": into, "both": out.unionByName(into.where("node <> other"))}[direction]
    return both.join(nodes.select("node").distinct(), "node", "left_semi")


def children(edges: DataFrame, concepts: DataFrame, ids: DataFrame) -> DataFrame:
    """(parent, child, types): all that outgoing edges of any type lead to from ids (column node), hollow nodes aside.
    Unknown ids have no rows, repeated ids count once."""
    real = concepts.where(~has_label(HOLLOW)).select(F.col("node").alias("child"))
    out = expand(edges, ids).select(F.col("node").alias("parent"), F.col("other").alias("child"), "type")
    return out.join(real, "child", "left_semi").groupBy("parent", "child").agg(F.array_sort(F.collect_set("type")).alias("types"))


def parents(edges: DataFrame, ids: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(node, parent): distinct neighbours by incoming edges."""
    return expand(edges, ids, "in", types).select("node", F.col("other").alias("parent")).distinct()


def children_in_facets(edges: DataFrame) -> DataFrame:
    """(node, facets): the facets in which a node has children; nodes without any have no row."""
    return edges.where("facet IS NOT NULL").groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("facet")).alias("facets"))


def facet_roots(roots: DataFrame, facets: list[str], wanted: DataFrame | None = None, max_roots: int = 0) -> DataFrame:
    """(facet, node) of the named facets. wanted (facet, node) keeps only those roots in the facets it names. Facets
    with more than max_roots of what is left are left out; 0 means no limit."""
    r = roots.where(F.col("facet").isin(facets)).select("facet", "node").distinct()
    if wanted is not None:
        limited = wanted.select("facet").distinct()
        r = r.join(limited, "facet", "left_anti").unionByName(r.join(wanted.select("facet", "node").distinct(), ["facet", "node"], "left_semi"))
    if max_roots > 0:
        few = r.groupBy("facet").agg(F.count("*").alias("n")).where(F.col("n") <= max_roots)
        r = r.join(few, "facet", "left_semi")
    return r


def facets_by_group(facets: DataFrame, roots: DataFrame, concepts: DataFrame, return_hollow: bool = False) -> DataFrame:
    """(grp, facets): each group's facets by name. Hierarchical ones need a root, a real one unless return_hollow;
    others are always there. Groups without facets have no row."""
    of = roots.join(concepts.select("node", has_label(HOLLOW).alias("hollow")), "node", "left")
    some = of.groupBy("facet").agg(F.bool_or(~F.coalesce("hollow", F.lit(False))).alias("real"))
    shown = facets.join(some, "facet", "left").where(
        (F.col("source_type") != "hierarchical")
        | F.when(F.lit(return_hollow), F.col("real").isNotNull()).otherwise(F.coalesce("real", F.lit(False)))
    )
    return shown.groupBy("grp").agg(F.array_sort(F.collect_list("facet")).alias("facets"))


def where_property(nodes: DataFrame, key: str, value: str) -> DataFrame:
    """Nodes whose property equals value, or holds it if it is an array; * as value means any, as key all nodes."""
    if key == "*":
        return nodes
    if value == "*":
        return nodes.where(F.col(key).isNotNull())
    return nodes.where(F.array_contains(key, value) if dict(nodes.dtypes)[key].startswith("array") else F.col(key) == value)


def where_edge(nodes: DataFrame, edges: DataFrame, direction: str = "out", types: list[str] | None = None, present: bool = True) -> DataFrame:
    """Nodes that have such an edge, or with present false those that have none."""
    return nodes.join(expand(edges, nodes, direction, types).select("node").distinct(), "node", "left_semi" if present else "left_anti")


def single(df: DataFrame, what: str = "row") -> DataFrame:
    """df as it is; more than one row raises an error now."""
    if df.limit(2).count() > 1:
        raise ValueError(f"more than one {what}")
    return df


def broken_keys(nodes: DataFrame, key: str) -> DataFrame:
    """(key, n): values that a unique key has more than once."""
    return nodes.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
