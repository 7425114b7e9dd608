"""Recursive operators: paths, sizes, leaves, tops and ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import all_paths, closure, ends_of_chains
from .query import HOLLOW, has_label


def paths_from_roots(
    starts: DataFrame, edges: DataFrame, roots: DataFrame, concepts: DataFrame | None = None, facet: str | None = None,
    return_column: str | None = None,
) -> DataFrame:
    """(node, path): for each start (column node) all paths from a facet root down to it, the start's own included if
    it is a root. Going up doesn't stop at roots. With facet only its edges count, and the root must be a member of it
    (concepts' column facets). return_column of concepts replaces the nodes; a path that lacks it anywhere goes."""
    up = edges.where(F.col("facet") == facet if facet else F.col("facet").isNull()).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = all_paths(starts.select(F.col("node").alias("origin"), "node").distinct(), up.distinct())
    found = found.join(roots.select("node").distinct(), "node", "left_semi")
    if facet:
        found = found.join(concepts.where(F.array_contains("facets", facet)).select("node"), "node", "left_semi")
    found = found.select(F.col("origin").alias("node"), F.reverse("path").alias("path"))
    if return_column is None:
        return found
    steps = found.select("node", "path", F.posexplode("path").alias("pos", "step")).join(
        concepts.select(F.col("node").alias("step"), F.col(return_column).alias("shown")), "step", "left",
    )
    named = steps.groupBy("node", "path").agg(F.sort_array(F.collect_list(F.struct("pos", "shown"))).alias("s"))
    return named.where(F.forall("s", lambda x: x["shown"].isNotNull())).select("node", F.col("s")["shown"].alias("path"))


def facet_sizes(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(facet, n): nodes below each facet by its own edges, each once."""
    start = roots.select(F.col("facet").alias("origin"), F.concat_ws("\x1f", "facet", "node").alias("node"))
    own = edges.where("facet IS NOT NULL").select(F.concat_ws("\x1f", "facet", "src").alias("src"), F.concat_ws("\x1f", "facet", "dst").alias("dst"))
    sizes = closure(start, own)
    return sizes.groupBy(F.col("origin").alias("facet")).agg(F.count("*").alias("n"))


def leaf_elements(elements: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, leaf): what is no aggregate below each start; one that is no aggregate is its own leaf. Diamonds count once."""
    below = closure(starts.select(F.col("node").alias("origin"), "node"), elements.select(F.col("aggregate").alias("src"), F.col("element").alias("dst")))
    inner = elements.select(F.col("aggregate").alias("node")).distinct()
    return below.join(inner, "node", "left_anti").select(F.col("origin").alias("node"), F.col("node").alias("leaf"))


def top_aggregates(elements: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(node, top) for every element: the highest aggregate above it. Of several the smallest is followed; allowed
    (column node) limits the aggregates."""
    e = elements if allowed is None else elements.join(allowed.select(F.col("node").alias("aggregate")).distinct(), "aggregate", "left_semi")
    return ends_of_chains(e.groupBy(F.col("element").alias("node")).agg(F.min("aggregate").alias("parent")))


def with_top(df: DataFrame, tops: DataFrame, column: str, out: str) -> DataFrame:
    """df with the top aggregate of column; a node without one is its own top."""
    t = tops.select(F.col("node").alias("__node"), F.col("top").alias("__top"))
    return df.join(t, df[column] == F.col("__node"), "left").withColumn(out, F.coalesce("__top", column)).drop("__node", "__top")


def ancestors(edges: DataFrame, concepts: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node, ancestor): all real nodes above each node (or each in of), itself not; hollow ones are neither shown nor passed."""
    real = concepts.where(~has_label(HOLLOW)).select(F.col("node").alias("src"))
    up = edges.join(real, "src", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    first = up if of is None else up.join(of.select(F.col("node").alias("src")), "src", "left_semi")
    found = closure(first.select(F.col("src").alias("origin"), F.col("dst").alias("node")), up)
    return found.where("origin <> node").select(F.col("origin").alias("node"), F.col("node").alias("ancestor"))
