"""Aggregates: built from equal names or mappings, filled from their elements, deleted.

Everything stays in long form, a row for each element or value, so that no group has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.iterate import heights, keep

AGGREGATE = "AGGREGATE"
EQUAL_NAMES = "AGGREGATE_EQUAL_NAMES"


def equal_name_elements(concepts: DataFrame, labels: list[str], name: str = "pref_name") -> DataFrame:
    """(aggregate, element): nodes with any of labels that share an exact name with another; the aggregate is named
    by the name. A node that has several of the labels counts once, aggregates never."""
    some = concepts.where(
        F.arrays_overlap("labels", F.array(*map(F.lit, labels))) & ~F.array_contains("labels", AGGREGATE)
    ).select(F.col(name).alias("aggregate"), F.col("node").alias("element"))
    some = some.where("aggregate IS NOT NULL").distinct()
    shared = some.groupBy("aggregate").agg(F.count("*").alias("n")).where("n > 1").select("aggregate")
    return some.join(shared, "aggregate", "left_semi")


def mapping_components(mappings: DataFrame, types: list[str]) -> DataFrame:
    """(node, component) over mappings (u, v, mapping_types) of which any type is allowed; the smallest node names it."""
    ok = mappings.where(F.arrays_overlap("mapping_types", F.array(*map(F.lit, types))))
    return connected_components(ok, keep, "u", "v").select("node", F.col("label").alias("component"))


def mapping_elements(mappings: DataFrame, concepts: DataFrame, types: list[str], label: str | None = None) -> DataFrame:
    """(aggregate, element): components with two labelled nodes or more. Others are passed through but aren't elements."""
    of = mapping_components(mappings, types)
    if label:
        of = of.join(concepts.where(F.array_contains("labels", label)).select("node"), "node", "left_semi")
    large = of.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return of.join(large.hint("merge"), "component", "left_semi").select(F.col("component").alias("aggregate"), F.col("node").alias("element"))


def new_aggregates(elements: DataFrame, labels: list[str], copy_properties: list[str], mapping_types: list[str]) -> DataFrame:
    """A row for each aggregate: node, labels, copy_properties, mapping_type."""
    const = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return elements.select(F.col("aggregate").alias("node")).distinct().select(
        "node", const([*labels, AGGREGATE]).alias("labels"), const(copy_properties).alias("copy_properties"),
        const(mapping_types).alias("mapping_type"),
    )


def matching_aggregates(aggregates: DataFrame, types: list[str], label: str) -> DataFrame:
    """Aggregates with label and exactly these mapping types."""
    wanted = F.array_sort(F.array_distinct(F.array(*map(F.lit, types))))
    return aggregates.where(F.array_contains("labels", label) & (F.array_sort(F.array_distinct("mapping_type")) == wanted))


def rolled_up(elements: DataFrame, values: DataFrame) -> DataFrame:
    """(aggregate, property, value, divergent) of scalar properties, from values (node, property, value).

    The value most elements have wins, of equally frequent ones the smallest; the others are divergent, sorted.
    """
    counts = elements.join(values, elements["element"] == values["node"]).groupBy("aggregate", "property", "value").agg(F.count("*").alias("n"))
    won = counts.groupBy("aggregate", "property").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"), F.array_sort(F.collect_set("value")).alias("all"),
    )
    return won.select("aggregate", "property", "value", F.array_remove("all", F.col("value")).alias("divergent"))


def unioned(elements: DataFrame, values: DataFrame) -> DataFrame:
    """(aggregate, property, values) of array properties, from values (node, property, ord, value): each value once, by
    the order of elements and then of values."""
    firsts = elements.join(values, elements["element"] == values["node"]).groupBy("aggregate", "property", "value").agg(F.min(F.struct("element", "ord")).alias("at"))
    return firsts.groupBy("aggregate", "property").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("s")).select(
        "aggregate", "property", F.col("s")["value"].alias("values"),
    )


def merged_synonyms(synonyms: Column, divergent_names: Column) -> Column:
    """Synonyms and divergent names: of those equal but for case the first, sorted."""
    both = F.concat(F.coalesce(synonyms, F.array().cast("array<string>")), F.coalesce(divergent_names, F.array().cast("array<string>")))
    first = F.filter(both, lambda x, i: F.array_position(F.transform(both, F.lower), F.lower(x)) == i + 1)
    return F.array_sort(first)


def rolled_up_nested(elements: DataFrame, values: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """rolled_up over aggregates of aggregates: the lowest first, whose values then are values of elements above.

    existing (node, property, value) are aggregates' own values; they are kept, and not computed anew.
    """
    level, known, out = keep(heights(elements.select(F.col("aggregate").alias("parent"), F.col("element").alias("child")))), values, None
    if existing is not None:
        known = known.unionByName(existing.select("node", "property", "value"))
    for h in range(1, (level.agg(F.max("height")).first()[0] or 0) + 1):
        own = elements.join(level.where(F.col("height") == h).select(F.col("node").alias("aggregate")), "aggregate", "left_semi")
        done = rolled_up(own, known)
        if existing is not None:
            done = done.join(existing.select(F.col("node").alias("aggregate"), "property"), ["aggregate", "property"], "left_anti")
        done = keep(done)
        known = known.unionByName(done.select(F.col("aggregate").alias("node"), "property", "value"))
        out = done if out is None else out.unionByName(done)
    return out if out is not None else rolled_up(elements, values)


def element_values(elements: DataFrame, values: DataFrame) -> DataFrame:
    """(aggregate, property, values): elements' values one after another, repeated ones too."""
    joined = elements.join(values, elements["element"] == values["node"])
    return joined.groupBy("aggregate", "property").agg(F.array_sort(F.collect_list("value")).alias("values"))


def delete_aggregates(concepts: DataFrame, edges: DataFrame, elements: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(concepts, edges, elements, counts) without the aggregates that bear any of labels. Other nodes only lose the
    label. counts has one row: num_nodes and num_relationships."""
    marked = F.arrays_overlap("labels", F.array(*map(F.lit, labels)))
    gone = concepts.where(marked & F.array_contains("labels", AGGREGATE)).select("node")
    left = concepts.join(gone, "node", "left_anti").withColumn("labels", F.array_except("labels", F.array(*map(F.lit, labels))))
    touched = lambda df, *ends: _without(df, gone, ends)
    kept_edges, kept_elements = touched(edges, "src", "dst"), touched(elements, "aggregate", "element")
    n = lambda df, nodes, sign: df.select(F.lit(nodes).alias("nodes"), F.lit(sign).alias("edges"))
    every = n(gone, 1, 0).union(n(edges, 0, 1)).union(n(elements, 0, 1)).union(n(kept_edges, 0, -1)).union(n(kept_elements, 0, -1))
    counts = every.agg(
        F.coalesce(F.sum("nodes"), F.lit(0)).cast("long").alias("num_nodes"),
        F.coalesce(F.sum("edges"), F.lit(0)).cast("long").alias("num_relationships"),
    )
    return left, kept_edges, kept_elements, counts


def _without(df: DataFrame, gone: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    for end in ends:
        df = df.join(gone.select(F.col("node").alias(end)), end, "left_anti")
    return df
