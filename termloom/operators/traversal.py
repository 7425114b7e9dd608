"""Traversals with evaluations: what a path's last node says decides whether the path is given and whether it goes on.

An evaluation is a table (node, emit, go). Nodes that it doesn't name are neither given nor stopped at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import keep
from .query import expand, has_label

ANY = "*"


def evaluation(nodes: DataFrame, emit: Column, go: Column | bool = True) -> DataFrame:
    """An evaluation by two conditions on nodes' columns; null is false."""
    shown = lambda c: F.coalesce(c if isinstance(c, Column) else F.lit(c), F.lit(False))
    return nodes.select("node", shown(emit).alias("emit"), shown(go).alias("go"))


def by_property(nodes: DataFrame, keys: list[str] | str = ANY, value: str = ANY) -> DataFrame:
    """Gives nodes one of whose properties equals value, or holds it if it is an array; ANY stands for all properties or for
    any value, both for all nodes."""
    if keys == ANY and value == ANY:
        return evaluation(nodes, F.lit(True))
    columns = [c for c in nodes.columns if c != "node"] if keys == ANY else [keys] if isinstance(keys, str) else keys
    kinds = dict(nodes.dtypes)

    def holds(c: str) -> Column:
        if value == ANY:
            return F.col(c).isNotNull()
        if kinds[c].startswith("array"):
            return F.exists(c, lambda x: x.cast("string") == value)
        return F.lit(False) if kinds[c].startswith(("map", "struct")) else F.col(c).cast("string") == value

    return evaluation(nodes, reduce(Column.__or__, (F.coalesce(holds(c), F.lit(False)) for c in columns)))


def by_label(nodes: DataFrame, label: str, absent: bool = False) -> DataFrame:
    """Gives nodes that bear label, or with absent those that don't."""
    return evaluation(nodes, ~F.coalesce(has_label(label), F.lit(False)) if absent else has_label(label))


def by_edge(nodes: DataFrame, edges: DataFrame, direction: str = "out", types: list[str] | None = None, present: bool = True) -> DataFrame:
    """Gives nodes that have such an edge, or with present false those that have none."""
    having = expand(edges, nodes, direction, types).select("node", F.lit(present).alias("found")).distinct()
    return evaluation(nodes.select("node").join(having, "node", "left"), F.coalesce("found", F.lit(not present)))


def by_group(nodes: DataFrame, name: str, root: str, column: str = "name") -> DataFrame:
    """Gives the group of that name, below which the traversal ends, and the groups' root."""
    return evaluation(nodes, F.col(column).isin(name, root), F.coalesce(F.col(column) != name, F.lit(True)))


def pruned_at(evaluated: DataFrame, stops: DataFrame) -> DataFrame:
    """evaluated, but paths end at stops (node)."""
    end = stops.select("node", F.lit(True).alias("stop")).distinct()
    both = evaluated.join(end, "node", "full_outer")
    return both.select("node", F.coalesce("emit", F.lit(False)).alias("emit"), (F.coalesce("go", F.lit(True)) & F.col("stop").isNull()).alias("go"))


def all_of(*evaluated: DataFrame) -> DataFrame:
    """An evaluation that gives a path if all give it, and goes on where all go on."""
    n = len(evaluated)
    rows = reduce(DataFrame.unionByName, evaluated).groupBy("node").agg(F.count("*").alias("n"), F.bool_and("emit").alias("emit"), F.bool_and("go").alias("go"))
    return rows.select("node", (F.col("emit") & (F.col("n") == n)).alias("emit"), "go")


def traverse(start: DataFrame, edges: DataFrame, evaluated: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(origin, node, path): the walks from start's nodes (node) along edges (src, dst) that meet no node twice, the empty one
    included, whose last node evaluated gives. Walks go on from nodes at which evaluated goes on, so what lies below others
    is never read."""
    flags = keep(evaluated.select("node", "emit", "go"))
    steps = edges.select("src", "dst").distinct()

    def judged(walks: DataFrame) -> DataFrame:
        with_flags = walks.join(flags, "node", "left")
        return keep(with_flags.select("origin", "node", "path", F.coalesce("emit", F.lit(False)).alias("emit"), F.coalesce("go", F.lit(True)).alias("go")))

    front = judged(start.select(F.col("node").alias("origin"), "node", F.array("node").alias("path")))
    parts = []
    for _ in range(max_rounds):
        if front.isEmpty():
            return reduce(DataFrame.union, parts) if parts else front.select("origin", "node", "path")
        parts.append(front.where("emit").select("origin", "node", "path"))
        met = front.where("go").join(steps, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        front = judged(met.select("origin", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")))
    raise RuntimeError(f"walks did not end within {max_rounds} rounds")
