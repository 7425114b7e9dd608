"""Mappings between concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_blank


def insert_mappings(mappings: DataFrame, nodes: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(all mappings, new ones) after inserting mappings (id1, id2, mapping_type) between nodes (id, node, facets).

    Mappings are symmetric: u < v with their sorted types. Unknown ids are skipped, as are LOOM mappings between concepts
    that share a facet, and those of a concept with itself. A blank field raises an error.
    """
    blank = is_blank("id1") | is_blank("id2") | is_blank("mapping_type")
    m = mappings.where(F.when(blank, F.raise_error(F.lit("a mapping lacks an id or its type")).cast("boolean")).otherwise(True))
    side = lambda k: nodes.select(
        F.col("id").alias(f"id{k}"), F.col("node").alias(f"n{k}"), F.coalesce("facets", F.array().cast("array<string>")).alias(f"f{k}"),
    )
    m = m.join(side(1), "id1").join(side(2), "id2").where("n1 <> n2")
    m = m.where(~((F.upper("mapping_type") == "LOOM") & F.arrays_overlap("f1", "f2")))
    pairs = m.select(F.least("n1", "n2").alias("u"), F.greatest("n1", "n2").alias("v"), "mapping_type")
    if stored is None:
        new = pairs.groupBy("u", "v").agg(F.array_sort(F.collect_set("mapping_type")).alias("mapping_types"))
        return new, new.select("u", "v")
    both = pairs.unionByName(stored.select("u", "v", F.explode("mapping_types").alias("mapping_type")))
    every = both.groupBy("u", "v").agg(F.array_sort(F.collect_set("mapping_type")).alias("mapping_types"))
    return every, pairs.select("u", "v").distinct().join(stored.select("u", "v"), ["u", "v"], "left_anti")
