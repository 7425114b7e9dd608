"""Export tables: id mappings, ancestor lists, dictionaries and facet maps. Each is a DataFrame; sinks write the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import normalized_space
from ..plans.iterate import closure, keep
from .paths import ancestors


def id_mapping(concepts: DataFrame, source: str, target: str, labels: list[str]) -> DataFrame:
    """(source_id, target_id): for each label's nodes every source value with every target value; strings count as
    arrays of one. A node with two of the labels is given twice, one without either property not at all."""
    arr = lambda c: F.col(c) if dict(concepts.dtypes)[c].startswith("array") else F.array(c)
    per_label = concepts.select(
        arr(source).alias("s"), arr(target).alias("t"),
        F.explode(F.array_intersect("labels", F.array(*map(F.lit, dict.fromkeys(labels))))).alias("label"),
    )
    return per_label.select("t", F.explode("s").alias("source_id")).select("source_id", F.explode("t").alias("target_id")).where("source_id IS NOT NULL AND target_id IS NOT NULL")


def hypernyms(edges: DataFrame, roots: DataFrame, concepts: DataFrame, facets: list[str] | None = None, label: str | None = None) -> DataFrame:
    """(node, hypernyms): real nodes (perhaps of a label) below the facets' roots with all real ancestors by these facets'
    edges, sorted and joined by |. None or ["all"] takes every facet, by the general edges. Nodes without ancestors have no
    row."""
    every = not facets or facets == ["all"]
    own = edges.where(F.col("facet").isNull() if every else F.col("facet").isin(facets)).select("src", "dst").distinct()
    start = (roots if every else roots.where(F.col("facet").isin(facets))).select(F.lit(0).alias("origin"), "node").distinct()
    below = closure(start, edges.where("facet IS NULL").select("src", "dst").distinct()).select("node")
    real = concepts.where(~F.array_contains("labels", "HOLLOW") & (F.array_contains("labels", label) if label else F.lit(True))).select("node")
    found = ancestors(own, concepts, keep(below.join(real, "node", "left_semi")))
    return found.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("ancestor")), "|").alias("hypernyms"))


def dictionary_lines(
    concepts: DataFrame, properties: list[str], source_of: dict[str, str] | None = None, exclude: list[str] | None = None,
    label: str | None = None,
) -> DataFrame:
    """(key, ids, node, value_ord, name_ord): a line for each name of each node and each index of its id arrays.

    A name is the preferred name, a synonym or an acronym, with single spaces and more than two characters. Several
    properties' ids at one index are joined by ||; source_of names the column that holds a property's sources, which
    then precede the id with a colon. Arrays of unequal length raise an error. Nodes without node or pref_name, or
    with an excluded label, have no lines.
    """
    c = concepts.where("node IS NOT NULL AND pref_name IS NOT NULL")
    if label:
        c = c.where(F.array_contains("labels", label))
    if exclude:
        c = c.where(~F.arrays_overlap("labels", F.array(*map(F.lit, exclude))))
    kinds = dict(c.dtypes)
    arr = lambda x: F.col(x) if kinds[x].startswith("array") else F.when(F.col(x).isNotNull(), F.array(x))

    def prefixed(p: str) -> Column:
        s = (source_of or {}).get(p)
        return F.zip_with(arr(s), arr(p), lambda a, b: F.concat(a, F.lit(":"), b)) if s else arr(p)

    ids = [prefixed(p) for p in properties]
    sizes = F.array_distinct(F.array(*(F.size(i) for i in ids)))
    c = c.withColumn("__zip", F.arrays_zip(*(i.alias(f"p{k}") for k, i in enumerate(ids)))).withColumn(
        "__ok",
        F.when(F.size(sizes) > 1, F.raise_error(F.concat(F.lit("id arrays of unequal length at "), F.col("node")))).otherwise(F.lit(None).cast("void")),
    )
    names = F.array_distinct(F.concat(
        F.array("pref_name"), *(F.coalesce(F.col(x), F.array().cast("array<string>")) for x in ("synonyms", "acronyms") if x in c.columns),
    ))
    lines = c.select("node", "__zip", "__ok", F.posexplode(names).alias("name_ord", "name"))
    lines = lines.select("node", "name_ord", normalized_space("name").alias("key"), "__ok", F.posexplode("__zip").alias("value_ord", "z"))
    joined = F.concat_ws("||", *(F.col("z")[f"p{k}"] for k in range(len(properties))))
    return lines.where((F.length("key") > 2) & F.col("__ok").isNull()).select("key", joined.alias("ids"), "node", "value_ord", "name_ord")


def unique_keys(lines: DataFrame) -> DataFrame:
    """(key, ids): each key's first line by node, index and name."""
    return lines.groupBy("key").agg(F.min_by("ids", F.struct("node", "value_ord", "name_ord")).alias("ids"))


def concept_facet_map(concepts: DataFrame) -> DataFrame:
    """(node, facets) of nodes that have facets, joined by |."""
    return concepts.where("node IS NOT NULL AND size(facets) > 0").select("node", F.array_join("facets", "|").alias("facets"))
