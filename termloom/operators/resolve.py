"""Entity resolution by coordinates: (original_id, original_source) first, then (source_id, source).

coords: node, original_id, original_source; sources: node, source_id, source, is_unique, ord.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import blank_to_null
from ..plans.components import connected_components
from ..plans.iterate import keep

UNKNOWN = "<unknown>"


def with_defaults(coords: DataFrame) -> DataFrame:
    """Blank fields as null; a blank source id takes the original id if the sources agree or one is blank; a blank
    source is <unknown> where there is a source id."""
    c = coords
    for x in ("source_id", "source", "original_id", "original_source"):
        c = c.withColumn(x, blank_to_null(x))
    agree = F.col("source").isNull() | F.col("original_source").isNull() | (F.col("source") == F.col("original_source"))
    c = c.withColumn("__take", F.col("source_id").isNull() & F.col("original_id").isNotNull() & agree)
    c = c.withColumn("source", F.when(F.col("__take"), F.coalesce("source", "original_source")).otherwise(F.col("source")))
    c = c.withColumn("source_id", F.when(F.col("__take"), F.col("original_id")).otherwise(F.col("source_id"))).drop("__take")
    return c.withColumn("source", F.when(F.col("source_id").isNotNull(), F.coalesce("source", F.lit(UNKNOWN))))


def lookup_coordinates(requests: DataFrame, coords: DataFrame, sources: DataFrame) -> DataFrame:
    """requests with node: the node of the same original pair, else that of the same source pair (or of the same source
    id where both call it unique); null if there is none.

    Hits by source that bear another complete original pair, and several nodes for one request, raise an error.
    """
    r = requests.withColumn("__r", F.monotonically_increasing_id()) if "__r" not in requests.columns else requests
    r = keep(r)
    by_original = r.select("__r", "original_id", "original_source").join(coords, ["original_id", "original_source"]).select("__r", F.col("node").alias("n"))
    # of several source pairs, any position counts
    s = sources.select("node", F.col("source_id").alias("sid"), F.col("source").alias("src"), F.col("is_unique").alias("uq"))
    same = (F.col("source_id") == F.col("sid")) & ((F.col("source") == F.col("src")) | (F.coalesce(F.col("unique_source_id"), F.lit(False)) & F.col("uq")))
    hits = r.join(s, same).select("__r", F.col("node"), "original_id", "original_source")
    hits = hits.join(coords.select("node", F.col("original_id").alias("oid"), F.col("original_source").alias("os")), "node", "left")
    clash = F.col("original_id").isNotNull() & F.col("original_source").isNotNull() & F.col("oid").isNotNull() & F.col("os").isNotNull() & ~(
        (F.col("original_id") == F.col("oid")) & (F.col("original_source") == F.col("os"))
    )
    hits = hits.join(by_original.select("__r"), "__r", "left_anti")
    hits = hits.withColumn(
        "n",
        F.when(
            clash, F.raise_error(F.concat(F.lit("inconsistent data: another original id at "), F.col("node").cast("string"))).cast("string"),
        ).otherwise(F.col("node").cast("string")),
    )
    both = by_original.select("__r", F.col("n").cast("string").alias("n")).unionByName(hits.select("__r", "n")).groupBy("__r").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    one = both.select(
        "__r",
        F.when(
            F.col("lo") != F.col("hi"), F.raise_error(F.concat(F.lit("several nodes: "), "lo", F.lit(", "), "hi")).cast("string"),
        ).otherwise(F.col("lo")).alias("node"),
    )
    return r.join(one, "__r", "left").drop("__r")


def nodes_by_source_id(ids: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, node) at any position, from any source; an id with several nodes raises an error."""
    hit = sources.select("source_id", "node").join(ids.select("source_id").distinct(), "source_id").groupBy("source_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    return hit.select(
        "source_id",
        F.when(
            F.col("lo") != F.col("hi"), F.raise_error(F.concat(F.lit("several nodes with source id "), "source_id")).cast("string"),
        ).otherwise(F.col("lo").cast("string")).alias("node"),
    )


def unite_batch(rows: DataFrame, unite_unique: bool = True) -> DataFrame:
    """(ord, group) for rows (ord, original_id, original_source, source_id, source, unique_source_id) of one import:
    rows that share an original pair, a source pair or (unite_unique) a unique source id are one concept, named by its
    smallest ord. A group with two original pairs raises an error. Rows without a complete pair stand alone."""
    key = lambda tag, *xs: F.when(F.concat(*xs).isNotNull(), F.concat_ws("\x1f", F.lit(tag), *xs))
    keys = F.array(
        key("o", "original_id", "original_source"), key("s", "source_id", "source"),
        *([F.when(F.coalesce("unique_source_id", F.lit(False)), key("u", "source_id"))] if unite_unique else []),
    )
    pair = F.when(F.concat("original_id", "original_source").isNotNull(), F.concat_ws("\x1f", "original_id", "original_source"))
    k = keep(rows.select("ord", pair.alias("pair"), F.explode_outer(F.array_compact(keys)).alias("key")))
    first = k.where("key IS NOT NULL").groupBy("key").agg(F.min("ord").alias("b"))
    # each key stands for its first row, so only rows with several keys link anything
    own = keep(k.join(first, "key", "left").groupBy("ord").agg(F.first("pair").alias("pair"), F.coalesce(F.min("b"), "ord").alias("low"), F.array_distinct(F.collect_list("b")).alias("b")))
    links = keep(own.where(F.size("b") > 1).select(F.col("low").alias("a"), F.explode("b").alias("b")).where("a <> b").distinct())
    grouped = own.select("ord", "pair", F.col("low").alias("group"))
    if not links.isEmpty():
        of = connected_components(links, keep)
        grouped = keep(own.join(of, own["low"] == of["node"], "left").select("ord", "pair", F.coalesce("label", "low").alias("group")))
    bad = grouped.where("pair IS NOT NULL").groupBy("group").agg(F.min("pair").alias("lo"), F.max("pair").alias("hi")).where("lo <> hi")
    bad.select(F.raise_error(F.concat(F.lit("inconsistent data: two original ids in "), F.col("group").cast("string")))).first()
    return grouped.select("ord", "group")


def merged_sources(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(node, source_id, source, is_unique): the union; a pair that is there keeps its flag."""
    key = ["node", "source_id", "source"]
    new = incoming.groupBy(*key).agg(F.min_by("is_unique", "ord").alias("is_unique"))
    return existing.select(*key, "is_unique").unionByName(new.join(existing.select(*key), key, "left_anti"))


def source_arrays(sources: DataFrame) -> DataFrame:
    """(node, source_id, sources, unique): for each id its sources, sorted, and their flags side by side."""
    s = sources.groupBy("node", "source_id").agg(F.array_sort(F.collect_set(F.struct("source", "is_unique"))).alias("s"))
    return s.select("node", "source_id", F.col("s")["source"].alias("sources"), F.col("s")["is_unique"].alias("unique"))


def _sources_by_id(sources: DataFrame) -> DataFrame:
    """(node, source_id, position, s): a node's ids with their places, from 0, and each id's sources with their flags, sorted."""
    s = sources.groupBy("node", "source_id").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_set(F.struct("source", "is_unique"))).alias("s"))
    place = F.row_number().over(W.partitionBy("node").orderBy("ord", "source_id")) - 1
    return s.select("node", "source_id", place.alias("position"), "s")


def source_access(sources: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (node, source_id, source) with position (the id's place among the node's ids, -1 if it isn't one), sources and
    unique_sources (all of the id, and those that call it unique) and is_unique (what the source asked for says)."""
    few = sources.join(asked.select("node").distinct(), "node", "left_semi")
    found = asked.join(_sources_by_id(few), ["node", "source_id"], "left")
    shown = F.coalesce("s", F.array().cast("array<struct<source:string,is_unique:boolean>>"))
    unique = F.filter(shown, lambda x: F.coalesce(x["is_unique"], F.lit(False)))["source"]
    return found.select(
        "node", "source_id", "source", F.coalesce("position", F.lit(-1)).alias("position"), shown["source"].alias("sources"),
        unique.alias("unique_sources"), F.coalesce(F.array_contains(unique, F.col("source")), F.lit(False)).alias("is_unique"),
    )


def source_lists(sources: DataFrame) -> DataFrame:
    """(node, source_ids, sources, n): each node's ids in their order, the sources of all of them one after the other, and how
    many ids it has."""
    s = _sources_by_id(sources).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("position", "source_id", "s"))).alias("a"))
    return s.select("node", F.col("a")["source_id"].alias("source_ids"), F.flatten(F.transform("a", lambda x: x["s"]["source"])).alias("sources"), F.size("a").alias("n"))
