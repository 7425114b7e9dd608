"""Relations mined from documents: pairs, counts, and the two retrieval queries.

relation_docs: type, u, v (u <= v), doc, count. Edges are undirected; both directions are made where a query needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import keep
from .paths import leaf_elements, with_top


def relation_pairs(relations: DataFrame) -> DataFrame:
    """All i < j pairs of the arguments of each relation: relations has args array<string> (nulls: unresolved) and any
    other columns, which stay; u and v are the pair, the smaller first. Pairs with an unresolved end, or whose ends are
    equal, are left out."""
    i = relations.withColumn("__all", F.col("args")).select("*", F.posexplode("args").alias("__i", "__x")).where("__x IS NOT NULL")
    rest = F.slice("__all", F.col("__i") + 2, F.greatest(F.size("__all") - F.col("__i") - 1, F.lit(0)))
    both = i.select("*", F.explode(rest).alias("__y")).where("__y IS NOT NULL AND __x <> __y")
    return both.withColumn("u", F.least("__x", "__y")).withColumn("v", F.greatest("__x", "__y")).drop("args", "__all", "__i", "__x", "__y")


def argument_parts(arg: DataFrame, column: str = "arg", default_property: str | Column = "originalId", default_source: str | Column | None = None) -> DataFrame:
    """arg with id_property, id and id_source of an argument (array of id and perhaps source). A prefix counts only if it
    is one of the id properties; ids may hold colons. Defaults are values or columns."""
    default = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    raw, source = F.get(column, F.lit(0)), F.get(column, F.lit(1))
    known = F.substring_index(raw, ":", 1).isin("id", "originalId", "sourceIds") & raw.contains(":")
    return arg.select(
        "*",
        F.when(known, F.substring_index(raw, ":", 1)).otherwise(F.coalesce(default(default_property), F.lit("originalId"))).alias("__property"),
        F.when(known, F.expr(f"substring({column}[0], length(substring_index({column}[0], ':', 1)) + 2)")).otherwise(raw).alias("__id"),
        F.coalesce(source, default(default_source)).alias("__source"),
    ).drop("id_property", "id", "id_source").withColumnsRenamed({"__property": "id_property", "__id": "id", "__source": "id_source"})


def resolved_arguments(rows: DataFrame, concepts: DataFrame, sources: DataFrame) -> DataFrame:
    """rows of relation documents (id_property, id_source, args array<array<string>> and others) with args as nodes, null
    where nobody has the id. The property id finds a node by it alone; originalId and sourceIds need a source, the
    argument's own or the document's: without one an argument stays unresolved. Several nodes of one pair raise an error.
    """
    r = keep(rows.withColumn("__r", F.monotonically_increasing_id()))
    one = r.select("__r", "id_property", "id_source", F.posexplode("args").alias("k", "arg"))
    one = argument_parts(one, "arg", F.col("id_property"), F.col("id_source"))
    # a source for ids, too, so that all three properties are looked up by equality
    any_source = F.lit("")
    one = one.withColumn("id_source", F.when(F.col("id_property") == "id", any_source).otherwise(F.col("id_source")))
    by_id = concepts.select(F.lit("id").alias("p"), F.col("id").alias("i"), any_source.alias("s"), "node")
    by_original = concepts.select(F.lit("originalId"), F.col("original_id"), F.col("original_source"), "node")
    by_source = sources.select(F.lit("sourceIds"), F.col("source_id"), F.col("source"), "node")
    known = by_id.union(by_original).union(by_source).where("i IS NOT NULL AND s IS NOT NULL").groupBy("p", "i", "s").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    several = F.raise_error(F.concat(F.lit("several nodes with "), "p", F.lit(" "), "i", F.lit(" of "), "s")).cast(known.schema["node"].dataType)
    found = one.join(known, (F.col("id_property") == F.col("p")) & (F.col("id") == F.col("i")) & (F.col("id_source") == F.col("s")))
    # not as a condition, which would be moved below the join and raised for pairs that nobody asks for
    found = found.select("__r", "k", F.when(F.col("node") != F.col("last"), several).otherwise(F.col("node")).alias("node"))
    args = one.select("__r", "k").join(found, ["__r", "k"], "left").groupBy("__r").agg(F.sort_array(F.collect_list(F.struct("k", "node"))).alias("a"))
    return r.drop("args").join(args.select("__r", F.col("a")["node"].alias("args")), "__r").drop("__r")


def counted_at(pairs: DataFrame) -> DataFrame:
    """(type, u, v, doc, count, at): within one entry of a document counts add up, of several entries the last one counts;
    at is its place. pairs has type, u, v, doc, entry (anything that orders all entries) and count."""
    per_entry = pairs.groupBy("type", "u", "v", "doc", "entry").agg(F.sum("count").cast("long").alias("count"))
    return latest_counts(per_entry.withColumnRenamed("entry", "at"))


def latest_counts(rows: DataFrame) -> DataFrame:
    """Of rows (type, u, v, doc, count, at) the last of each relation and document."""
    return rows.groupBy("type", "u", "v", "doc").agg(F.max_by("count", "at").alias("count"), F.max("at").alias("at"))


def counted(pairs: DataFrame) -> DataFrame:
    """(type, u, v, doc, count) of one import, as counted_at says."""
    return counted_at(pairs).drop("at")


def upsert_counts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """relation_docs after an import: documents that come again get the new count."""
    key = ["type", "u", "v", "doc"]
    return stored.select(*key, "count").join(incoming.select(*key), key, "left_anti").unionByName(incoming.select(*key, "count"))


def totals(relation_docs: DataFrame) -> DataFrame:
    """(type, u, v, total, n_docs)."""
    return relation_docs.groupBy("type", "u", "v").agg(F.sum("count").alias("total"), F.count("*").alias("n_docs"))


def parallel_arrays(relation_docs: DataFrame) -> DataFrame:
    """(type, u, v, total_count, doc_ids, counts) with documents sorted."""
    return relation_docs.groupBy("type", "u", "v").agg(F.sum("count").alias("total_count"), F.array_sort(F.collect_list(F.struct("doc", "count"))).alias("d")).select(
        "type", "u", "v", "total_count", F.col("d")["doc"].alias("doc_ids"), F.col("d")["count"].alias("counts"),
    )


def first_methods(rows: DataFrame) -> DataFrame:
    """(type, u, v, db_name, method, at): of rows of these columns the first of each database; a blank method is <unknown>."""
    method = F.when(F.coalesce(F.btrim("method"), F.lit("")) == "", "<unknown>").otherwise(F.col("method"))
    return rows.withColumn("method", method).groupBy("type", "u", "v", "db_name").agg(F.min_by("method", "at").alias("method"), F.min("at").alias("at"))


def upsert_databases(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(type, u, v, db_name, method): each database's first method stays. incoming has ord, which orders its rows."""
    key = ["type", "u", "v", "db_name"]
    new = first_methods(incoming.withColumnRenamed("ord", "at")).drop("at")
    return stored.select(*key, "method").unionByName(new.join(stored.select(*key), key, "left_anti"))


def _requested(ids: DataFrame, tops: DataFrame) -> DataFrame:
    return with_top(ids.select("node").distinct(), tops, "node", "top").select(F.col("top").alias("node")).distinct()


def _seen_from(requested: DataFrame, relation_docs: DataFrame, elements: DataFrame, tops: DataFrame, types: list[str]) -> DataFrame:
    """(arg1, arg2, count): relations of the leaves below each requested top, once each, with the top at the other end."""
    leaves = leaf_elements(elements, requested).select(F.col("node").alias("arg1"), F.col("leaf").alias("u"))
    edges = relation_docs.where(F.col("type").isin(types))
    both = edges.select("u", "v", "count").union(edges.select("v", "u", "count").where("u <> v"))
    # few relations touch the leaves: only these are summed
    found = both.join(leaves, "u").groupBy("arg1", F.col("v").alias("other")).agg(F.sum("count").alias("count"))
    return with_top(found, tops, "other", "arg2").select("arg1", "arg2", "count")


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Result lines: arg1_id, arg1_name, arg2_id, arg2_name, count."""
    side = lambda k: names.select(F.col("node").alias(f"arg{k}"), F.col("name").alias(f"arg{k}_name"))
    out = rows.groupBy("arg1", "arg2").agg(F.sum("count").cast("long").alias("count")).where("count > 0")
    out = out.join(side(1), "arg1", "left").join(side(2), "arg2", "left")
    return out.select(F.col("arg1").alias("arg1_id"), "arg1_name", F.col("arg2").alias("arg2_id"), "arg2_name", "count")


def one_sided(
    ids: DataFrame, relation_docs: DataFrame, elements: DataFrame, tops: DataFrame, names: DataFrame, types: list[str],
    inter_input: bool = False,
) -> DataFrame:
    """All relations of the requested concepts (ids: node), summed between top aggregates. Relations among the
    requested themselves only with inter_input. Each relation counts once a direction, however many ids share a top."""
    asked = _requested(ids, tops)
    rows = _seen_from(asked, relation_docs, elements, tops, types)
    if not inter_input:
        rows = rows.join(asked.select(F.col("node").alias("arg2")), "arg2", "left_anti")
    return _named(rows, names)


def two_sided(a: DataFrame, b: DataFrame, relation_docs: DataFrame, elements: DataFrame, tops: DataFrame, names: DataFrame, types: list[str]) -> DataFrame:
    """Relations between the tops of a and those of b, seen from a."""
    rows = _seen_from(_requested(a, tops), relation_docs, elements, tops, types)
    return _named(rows.join(_requested(b, tops).select(F.col("node").alias("arg2")), "arg2", "left_semi"), names)
