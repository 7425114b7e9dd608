"""Import of concepts: identity, placeholders, merged properties, taxonomy and further edges, aggregates.

One import is one set-based job over all its concepts, whatever their number; a graph is never changed, a new one is made.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import blank_to_null, is_blank, merged_entries, merged_map, null_if_empty, ordered_union, value_clash, without
from ..plans.iterate import keep
from .facets import ensure_no_facet, resolve_facet
from .graph import Graph, next_number, numbered
from .query import HOLLOW
from .resolve import lookup_coordinates, merged_sources, unite_batch, with_defaults

BROADER = "IS_BROADER_THAN"
ARRAYS = {"synonyms": "synonyms", "writingVariants": "writing_variants", "descriptions": "descriptions", "copyProperties": "copy_properties"}


@dataclass(frozen=True)
class Options:
    """How an import treats what it doesn't know."""

    merge: bool = False
    override_preferred_name: bool = False
    do_not_create_hollow_parents: bool = False
    create_hollow_aggregate_elements: bool = False
    cut_parents: tuple[str, ...] = ()
    parentless_to_no_facet: bool = False
    unite_unique_source_ids: bool = True


def _coordinates(rows: DataFrame, c: str, kind: str, k: Column) -> DataFrame:
    names = {"sourceId": "source_id", "source": "source", "originalId": "original_id", "originalSource": "original_source"}
    return rows.where(F.col(c).isNotNull()).select(
        "ord", F.lit(kind).alias("kind"), k.cast("int").alias("k"), F.col(f"{c}.sourceId").alias("given_id"),
        *(F.col(f"{c}.{a}").alias(b) for a, b in names.items()), F.coalesce(f"{c}.uniqueSourceId", F.lit(False)).alias("unique_source_id"),
    )


def references(concepts: DataFrame, options: Options) -> DataFrame:
    """(ord, kind, k, given_id, coordinates): what each concept is, and the parents, elements and targets it names."""
    out = _coordinates(concepts, "coordinates", "concept", F.lit(0))
    lists = [("elementCoordinates", "element", "e"), ("relationships", "target", "e.targetCoordinates")]
    if not options.merge:
        lists.append(("parentCoordinates", "parent", "e"))
    for column, kind, at in lists:
        e = concepts.select("ord", F.posexplode(column).alias("k", "e")).select("ord", "k", F.col(at).alias("c"))
        out = out.unionByName(_coordinates(e, "c", kind, F.col("k")))
    return with_defaults(out)


def check(concepts: DataFrame, options: Options) -> None:
    """Raises an error if an input concept lacks what an import needs."""
    c = F.col("coordinates")
    bare = c.isNull() & ~F.coalesce(F.col("aggregate"), F.lit(False))
    half = is_blank(c["originalId"]) != is_blank(c["originalSource"])
    no_id = is_blank(c["sourceId"]) & is_blank(c["originalId"])
    problem = F.when(bare, "no coordinates").when(c.isNotNull() & half, "original id and source go together").when(
        c.isNotNull() & no_id & (not options.merge), "no source id",
    )
    if options.merge:
        problem = F.coalesce(problem, F.when(F.size("parentCoordinates") > 0, "parents while merging"))
    if row := concepts.select("ord", problem.alias("p")).where("p IS NOT NULL").first():
        raise ValueError(f"concept {row['ord']}: {row['p']}")


def insert_concepts(graph: Graph, concepts: DataFrame, facet: dict | None = None, options: Options = Options()) -> tuple[Graph, dict]:  # noqa: B008
    """(graph, counts) after importing concepts (columns of documents.CONCEPT and ord, the input order).

    Without a facet the import merges: unknown concepts are skipped. counts has concepts, relationships and facet.
    """
    graph, fid = resolve_facet(graph, facet)
    if fid is None:
        options = Options(**{**options.__dict__, "merge": True})
    concepts = keep(concepts.withColumn("aggregate", F.coalesce("aggregate", F.lit(False))))
    check(concepts, options)
    refs = keep(references(concepts, options).withColumn("r", F.monotonically_increasing_id()))

    # one group for each concept meant, and the node that it has already
    groups = unite_batch(
        refs.select(F.col("r").alias("ord"), "original_id", "original_source", "source_id", "source", "unique_source_id"),
        options.unite_unique_source_ids,
    )
    coords = graph.concepts.select("node", "original_id", "original_source").where("original_id IS NOT NULL")
    known = lookup_coordinates(
        refs.select("r", "original_id", "original_source", "source_id", "source", "unique_source_id"), coords, graph.sources,
    ).select("r", F.col("node").cast("long").alias("node"))
    refs = keep(refs.join(groups.withColumnRenamed("ord", "r"), "r").join(known, "r"))
    cut = F.col("given_id").isin(list(options.cut_parents)) if options.cut_parents else F.lit(False)
    makes = F.when(F.col("kind") == "concept", not options.merge).when(
        F.col("kind") == "parent", ~cut & (not options.do_not_create_hollow_parents),
    ).when(F.col("kind") == "element", options.create_hollow_aggregate_elements).otherwise(True)
    per_group = refs.groupBy("group").agg(
        F.min("node").alias("node"), F.bool_or(makes).alias("makes"),
        F.min(F.when(F.col("kind") == "concept", F.col("ord"))).alias("first"), F.min("ord").alias("any_ord"),
    )
    fresh = numbered(
        per_group.where("node IS NULL AND makes").select("group", F.coalesce("first", "any_ord").alias("at")), ["at", "group"], "new_node",
        next_number(graph, "node"),
    )
    node_of = keep(per_group.join(fresh.select("group", "new_node"), "group", "left").select(
        "group", F.coalesce("node", "new_node").alias("node"), F.col("node").isNotNull().alias("existed"),
        F.col("first").isNotNull().alias("imported"), "first",
    ))
    at = keep(refs.drop("node").join(node_of, "group").where("node IS NOT NULL"))

    old = graph.concepts
    own = at.where("kind = 'concept'").select("ord", "node", "existed", "original_id", "original_source")
    rows = concepts.join(own, "ord")
    # aggregates that are real already stay as they are
    real = old.where(~F.array_contains("labels", HOLLOW)).select("node")
    rows = keep(rows.where("NOT aggregate").unionByName(rows.where("aggregate").join(real, "node", "left_anti")))
    merged = _merged_rows(rows)

    made = node_of.join(graph.concepts.select("node", F.lit(True).alias("old")), "node", "left").where("node IS NOT NULL AND old IS NULL")
    blank = made.select("node").join(
        at.groupBy("node").agg(
            F.min_by("original_id", F.struct(F.col("original_id").isNull(), "r")).alias("original_id"),
            F.min_by("original_source", F.struct(F.col("original_id").isNull(), "r")).alias("original_source"),
        ),
        "node",
    )
    no_array = F.lit(None).cast("array<string>")
    new_rows = blank.select(
        "node", F.lit(None).cast("string").alias("id"), F.array(F.lit(HOLLOW), F.lit("CONCEPT")).alias("labels"),
        F.lit(None).cast("string").alias("pref_name"), "original_id", "original_source",
        *(no_array.alias(c) for c in ("synonyms", "writing_variants", "descriptions", "copy_properties", "facets", "mapping_type")),
        F.lit(None).cast("map<string,string>").alias("props"),
    )
    every = old.unionByName(new_rows)

    # hollow nodes that now have a concept get the next ids, in input order
    to_fill = every.where(F.array_contains("labels", HOLLOW)).select("node").join(merged.select("node", "first", "is_aggregate"), "node")
    ids = [numbered(to_fill.where(F.col("is_aggregate") == flag).select("node", "first"), ["first", "node"], "n", next_number(graph, prefix)).select("node", F.concat(F.lit(prefix), F.col("n").cast("string")).alias("new_id")) for flag, prefix in ((False, "tid"), (True, "atid"))]
    filled = keep(ids[0].union(ids[1]))
    result = keep(_merge_into(every, merged, filled, fid, options))
    sources = keep(_sources(graph, at, concepts, rows))

    graph = graph.with_(concepts=result, sources=sources)
    if options.parentless_to_no_facet and fid:
        graph = ensure_no_facet(graph, fid)
    roots_left = graph.roots.join(filled.select("node"), "node", "left_anti").select("facet", "node", "is_no_facet")
    edges, roots = _taxonomy(concepts, at, result, fid, options)
    more = _explicit(concepts, at)
    all_edges = keep(upsert_edges(graph.edges, edges.unionByName(more)))
    all_roots = keep(roots_left.unionByName(roots).distinct())
    elements = at.where("kind = 'element'").select("ord", F.col("node").alias("element")).join(
        rows.where("aggregate").select("ord", F.col("node").alias("aggregate")), "ord",
    ).select("aggregate", "element")
    all_elements = keep(graph.elements.unionByName(elements).distinct())
    new_roots = all_roots.join(graph.roots, ["facet", "node", "is_no_facet"], "left_anti")
    signs = ((all_edges, 0, 1), (graph.edges, 0, -1), (all_elements, 0, 1), (graph.elements, 0, -1), (new_roots, 0, 1), (new_rows, 1, 0))
    sizes = [df.agg(F.count("*").alias("n")).select((F.col("n") * nodes).alias("concepts"), (F.col("n") * rel).alias("relationships")) for df, nodes, rel in signs]
    made = reduce(DataFrame.unionByName, sizes).agg(F.sum("concepts").alias("concepts"), F.sum("relationships").alias("relationships")).first()
    counts = {"concepts": made["concepts"], "relationships": made["relationships"], "facet": fid}
    return graph.with_(edges=all_edges, roots=all_roots, elements=all_elements), counts


def _merged_rows(rows: DataFrame) -> DataFrame:
    """A row for each node: what the import's concepts say of it together, by input order."""
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("ord")))
    name = blank_to_null("preferredName")
    in_order = lambda a: F.sort_array(F.collect_list(F.when(F.col(a).isNotNull(), F.struct("ord", F.col(a).alias("v")))))
    arrays = [F.array_distinct(F.flatten(F.transform(in_order(a), lambda s: s["v"]))).alias(b) for a, b in (*ARRAYS.items(), ("labels", "more_labels"))]
    props = F.aggregate(
        F.sort_array(F.collect_list(F.when(F.col("additional_properties").isNotNull(), F.struct("ord", F.map_entries("additional_properties").alias("e"))))),
        F.lit(None).cast("array<struct<key:string,value:string>>"), lambda a,
        s: F.concat(
            F.coalesce(a, F.array().cast("array<struct<key:string,value:string>>")),
            F.filter(s["e"], lambda x: F.coalesce(~F.exists(a, lambda y: y["key"] == x["key"]), F.lit(True))),
        ),
    )
    return keep(rows.groupBy("node").agg(
        F.min("ord").alias("first"), F.bool_or("aggregate").alias("is_aggregate"),
        F.bool_or(F.coalesce("aggregateIncludeInHierarchy", F.lit(False))).alias("in_hierarchy"), first(name).alias("name"),
        F.max_by(name, F.when(name.isNotNull(), F.col("ord"))).alias("last_name"), first(F.col("original_id")).alias("oid"),
        first(F.col("original_source")).alias("osrc"), *arrays, F.map_from_entries(props).alias("more_props"),
    ))


def _merge_into(every: DataFrame, merged: DataFrame, filled: DataFrame, fid: str | None, options: Options) -> DataFrame:
    renamed = merged.select(
        "node", "is_aggregate", "in_hierarchy", "name", "last_name", "oid", "osrc", "more_labels", "more_props", F.lit(True).alias("hit"),
        *(F.col(b).alias(f"in_{b}") for b in ARRAYS.values()),
    )
    x = every.join(renamed, "node", "left").join(filled, "node", "left")
    hit = F.col("hit").isNotNull()
    name = F.when(
        hit & options.override_preferred_name, F.coalesce("last_name", "pref_name"),
    ).when(hit, F.coalesce("pref_name", "name")).otherwise(F.col("pref_name"))
    base = F.when(F.col("new_id").isNotNull(), F.array_remove("labels", HOLLOW)).otherwise(F.col("labels"))
    agg = F.coalesce("is_aggregate", F.lit(False))
    labels = F.array_union(base, F.when(agg, F.array(F.lit("AGGREGATE"))).otherwise(F.array().cast("array<string>")))
    labels = F.when(hit, F.array_union(labels, F.coalesce("more_labels", F.array().cast("array<string>")))).otherwise(F.col("labels"))
    united = {b: F.when(hit, null_if_empty(ordered_union(b, f"in_{b}"))).otherwise(F.col(b)) for b in ARRAYS.values()}
    x = x.withColumn("__name", name)
    facets = F.when(
        hit & ~agg & F.lit(fid is not None), F.array_union(F.coalesce("facets", F.array().cast("array<string>")), F.array(F.lit(fid))),
    ).otherwise(F.col("facets"))
    return x.select(
        "node", F.coalesce("new_id", "id").alias("id"), labels.alias("labels"), F.col("__name").alias("pref_name"), F.coalesce("original_id", "oid").alias("original_id"), F.coalesce("original_source", "osrc").alias("original_source"),
        F.when(hit, null_if_empty(without(united["synonyms"], "__name"))).otherwise(F.col("synonyms")).alias("synonyms"), united["writing_variants"].alias("writing_variants"), united["descriptions"].alias("descriptions"), united["copy_properties"].alias("copy_properties"),
        facets.alias("facets"), "mapping_type", F.when(
            hit & F.col("more_props").isNotNull(), merged_map("props", "more_props"),
        ).otherwise(F.col("props")).alias("props"),
    )


def _sources(graph: Graph, at: DataFrame, concepts: DataFrame, rows: DataFrame) -> DataFrame:
    """Source ids of all nodes: those they had, and those of this import with their further coordinates."""
    new = at.where("source_id IS NOT NULL").select("node", "source_id", "source", F.col("unique_source_id").alias("is_unique"), "ord")
    extra = concepts.select("ord", F.explode("additional_coordinates").alias("c")).where("c.sourceId IS NOT NULL AND c.source IS NOT NULL")
    extra = extra.join(rows.select("ord", "node"), "ord").select(
        "node", F.col("c.sourceId").alias("source_id"), F.col("c.source").alias("source"),
        F.coalesce("c.uniqueSourceId", F.lit(False)).alias("is_unique"), "ord",
    )
    pairs = merged_sources(graph.sources, new.unionByName(extra))
    order = new.unionByName(extra).groupBy("node", "source_id").agg(F.min("ord").alias("o"))
    had = graph.sources.groupBy("node", "source_id").agg(F.min("ord").alias("ord"))
    start = had.groupBy("node").agg((F.max("ord") + 1).alias("start"))
    added = order.join(had, ["node", "source_id"], "left_anti").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("o", "source_id"))).alias("s"))
    added = added.join(start, "node", "left").select("node", F.coalesce("start", F.lit(0)).alias("start"), F.posexplode("s").alias("k", "x")).select(
        "node", F.col("x.source_id").alias("source_id"), (F.col("start") + F.col("k")).cast("int").alias("ord"),
    )
    return pairs.join(had.unionByName(added), ["node", "source_id"]).select("node", "source_id", "source", "is_unique", "ord")


def _taxonomy(concepts: DataFrame, at: DataFrame, nodes: DataFrame, fid: str | None, options: Options) -> tuple[DataFrame, DataFrame]:
    """New (edges, roots) from parents and from their absence."""
    none = F.lit(None).cast("map<string,string>")
    shown = concepts.where(~F.col("aggregate") | F.coalesce("aggregateIncludeInHierarchy", F.lit(False)))
    own = at.where("kind = 'concept'").select("ord", F.col("node").alias("child"))
    has_parents = F.coalesce(F.size("parentCoordinates"), F.lit(0)) > 0
    c = shown.join(own, "ord").select(
        "ord", "child", has_parents.alias("has_parents"), F.coalesce("eligible_for_facet_root", F.lit(True)).alias("eligible"),
        "parentCoordinates",
    )
    roots = c.where("NOT has_parents AND eligible").select(
        F.lit(fid).alias("facet"), F.col("child").alias("node"), F.lit(options.parentless_to_no_facet).alias("is_no_facet"),
    ).where("facet IS NOT NULL")
    at_first = F.struct(F.lit(0).cast("long").alias("ord"), F.lit(0).alias("k"))
    empty = concepts.sparkSession.createDataFrame([], "src long, dst long, type string, facet string, props map<string,string>, at struct<ord long, k int>")
    if options.merge or fid is None:
        return empty, roots
    named = c.select("ord", "child", F.posexplode("parentCoordinates").alias("k", "p"))
    cut = F.col("p.sourceId").isin(list(options.cut_parents)) if options.cut_parents else F.lit(False)
    labels = nodes.select(F.col("node").alias("parent"), "labels")
    p = named.withColumn("cut", F.coalesce(cut, F.lit(False))).join(
        at.where("kind = 'parent'").select("ord", "k", F.col("node").alias("parent"), (F.col("existed") | F.col("imported")).alias("known")),
        ["ord", "k"], "left",
    ).join(labels, "parent", "left")
    wrong = F.array_contains("labels", "AGGREGATE") & ~F.array_contains("labels", "CONCEPT")
    p = keep(p.where(F.when(~F.col("cut") & wrong, F.raise_error(F.lit("a parent is an aggregate outside the hierarchy")).cast("boolean")).otherwise(True)))
    linked = p.where("NOT cut AND parent IS NOT NULL")
    edges = linked.select(
        F.col("parent").alias("src"), F.col("child").alias("dst"), F.explode(F.array(F.lit(None).cast("string"), F.lit(fid))).alias("facet"),
    ).distinct()
    edges = edges.select("src", "dst", F.concat_ws("_", F.lit(BROADER), "facet").alias("type"), "facet", none.alias("props"), at_first.alias("at"))
    root = lambda df, node: df.select(F.lit(fid).alias("facet"), F.col(node).alias("node"), F.lit(False).alias("is_no_facet"))
    roots = roots.unionByName(root(p.where("cut OR parent IS NULL"), "child")).unionByName(root(linked.where("NOT known"), "parent"))
    return edges, roots.distinct()


def _explicit(concepts: DataFrame, at: DataFrame) -> DataFrame:
    own = at.where("kind = 'concept'").select("ord", F.col("node").alias("src"))
    r = concepts.select("ord", F.posexplode("relationships").alias("k", "e")).join(own, "ord").join(
        at.where("kind = 'target'").select("ord", "k", F.col("node").alias("dst")), ["ord", "k"],
    )
    return r.select(
        "src", "dst", F.col("e.type").alias("type"), F.lit(None).cast("string").alias("facet"), F.col("e.properties").alias("props"),
        F.struct("ord", "k").alias("at"),
    )


ENTRIES = "array<struct<key:string,value:string>>"


def upsert_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges after an import's edges (src, dst, type, facet, props, at: their order), taken one after another for each pair
    of ends and type.

    An edge is merged into the first of those there that no single value of its properties contradicts: it adds properties,
    and elements to lists. If there is none, it becomes another edge, and the import's later ones of that key are taken as
    the same and change nothing. Edges of a key are in the order in which they came (nth); values are JSON texts. A list that
    meets a single value is an error. Keys that the import doesn't name stay as they are.
    """
    key = ["src", "dst", "type", "facet"]
    entries = lambda c: F.coalesce(F.array_sort(F.map_entries(c)), F.array().cast(ENTRIES))
    new = incoming.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", entries("props").alias("p")))).alias("new"))
    hit = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    there = stored.select(*(F.col(k).alias(f"__{k}") for k in key), "props", "nth")
    touched = new.select(*key).join(there, reduce(Column.__and__, hit)).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("nth", entries("props").alias("p")))).alias("old"))
    renamed = touched.select(*(F.col(k).alias(f"__{k}") for k in key), "old")
    both = new.join(renamed, reduce(Column.__and__, hit), "left").select(
        *key, "new", F.coalesce(F.transform("old", lambda e: e["p"]), F.array().cast(f"array<{ENTRIES}>")).alias("old"),
    )

    def clash(a: Column, b: Column) -> Column:
        return F.exists(b, lambda e: value_clash(F.get(F.filter(a, lambda o: o["key"] == e["key"]), F.lit(0))["value"], e["value"], e["key"]))

    def step(state: Column, one: Column) -> Column:
        fits = F.transform(state["edges"], lambda e: ~clash(e, one["p"]))
        first = F.array_position(fits, F.lit(True)).cast("int")  # from 1, 0 if there is none
        merged = F.transform(state["edges"], lambda e, i: F.when(i + 1 == first, merged_entries(e, one["p"])).otherwise(e))
        found = F.struct(merged.alias("edges"), F.lit(False).alias("made"))
        made = F.struct(F.array_append(state["edges"], one["p"]).alias("edges"), F.lit(True).alias("made"))
        return F.when(state["made"], state).when(first > 0, found).otherwise(made)

    start = F.struct(F.col("old").alias("edges"), F.lit(False).alias("made"))
    folded = both.select(*key, F.posexplode(F.aggregate("new", start, step)["edges"]).alias("nth", "p"))
    props = F.when(F.size("p") > 0, F.map_from_entries("p")).otherwise(F.lit(None).cast("map<string,string>"))
    rest = stored.join(new.select(*(F.col(k).alias(f"__{k}") for k in key)), reduce(Column.__and__, hit), "left_anti")
    return rest.select(*key, "props", "nth").unionByName(folded.select(*key, props.alias("props"), "nth"))
