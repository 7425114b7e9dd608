"""The graph's services by the names its users know: each takes a Graph and gives a DataFrame or a new Graph.

Concepts go by their id (tid0, atid0) in requests and results; inside, tables are keyed by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_text, as_value, list_of
from ..plans.iterate import closure, heights, keep
from . import aggregates as A
from . import exports as E
from . import mappings as M
from . import paths as P
from . import query as Q
from . import relations as R
from . import traversal as T
from . import variants as V
from .graph import Graph, next_number, next_numbers, numbered, without_nodes

NAME = {
    "preferredName": "pref_name", "id": "id", "originalId": "original_id", "originalSource": "original_source", "synonyms": "synonyms",
    "descriptions": "descriptions", "writingVariants": "writing_variants",
}
#: Properties that are columns of concepts; all others are in props.
SCALARS = {p: NAME[p] for p in ("preferredName", "originalId", "originalSource")}
LISTS = {p: NAME[p] for p in ("synonyms", "writingVariants", "descriptions")} | {"facets": "facets"}
TOP_LABELS = ("AGGREGATE_GENEGROUP", "AGGREGATE_TOP_ORTHOLOGY")


def _ids(graph: Graph, ids: list[str]) -> DataFrame:
    asked = graph.concepts.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return graph.concepts.join(asked.distinct(), "id", "left_semi").select("node")


def _named(df: DataFrame, graph: Graph, column: str, out: str) -> DataFrame:
    return df.join(graph.concepts.select(F.col("node").alias(column), F.col("id").alias(out)), column)


def get_children_of_concepts(graph: Graph, concept_ids: list[str], label: str | None = None) -> DataFrame:
    """(parent_id, child_id, types)."""
    concepts = Q.scan(graph.concepts, label) if label else graph.concepts
    found = Q.children(graph.edges, concepts, _ids(graph, concept_ids))
    return _named(_named(found, graph, "parent", "parent_id"), graph, "child", "child_id").select("parent_id", "child_id", "types")


def _nodes_with(graph: Graph, values: list[str], id_property: str) -> DataFrame:
    """The nodes that bear the values in id_property; a value that no concept has is an error."""
    asked = graph.concepts.sparkSession.createDataFrame([(v,) for v in values], "value string").distinct()
    if id_property == "sourceIds":
        known = graph.sources.select("node", F.col("source_id").alias("value"))
    else:
        known = graph.concepts.select(
            "node",
            (F.col(NAME[id_property]) if id_property in NAME else as_text(F.try_element_at("props", F.lit(id_property)))).alias("value"),
        )
    found = keep(asked.join(known, "value", "left").select("value", "node").distinct())
    if row := found.where("node IS NULL").first():
        raise ValueError(f"no concept with {id_property} {row['value']}")
    return found.select("node").distinct()


def get_paths_to_facetroots(
    graph: Graph, concept_ids: list[str], return_id_property: str = "id", sort_result: bool = False, facet_id: str | None = None,
    id_property: str = "id",
) -> DataFrame:
    """(concept_id, path): paths from facet roots to each concept, as values of a property; perhaps shortest first. Concepts are
    given by their values of id_property; an unknown one is an error."""
    found = P.paths_from_roots(_nodes_with(graph, concept_ids, id_property), graph.edges, graph.roots, graph.concepts, facet_id, NAME[return_id_property])
    named = _named(found, graph, "node", "concept_id").select("concept_id", "path")
    return named.orderBy(F.size("path")) if sort_result else named


def get_facet_roots(graph: Graph, facet_ids: list[str], concept_ids: dict[str, list[str]] | None = None, max_roots: int = 0) -> DataFrame:
    """(facet, concept_id)."""
    wanted = None
    if concept_ids:
        asked = graph.concepts.sparkSession.createDataFrame([(f, i) for f, xs in concept_ids.items() for i in xs], "facet string, id string")
        wanted = asked.join(graph.concepts.select("id", "node"), "id").select("facet", "node")
    found = Q.facet_roots(graph.roots.where("NOT is_no_facet"), facet_ids, wanted, max_roots)
    return _named(found, graph, "node", "concept_id").select("facet", "concept_id")


def update_children_information(graph: Graph) -> DataFrame:
    """(concept_id, facets) in which each concept has children."""
    return _named(Q.children_in_facets(graph.edges), graph, "node", "concept_id").select("concept_id", "facets")


def get_facets(graph: Graph, return_hollow_facets: bool = False) -> DataFrame:
    """(grp, facets)."""
    return Q.facets_by_group(graph.facets.where("NOT is_no_facet"), graph.roots, graph.concepts, return_hollow_facets)


def get_all_facets(graph: Graph, key: str = T.ANY, value: str = T.ANY) -> DataFrame:
    """(facet, name, grp): facets one of whose properties (key, or any) equals value or holds it; ANY value asks only whether
    the property is there. Facets of the no-facet groups come too, as they stand below groups of their own."""
    named = graph.facets.withColumn("node", F.col("facet"))
    fits = T.by_property(named, key, value).where("emit").select(F.col("node").alias("facet")).distinct()
    return graph.facets.join(fits, "facet", "left_semi").select("facet", "name", "grp", "is_no_facet")


def get_morphology(graph: Graph, concept_ids: list[str] | None, kind: str, label: str | None = None) -> DataFrame:
    """(concept_id, name, doc, count): variants of a kind (acronym, writing_variant) of concepts (None: of all), perhaps only of
    those that bear a label."""
    asked = graph.concepts if concept_ids is None else graph.concepts.where(F.col("id").isin(concept_ids))
    some = (Q.scan(asked, label) if label else asked).select(F.col("id").alias("concept"))
    own = graph.variants.where(F.col("kind") == kind).join(some, "concept", "left_semi")
    return own.select(F.col("concept").alias("concept_id"), "name", "doc", "count")


def node_maps(graph: Graph, concept_ids: list[str] | None = None) -> DataFrame:
    """(node, json): all properties of each concept (or of those given) and its labels as one nested JSON object: texts, numbers,
    booleans, lists and objects keep their kind; what a concept hasn't is left out."""
    c = graph.concepts if concept_ids is None else graph.concepts.where(F.col("id").isin(concept_ids))
    first = graph.sources.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("ord", "source_id", "source", "is_unique"))).alias("s"))
    c = c.join(first, "node", "left")
    listed = lambda x: F.when(F.size(x) > 0, F.to_json(x))
    shown = {p: as_value(NAME[p]) for p in ("id", "preferredName", "originalId", "originalSource")}
    shown |= {p: listed(F.col(x)) for p, x in {**LISTS, "copyProperties": "copy_properties", "mappingType": "mapping_type", "labels": "labels"}.items()}
    shown |= {p: listed(F.col("s")[f]) for p, f in (("sourceIds", "source_id"), ("sources", "source"), ("uniqueSourceIds", "is_unique"))}
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    own = F.filter(F.array(*(entry(F.lit(p), v) for p, v in shown.items())), lambda e: e["value"].isNotNull())
    free = F.filter(
        F.coalesce(F.map_entries("props"), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: ~F.exists(own, lambda o: o["key"] == e["key"]),
    )
    pairs = F.transform(F.concat(own, free), lambda e: F.concat(as_value(e["key"]), F.lit(":"), e["value"]))
    return c.select("node", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("json"))


def get_facet_size(graph: Graph) -> DataFrame:
    """(facet, n)."""
    return P.facet_sizes(
        graph.roots.where("NOT is_no_facet").withColumn("node", F.col("node").cast("string")),
        graph.edges.withColumn("src", F.col("src").cast("string")).withColumn("dst", F.col("dst").cast("string")),
    )


def insert_mappings(graph: Graph, mappings: DataFrame) -> tuple[Graph, int]:
    """(graph, new mappings); ids are source ids."""
    nodes = graph.sources.select(F.col("source_id").alias("id"), "node").distinct().join(graph.concepts.select("node", "facets"), "node")
    every, new = M.insert_mappings(mappings, nodes, graph.mappings)
    return graph.with_(mappings=keep(every)), new.count()


def insert_ie_relations(graph: Graph, rows: DataFrame) -> Graph:
    """The graph after the relations of documents (rows of documents.read_relations)."""
    resolved = keep(R.resolved_arguments(rows, graph.concepts, graph.sources))
    pairs = keep(R.relation_pairs(resolved.select("doc", "entry", "is_db", "type", "count", "method", "args")))
    docs = R.counted(pairs.where("NOT is_db"))
    dbs = pairs.where("is_db").select("type", "u", "v", F.col("doc").alias("db_name"), "method", F.col("entry").alias("ord"))
    return graph.with_(relation_docs=keep(R.upsert_counts(graph.relation_docs, docs)), relation_dbs=keep(R.upsert_databases(graph.relation_dbs, dbs)))


def retrieve_ie_relations(graph: Graph, request: dict) -> DataFrame:
    """Result lines of a request {a_list: {id_property, ids}, b_list, relationTypes, enable_inter_input_relation_retrieval}.
    sourceIds means each concept's first source id; unknown ids are dropped; lines go by it as well."""
    spark = graph.concepts.sparkSession
    first = graph.sources.where("ord = 0").groupBy("node").agg(F.min("source_id").alias("sourceIds"))
    by = graph.concepts.select("node", "id", F.col("original_id").alias("originalId"), F.col("pref_name").alias("name"), "labels").join(first, "node", "left")

    def nodes(side: dict) -> DataFrame:
        asked = spark.createDataFrame([(x,) for x in side["ids"]], "x string").distinct()
        return by.join(asked, by[side["id_property"]] == asked["x"], "left_semi").select("node")

    tops = P.top_aggregates(graph.elements, by.where(F.arrays_overlap("labels", F.array(*map(F.lit, TOP_LABELS)))))
    args = (graph.relation_docs, graph.elements, tops, by.select("node", "name"), request["relationTypes"])
    b = request.get("b_list") or {}
    found = R.two_sided(nodes(request["a_list"]), nodes(b), *args) if b.get("ids") else R.one_sided(
        nodes(request["a_list"]), *args, bool(request.get("enable_inter_input_relation_retrieval")),
    )
    shown = request["a_list"]["id_property"]
    side = lambda k: by.select(F.col("node").alias(f"arg{k}_id"), F.col(shown).alias(f"id{k}"))
    return found.join(side(1), "arg1_id").join(side(2), "arg2_id").select(
        F.col("id1").alias("arg1_id"), "arg1_name", F.col("id2").alias("arg2_id"), "arg2_name", "count",
    )


def add_concept_terms(graph: Graph, rows: DataFrame) -> Graph:
    """The graph after variants and acronyms (rows of documents.read_variants)."""
    known = graph.concepts.where("id IS NOT NULL").select(F.col("id").alias("node"))
    return graph.with_(variants=keep(V.upsert_variants(graph.variants, V.counted_variants(rows), known)))


def _with_aggregates(
    graph: Graph, elements: DataFrame, labels: list[str], copy_properties: list[str], mapping_types: list[str], concepts: DataFrame | None = None,
) -> Graph:
    """elements (aggregate: any name, element: node), a kept table, as new aggregates with ids of their own, after concepts, by
    default the graph's."""
    elements = elements.select(F.col("aggregate").cast("string").alias("key"), "element")
    start, first_id = next_numbers(graph, ["node", "atid"])
    keys = numbered(elements.select("key").distinct(), ["key"], "n")
    made = A.new_aggregates(keys.select(F.col("n").alias("aggregate")), labels, copy_properties, mapping_types).select(
        (F.col("node") + start).alias("node"), F.concat(F.lit("atid"), (F.col("node") + first_id).cast("string")).alias("id"), "labels",
        "copy_properties", "mapping_type",
    )
    concepts = (graph.concepts if concepts is None else concepts).unionByName(made, allowMissingColumns=True)
    linked = elements.join(keys, "key").select((F.col("n") + start).alias("aggregate"), "element")
    return graph.with_(concepts=keep(concepts), elements=keep(graph.elements.unionByName(linked)))


def n_aggregates(graph: Graph, labels: list[str]) -> int:
    """How many aggregates have any of the labels, whenever they were built."""
    marked = F.array_contains("labels", A.AGGREGATE) & F.arrays_overlap("labels", F.array(*map(F.lit, labels)))
    return graph.concepts.where(marked).count()


def n_built(before: Graph, after: Graph) -> int:
    """How many aggregates a build has made: those with numbers that weren't given before it."""
    new = F.col("node") >= next_number(before, "node")
    return after.concepts.where(F.array_contains("labels", A.AGGREGATE) & new).count()


def build_aggregates_by_preferred_name(
    graph: Graph, labels: list[str], aggregated_labels: list[str], copy_properties: list[str], name_property: str = "preferredName",
) -> Graph:
    elements = keep(A.equal_name_elements(graph.concepts, labels, NAME[name_property]))
    return _with_aggregates(graph, elements, aggregated_labels, copy_properties, [A.EQUAL_NAMES])


def build_aggregates_by_mappings(
    graph: Graph, allowed_mapping_types: list[str], aggregated_label: str, label: str | None = None,
    copy_properties: tuple[str, ...] = ("preferredName", "synonyms", "writingVariants", "descriptions", "facets"),
) -> Graph:
    """Aggregates of mapped concepts, after those of the label before are gone; concepts without mappings get the label, but not
    other aggregates, which would be deleted with those of the label."""
    graph = delete_aggregates(graph, [aggregated_label])[0]
    elements = keep(A.mapping_elements(graph.mappings, graph.concepts, allowed_mapping_types, label))
    plain = graph.concepts.where(~F.array_contains("labels", A.AGGREGATE))
    alone = (plain.where(F.array_contains("labels", label)) if label else plain).join(
        elements.select(F.col("element").alias("node")), "node", "left_anti",
    ).select("node", F.lit(True).alias("alone"))
    marked = graph.concepts.join(alone, "node", "left").withColumn(
        "labels", F.when(F.col("alone"), F.array_union("labels", F.array(F.lit(aggregated_label)))).otherwise(F.col("labels")),
    ).drop("alone")
    return _with_aggregates(graph, elements, [aggregated_label], list(copy_properties), allowed_mapping_types, marked)


def delete_aggregates(graph: Graph, aggregated_labels: list[str]) -> tuple[Graph, DataFrame]:
    """(graph, counts): aggregates with any of the labels are gone with all that hangs on them, others only lose the label.
    counts has one row: num_nodes and num_relationships."""
    marked = F.arrays_overlap("labels", F.array(*map(F.lit, aggregated_labels)))
    gone = graph.concepts.where(marked & F.array_contains("labels", A.AGGREGATE)).select("node")
    graph, counts = without_nodes(graph, gone)
    return graph.with_(concepts=graph.concepts.withColumn("labels", F.array_except("labels", F.array(*map(F.lit, aggregated_labels))))), counts


def copy_aggregate_properties(graph: Graph, skip_existing_properties: bool = False, aggregated_labels: tuple[str, ...] = (A.AGGREGATE,)) -> Graph:
    """The graph of copied_aggregate_properties, without the counts."""
    return _copied(graph, skip_existing_properties, aggregated_labels, count=False)[0]


def copied_aggregate_properties(
    graph: Graph, skip_existing_properties: bool = False, aggregated_labels: tuple[str, ...] = (A.AGGREGATE,),
) -> tuple[Graph, dict[str, int]]:
    """(graph, counts): aggregates with any of the labels, and those below them first, take from their elements the properties
    that their copy_properties list, columns and props alike; aggregates without such a list are left as they are.

    Listed properties are cleared before, or left where set if existing ones are skipped. Of scalar values the most
    frequent wins; the others go to props as <property>_divergentProperty, a JSON array, and divergent preferred names
    to the synonyms too. counts: numAggregates, numElements and numProperties.
    """
    return _copied(graph, skip_existing_properties, aggregated_labels, count=True)


def _copied(graph: Graph, skip_existing_properties: bool, aggregated_labels: tuple[str, ...], count: bool) -> tuple[Graph, dict[str, int]]:
    """copied_aggregate_properties; counts are empty if they aren't asked for."""
    c, elements, div = graph.concepts, keep(graph.elements), "_divergentProperty"
    aggregates = c.where(F.array_contains("labels", A.AGGREGATE)).select("node", "labels", "copy_properties")
    chosen = aggregates.where(F.arrays_overlap("labels", F.array(*map(F.lit, aggregated_labels)))).select(F.lit(0).alias("origin"), "node")
    nested = elements.join(aggregates.select(F.col("node").alias("element")), "element", "left_semi")
    reached = closure(chosen, nested.select(F.col("aggregate").alias("src"), F.col("element").alias("dst"))).select("node")
    listed = keep(aggregates.join(reached, "node", "left_semi").select(
        F.col("node").alias("aggregate"), F.explode(F.array_distinct("copy_properties")).alias("property"),
    ))

    scalars = c.select("node", F.explode("props").alias("property", "value"))
    for p, column in SCALARS.items():
        scalars = scalars.unionByName(c.select("node", F.lit(p).alias("property"), F.col(column).alias("value")))
    arrays = None
    for p, column in LISTS.items():
        x = c.select("node", F.lit(p).alias("property"), F.posexplode(column).alias("ord", "value"))
        arrays = x if arrays is None else arrays.unionByName(x)
    scalars = scalars.where("value IS NOT NULL")
    has = lambda: scalars.select("node", "property").union(arrays.select("node", "property")).distinct()
    todo = keep(listed.join(has().withColumnRenamed("node", "aggregate"), ["aggregate", "property"], "left_anti")) if skip_existing_properties else listed
    cleared = todo.withColumnRenamed("aggregate", "node")
    old_synonyms = arrays.where("property = 'synonyms'")
    scalars, arrays = (keep(x.join(cleared, ["node", "property"], "left_anti")) for x in (scalars, arrays))

    level = keep(heights(elements.select(F.col("aggregate").alias("parent"), F.col("element").alias("child"))))
    n_properties, won, united, top = 0, None, None, level.agg(F.max("height")).first()[0] or 0
    for h in range(1, top + 1):
        now = keep(todo.join(level.where(F.col("height") == h).select(F.col("node").alias("aggregate")), "aggregate", "left_semi"))
        if now.isEmpty():
            continue
        own = elements.join(now.select("aggregate").distinct(), "aggregate", "left_semi")
        if count:
            n_properties += elements.join(now, "aggregate").join(has().withColumnRenamed("node", "element"), ["element", "property"], "left_semi").count()
        s = keep(A.rolled_up(own, scalars).join(now, ["aggregate", "property"], "left_semi"))
        a = A.unioned(own, arrays).join(now, ["aggregate", "property"], "left_semi")
        names = s.where("property = 'preferredName' AND size(divergent) > 0").select("aggregate", "divergent")
        kept = old_synonyms.withColumnRenamed("node", "aggregate").join(names, "aggregate", "left_semi").join(now, ["aggregate", "property"], "left_anti")
        kept = kept.groupBy("aggregate").agg(F.sort_array(F.collect_list(F.struct("ord", "value")))["value"].alias("kept"))
        synonyms = a.where("property = 'synonyms'").select("aggregate", "values").join(names, "aggregate", "full_outer").join(kept, "aggregate", "left")
        synonyms = synonyms.select(
            "aggregate", F.lit("synonyms").alias("property"),
            A.merged_synonyms(F.coalesce("values", "kept"), F.col("divergent")).alias("values"),
        )
        a = keep(a.where("property <> 'synonyms'").unionByName(synonyms))
        won, united = (s if won is None else won.unionByName(s)), (a if united is None else united.unionByName(a))
        if h == top:
            break  # nothing above takes their values
        made = a.select(F.col("aggregate").alias("node"), "property", F.posexplode("values").alias("ord", "value"))
        scalars = keep(scalars.unionByName(s.select(F.col("aggregate").alias("node"), "property", "value")))
        arrays = keep(arrays.join(made.select("node", "property").distinct(), ["node", "property"], "left_anti").unionByName(made))

    counts = {} if not count else {
        "numAggregates": reached.count(),
        "numElements": elements.join(listed.select("aggregate").distinct(), "aggregate", "left_semi").count(), "numProperties": n_properties,
    }
    if won is None:
        return graph, counts
    as_map = lambda df, key, value, out: df.groupBy(F.col("aggregate").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(out))
    shown = F.when(F.col("property").isin(list(SCALARS)), F.transform("divergent", as_value)).otherwise(F.col("divergent"))  # values of props are JSON texts
    odd = won.where("size(divergent) > 0").select("aggregate", F.concat("property", F.lit(div)).alias("property"), list_of(shown).alias("value"))
    free = won.where(~F.col("property").isin(list(SCALARS))).select("aggregate", "property", "value").unionByName(odd)
    out = c.join(todo.groupBy(F.col("aggregate").alias("node")).agg(F.collect_set("property").alias("__todo")), "node", "left")
    for df, value, name in ((won, "value", "__s"), (united, "values", "__a"), (free, "value", "__p")):
        out = out.join(as_map(df, "property", value, name), "node", "left")
    mine = lambda p: F.coalesce(F.array_contains("__todo", p), F.lit(False))
    new = {column: F.when(mine(p), F.try_element_at("__s", F.lit(p))).otherwise(F.col(column)) for p, column in SCALARS.items()}
    new |= {column: F.coalesce(F.try_element_at("__a", F.lit(p)), F.when(~mine(p), F.col(column))) for p, column in LISTS.items()}
    none = F.create_map().cast("map<string,string>")
    left = F.map_filter(F.coalesce("props", none), lambda k, _: ~F.array_contains("__todo", F.regexp_replace(k, div + "$", "")))
    new["props"] = F.when(
        F.col("__todo").isNull() | F.col("props").isNull() & F.col("__p").isNull(), F.col("props"),
    ).otherwise(F.map_concat(left, F.coalesce("__p", none)))
    return graph.with_(concepts=keep(out.select(*(new[x].alias(x) if x in new else F.col(x) for x in c.columns)))), counts


def export_concept_id_mapping(
    graph: Graph, source_id_property: str = "sourceIds", target_id_property: str = "id", labels: tuple[str, ...] = ("CONCEPT",),
) -> DataFrame:
    """(source_id, target_id); sourceIds are all of a concept's source ids."""
    ids = graph.sources.groupBy("node").agg(F.array_sort(F.collect_set("source_id")).alias("sourceIds"))
    c = graph.concepts.join(ids, "node", "left")
    column = lambda p: p if p == "sourceIds" else NAME[p]
    return E.id_mapping(c, column(source_id_property), column(target_id_property), list(labels))


def export_hypernyms(graph: Graph, facet_names: list[str] | None = None, label: str | None = None) -> DataFrame:
    """(concept_id, hypernyms) of concepts, perhaps of a label; hypernyms joined by |."""
    named = graph.concepts.where("id IS NOT NULL").withColumn("key", F.col("id"))
    at = named.select("node", "key")
    by_id = lambda df, *ends: _keyed(df, at, ends)
    facets = None
    if facet_names and facet_names != ["all"]:
        facets = [r.facet for r in graph.facets.where(F.col("name").isin(facet_names) & ~F.col("is_no_facet")).select("facet").collect()]
    found = E.hypernyms(by_id(graph.edges, "src", "dst"), by_id(graph.roots, "node"), named.drop("node").withColumnRenamed("key", "node"), facets, label)
    return found.withColumnRenamed("node", "concept_id")


def _keyed(df: DataFrame, at: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    for end in ends:
        df = df.join(at.select(F.col("node").alias(end), F.col("key").alias("__key")), end).drop(end).withColumnRenamed("__key", end)
    return df


def export_concept_facet_map(graph: Graph, label: str | None = None) -> DataFrame:
    """(concept_id, facets) of concepts, perhaps of a label."""
    concepts = graph.concepts.where(F.array_contains("labels", label)) if label else graph.concepts
    return E.concept_facet_map(concepts.where("id IS NOT NULL").drop("node").withColumnRenamed("id", "node")).withColumnRenamed("node", "concept_id")


def export_dictionary(
    graph: Graph, id_property: str | list[str] = "id", exclusion_labels: list[str] | None = None, unique_keys: bool = False,
    label: str = "CONCEPT", add_source_prefix: bool = False,
) -> DataFrame:
    """(key, ids): names, synonyms and acronyms of concepts with their ids.

    Several id properties (a list, or parted by commas) are joined by ||; a source prefix is the id's source, or id for
    the property id, and a colon. Aggregates without a property take the values of their elements; other concepts
    without it raise an error, as arrays of unequal length do.
    """
    properties = id_property.split(",") if isinstance(id_property, str) else list(id_property)
    acronyms = graph.variants.where("kind = 'acronym'").groupBy(F.col("concept").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("acronyms"))
    c = graph.concepts.where("id IS NOT NULL AND pref_name IS NOT NULL").where(F.array_contains("labels", label))
    if exclusion_labels:
        c = c.where(~F.arrays_overlap("labels", F.array(*map(F.lit, exclusion_labels))))
    c = c.join(acronyms, "id", "left")
    for k, p in enumerate(properties):
        source = F.lit("id") if p == "id" else F.col("original_source" if p == "originalId" else "source") if p in ("originalId", "sourceIds") else None
        if source is None and add_source_prefix:
            raise ValueError(f"the source property of {p} is unknown")
        source = source if add_source_prefix else F.lit(None).cast("string")
        pair = lambda x, s=source: F.struct(F.col(x).alias("id"), s.alias("source")) if isinstance(x, str) else F.struct(x.alias("id"), s.alias("source"))
        if p == "sourceIds":
            values = graph.sources.where("source_id IS NOT NULL").select("node", pair("source_id").alias("value")).distinct()
        elif p not in NAME:
            values = graph.concepts.select("node", pair(as_text(F.try_element_at("props", F.lit(p)))).alias("value"))
        elif dict(graph.concepts.dtypes)[NAME[p]].startswith("array"):
            values = graph.concepts.select("node", F.posexplode(NAME[p])).select(
                "node", F.struct("pos", F.col("col").alias("id"), source.alias("source")).alias("value"),
            )
        else:
            values = graph.concepts.select("node", pair(NAME[p]).alias("value"))
        values = values.where("value.id IS NOT NULL")
        own = values.groupBy("node").agg(F.array_sort(F.collect_list("value")).alias("__own"))
        lacking = c.where(F.array_contains("labels", A.AGGREGATE)).join(own, "node", "left_anti").select(F.col("node").alias("aggregate"))
        of_elements = A.element_values(
            graph.elements.join(lacking, "aggregate", "left_semi"),
            values.select("node", F.lit(p).alias("property"), F.struct("node", "value").alias("value")),
        )  # in the order of elements
        c = c.join(own, "node", "left").join(of_elements.select(F.col("aggregate").alias("node"), F.col("values")["value"].alias("__elements")), "node", "left")
        kind = own.schema["__own"].dataType
        error = lambda what, of=p, kind=kind: F.raise_error(F.concat(F.lit(f"no {what} of {of} at "), F.col("id"))).cast(kind)
        c = c.withColumn("__found", F.coalesce("__own", "__elements", error("value")))
        if add_source_prefix:
            c = c.withColumn("__found", F.when(F.exists("__found", lambda x: x["source"].isNull()), error("source")).otherwise(F.col("__found")))
        c = c.withColumns({f"__id{k}": F.col("__found")["id"], f"__source{k}": F.col("__found")["source"]}).drop("__own", "__elements", "__found")
    names = [f"__id{k}" for k in range(len(properties))]
    source_of = {x: f"__source{k}" for k, x in enumerate(names)} if add_source_prefix else None
    lines = E.dictionary_lines(c.drop("node").withColumn("node", F.col("id")), names, source_of, exclusion_labels, label)
    return E.unique_keys(lines) if unique_keys else lines.select("key", "ids")
