"""Queries of the services and accessors over one graph of places, and the SQL that checks each.

Regions, nations, customers and suppliers are concepts with ids, original ids, source ids, synonyms and free properties;
customers of a nation and segment are mapped in a chain, orders give relations and acronyms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import aggregates as A
from ..operators import query as Q
from ..operators import relations as R
from ..operators import resolve as C
from ..operators import service as S
from ..operators import traversal as T
from ..operators import variants as V
from ..operators.graph import Graph
from .contract import query
from .derived import DerivedGraph

#: Table, key, name, parent's key, label, first node number and the parent's first.
KINDS = (
    ("region", "r_regionkey", "r_name", None, "region", 0, None), ("nation", "n_nationkey", "n_name", "n_regionkey", "nation", 1000, 0),
    ("customer", "c_custkey", "c_name", "c_nationkey", "customer", 10**6, 1000),
    ("supplier", "s_suppkey", "s_name", "s_nationkey", "supplier", 10**12, 1000),
)
#: The same in SQL: nodes, the edges between them, and each customer's part of its chain.
PLACES = """
nodes AS (
  SELECT r_regionkey::BIGINT AS node, r_name AS name, 'region' AS kind, 'R' || r_regionkey AS own FROM region
  UNION ALL SELECT 1000 + n_nationkey, n_name, 'nation', 'N' || n_nationkey FROM nation
  UNION ALL SELECT 1000000 + c_custkey, c_name, 'customer', 'C' || c_custkey FROM customer
  UNION ALL SELECT 1000000000000 + s_suppkey, s_name, 'supplier', 'S' || s_suppkey FROM supplier),
steps AS (
  SELECT n_regionkey::BIGINT AS src, 1000 + n_nationkey::BIGINT AS dst FROM nation
  UNION ALL SELECT 1000 + c_nationkey, 1000000 + c_custkey FROM customer
  UNION ALL SELECT 1000 + s_nationkey, 1000000000000 + s_suppkey FROM supplier),
parted AS (
  SELECT c_custkey, c_name, c_nationkey, c_mktsegment,
         sum(CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS part
  FROM customer),
grouped AS (
  SELECT *, count(*) OVER w AS n, min(c_custkey) OVER w AS first FROM parted WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment, part))"""


def places(g: DerivedGraph) -> Graph:
    """The graph; each table is read when it is used."""
    empty = Graph.empty(g.spark)
    rows = {name: [] for name in ("concepts", "sources", "edges")}
    for table, key, name, parent, label, first, parents_first in KINDS:
        t = g.table(table)
        node, own = F.col(key).cast("long") + F.lit(first), F.concat(F.lit(label[0].upper()), F.col(key).cast("string"))
        is_customer = label == "customer"
        free = F.create_map(
            F.lit("rank"), F.col("c_nationkey").cast("string"), F.lit("segment"), X.as_value("c_mktsegment"), F.lit("tags"), F.lit('["[x]","y"]'),
        ) if is_customer else F.lit(None).cast("map<string,string>")
        rows["concepts"].append(t.select(
            node.alias("node"), F.concat(F.lit("tid"), node.cast("string")).alias("id"), F.array(F.lit("CONCEPT"), F.lit(label)).alias("labels"),
            F.col(name).alias("pref_name"), own.alias("original_id"), F.lit(label.upper()).alias("original_source"),
            (F.array("c_mktsegment") if is_customer else F.lit(None).cast("array<string>")).alias("synonyms"),
            F.array(F.lit("fid0")).alias("facets"), free.alias("props"),
        ))
        ids = [F.struct(own.alias("source_id"), F.lit(label.upper()).alias("source"), (F.col(key) % 2 == 0).alias("is_unique"), F.lit(0).alias("ord"))]
        if is_customer:
            ids += [
                F.struct(F.col("c_mktsegment").alias("source_id"), F.lit(source).alias("source"), unique.alias("is_unique"), F.lit(1).alias("ord"))
                for source, unique in (("SEGMENTS", F.lit(False)), ("ALIASES", F.col(key) % 3 == 0))
            ]
        rows["sources"].append(t.select(node.alias("node"), F.explode(F.array(*ids)).alias("s")).select("node", "s.*"))
        if parent:
            facet = F.explode(F.array(F.lit(None).cast("string"), F.lit("fid0"))).alias("facet")
            own_edges = t.select((F.col(parent).cast("long") + F.lit(parents_first)).alias("src"), node.alias("dst"), facet)
            rows["edges"].append(own_edges.withColumns({"type": F.concat_ws("_", F.lit("IS_BROADER_THAN"), "facet"), "nth": F.lit(0)}))
    roots = g.table("region").select(F.lit("fid0").alias("facet"), F.col("r_regionkey").cast("long").alias("node"), F.lit(False).alias("is_no_facet"))
    chain = W.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    links = g.table("customer").select("c_custkey", F.lag("c_custkey").over(chain).alias("prev")).where("prev IS NOT NULL")
    kind = F.array(F.when(F.col("c_custkey") % 5 == 0, "LOOM").otherwise("EQUAL"))
    mappings = links.select((F.col("prev") + 10**6).alias("u"), (F.col("c_custkey") + 10**6).alias("v"), kind.alias("mapping_types"))
    day = W.partitionBy("o_orderdate").orderBy("o_orderkey")
    near = g.table("orders").select("o_orderkey", (F.col("o_custkey") + 10**6).alias("a"), (F.lag("o_custkey").over(day) + 10**6).alias("b"))
    relations = near.where("a <> b").select(
        F.lit("same_day").alias("type"), F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.col("o_orderkey").cast("string").alias("doc"),
        F.lit(1).cast("long").alias("count"),
    )
    acronyms = g.table("orders").select(
        F.lit("acronym").alias("kind"), F.concat(F.lit("tid"), (F.col("o_custkey") + 10**6).cast("string")).alias("concept"),
        F.lower("o_orderpriority").alias("norm"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("string").alias("doc"),
        F.lit(1).cast("long").alias("count"),
    )
    tables = {"roots": [roots], "mappings": [mappings], "relation_docs": [relations], "variants": [acronyms], **rows}
    whole = {}
    for name, parts in tables.items():
        whole[name] = getattr(empty, name)
        for part in parts:
            whole[name] = whole[name].unionByName(part, allowMissingColumns=True)
    return empty.with_(**whole)


def goods(g: DerivedGraph) -> Graph:
    """A facet for each type of parts, in groups by the type's first letter, with the brands of its smallest parts as labels."""
    small = F.array_sort(F.collect_set(F.when(F.col("p_size") <= 2, F.col("p_brand"))))
    types = g.table("part").groupBy("p_type").agg(small.alias("labels"))
    facets = types.select(
        F.concat(F.lit("f:"), "p_type").alias("facet"), F.col("p_type").alias("name"), "labels", F.lit("hierarchical").alias("source_type"),
        F.concat(F.lit("g:"), F.substring("p_type", 1, 1)).alias("grp"), F.lit(False).alias("is_no_facet"),
    )
    groups = types.select(F.concat(F.lit("g:"), F.substring("p_type", 1, 1)).alias("grp"), F.substring("p_type", 1, 1).alias("name")).distinct()
    empty = Graph.empty(g.spark)
    return empty.with_(
        facets=empty.facets.unionByName(facets, allowMissingColumns=True), groups=empty.groups.unionByName(groups, allowMissingColumns=True),
    )


@query(
    "service_children",
    """SELECT 'tid' || src AS parent_id, 'tid' || dst AS child_id, 'IS_BROADER_THAN|IS_BROADER_THAN_fid0' AS types
FROM steps WHERE src BETWEEN 1000 AND 1999 AND dst < 1000000000000""",
    ctes=PLACES,
)
def service_children(g):
    """The customers of all nations; an unknown id has no row."""
    found = S.get_children_of_concepts(places(g), [f"tid{1000 + k}" for k in range(1000)], "customer")
    return found.withColumn("types", X.listed("types"))


@query(
    "service_paths",
    """SELECT 'tid' || n.node AS concept_id, r.name || '>' || n.name AS path
FROM steps JOIN nodes AS n ON n.node = dst JOIN nodes AS r ON r.node = src WHERE n.kind = 'nation'""",
    ctes=PLACES,
)
def service_paths(g):
    """Paths to the nations, which are asked for by source id and shown by name."""
    keys = [f"N{r.n_nationkey}" for r in g.table("nation").select("n_nationkey").toLocalIterator()]
    found = S.get_paths_to_facetroots(places(g), keys, "preferredName", id_property="sourceIds")
    return found.withColumn("path", F.array_join("path", ">"))


@query("service_children_info", "SELECT DISTINCT 'tid' || src AS concept_id, 'fid0' AS facets FROM steps", ctes=PLACES)
def service_children_info(g):
    return S.update_children_information(places(g)).withColumn("facets", X.listed("facets"))


@query("service_facet_roots", "SELECT 'fid0' AS facet, 'tid' || node AS concept_id FROM nodes WHERE kind = 'region'", ctes=PLACES)
def service_facet_roots(g):
    return S.get_facet_roots(places(g), ["fid0", "fid9"])


@query(
    "service_facet_size",
    "SELECT 'fid0' AS facet, count(*)::BIGINT AS n FROM (SELECT node FROM nodes WHERE kind = 'region' UNION SELECT dst FROM steps)", ctes=PLACES,
)
def service_facet_size(g):
    return S.get_facet_size(places(g))


@query(
    "service_id_mapping",
    "SELECT own AS source_id, 'tid' || node AS target_id FROM nodes UNION ALL SELECT c_mktsegment, 'tid' || (1000000 + c_custkey) FROM customer",
    ctes=PLACES,
)
def service_id_mapping(g):
    return S.export_concept_id_mapping(places(g))


@query(
    "service_hypernyms",
    """SELECT 'tid' || node AS concept_id, string_agg('tid' || above, '|' ORDER BY 'tid' || above) AS hypernyms
FROM (SELECT a.dst AS node, a.src AS above FROM steps AS a UNION SELECT a.dst, b.src FROM steps AS a JOIN steps AS b ON b.dst = a.src) GROUP BY node""",
    ctes=PLACES,
)
def service_hypernyms(g):
    return S.export_hypernyms(places(g))


@query("service_facet_map", "SELECT 'tid' || node AS concept_id, 'fid0' AS facets FROM nodes WHERE kind = 'supplier'", ctes=PLACES)
def service_facet_map(g):
    return S.export_concept_facet_map(places(g), "supplier")


@query(
    "service_dictionary",
    """SELECT key, 'customer:C' || (node - 1000000) AS ids
FROM (SELECT name AS key, node FROM nodes WHERE kind = 'customer' UNION SELECT c_mktsegment, 1000000 + c_custkey FROM customer
      UNION SELECT o_orderpriority, 1000000 + o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) WHERE len(key) > 2""",
    ctes=PLACES,
)
def service_dictionary(g):
    """Names, synonyms and acronyms of customers with their original ids, each after its source."""
    found = S.export_dictionary(places(g), "originalId", label="customer", add_source_prefix=True)
    return found.withColumn("ids", F.regexp_replace("ids", "^CUSTOMER:", "customer:"))


@query(
    "service_relations",
    """SELECT 'C' || a AS arg1_id, x.c_name AS arg1_name, 'C' || b AS arg2_id, y.c_name AS arg2_name, count(*)::BIGINT AS count
FROM (SELECT a, b FROM day UNION ALL SELECT b, a FROM day) JOIN customer AS x ON x.c_custkey = a JOIN customer AS y ON y.c_custkey = b
WHERE a < 200 AND a <> b GROUP BY ALL""",
    ctes="day AS (SELECT o_custkey AS a, lag(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS b FROM orders)",
)
def service_relations(g):
    """A request for two hundred customers by original id, relations among themselves included."""
    asked = {"id_property": "originalId", "ids": [f"C{k}" for k in range(200)]}
    request = {"a_list": asked, "relationTypes": ["same_day"], "enable_inter_input_relation_retrieval": True}
    return S.retrieve_ie_relations(places(g), request)


@query(
    "service_mapping_build",
    "SELECT 1000000 + c_custkey AS node, CASE WHEN n > 1 THEN (1000000 + first)::VARCHAR END AS first FROM grouped",
    ctes=PLACES,
)
def service_mapping_build(g):
    """Each customer with the first of its aggregate; those without mappings have none but bear the aggregates' label."""
    built = S.build_aggregates_by_mappings(places(g), ["EQUAL"], "MAPPED", "customer")
    first = built.elements.groupBy("aggregate").agg(F.min("element").alias("first"))
    of = built.elements.join(first.hint("merge"), "aggregate").select(F.col("element").alias("node"), F.col("first").cast("string").alias("first"))
    plain = built.concepts.where(F.array_contains("labels", "MAPPED") & ~F.array_contains("labels", A.AGGREGATE))
    return of.unionByName(plain.select("node", F.lit(None).cast("string").alias("first")))


@query(
    "service_copy_properties",
    """SELECT min(c_name) AS pref_name, string_agg(DISTINCT c_mktsegment, '|') AS segment, count(*)::BIGINT AS n_names,
       to_json(list(c_name ORDER BY c_name)[2:])::VARCHAR AS divergent
FROM grouped WHERE n > 1 GROUP BY first""",
    ctes=PLACES,
)
def service_copy_properties(g):
    """Aggregates with their elements' commonest name, their synonyms with all other names, and what diverges."""
    built = S.build_aggregates_by_mappings(places(g), ["EQUAL"], "MAPPED", "customer", ("preferredName", "synonyms"))
    filled = S.copy_aggregate_properties(built, aggregated_labels=("MAPPED",)).concepts.where(F.array_contains("labels", A.AGGREGATE))
    others = F.array_except("synonyms", F.from_json(F.col("props")["preferredName_divergentProperty"], "array<string>"))
    return filled.select(
        "pref_name", X.listed(others).alias("segment"), F.size("synonyms").cast("long").alias("n_names"),
        F.col("props")["preferredName_divergentProperty"].alias("divergent"),
    )


@query(
    "service_all_facets",
    """SELECT 'f:' || p_type AS facet, p_type AS name, 'g:' || p_type[1] AS grp
FROM part WHERE p_size <= 2 AND p_brand = (SELECT min(p_brand) FROM part WHERE p_size <= 2) GROUP BY p_type""",
)
def service_all_facets(g):
    """Facets whose labels hold a value."""
    brand = g.table("part").where("p_size <= 2").agg(F.min("p_brand").alias("b")).first()["b"]
    return S.get_all_facets(goods(g), "labels", brand or "").select("facet", "name", "grp")


@query(
    "facet_group_by_name",
    "SELECT 'g:' || p_type[1] AS node, 'root>g:' || p_type[1] AS path FROM part WHERE p_type[1] = (SELECT min(p_type)[1] FROM part) GROUP BY ALL UNION ALL SELECT 'root', 'root'",
)
def facet_group_by_name(g):
    """From the groups' root to the group of a name; walks end there, and facets are never read."""
    graph = goods(g)
    name = graph.groups.agg(F.min("name").alias("n")).first()["n"] or ""
    root = g.spark.createDataFrame([("root", "root")], "node string, name string")
    nodes = root.unionByName(graph.groups.select(F.col("grp").alias("node"), "name")).unionByName(graph.facets.select(F.col("facet").alias("node"), "name"))
    edges = graph.groups.select(F.lit("root").alias("src"), F.col("grp").alias("dst")).unionByName(
        graph.facets.select(F.col("grp").alias("src"), F.col("facet").alias("dst")),
    )
    found = T.traverse(root.select("node"), edges, T.by_group(nodes, name, "root"))
    return found.select("node", F.array_join("path", ">").alias("path"))


@query(
    "service_morphology",
    "SELECT 'tid' || (1000000 + o_custkey) AS concept_id, o_orderpriority AS name, o_orderkey::VARCHAR AS doc, 1::BIGINT AS count FROM orders SEMI JOIN customer ON c_custkey = o_custkey",
)
def service_morphology(g):
    """Acronyms of all concepts that bear a label."""
    return S.get_morphology(places(g), None, "acronym", "customer")


@query(
    "variant_upsert",
    """SELECT s.* FROM s ANTI JOIN i USING (concept, norm, doc)
UNION ALL SELECT concept, norm, coalesce((SELECT min(name) FROM s WHERE s.norm = i.norm), name), doc, count FROM i""",
    ctes="""
s AS (SELECT 'C' || o_custkey AS concept, lower(o_orderpriority) AS norm, min(o_orderpriority) AS name, (o_orderkey % 7)::VARCHAR AS doc, count(*)::BIGINT AS count
  FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
i AS (SELECT 'C' || o_custkey AS concept, lower(o_orderpriority) AS norm, lower(o_orderpriority) AS name, (o_orderkey % 7)::VARCHAR AS doc, count(*)::BIGINT AS count
  FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 0 GROUP BY ALL)""",
)
def variant_upsert(g):
    """Counts of one status replace those of another in the same document and keep their surface form; half of the concepts are
    unknown."""
    def counted(status: str, name) -> DataFrame:
        rows = g.table("orders").where(F.col("o_orderstatus") == status)
        return V.counted_variants(rows.select(
            F.lit("v").alias("kind"), F.concat(F.lit("C"), "o_custkey").alias("concept"), (F.col("o_orderkey") % 7).cast("string").alias("doc"),
            name.alias("name"), F.lit(1).alias("count"), F.lit(0).alias("ord"),
        ))

    known = g.table("orders").where("o_custkey % 2 = 0").select(F.concat(F.lit("C"), "o_custkey").alias("node"))
    merged = V.upsert_variants(counted("F", F.col("o_orderpriority")), counted("O", F.lower("o_orderpriority")), known)
    return merged.select("concept", "norm", "name", "doc", "count")


@query(
    "source_accessors",
    """SELECT 1000000 + c_custkey AS node, c_mktsegment AS source_id, 'ALIASES' AS source, 1 AS position, 'ALIASES|SEGMENTS' AS sources,
       CASE WHEN c_custkey % 3 = 0 THEN 'ALIASES' ELSE '' END AS unique_sources, c_custkey % 3 = 0 AS is_unique FROM customer
UNION ALL SELECT 1000000 + c_custkey, 'C' || c_custkey, 'OTHER', 0, 'CUSTOMER', CASE WHEN c_custkey % 2 = 0 THEN 'CUSTOMER' ELSE '' END, FALSE FROM customer
UNION ALL SELECT 1000000 + c_custkey, 'none', 'CUSTOMER', -1, '', '', FALSE FROM customer""",
)
def source_accessors(g):
    """What is known of a segment's id, of the own id from another source, and of an id that nobody has."""
    pair = lambda i, s: F.struct(i.alias("source_id"), F.lit(s).alias("source"))
    own = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    three = F.explode(F.array(pair(F.col("c_mktsegment"), "ALIASES"), pair(own, "OTHER"), pair(F.lit("none"), "CUSTOMER"))).alias("a")
    asked = g.table("customer").select((F.col("c_custkey") + 10**6).alias("node"), three).select("node", "a.*")
    found = C.source_access(places(g).sources, asked)
    return found.withColumns({"sources": X.listed("sources"), "unique_sources": X.listed("unique_sources")})


@query(
    "source_id_lists",
    "SELECT 1000000 + c_custkey AS node, 'C' || c_custkey || '|' || c_mktsegment AS source_ids, 'CUSTOMER|ALIASES|SEGMENTS' AS sources, 2 AS n FROM customer",
)
def source_id_lists(g):
    found = C.source_lists(places(g).sources).where(F.col("node").between(10**6, 10**12 - 1))
    return found.select("node", F.array_join("source_ids", "|").alias("source_ids"), F.array_join("sources", "|").alias("sources"), "n")


@query(
    "lookup_source_ids",
    """SELECT own AS source_id, node::VARCHAR AS node
FROM nodes WHERE kind = 'customer' AND node - 1000000 IN (SELECT o_custkey FROM orders)""",
    ctes=PLACES,
)
def lookup_source_ids(g):
    """Customers of orders by their source id alone."""
    ids = g.table("orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source_id"))
    return C.nodes_by_source_id(ids, places(g).sources)


@query(
    "lookup_unique_sources",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 OR o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN (1000000 + o_custkey)::VARCHAR END AS node
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""",
)
def lookup_unique_sources(g):
    """Customers of orders by source id: from the same source, or from another if both call the id unique."""
    graph, none = places(g), F.lit(None).cast("string")
    requests = g.table("orders").join(g.table("customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(
        "o_orderkey", none.alias("original_id"), none.alias("original_source"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "CUSTOMER").otherwise("OTHER").alias("source"), (F.col("o_orderkey") % 3 == 0).alias("unique_source_id"),
    )
    coords = graph.concepts.select("node", "original_id", "original_source")
    return C.lookup_coordinates(requests, coords, graph.sources).select("o_orderkey", "node")


@query(
    "node_maps",
    """SELECT 1000000 + c_custkey AS node, '{"id":"tid' || (1000000 + c_custkey) || '","preferredName":"' || c_name || '","originalId":"C' || c_custkey
  || '","originalSource":"CUSTOMER","synonyms":["' || c_mktsegment || '"],"facets":["fid0"],"labels":["CONCEPT","customer"],"sourceIds":["C' || c_custkey
  || '","' || c_mktsegment || '","' || c_mktsegment || '"],"sources":["CUSTOMER","ALIASES","SEGMENTS"],"uniqueSourceIds":[' || (c_custkey % 2 = 0) || ',' || (c_custkey % 3 = 0)
  || ',false],"rank":' || c_nationkey || ',"segment":"' || c_mktsegment || '","tags":["[x]","y"]}' AS json FROM customer""",
)
def node_maps(g):
    """All properties of customers as nested JSON: numbers, texts and lists keep their kind."""
    graph = places(g)
    return S.node_maps(graph.with_(concepts=Q.scan(graph.concepts, "customer")))


@query(
    "matching_aggregates",
    "SELECT o_custkey AS node FROM orders GROUP BY o_custkey HAVING list_sort(list(DISTINCT o_orderstatus)) = ['F', 'O']",
)
def matching_aggregates(g):
    """Of aggregates made of orders those with exactly two mapping types, in any order."""
    kinds = g.table("orders").groupBy(F.col("o_custkey").alias("node")).agg(F.collect_set("o_orderstatus").alias("mapping_type"))
    made = kinds.withColumn("labels", F.array(F.lit(A.AGGREGATE), F.lit("ORDERED")))
    return A.matching_aggregates(made, ["O", "F", "O"], "ORDERED").select("node")


@query(
    "unique_lookup",
    "SELECT node, name AS pref_name FROM nodes WHERE name IN (SELECT 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') FROM orders)", ctes=PLACES,
)
def unique_lookup(g):
    """Concepts by name, which must be unique."""
    keys = g.table("orders").select(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"))
    return Q.lookup(places(g).concepts, "pref_name", keys, "name").select("node", "pref_name")


@query(
    "relation_arguments",
    """SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderkey % 2 = 0 THEN node ELSE '-' END, node, node, '-', '-', node) AS args
FROM (SELECT o_orderkey, coalesce((1000000 + c_custkey)::VARCHAR, '-') AS node FROM orders LEFT JOIN customer ON c_custkey = o_custkey)""",
)
def relation_arguments(g):
    """Arguments of relations as nodes: by the document's property and source (every other document has no source), by a source
    of their own, by id, by source id from a source that doesn't know it, by an id nobody has, and by source id."""
    own = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    node_id = F.concat(F.lit("id:tid"), (F.col("o_custkey") + 10**6).cast("string"))
    by_source = F.concat(F.lit("sourceIds:"), own)
    asked = [[own], [own, F.lit("CUSTOMER")], [node_id], [by_source, F.lit("OTHER")], [F.lit("X"), F.lit("CUSTOMER")], [by_source, F.lit("CUSTOMER")]]
    rows = g.table("orders").select(
        "o_orderkey", F.lit("originalId").alias("id_property"), F.when(F.col("o_orderkey") % 2 == 0, "CUSTOMER").alias("id_source"),
        F.array(*(F.array(*a) for a in asked)).alias("args"),
    )
    graph = places(g)
    found = R.resolved_arguments(rows, graph.concepts, graph.sources)
    shown = F.transform("args", lambda a: F.coalesce(a.cast("string"), F.lit("-")))
    return found.select("o_orderkey", F.array_join(shown, "|").alias("args"))
