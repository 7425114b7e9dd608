"""Queries over the derived graph, one for each operator, and the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import aggregates as A
from ..operators import exports as E
from ..operators import mappings as M
from ..operators import paths as P
from ..operators import query as Q
from ..operators import relations as R
from ..operators import resolve as C
from ..operators import variants as V
from .derived import DerivedGraph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The derived graph in SQL.
GRAPH = r"""
concepts AS (
  SELECT DISTINCT 'R' || r_regionkey AS node, r_name AS pref_name, 'region' AS label, 'fid0' AS facet FROM region
  UNION ALL SELECT DISTINCT 'N' || n_nationkey, n_name, 'nation', 'fid0' FROM nation
  UNION ALL SELECT DISTINCT 'C' || c_custkey, c_name, 'customer', 'fid0' FROM customer
  UNION ALL SELECT DISTINCT 'S' || s_suppkey, s_name, 'supplier', 'fid0' FROM supplier
  UNION ALL SELECT DISTINCT 'P' || p_partkey, p_name, 'part', 'fid1' FROM part
  UNION ALL SELECT DISTINCT 'T' || p_type, p_type, 'p_type', 'fid1' FROM part
  UNION ALL SELECT DISTINCT 'B' || p_brand, p_brand, 'p_brand', 'fid1' FROM part),
broader AS (
  SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, 'fid0' AS facet FROM nation
  UNION SELECT 'N' || c_nationkey, 'C' || c_custkey, 'fid0' FROM customer
  UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'fid0' FROM supplier
  UNION SELECT 'T' || p_type, 'P' || p_partkey, 'fid1' FROM part
  UNION SELECT 'B' || p_brand, 'P' || p_partkey, 'fid1' FROM part),
roots AS (
  SELECT 'fid0' AS facet, 'R' || r_regionkey AS node FROM region
  UNION SELECT 'fid1', 'T' || p_type FROM part UNION SELECT 'fid1', 'B' || p_brand FROM part),
elements AS (
  SELECT 'AT:' || p_type AS aggregate, 'AG:' || p_type || ':' || p_brand AS element FROM part
  UNION SELECT 'AG:' || p_type || ':' || p_brand, 'P' || p_partkey FROM part),
tops AS (SELECT 'P' || p_partkey AS node, 'AT:' || p_type AS top, p_type AS name FROM part),
chain AS (
  SELECT p_partkey, lag(p_partkey) OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS prev FROM part),
mappings AS (
  SELECT least('P' || prev, 'P' || p_partkey) AS u, greatest('P' || prev, 'P' || p_partkey) AS v, CASE WHEN p_partkey % 2 = 1 THEN 'LOOM' ELSE 'EQUAL' END AS kind
  FROM chain WHERE prev IS NOT NULL),
args AS (SELECT DISTINCT l_orderkey::VARCHAR AS doc, l_returnflag AS type, 'P' || l_partkey AS arg FROM lineitem),
pairs AS (SELECT a.doc, a.type, a.arg AS u, b.arg AS v, 1 AS count FROM args a JOIN args b ON a.doc = b.doc AND a.type = b.type AND a.arg < b.arg)
"""


def query(name: str, sql: str | None = None, ctes: str = "", recursive: bool = False):
    """Registers a function of the graph, and its SQL on top of GRAPH."""

    def register(f: Callable[[DerivedGraph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(DerivedGraph(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{GRAPH}{',' + ctes if ctes else ''}\n{sql}"
        return f

    return register


def nodes_of(df: DataFrame, column: str = "node") -> DataFrame:
    return df.select(F.col(column).alias("node")).distinct()


@query("label_scan", "SELECT node, pref_name FROM concepts WHERE label = 'supplier'")
def label_scan(g):
    return Q.scan(g.concepts, "supplier").select("node", "pref_name")


@query("children", "SELECT src AS parent, dst AS child, 'IS_BROADER_THAN|IS_BROADER_THAN_' || facet AS types FROM broader WHERE src[1] IN ('R', 'T')")
def children(g):
    ids = nodes_of(g.roots.where("node LIKE 'R%' OR node LIKE 'T%'"))
    return Q.children(g.edges, g.concepts, ids).select("parent", "child", X.listed("types").alias("types"))


@query("parents", "SELECT DISTINCT dst AS node, src AS parent FROM broader WHERE dst[1] = 'P'")
def parents(g):
    return Q.parents(g.edges, nodes_of(Q.scan(g.concepts, "part")))


@query("children_in_facets", "SELECT src AS node, string_agg(DISTINCT facet, '|' ORDER BY facet) AS facets FROM broader GROUP BY src")
def children_in_facets(g):
    return Q.children_in_facets(g.edges).select("node", X.listed("facets").alias("facets"))


@query("facet_roots", "SELECT facet, node FROM roots WHERE facet IN (SELECT facet FROM roots GROUP BY facet HAVING count(*) <= 10)")
def facet_roots(g):
    return Q.facet_roots(g.roots, ["fid0", "fid1"], max_roots=10)


@query("facet_roots_filtered", "SELECT facet, node FROM roots WHERE facet = 'fid0' OR node[1] = 'B'")
def facet_roots_filtered(g):
    wanted = g.roots.where("facet = 'fid1' AND node LIKE 'B%'")
    return Q.facet_roots(g.roots, ["fid0", "fid1"], wanted)


@query("facets_by_group", "SELECT 'g0' AS grp, 'fid0|fid1' AS facets UNION ALL SELECT 'g1', 'fid3'")
def facets_by_group(g):
    return Q.facets_by_group(g.facets, g.roots, g.concepts).select("grp", X.listed("facets").alias("facets"))


@query(
    "paths_to_roots", "SELECT walk.node, path FROM walk JOIN roots ON walk.at = roots.node",
    "walk AS (SELECT node, node AS at, node AS path FROM concepts UNION ALL SELECT w.node, b.src, b.src || '>' || w.path FROM walk w JOIN broader b ON b.dst = w.at)", True,
)
def paths_to_roots(g):
    found = P.paths_from_roots(nodes_of(g.concepts), g.edges, g.roots)
    return found.select("node", F.array_join("path", ">").alias("path"))


@query(
    "paths_in_facet", "SELECT walk.node, names AS path FROM walk JOIN roots ON walk.at = roots.node",
    "walk AS (SELECT node, node AS at, pref_name AS names FROM concepts WHERE facet = 'fid1' UNION ALL SELECT w.node, b.src, c.pref_name || '>' || w.names FROM walk w JOIN broader b ON b.dst = w.at JOIN concepts c ON c.node = b.src)", True,
)
def paths_in_facet(g):
    found = P.paths_from_roots(nodes_of(g.concepts), g.edges, g.roots, g.concepts, "fid1", "pref_name")
    return found.select("node", F.array_join("path", ">").alias("path"))


@query("facet_size", "SELECT facet, count(*)::BIGINT AS n FROM (SELECT facet, node FROM roots UNION SELECT facet, dst FROM broader) GROUP BY facet")
def facet_size(g):
    return P.facet_sizes(g.roots, g.edges)


@query("leaf_elements", "SELECT top AS node, node AS leaf FROM tops")
def leaf_elements(g):
    tops = nodes_of(g.elements.where("aggregate LIKE 'AT:%'"), "aggregate")
    return P.leaf_elements(g.elements, tops)


@query("highest_aggregate", "SELECT node, top FROM tops UNION SELECT element, aggregate FROM elements WHERE aggregate LIKE 'AT:%'")
def highest_aggregate(g):
    return P.top_aggregates(g.elements)


@query(
    "hypernyms", "SELECT node, string_agg(anc, '|' ORDER BY anc) AS hypernyms FROM (SELECT DISTINCT node, anc FROM up) GROUP BY node",
    "up AS (SELECT dst AS node, src AS anc FROM broader UNION SELECT u.node, b.src FROM up u JOIN broader b ON b.dst = u.anc)", True,
)
def hypernyms(g):
    return E.hypernyms(g.edges, g.roots, g.concepts, ["fid0", "fid1"])


COMPONENTS = "link AS (SELECT u AS a, v AS b FROM mappings WHERE kind = 'EQUAL' UNION SELECT v, u FROM mappings WHERE kind = 'EQUAL'), reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a), comp AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a)"


@query("mapping_components", "SELECT node, component FROM comp", COMPONENTS, True)
def mapping_components(g):
    return A.mapping_components(g.mappings, ["EQUAL"])


@query(
    "mapping_aggregates",
    "SELECT component AS aggregate, count(*)::BIGINT AS n, string_agg(node, '|' ORDER BY node) AS elements FROM comp GROUP BY component HAVING count(*) > 1",
    COMPONENTS, True,
)
def mapping_aggregates(g):
    e = A.mapping_elements(g.mappings, g.concepts, ["EQUAL"], "part")
    return e.groupBy("aggregate").agg(F.count("*").alias("n"), X.listed(F.collect_list("element")).alias("elements"))


@query(
    "equal_name_aggregates",
    "SELECT p_name AS aggregate, 'P' || p_partkey AS element FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)",
)
def equal_name_aggregates(g):
    return A.equal_name_elements(g.concepts, ["part"])


@query(
    "aggregate_rollup_majority",
    "SELECT p_name AS aggregate, arg_min(p_brand, (-n, p_brand)) AS value, string_agg(p_brand, '|' ORDER BY p_brand) FILTER (WHERE p_brand <> best) AS divergent FROM (SELECT *, first_value(p_brand) OVER (PARTITION BY p_name ORDER BY n DESC, p_brand) AS best FROM (SELECT p_name, p_brand, count(*) AS n FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1) GROUP BY ALL)) GROUP BY p_name",
)
def aggregate_rollup_majority(g):
    values = g.table("part").select(F.concat(F.lit("P"), "p_partkey").alias("node"), F.lit("brand").alias("property"), F.col("p_brand").alias("value"))
    up = A.rolled_up(A.equal_name_elements(g.concepts, ["part"]), values)
    return up.select("aggregate", "value", F.when(F.size("divergent") > 0, X.listed("divergent")).alias("divergent"))


@query(
    "aggregate_rollup_arrays",
    "SELECT aggregate, string_agg(p_type, '|' ORDER BY first) AS types FROM (SELECT p_name AS aggregate, p_type, min('P' || p_partkey) AS first FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1) GROUP BY ALL) GROUP BY aggregate",
)
def aggregate_rollup_arrays(g):
    values = g.table("part").select(
        F.concat(F.lit("P"), "p_partkey").alias("node"), F.lit("types").alias("property"), F.lit(0).alias("ord"),
        F.col("p_type").alias("value"),
    )
    return A.unioned(A.equal_name_elements(g.concepts, ["part"]), values).select("aggregate", F.array_join("values", "|").alias("types"))


@query(
    "aggregate_rollup_nested",
    "SELECT 'AG:' || p_type || ':' || p_brand AS aggregate, best AS value FROM grp UNION ALL SELECT 'AT:' || p_type, arg_min(best, (-n, best)) FROM (SELECT p_type, best, count(*) AS n FROM grp GROUP BY ALL) GROUP BY p_type",
    "grp AS (SELECT p_type, p_brand, arg_min(p_name, (-n, p_name)) AS best FROM (SELECT p_type, p_brand, p_name, count(*) AS n FROM part GROUP BY ALL) GROUP BY ALL)",
)
def aggregate_rollup_nested(g):
    values = g.table("part").select(F.concat(F.lit("P"), "p_partkey").alias("node"), F.lit("name").alias("property"), F.col("p_name").alias("value"))
    return A.rolled_up_nested(g.elements, values).select("aggregate", "value")


@query("delete_aggregates", "SELECT count(DISTINCT aggregate)::BIGINT AS num_nodes, (count(*))::BIGINT AS num_relationships FROM elements")
def delete_aggregates(g):
    aggs = g.elements.select(F.col("aggregate").alias("node")).distinct().select(
        "node", F.lit(None).cast("string").alias("pref_name"), F.array(F.lit("AGGREGATE"), F.lit("GROUPS")).alias("labels"),
        F.array().cast("array<string>").alias("facets"),
    )
    return A.delete_aggregates(g.concepts.unionByName(aggs), g.edges, g.elements, ["GROUPS"])[3]


@query("element_values", "SELECT 'AG:' || p_type || ':' || p_brand AS aggregate, string_agg(p_name, '|' ORDER BY p_name) AS names FROM part GROUP BY ALL")
def element_values(g):
    values = g.table("part").select(F.concat(F.lit("P"), "p_partkey").alias("node"), F.lit("name").alias("property"), F.col("p_name").alias("value"))
    return A.element_values(g.elements, values).select("aggregate", F.array_join("values", "|").alias("names"))


def docs_of(g: DerivedGraph) -> DataFrame:
    return R.counted(R.relation_pairs(g.order_relations))


@query("relation_pairs", "SELECT type, u, v, sum(count)::BIGINT AS total, count(*)::BIGINT AS n_docs FROM pairs GROUP BY ALL")
def relation_pairs(g):
    return R.totals(docs_of(g))


@query(
    "relation_upsert",
    "SELECT type, u, v, sum(count)::BIGINT AS total_count, string_agg(doc || ':' || count, '|' ORDER BY doc) AS docs FROM (SELECT type, u, v, doc, CASE WHEN doc::BIGINT % 3 = 0 THEN 5 ELSE 1 END AS count FROM pairs) GROUP BY ALL",
)
def relation_upsert(g):
    stored = docs_of(g)
    again = stored.where("cast(doc AS long) % 3 = 0").withColumn("count", F.lit(5).cast("long"))
    out = R.parallel_arrays(R.upsert_counts(stored, again))
    return out.select(
        "type", "u", "v", "total_count",
        F.array_join(F.zip_with("doc_ids", "counts", lambda d, n: F.concat_ws(":", d, n.cast("string"))), "|").alias("docs"),
    )


@query(
    "relation_databases",
    "SELECT type, u, v, 'flag' AS db_name, coalesce(nullif(trim(arg_min(method, doc)), ''), '<unknown>') AS method FROM (SELECT type, u, v, doc, CASE WHEN doc::BIGINT % 2 = 0 THEN ' ' ELSE 'order' || doc END AS method FROM pairs) GROUP BY ALL",
)
def relation_databases(g):
    incoming = docs_of(g).select(
        "type", "u", "v", F.lit("flag").alias("db_name"),
        F.when(F.col("doc").cast("long") % 2 == 0, " ").otherwise(F.concat(F.lit("order"), "doc")).alias("method"),
        F.col("doc").alias("ord"),
    )
    return R.upsert_databases(incoming.select("type", "u", "v", "db_name", "method").where("false"), incoming)


SIDES = "both_ways AS (SELECT type, u, v, count FROM pairs UNION ALL SELECT type, v, u, count FROM pairs), lines AS (SELECT a.top AS arg1_id, a.name AS arg1_name, b.top AS arg2_id, b.name AS arg2_name, sum(count)::BIGINT AS count FROM both_ways JOIN tops a ON u = a.node JOIN tops b ON v = b.node WHERE type IN ('A', 'R') GROUP BY ALL), asked AS (SELECT DISTINCT top FROM tops JOIN part ON node = 'P' || p_partkey WHERE p_size <= 5 AND p_brand = (SELECT min(p_brand) FROM part)), others AS (SELECT DISTINCT top FROM tops JOIN part ON node = 'P' || p_partkey WHERE p_size >= 45 AND p_brand = (SELECT max(p_brand) FROM part))"


def _asked(g: DerivedGraph, sizes: str, brand) -> DataFrame:
    p = g.table("part")
    return p.where(sizes).join(p.agg(brand("p_brand").alias("p_brand")), "p_brand").select(F.concat(F.lit("P"), "p_partkey").alias("node"))


@query("relations_one_sided", "SELECT * FROM lines WHERE arg1_id IN (SELECT top FROM asked) AND arg2_id NOT IN (SELECT top FROM asked)", SIDES)
def relations_one_sided(g):
    return R.one_sided(_asked(g, "p_size <= 5", F.min), docs_of(g), g.elements, P.top_aggregates(g.elements), g.names, ["A", "R"])


@query("relations_one_sided_inter", "SELECT * FROM lines WHERE arg1_id IN (SELECT top FROM asked)", SIDES)
def relations_one_sided_inter(g):
    return R.one_sided(_asked(g, "p_size <= 5", F.min), docs_of(g), g.elements, P.top_aggregates(g.elements), g.names, ["A", "R"], True)


@query("relations_two_sided", "SELECT * FROM lines WHERE arg1_id IN (SELECT top FROM asked) AND arg2_id IN (SELECT top FROM others)", SIDES)
def relations_two_sided(g):
    return R.two_sided(
        _asked(g, "p_size <= 5", F.min), _asked(g, "p_size >= 45", F.max), docs_of(g), g.elements, P.top_aggregates(g.elements), g.names,
        ["A", "R"],
    )


@query(
    "mapping_insert_loom",
    "SELECT u, v, string_agg(DISTINCT kind, '|' ORDER BY kind) AS mapping_types FROM (SELECT * FROM mappings WHERE kind = 'EQUAL' UNION ALL SELECT least(u, s), greatest(u, s), 'LOOM' FROM (SELECT DISTINCT 'P' || l_partkey AS u, 'S' || l_suppkey AS s FROM lineitem)) GROUP BY u, v",
)
def mapping_insert_loom(g):
    """Chains of parts, whose LOOM mappings lie within a facet and go, and parts to suppliers, whose facets differ."""
    across = g.table("lineitem").select(
        F.concat(F.lit("P"), "l_partkey").alias("id1"), F.concat(F.lit("S"), "l_suppkey").alias("id2"), F.lit("loom").alias("mapping_type"),
    ).distinct()
    across = across.withColumn("mapping_type", F.upper("mapping_type"))
    given = g.mappings.select(F.col("u").alias("id1"), F.col("v").alias("id2"), F.col("mapping_types")[0].alias("mapping_type")).unionByName(across)
    nodes = g.concepts.select(F.col("node").alias("id"), "node", "facets")
    return M.insert_mappings(given, nodes)[0].select("u", "v", X.listed("mapping_types").alias("mapping_types"))


@query(
    "coordinate_lookup",
    "SELECT DISTINCT l_partkey::VARCHAR AS request, CASE WHEN p_partkey IS NOT NULL THEN 'P' || p_partkey END AS node FROM lineitem LEFT JOIN part ON p_partkey = l_partkey UNION ALL SELECT s_name, 'S' || s_suppkey FROM supplier UNION ALL SELECT c_name, NULL FROM customer",
)
def coordinate_lookup(g):
    """Parts by their original pair, suppliers by their source pair, and customers that nobody knows."""
    part, none = g.table("part"), F.lit(None).cast("string")
    coords = part.select(
        F.concat(F.lit("P"), "p_partkey").alias("node"), F.col("p_partkey").cast("string").alias("original_id"),
        F.lit("PARTS").alias("original_source"),
    )
    sources = g.table("supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("node"), F.col("s_name").alias("source_id"), F.lit("SUPPLIERS").alias("source"),
        F.lit(False).alias("is_unique"), F.lit(0).alias("ord"),
    )
    flag = F.lit(False).alias("unique_source_id")
    asked = g.table("lineitem").select(F.col("l_partkey").cast("string").alias("original_id")).distinct()
    asked = asked.select(
        F.col("original_id").alias("request"), "original_id", F.lit("PARTS").alias("original_source"), none.alias("source_id"),
        none.alias("source"), flag,
    )
    by_source = lambda t, name: g.table(t).select(
        F.col(name).alias("request"), none.alias("original_id"), none.alias("original_source"), F.col(name).alias("source_id"),
        F.lit("SUPPLIERS").alias("source"), flag,
    )
    return C.lookup_coordinates(
        asked.unionByName(by_source("supplier", "s_name")).unionByName(by_source("customer", "c_name")), coords, sources,
    ).select("request", "node")


@query(
    "scalar_keep_first",
    "SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id",
)
def scalar_keep_first(g):
    """The first value stays; with override the last one does."""
    e = g.table("events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("a"), F.max_by("event_type", "event_id").alias("b"))
    return e.select("user_id", X.overridden("a", "b", False).alias("first_type"), X.overridden("a", "b", True).alias("last_type"))


@query(
    "array_merge",
    "SELECT user_id, string_agg(event_type, '|' ORDER BY first) AS types FROM (SELECT user_id, event_type, min((value >= 50, event_id)) AS first FROM events GROUP BY ALL) GROUP BY user_id",
)
def array_merge(g):
    """Event types of low values are there already, those of high values come in; each once, by order of appearance."""
    e = g.table("events").withColumn("late", F.coalesce(F.col("value") >= 50, F.lit(False)))
    seq = lambda late: F.sort_array(F.collect_list(F.when(F.col("late") == late, F.struct("event_id", "event_type"))))["event_type"]
    both = e.groupBy("user_id").agg(seq(False).alias("old"), seq(True).alias("new"))
    return both.select("user_id", F.array_join(X.ordered_union("old", "new"), "|").alias("types"))


@query(
    "source_id_merge",
    "SELECT 'P' || l_partkey AS node, l_suppkey::VARCHAR AS source_id, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS sources FROM lineitem GROUP BY ALL",
)
def source_id_merge(g):
    li = g.table("lineitem").select(
        F.concat(F.lit("P"), "l_partkey").alias("node"), F.col("l_suppkey").cast("string").alias("source_id"),
        F.col("l_returnflag").alias("source"), F.lit(False).alias("is_unique"), F.col("l_orderkey").alias("ord"),
    )
    old, new = li.where("source = 'A'").drop("ord").distinct(), li
    return C.source_arrays(C.merged_sources(old, new)).select("node", "source_id", F.array_join("sources", "|").alias("sources"))


@query("id_mapping", "SELECT node AS source_id, facet AS target_id FROM concepts WHERE label IN ('nation', 'supplier')")
def id_mapping(g):
    return E.id_mapping(g.concepts, "node", "facets", ["nation", "supplier"])


@query(
    "dictionary_unique",
    "SELECT regexp_replace(trim(pref_name), '\\s+', ' ', 'g') AS key, 'fid0:' || min(node) AS ids FROM concepts WHERE facet = 'fid0' AND label <> 'region' AND length(pref_name) > 2 GROUP BY 1",
)
def dictionary_unique(g):
    own = g.concepts.where("facets[0] = 'fid0'").withColumn("own_id", F.array("node"))
    return E.unique_keys(E.dictionary_lines(own, ["own_id"], {"own_id": "facets"}, ["region"], "CONCEPT"))


@query("concept_facet_map", "SELECT node, facet AS facets FROM concepts")
def concept_facet_map(g):
    return E.concept_facet_map(g.concepts)


@query(
    "variant_counts",
    r"SELECT concept, lower(w) AS norm, arg_min(w, (doc_id, w)) AS name, count(DISTINCT doc_id)::BIGINT AS n_docs, count(*)::BIGINT AS total FROM (SELECT lang AS concept, doc_id, unnest(string_split_regex(text, '[ \t\n\r\f\v]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2",
)
def variant_counts(g):
    docs = g.table("documents")
    v = V.counted_variants(V.words_of_texts(docs, F.col("lang"), F.col("doc_id"), F.col("text"), "[ \\t\\n\\r\\f\\x0B]+"))
    counts = v.groupBy("norm", "concept").agg(
        F.min_by("name", F.struct("doc", "name")).alias("name"), F.count("*").alias("n_docs"), F.sum("count").alias("total"),
    )
    return counts.select("concept", "norm", "name", "n_docs", "total")


@query(
    "text_phrase",
    r"SELECT 'P' || p_partkey AS node FROM part WHERE contains(' ' || trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ', ' ' || (SELECT lower(string_split(min(p_name), ' ')[1]) FROM part) || ' ')",
)
def text_phrase(g):
    first = g.table("part").agg(F.lower(F.element_at(F.split(F.min("p_name"), " "), 1)).alias("w")).first()["w"] or ""
    return g.table("part").where(V.has_phrase(F.col("p_name"), first)).select(F.concat(F.lit("P"), "p_partkey").alias("node"))


@query(
    "json_properties",
    "SELECT event_id, json_extract_string(props, '$.' || (SELECT min(k) FROM (SELECT unnest(json_keys(props)) AS k FROM events))) AS value FROM events",
)
def json_properties(g):
    """A free property from JSON text, under the smallest key that any row has."""
    e = g.table("events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    key = e.select(F.explode(F.map_keys("m")).alias("k")).agg(F.min("k").alias("k")).first()["k"]
    return e.select("event_id", F.try_element_at("m", F.lit(key)).alias("value"))


@query("broken_keys", "SELECT pref_name, count(*)::BIGINT AS n FROM concepts GROUP BY pref_name HAVING count(*) > 1")
def broken_keys(g):
    return Q.broken_keys(g.concepts, "pref_name")


@query("edge_predicates", "SELECT node FROM concepts WHERE label = 'nation' AND node IN (SELECT src FROM broader WHERE dst[1] = 'S')")
def edge_predicates(g):
    to_suppliers = g.edges.where("dst LIKE 'S%'")
    return Q.where_edge(Q.where_property(Q.scan(g.concepts, "nation"), "facets", "fid0"), to_suppliers, "out", ["IS_BROADER_THAN"]).select("node")
