"""Queries that import concepts made from the star-schema tables, and the SQL that checks each.

Nations and customers come in one document, each under its parent; regions are named as parents only, and come later.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.graph import Graph
from ..operators.ingest import Options, insert_concepts
from ..operators.service import build_aggregates_by_preferred_name
from ..operators.service import delete_aggregates as service_delete
from ..sources.documents import CONCEPT, read_concept_lines
from .iterate import checkpoint_folder, remove_folder
from .contract import query
from .derived import DerivedGraph

FACET = {"name": "places", "facetGroup": {"name": "geography", "position": 1}}


def coordinates(prefix: str, key: str, source: str) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias("sourceId"), F.lit(source).alias("source"), none.alias("originalId"),
        none.alias("originalSource"), F.lit(False).alias("uniqueSourceId"),
    )


def documents(g: DerivedGraph, rows: DataFrame) -> DataFrame:
    """rows as concepts of an import, with all columns of one."""
    return g.spark.createDataFrame([], f"ord long, {CONCEPT[len('struct<') : -1]}").unionByName(rows, allowMissingColumns=True)


def nations_and_customers(g: DerivedGraph) -> DataFrame:
    n, c = g.table("nation"), g.table("customer")
    nations = n.select(
        F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("preferredName"),
        coordinates("N", "n_nationkey", "NATIONS").alias("coordinates"),
        F.array(coordinates("R", "n_regionkey", "REGIONS")).alias("parentCoordinates"),
    )
    customers = c.select(
        (F.col("c_custkey") + 1000).cast("long").alias("ord"), F.col("c_name").alias("preferredName"),
        coordinates("C", "c_custkey", "CUSTOMERS").alias("coordinates"),
        F.array(coordinates("N", "c_nationkey", "NATIONS")).alias("parentCoordinates"),
    )
    return documents(g, nations.unionByName(customers))


def regions(g: DerivedGraph) -> DataFrame:
    r = g.table("region")
    return documents(
        g,
        r.select(
            F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("preferredName"),
            coordinates("R", "r_regionkey", "REGIONS").alias("coordinates"),
        ),
    )


def first_import(g: DerivedGraph) -> Graph:
    return insert_concepts(Graph.empty(g.spark), nations_and_customers(g), FACET)[0]


def ids_of(graph: Graph) -> DataFrame:
    return graph.sources.select("node", "source_id")


@query(
    "import_hierarchy",
    "SELECT parent, child, type FROM (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer), (SELECT unnest(['IS_BROADER_THAN', 'IS_BROADER_THAN_fid0']) AS type)",
)
def import_hierarchy(g):
    """Edges of an import, those to parents that come later in the document or not at all included."""
    graph = first_import(g)
    end = lambda c: ids_of(graph).select(F.col("node").alias(c), F.col("source_id").alias("parent" if c == "src" else "child"))
    return graph.edges.join(end("src"), "src").join(end("dst"), "dst").select("parent", "child", "type")


@query(
    "import_ids",
    "SELECT source_id, 'tid' || (row_number() OVER (ORDER BY ord) - 1) AS id, name AS pref_name, 'CONCEPT' AS labels, 'fid0' AS facets FROM (SELECT n_nationkey AS ord, 'N' || n_nationkey AS source_id, n_name AS name FROM nation UNION ALL SELECT 1000 + c_custkey, 'C' || c_custkey, c_name FROM customer) UNION ALL SELECT DISTINCT 'R' || n_regionkey, NULL, NULL, 'CONCEPT|HOLLOW', NULL FROM nation",
)
def import_ids(g):
    """Ids follow the document's order; parents that nobody describes are placeholders without id, name and facet."""
    graph = first_import(g)
    facets = F.when(F.size("facets") > 0, X.listed("facets"))
    return graph.concepts.join(ids_of(graph), "node").select("source_id", "id", "pref_name", X.listed("labels").alias("labels"), facets.alias("facets"))


@query("import_roots", "SELECT DISTINCT 'fid0' AS facet, 'R' || n_regionkey AS source_id FROM nation")
def import_roots(g):
    graph = first_import(g)
    return graph.roots.join(ids_of(graph), "node").select("facet", "source_id")


@query(
    "import_fill",
    "SELECT 'R' || r_regionkey AS source_id, 'tid' || ((SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY r_regionkey) - 1) AS id, r_name AS pref_name, 'CONCEPT' AS labels, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)::BIGINT AS n_children FROM region",
)
def import_fill(g):
    """A second import describes the placeholders: they get names and the next ids, and keep their children."""
    graph = insert_concepts(first_import(g), regions(g), FACET)[0]
    n = graph.edges.where("facet IS NULL").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_children"))
    filled = graph.concepts.join(ids_of(graph).where("source_id LIKE 'R%'"), "node").join(n, "node", "left")
    return filled.select("source_id", "id", "pref_name", X.listed("labels").alias("labels"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


@query(
    "import_merge",
    "SELECT 'C' || c_custkey AS source_id, c_name AS pref_name, c_mktsegment || '|x' AS synonyms, 'CUSTOMERS|SEGMENTS' AS sources FROM customer",
)
def import_merge(g):
    """Without a facet an import merges into what is there: known customers get synonyms and a further source of their id,
    but neither a new name nor their own name as a synonym; suppliers, whom nobody knows, are skipped."""
    c, s = g.table("customer"), g.table("supplier")
    row = lambda t, key, prefix, source, syn: t.select(
        F.col(key).cast("long").alias("ord"), F.lit("other").alias("preferredName"), coordinates(prefix, key, source).alias("coordinates"),
        syn.alias("synonyms"), F.array(coordinates(prefix, key, "SEGMENTS")).alias("additional_coordinates"),
    )
    known = row(c, "c_custkey", "C", "CUSTOMERS", F.array("c_mktsegment", F.lit("x"), "c_name", "c_mktsegment"))
    unknown = row(s, "s_suppkey", "S", "SUPPLIERS", F.array("s_name")).withColumn("ord", F.col("ord") + 10_000_000)
    graph = insert_concepts(first_import(g), documents(g, known.unionByName(unknown)), None, Options(merge=True))[0]
    sources = graph.sources.groupBy("node", "source_id").agg(X.listed(F.collect_list("source")).alias("sources"))
    return graph.concepts.join(sources, "node").where("source_id LIKE 'C%' OR source_id LIKE 'S%'").select(
        "source_id", "pref_name", F.array_join("synonyms", "|").alias("synonyms"), "sources",
    )


@query(
    "import_aggregates",
    "SELECT DISTINCT n_name AS aggregate, 'C' || c_custkey AS element FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def import_aggregates(g):
    """Aggregates name their elements, which come after them in the document."""
    c = g.table("customer")
    by = c.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(coordinates("C", "c_custkey", "CUSTOMERS"))).alias("elementCoordinates")).join(
        g.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"),
    )
    aggregates = by.select(
        F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("preferredName"),
        coordinates("A", "n_nationkey", "GROUPS").alias("coordinates"), "elementCoordinates", F.lit(True).alias("aggregate"),
    )
    customers = c.select(
        (F.col("c_custkey") + 1000).cast("long").alias("ord"), F.col("c_name").alias("preferredName"),
        coordinates("C", "c_custkey", "CUSTOMERS").alias("coordinates"),
    )
    graph = insert_concepts(Graph.empty(g.spark), documents(g, aggregates.unionByName(customers, allowMissingColumns=True)), FACET)[0]
    names = graph.concepts.select(F.col("node").alias("aggregate"), "pref_name")
    return graph.elements.join(names, "aggregate").join(ids_of(graph).withColumnRenamed("node", "element"), "element").select(
        F.col("pref_name").alias("aggregate"), F.col("source_id").alias("element"),
    )


@query(
    "import_relationships",
    "SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst, 'LIVES_IN' AS type, 'segment=' || c_mktsegment || '|since=1' AS props FROM customer UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'LIVES_IN', 'segment=other' FROM customer",
)
def import_relationships(g):
    """An edge that comes again with more properties stays one edge; another value of a property makes a second edge."""
    c, kind = g.table("customer"), "array<struct<targetCoordinates struct<sourceId string, source string, originalId string, originalSource string, uniqueSourceId boolean>, type string, properties map<string,string>>>"

    def again(props: Column) -> DataFrame:
        to = F.array(F.struct(
            coordinates("N", "c_nationkey", "NATIONS").alias("targetCoordinates"), F.lit("LIVES_IN").alias("type"),
            props.alias("properties"),
        )).cast(kind)
        return documents(
            g,
            c.select(
                (F.col("c_custkey") + 1000).cast("long").alias("ord"), F.col("c_name").alias("preferredName"),
                coordinates("C", "c_custkey", "CUSTOMERS").alias("coordinates"), to.alias("relationships"),
            ),
        )

    graph = first_import(g)
    segment, other = (F.create_map(F.lit("segment"), X.as_value(x)) for x in (F.col("c_mktsegment"), F.lit("other")))
    for props in (segment, F.map_concat(segment, F.create_map(F.lit("since"), F.lit("1"))), other):
        graph = insert_concepts(graph, again(props), FACET)[0]
    return lives_in(graph)


def lives_in(graph: Graph) -> DataFrame:
    """(src, dst, type, props) of edges LIVES_IN, with source ids and properties as text."""
    end = lambda c: ids_of(graph).select(F.col("node").alias(c), F.col("source_id").alias(f"{c}_id"))
    shown = F.array_join(F.sort_array(F.transform(F.map_entries("props"), lambda e: F.concat_ws("=", e["key"], X.as_text(e["value"])))), "|")
    named = graph.edges.where("type = 'LIVES_IN'").join(end("src"), "src").join(end("dst"), "dst")
    return named.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "type", shown.alias("props"))


@query(
    "import_edge_fold",
    r"""
SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst, 'LIVES_IN' AS type,
       'note=[' || c_mktsegment || '] draft|segment=' || c_mktsegment || '|since=1|tags=["a","b",1]' AS props FROM customer
UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'LIVES_IN', 'note=other' FROM customer
""",
)
def import_edge_fold(g):
    """Several edges of one key in one import: those that fit what is stored add to it in their order, the first that doesn't
    makes another edge, and those after it change nothing. A text in brackets stays a text, lists are united."""
    c, kind = g.table("customer"), documents(g, g.spark.createDataFrame([], "ord long")).schema["relationships"].dataType
    text = lambda x: X.as_value(x)
    note = F.concat(F.lit("["), "c_mktsegment", F.lit("] draft"))
    to = lambda **p: F.struct(
        coordinates("N", "c_nationkey", "NATIONS").alias("targetCoordinates"), F.lit("LIVES_IN").alias("type"),
        F.map_from_arrays(F.array(*map(F.lit, p)), F.array(*p.values())).alias("properties"),
    )
    first = [to(segment=text("c_mktsegment"), tags=F.lit('["a"]'))]
    later = [
        to(note=text(note), segment=text("c_mktsegment")), to(since=F.lit("1"), tags=F.lit('["b","a",1]')), to(note=text(F.lit("other"))),
        to(note=text(F.lit("other")), lost=F.lit("true")), to(note=text(note), lost=F.lit("true")),
    ]
    graph = first_import(g)
    for edges in (first, later):
        named = c.select(
            (F.col("c_custkey") + 1000).cast("long").alias("ord"), F.col("c_name").alias("preferredName"),
            coordinates("C", "c_custkey", "CUSTOMERS").alias("coordinates"), F.array(*edges).cast(kind).alias("relationships"),
        )
        graph = insert_concepts(graph, documents(g, named), FACET)[0]
    return lives_in(graph)


@query(
    "import_lines",
    "SELECT 'C' || c_custkey AS source_id, 'tid' || (row_number() OVER (ORDER BY c_custkey DESC) - 1) AS id, c_name AS pref_name FROM customer",
)
def import_lines(g):
    """Concepts as JSON lines in several files, without numbers: ids follow the order of files and of lines in them."""
    path = f"{checkpoint_folder(g.spark)}/lines-{uuid4()}"
    rows = g.table("customer").select(
        "c_custkey",
        F.struct(F.col("c_name").alias("preferredName"), coordinates("C", "c_custkey", "CUSTOMERS").alias("coordinates")).alias("c"),
    )
    in_order = rows.repartitionByRange(4, F.col("c_custkey").desc()).sortWithinPartitions(F.col("c_custkey").desc())
    in_order.select("c.*").write.json(path)
    graph = insert_concepts(Graph.empty(g.spark), read_concept_lines(g.spark, path), FACET)[0]
    remove_folder(g.spark, path)
    return graph.concepts.join(ids_of(graph), "node").select("source_id", "id", "pref_name")


@query(
    "delete_then_build",
    """SELECT 'atid' || (n + row_number() OVER (ORDER BY pref_name) - 1) AS id, NULL::VARCHAR AS source_id, 0::BIGINT AS n_left,
       (SELECT count(*) FROM customer)::BIGINT + 5 * n AS n_deleted, n AS n_nodes FROM names, n""",
    ctes="names AS (SELECT DISTINCT c_mktsegment AS pref_name FROM customer), n AS (SELECT count(*) AS n FROM names)",
)
def delete_then_build(g):
    """Aggregates of customers by segment are deleted, with the source ids, roots, mappings, relations and edges that they have
    got, and built again: the new ones get new numbers and ids, and nothing of the old ones."""
    c = g.table("customer")
    own = documents(
        g,
        c.select(
            F.col("c_custkey").cast("long").alias("ord"), F.col("c_mktsegment").alias("preferredName"),
            coordinates("C", "c_custkey", "CUSTOMERS").alias("coordinates"),
        ),
    )
    graph = insert_concepts(Graph.empty(g.spark), own, FACET)[0]
    built = build_aggregates_by_preferred_name(graph, ["CONCEPT"], ["SEGMENT"], ["preferredName"])
    a = built.concepts.where(F.array_contains("labels", "SEGMENT")).select("node", "id")
    with_rows = lambda table, rows: {table: getattr(built, table).unionByName(rows, allowMissingColumns=True)}
    hung = {
        **with_rows(
            "sources",
            a.select(
                "node", F.concat(F.lit("S"), "id").alias("source_id"), F.lit("SEGMENTS").alias("source"), F.lit(True).alias("is_unique"),
                F.lit(0).alias("ord"),
            ),
        ),
        **with_rows("roots", a.select(F.lit("fid0").alias("facet"), "node", F.lit(False).alias("is_no_facet"))),
        **with_rows("mappings", a.select(F.lit(0).cast("long").alias("u"), F.col("node").alias("v"), F.array(F.lit("EQUAL")).alias("mapping_types"))),
        **with_rows(
            "relation_docs",
            a.select(
                F.lit("t").alias("type"), F.lit(0).cast("long").alias("u"), F.col("node").alias("v"),
                F.explode(F.array(F.lit("d1"), F.lit("d2"))).alias("doc"), F.lit(1).cast("long").alias("count"),
            ),
        ),
        **with_rows("edges", a.select(F.lit(0).cast("long").alias("src"), F.col("node").alias("dst"), F.lit("x").alias("type"), F.lit(0).alias("nth"))),
        **with_rows(
            "variants",
            a.select(
                F.lit("acronym").alias("kind"), F.col("id").alias("concept"), F.lit("n").alias("norm"), F.lit("N").alias("name"),
                F.lit("d").alias("doc"), F.lit(1).cast("long").alias("count"),
            ),
        ),
    }
    left, counts = service_delete(built.with_(**hung), ["SEGMENT"])
    again = build_aggregates_by_preferred_name(left, ["CONCEPT"], ["SEGMENT"], ["preferredName"])
    tables = (left.relation_docs, left.mappings, left.edges, left.elements, left.variants)
    n_left = sum(t.count() for t in tables)
    new = again.concepts.where(F.array_contains("labels", "SEGMENT")).join(again.sources.select("node", "source_id"), "node", "left")
    total = counts.first()
    numbers = {"n_left": n_left, "n_deleted": total["num_relationships"], "n_nodes": total["num_nodes"]}
    return new.select("id", "source_id", *(F.lit(n).cast("long").alias(c) for c, n in numbers.items()))
