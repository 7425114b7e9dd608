"""The graph's tables as one value; versions of it as Parquet folders."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.iterate import keep

SCHEMAS = {
    "concepts": "node long, id string, labels array<string>, pref_name string, original_id string, original_source string, synonyms array<string>, writing_variants array<string>, descriptions array<string>, copy_properties array<string>, facets array<string>, mapping_type array<string>, props map<string,string>",
    "sources": "node long, source_id string, source string, is_unique boolean, ord int",
    "edges": "src long, dst long, type string, facet string, props map<string,string>, nth int",
    "roots": "facet string, node long, is_no_facet boolean",
    "elements": "aggregate long, element long",
    "facets": "facet string, name string, short_name string, custom_id string, labels array<string>, source_type string, grp string, is_no_facet boolean",
    "groups": "grp string, name string, position int, type string, labels array<string>, is_no_facet boolean",
    "mappings": "u long, v long, mapping_types array<string>",
    "relation_docs": "type string, u long, v long, doc string, count long",
    "relation_dbs": "type string, u long, v long, db_name string, method string",
    "variants": "kind string, concept string, norm string, name string, doc string, count long",
    "sequences": "name string, next long",
}
#: The table, column and prefix of each sequence's numbers.
SEQUENCES = {
    "node": ("concepts", "node", ""), "tid": ("concepts", "id", "tid"), "atid": ("concepts", "id", "atid"),
    "fid": ("facets", "facet", "fid"), "fgid": ("groups", "grp", "fgid"),
}
#: Columns of each table that name nodes.
NODE_COLUMNS = {
    "concepts": ("node",), "sources": ("node",), "edges": ("src", "dst"), "roots": ("node",), "elements": ("aggregate", "element"),
    "mappings": ("u", "v"), "relation_docs": ("u", "v"), "relation_dbs": ("u", "v"),
}
#: The column by which saved tables are dealt to buckets.
KEYED = {"concepts": "node", "sources": "node", "edges": "src", "elements": "aggregate", "roots": "node"}
#: What makes one relationship of a node, by table: all rows that agree in these columns. Source ids are properties.
RELATIONSHIPS = {
    "edges": None, "roots": None, "elements": None, "mappings": None, "relation_docs": ("type", "u", "v"),
    "relation_dbs": ("type", "u", "v"), "variants": ("kind", "concept"),
}


@dataclass(frozen=True)
class Graph:
    concepts: DataFrame
    sources: DataFrame
    edges: DataFrame
    roots: DataFrame
    elements: DataFrame
    facets: DataFrame
    groups: DataFrame
    mappings: DataFrame
    relation_docs: DataFrame
    relation_dbs: DataFrame
    variants: DataFrame
    sequences: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})

    @staticmethod
    def read(spark: SparkSession, path: str) -> Graph:
        return Graph(**{name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()})

    def write(self, path: str) -> None:
        """A new version; a folder that is there already raises an error, as tables being read are never overwritten."""
        whole = with_marks(self)
        for f in fields(whole):
            getattr(whole, f.name).write.parquet(f"{path}/{f.name}")

    def save(self, name: str, buckets: int = 64) -> None:
        """The graph as tables name_concepts, name_edges ... of the session's catalog. Those of KEYED are dealt to buckets by
        their key, so that what is joined on it again and again, such as edges in each round of a closure, isn't shuffled."""
        whole = with_marks(self)
        for f in fields(whole):
            rows, key = getattr(whole, f.name), KEYED.get(f.name)
            writer = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key) if key else rows.write
            writer.mode("errorifexists").format("parquet").saveAsTable(f"{name}_{f.name}")

    @staticmethod
    def load(spark: SparkSession, name: str) -> Graph:
        """The tables that save has made."""
        return Graph(**{f.name: spark.table(f"{name}_{f.name}") for f in fields(Graph)})

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)


def numbered(df: DataFrame, order: list[str], out: str, start: int = 0) -> DataFrame:
    """df with dense numbers from start in the order of columns. Ranges of the order are counted, and each row gets its
    range's offset and its place there, so no task sees all rows."""
    ranged = keep(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))  # a row for each partition
    offset = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(W.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__k", place).join(F.broadcast(offset), "__p").withColumn(out, F.lit(start - 1) + F.col("__o") + F.col("__k")).drop("__p", "__k", "__o")


def _numbers(graph: Graph, names: list[str]) -> DataFrame:
    """(name, next) of sequences by what their tables hold, each read once, and by the marks of what they have ever given; next is
    null if there is neither."""
    parts = [graph.sequences.where(F.col("name").isin(names))]
    for table in dict.fromkeys(SEQUENCES[name][0] for name in names):
        own = []
        for name in names:
            if SEQUENCES[name][0] == table:
                _, column, prefix = SEQUENCES[name]
                text = F.col(column).cast("string")
                number = F.when(text.rlike(f"^{prefix}[0-9]+$"), F.substring(text, F.lit(len(prefix) + 1), F.lit(30)).cast("long"))
                own.append(F.struct(F.lit(name).alias("name"), (F.max(number) + 1).alias("next")))
        parts.append(getattr(graph, table).agg(F.array(*own).alias("s")).select(F.inline("s")))
    return reduce(DataFrame.unionByName, parts)


def next_numbers(graph: Graph, names: list[str]) -> list[int]:
    """The next number of each sequence: above all that it has given, also to what is gone since."""
    found = dict(_numbers(graph, names).groupBy("name").agg(F.max("next")).collect())
    return [found.get(name) or 0 for name in names]


def next_number(graph: Graph, name: str) -> int:
    """next_numbers of one sequence."""
    return next_numbers(graph, [name])[0]


def with_marks(graph: Graph) -> Graph:
    """graph whose sequences stand where its tables are now, or higher. What takes rows away keeps the marks with this."""
    every = _numbers(graph, list(SEQUENCES))
    return graph.with_(sequences=keep(every.where("next IS NOT NULL").groupBy("name").agg(F.max("next").alias("next"))))


def without_nodes(graph: Graph, gone: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, counts) without the nodes (gone: node) and all that hangs on them, in every table: source ids, edges, roots,
    elements either way, mappings, relations and variants. Their numbers and ids are not given again. counts has one row:
    num_nodes and num_relationships (what RELATIONSHIPS counts as one)."""
    graph, gone = with_marks(graph), keep(gone.select("node").distinct())
    kept, sizes = {}, [gone.agg(F.count("*").alias("nodes")).select("nodes", F.lit(0).cast("long").alias("edges"))]
    ids = graph.concepts.join(gone, "node", "left_semi").where("id IS NOT NULL").select(F.col("id").alias("node"))
    for name, columns in {**NODE_COLUMNS, "variants": ("concept",)}.items():
        table, nodes, lost = getattr(graph, name), ids if name == "variants" else gone, F.lit(False)
        hit = table
        for c in columns:
            mark = f"__gone_{c}"
            hit = hit.join(nodes.select(F.col("node").alias(f"__{c}"), F.lit(True).alias(mark)), F.col(c) == F.col(f"__{c}"), "left")
            lost = lost | F.col(mark).isNotNull()
        hit = keep(hit.select(table.columns + [lost.alias("__lost")]))
        kept[name] = hit.where("NOT __lost").drop("__lost")
        if name in RELATIONSHIPS:
            away = hit.where("__lost")
            sizes.append((
                away.select(*RELATIONSHIPS[name]).distinct() if RELATIONSHIPS[name] else away
            ).agg(F.lit(0).cast("long").alias("nodes"), F.count("*").alias("edges")))
    counts = reduce(DataFrame.unionByName, sizes).agg(F.sum("nodes").alias("num_nodes"), F.sum("edges").alias("num_relationships"))
    return graph.with_(**kept), counts
