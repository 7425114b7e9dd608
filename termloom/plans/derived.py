"""A concept graph made from the star-schema tables, so that every operator can run over them.

Regions, nations, customers and suppliers form facet fid0; part types and brands are the two parents of each part in
facet fid1. Part types hold groups (type and brand), which hold parts. Parts with equal name and brand are mapped in a
chain. Orders are documents whose parts are related under the return flag.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


class DerivedGraph:
    """The tables of the graph, each read when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def concepts(self) -> DataFrame:
        """node, pref_name, labels, facets."""
        def of(table: str, prefix: str, key: str, name: str, facet: str) -> DataFrame:
            t = self.table(table).select(_id(prefix, key).alias("node"), F.col(name).alias("pref_name")).distinct()
            return t.select("node", "pref_name", F.array(F.lit("CONCEPT"), F.lit(table)).alias("labels"), F.array(F.lit(facet)).alias("facets"))

        kinds = [
            ("region", "R", "r_regionkey", "r_name", "fid0"), ("nation", "N", "n_nationkey", "n_name", "fid0"),
            ("customer", "C", "c_custkey", "c_name", "fid0"), ("supplier", "S", "s_suppkey", "s_name", "fid0"),
            ("part", "P", "p_partkey", "p_name", "fid1"),
        ]
        part = self.table("part")
        extra = [part.select(_id(p, c).alias("node"), F.col(c).alias("pref_name")).distinct().select("node", "pref_name", F.array(F.lit("CONCEPT"), F.lit(c)).alias("labels"), F.array(F.lit("fid1")).alias("facets")) for p, c in (("T", "p_type"), ("B", "p_brand"))]
        return reduce(DataFrame.unionByName, [*(of(*k) for k in kinds), *extra])

    @cached_property
    def edges(self) -> DataFrame:
        """src, dst, type, facet: the general edge (facet null) and its twin in the facet."""
        nation, part = self.table("nation"), self.table("part")
        pairs = [
            nation.select(_id("R", "n_regionkey").alias("src"), _id("N", "n_nationkey").alias("dst"), F.lit("fid0").alias("facet")),
            self.table("customer").select(_id("N", "c_nationkey"), _id("C", "c_custkey"), F.lit("fid0")),
            self.table("supplier").select(_id("N", "s_nationkey"), _id("S", "s_suppkey"), F.lit("fid0")),
            part.select(_id("T", "p_type"), _id("P", "p_partkey"), F.lit("fid1")),
            part.select(_id("B", "p_brand"), _id("P", "p_partkey"), F.lit("fid1")),
        ]
        own = reduce(DataFrame.union, pairs).distinct()
        both = own.select("src", "dst", F.explode(F.array(F.lit(None).cast("string"), F.col("facet"))).alias("facet"))
        return both.select("src", "dst", F.concat_ws("_", F.lit("IS_BROADER_THAN"), "facet").alias("type"), "facet")

    @cached_property
    def roots(self) -> DataFrame:
        part = self.table("part")
        rows = [
            self.table("region").select(F.lit("fid0").alias("facet"), _id("R", "r_regionkey").alias("node")),
            part.select(F.lit("fid1"), _id("T", "p_type")), part.select(F.lit("fid1"), _id("B", "p_brand")),
        ]
        return reduce(DataFrame.union, rows).distinct()

    @cached_property
    def facets(self) -> DataFrame:
        rows = [
            ("fid0", "places", "g0", "hierarchical"), ("fid1", "goods", "g0", "hierarchical"), ("fid2", "empty", "g1", "hierarchical"),
            ("fid3", "terms", "g1", "flat"),
        ]
        return self.spark.createDataFrame(rows, "facet string, name string, grp string, source_type string")

    @cached_property
    def elements(self) -> DataFrame:
        """aggregate, element: type over type and brand over part."""
        p = self.table("part").select(
            F.concat(F.lit("AT:"), "p_type").alias("top"), F.concat_ws(":", F.lit("AG"), "p_type", "p_brand").alias("grp"),
            _id("P", "p_partkey").alias("part"),
        )
        return p.select(F.col("top").alias("aggregate"), F.col("grp").alias("element")).distinct().union(p.select("grp", "part"))

    @cached_property
    def names(self) -> DataFrame:
        p = self.table("part")
        tops = p.select(F.concat(F.lit("AT:"), "p_type").alias("node"), F.col("p_type").alias("name")).distinct()
        return p.select(_id("P", "p_partkey").alias("node"), F.col("p_name").alias("name")).union(tops)

    @cached_property
    def mappings(self) -> DataFrame:
        """u, v, mapping_types: each part to the next of the same name and brand; LOOM from odd keys, else EQUAL."""
        w = W.partitionBy("p_name", "p_brand").orderBy("p_partkey")
        p = self.table("part").select("p_partkey", F.lag("p_partkey").over(w).alias("prev")).where("prev IS NOT NULL")
        kind = F.when(F.col("p_partkey") % 2 == 1, "LOOM").otherwise("EQUAL")
        a, b = _id("P", "prev"), _id("P", "p_partkey")
        return p.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.array(kind).alias("mapping_types"))

    @cached_property
    def order_relations(self) -> DataFrame:
        """doc, type, args, count, entry: the distinct parts of an order's lines with one return flag, dealt by document and type."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # as a number: pairs are many more than lines
        li = self.table("lineitem").select(
            F.col("l_orderkey").cast("string").alias("doc"), F.col("l_returnflag").alias("type"), _id("P", "l_partkey").alias("arg"),
        ).repartition(parts, "doc", "type")
        args = li.groupBy("doc", "type").agg(F.array_sort(F.collect_set("arg")).alias("args"))
        return args.select("doc", "type", "args", F.lit(1).alias("count"), F.lit(0).alias("entry"))
