"""JSON inputs with explicit schemas: concepts, facets, mappings, relations and term variants."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import numbered

COORDINATES = "struct<sourceId string, source string, originalId string, originalSource string, uniqueSourceId boolean>"
CONCEPT = (
    "struct<preferredName string, descriptions array<string>, synonyms array<string>, writingVariants array<string>, "
    f"labels array<string>, copyProperties array<string>, coordinates {COORDINATES}, "
    f"additional_coordinates array<{COORDINATES}>, parentCoordinates array<{COORDINATES}>, elementCoordinates array<{COORDINATES}>, "
    f"relationships array<struct<targetCoordinates {COORDINATES}, type string, properties map<string,string>>>, "
    "aggregate boolean, aggregateIncludeInHierarchy boolean, additional_properties map<string,string>, eligible_for_facet_root boolean>"
)
#: As CONCEPT, with free properties as they stand in JSON.
CONCEPT_JSON = CONCEPT.replace("map<string,string>", "map<string,variant>")
FACET = "struct<id string, name string, shortName string, customId string, sourceType string, labels array<string>, noFacet boolean, facetGroup string>"
OPTIONS = "struct<noFacetCmd struct<parentCriteria array<string>>, cutParents array<string>, doNotCreateHollowParents boolean, createHollowAggregateElements boolean, merge boolean, overridePreferredName boolean>"
IMPORT = f"facet {FACET}, importOptions {OPTIONS}, name_num_concepts long, concepts array<{CONCEPT_JSON}>"
RELATION = "struct<count int, method string, args array<array<string>>>"
RELATIONS = f"id_property string, id_source string, documents array<struct<name string, db boolean, isDb boolean, relations map<string, array<{RELATION}>>>>"
GROUP = "name string, position int, labels array<string>, type string"


#: Positions within a file are below this, so that file and position are one number.
FILE_ROWS = 1 << 40


def typed(values: Column) -> Column:
    """A map of JSON values as a map of JSON texts, so that texts, numbers, booleans and lists keep their kind. Nulls are
    no values."""
    return F.transform_values(F.map_filter(values, lambda _, v: v.isNotNull() & ~F.is_variant_null(v)), lambda _, v: F.to_json(v))


def typed_concept(c: Column) -> Column:
    """A concept read by CONCEPT_JSON, with its free properties and those of its relationships as JSON texts."""
    edges = F.transform(c["relationships"], lambda r: r.withField("properties", typed(r["properties"])))
    return c.withField("relationships", edges).withField("additional_properties", typed(c["additional_properties"]))


def in_files(df: DataFrame) -> DataFrame:
    """df of files with columns file, its path, and file_no, the place of the path among all."""
    rows = df.select("*", F.col("_metadata.file_path").alias("file"))
    paths = rows.select("file").distinct()
    return rows.join(numbered(paths, ["file"], "file_no"), "file")


def with_group(facet: DataFrame) -> DataFrame:
    """Facets whose group is a struct; one given as a bare string is a group of that name."""
    group, name = F.from_json("facetGroup", GROUP), F.col("facetGroup").alias("name")
    bare = F.struct(
        name, F.lit(None).cast("int").alias("position"), F.lit(None).cast("array<string>").alias("labels"),
        F.lit(None).cast("string").alias("type"),
    )
    return facet.withColumn("facetGroup", F.when(F.col("facetGroup").startswith("{"), group).otherwise(bare))


def one_row(df: DataFrame, what: str) -> DataFrame:
    """df's one distinct row, or none; several raise an error."""
    rows = df.distinct()
    if rows.limit(2).count() > 1:
        raise ValueError(f"documents with several {what}: import each by itself (read_imports)")
    return rows


def import_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of concept documents, a file each, with file and file_no."""
    return in_files(spark.read.schema(IMPORT).json(path, multiLine=True))


def read_import(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facet, options, concepts) of concept documents that are one import: one row, one row, and a row for each concept with
    its place ord, by file and then position. Files with different facets or options raise an error."""
    doc = import_documents(spark, path)
    facet = one_row(with_group(doc.where("facet IS NOT NULL").select("facet.*")), "facets")
    return facet, one_row(doc.where("importOptions IS NOT NULL").select("importOptions.*"), "options"), concept_rows(doc)


def read_imports(spark: SparkSession, path: str | list[str]) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
    """read_import of each file by itself, in the order of paths: documents with facets and options of their own."""
    files = import_documents(spark, path).select("file").distinct().orderBy("file")
    for row in files.toLocalIterator():
        yield read_import(spark, row["file"])


def concept_rows(doc: DataFrame) -> DataFrame:
    """A row for each concept of documents (file_no, concepts)."""
    each = doc.select("file_no", F.posexplode("concepts").alias("pos", "c"))
    return each.select((F.col("file_no") * FILE_ROWS + F.col("pos")).alias("ord"), typed_concept(F.col("c")).alias("c")).select("ord", "c.*")


def read_concept_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Concepts as JSON lines, for inputs too large for one document. Their order is that of a field ord, then of files and
    lines; without it, of files and lines alone."""
    rows = spark.read.schema("ord long, " + CONCEPT_JSON[len("struct<") : -1]).json(path)
    at = rows.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"),
    )
    at = at.withColumn("__given", F.coalesce("ord", F.lit(2**62)))
    named = at.select("__given", "__file", "__block", "__line", typed_concept(F.struct(*rows.drop("ord").columns)).alias("c"))
    return numbered(named, ["__given", "__file", "__block", "__line"], "ord").select("ord", "c.*")


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """(id1, id2, mapping_type)."""
    return spark.read.schema("id1 string, id2 string, mappingType string").json(path, multiLine=True).withColumnRenamed("mappingType", "mapping_type")


def read_facets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACET[len("struct<") : -1]).json(path, multiLine=True)


def relation_rows(doc: DataFrame) -> DataFrame:
    """(id_property, id_source, entry, doc, is_db, type, count, method, args array<array<string>>) of relation documents.
    entry is the place of a document's entry in all input: the file's time and path where doc has them (columns time and
    file), and the position in it. Without documents there are no rows."""
    at = [F.col(c) if c in doc.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("time", "timestamp"), ("file", "string"))]
    d = doc.select("id_property", "id_source", *at, F.posexplode("documents").alias("pos", "d"))
    d = d.select("id_property", "id_source", F.struct("time", "file", "pos").alias("entry"), "d")
    is_db = F.coalesce("d.db", "d.isDb", F.lit(False)).alias("is_db")
    r = d.select("id_property", "id_source", "entry", F.col("d.name").alias("doc"), is_db, F.explode("d.relations").alias("type", "rs"))
    return r.select(
        "id_property", "id_source", "entry", "doc", "is_db", "type", F.explode("rs").alias("r"),
    ).select("id_property", "id_source", "entry", "doc", "is_db", "type", "r.*")


def timed(df: DataFrame) -> DataFrame:
    """df of files with their times and paths."""
    return df.select("*", F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"))


def read_relations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return relation_rows(timed(spark.read.schema(RELATIONS).json(path, multiLine=True)))


def variant_rows(doc: DataFrame) -> DataFrame:
    """(kind, concept, doc, name, count, ord) of documents whose fields conceptTerms and conceptAcronyms hold JSON text."""
    inner = "map<string, map<string, map<string, int>>>"
    kinds = doc.select(F.explode(F.create_map(
        F.lit("writing_variant"), F.from_json("conceptTerms", inner), F.lit("acronym"), F.from_json("conceptAcronyms", inner),
    )).alias("kind", "m"))
    docs = kinds.select("kind", F.explode("m").alias("concept", "m")).select("kind", "concept", F.explode("m").alias("doc", "m"))
    return docs.select("kind", "concept", "doc", F.posexplode("m").alias("ord", "name", "count"))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    return variant_rows(spark.read.schema("conceptTerms string, conceptAcronyms string").json(path, multiLine=True))
