"""Writing variants and acronyms of concepts, counted by document; and phrase search in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import normalized_variant


def words_of_texts(docs: DataFrame, concept: Column, doc: Column, text: Column, pattern: str) -> DataFrame:
    """Rows of counted_variants: a writing variant for each part of each text between matches of pattern. Texts are dealt by
    document before they are cut, so that what belongs to a document meets in one task and only texts are shuffled for it."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as a number: few parts hold too many words each
    texts = docs.select(concept.alias("concept"), doc.alias("doc"), text.alias("text")).repartition(parts, "doc")
    words = texts.select("concept", "doc", F.explode(F.split("text", pattern)).alias("name")).where("name <> ''")
    return words.select(F.lit("writing_variant").alias("kind"), "*", F.lit(1).alias("count"), F.lit(0).alias("ord"))


def counted_variants(rows: DataFrame) -> DataFrame:
    """(kind, concept, norm, name, doc, count) from rows (kind, concept, doc, name, count, ord): what is equal after
    normalisation adds up within a document and keeps its first surface form. Rows that are dealt by doc stay where they are."""
    r = rows.withColumn("norm", normalized_variant("name"))
    # norm first: most rows differ there, so they are sorted by it without a look at the rest
    merged = r.groupBy("norm", "concept", "doc", "kind").agg(
        F.min_by("name", F.struct("ord", "name")).alias("name"), F.sum("count").cast("long").alias("count"),
    )
    return merged.select("kind", "concept", "norm", "name", "doc", "count")


def upsert_variants(stored: DataFrame, incoming: DataFrame, concepts: DataFrame) -> DataFrame:
    """Stored counts after an import: incoming documents' counts replace theirs, surface forms stay, unknown concepts
    are skipped."""
    key = ["kind", "concept", "norm", "doc"]
    new = incoming.join(concepts.select(F.col("node").alias("concept")).distinct(), "concept", "left_semi")
    names = stored.groupBy("kind", "norm").agg(F.min("name").alias("__name"))
    new = new.join(names, ["kind", "norm"], "left").withColumn("name", F.coalesce("__name", "name")).drop("__name")
    cols = ["kind", "concept", "norm", "name", "doc", "count"]
    return stored.select(cols).join(new.select(key), key, "left_anti").unionByName(new.select(cols))


def variants_of(variants: DataFrame, kind: str, concept: str) -> DataFrame:
    """(norm, name, documents, counts): a concept's variants of a kind, documents sorted."""
    v = variants.where((F.col("kind") == kind) & (F.col("concept") == concept)).groupBy("norm").agg(
        F.min("name").alias("name"), F.array_sort(F.collect_list(F.struct("doc", "count"))).alias("d"),
    )
    return v.select("norm", "name", F.col("d")["doc"].alias("documents"), F.col("d")["count"].alias("counts"))


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether the words of phrase stand next to each other in text; words are runs of letters and digits, case aside."""
    flat = F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " ")), F.lit(" "))
    words = F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(F.lit(phrase)), "[^\\p{L}\\p{N}]+", " ")), F.lit(" "))
    return flat.contains(words)


def has_token(text: Column, token: str) -> Column:
    """Whether token is one of the text's parts between white space."""
    return F.array_contains(F.split(F.coalesce(text, F.lit("")), "\\s+"), token)
