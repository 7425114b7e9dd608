"""A positional inverted index: phrases are found by the places of their words, without reading texts again."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "token string, doc string, positions array<int>, bucket int"
#: Postings are dealt to so many folders by token, so that a query reads those of its words alone.
BUCKETS = 64
#: Documents in a part that is indexed by one task.
PART = 4096


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, in order; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text), dealt by document to a part for each PART of them, at most as many as shuffles have."""
    parts = min(docs.count() // PART + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).repartition(parts, "doc")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, doc, positions, bucket): where each token stands in each document, from 0. Texts are dealt by document before they are
    cut, so that positions are gathered where they are. Texts without tokens, null ones included, have none; ids are given as text."""
    at = _dealt(docs, id_col, text_col).select("doc", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    own = at.groupBy("token", "doc").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return own.withColumn("bucket", _bucket(F.col("token")))


def write_index(docs: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Writes the postings, a folder for each bucket with a file, sorted by token, for each part of the documents; a folder that is
    there already raises an error. Only texts are shuffled, no postings."""
    made = postings(docs, id_col, text_col).sortWithinPartitions("bucket", "token")
    made.write.partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def words_of(phrase: str) -> list[str]:
    return re.findall(r"[^\W_]+", phrase.lower())


def find_phrase(index: DataFrame, phrase: str) -> DataFrame:
    """(doc, at): every place where the phrase's words stand next to each other. Only postings of its words are read. A phrase
    without words is nowhere."""
    words = words_of(phrase)
    spark = index.sparkSession
    if not words:
        return index.select("doc", F.lit(0).alias("at")).where("false")
    places: dict[str, list[int]] = {}
    for k, w in enumerate(words):
        places.setdefault(w, []).append(k)
    # the buckets as values, so that Spark reads no other folders
    asked = spark.createDataFrame(
        [(w, ks) for w, ks in places.items()], "token string, places array<int>",
    ).withColumn("bucket", _bucket(F.col("token"))).collect()
    some = index.where(F.col("bucket").isin(sorted({r["bucket"] for r in asked})) & F.col("token").isin(list(places)))
    at = F.create_map(*(x for w, ks in places.items() for x in (F.lit(w), F.array(*map(F.lit, ks)))))
    starts = F.flatten(F.transform(at[F.col("token")], lambda k: F.transform("positions", lambda p: p - k)))
    met = some.select("doc", F.explode(starts).alias("at"))  # a place comes once for each word that is where it must be
    return met.groupBy("doc", "at").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select("doc", "at")


def documents_with(index: DataFrame, phrase: str) -> DataFrame:
    """(doc) that hold the phrase."""
    return find_phrase(index, phrase).select("doc").distinct()


def one_document_with(index: DataFrame, phrase: str) -> str | None:
    """The document that holds the phrase; None if there is none, several raise an error."""
    found = documents_with(index, phrase).limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"more than one document with {phrase!r}")
    return found[0]["doc"] if found else None
