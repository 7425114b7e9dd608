"""Relations as a stream: JSON documents that arrive in a folder are merged into stored tables.

Every row carries its place in all input (the file's time and path, and the position in it), and what counts of a relation
is decided by these places alone. So the result doesn't depend on how files fall into batches, and a batch only appends its
own rows; now and then all rows so far become one base table, which bounds what a reader merges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import counted_at, first_methods, latest_counts, relation_pairs
from ..plans.iterate import remove_folder
from ..sources.documents import RELATIONS, relation_rows, timed

AT = "at struct<time:timestamp,file:string,pos:int>"
STORED = f"type string, u string, v string, doc string, count long, {AT}"
DATABASES = f"type string, u string, v string, db_name string, method string, {AT}"
#: After so many batches their rows become one base.
COMPACT_EVERY = 16


def relation_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Relation rows of JSON documents in folder, old and new ones."""
    files = spark.readStream.schema(RELATIONS).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch)
    return relation_rows(timed(files.json(folder)))


def _versions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows in path with their version; none if there is no such folder yet."""
    try:
        return spark.read.schema(f"{schema}, version long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, version long")


def _base(spark: SparkSession, path: str, n: int) -> int:
    """The last base up to batch n; -1 if there is none. Bases are marked once they are whole."""
    marks = _versions(spark, f"{path}/marks", "base long").where(F.col("base") <= n)
    return marks.agg(F.coalesce(F.max("base"), F.lit(-1)).alias("b")).first()["b"]


def _read(spark: SparkSession, path: str, n: int, schema: str, merged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    base = _base(spark, path, n)
    late = _versions(spark, f"{path}/rows", schema).where((F.col("version") > base) & (F.col("version") <= n))
    return merged(_versions(spark, f"{path}/base", schema).where(F.col("version") == base).unionByName(late).drop("version"))


def read_version(spark: SparkSession, path: str, n: int) -> DataFrame:
    """relation_docs after batch n; before the first there are none."""
    return _read(spark, path, n, STORED, latest_counts).drop("at")


def read_databases(spark: SparkSession, path: str, n: int) -> DataFrame:
    """relation_dbs after batch n."""
    return _read(spark, f"{path}/databases", n, DATABASES, first_methods).drop("at")


def compact(spark: SparkSession, path: str, n: int, schema: str, merged: Callable[[DataFrame], DataFrame]) -> None:
    """Writes all rows up to batch n as a base."""
    if _base(spark, path, n) < n:
        _read(spark, path, n, schema, merged).write.mode("overwrite").parquet(f"{path}/base/version={n}")
        spark.createDataFrame([(n,)], "base long").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/version={n}")


def expire(spark: SparkSession, path: str, n: int) -> None:
    """Removes what only versions before n need: batches and bases that the last base up to n replaces."""
    for at in (path, f"{path}/databases"):
        base = _base(spark, at, n)
        for part, schema in (("rows", "u string"), ("base", "u string"), ("marks", "base long")):
            old = _versions(spark, f"{at}/{part}", schema).where(F.col("version") <= base - (part != "rows")).select("version").distinct()
            for row in old.toLocalIterator():
                remove_folder(spark, f"{at}/{part}/version={row['version']}")


def start_import(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False, resolve: Callable[[DataFrame], DataFrame] | None = None):
    """Starts the stream that merges rows' relations: those of literature into relation_docs, those of databases into
    relation_dbs. Batch n makes version n, and the same if it is run again after a failure.

    resolve turns a batch's arguments into nodes (resolved_arguments with a graph's tables); without it they are taken as
    ids that are resolved already."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        known = resolve(batch) if resolve else batch.withColumn("args", F.transform("args", lambda a: F.get(a, F.lit(0))))
        pairs = relation_pairs(known)
        counts = counted_at(pairs.where("NOT is_db"))
        methods = first_methods(pairs.where("is_db").select("type", "u", "v", F.col("doc").alias("db_name"), "method", F.col("entry").alias("at")))
        text = {c: F.col(c).cast("string") for c in ("u", "v")}
        for at, part, schema, merged in ((path, counts, STORED, latest_counts), (f"{path}/databases", methods, DATABASES, first_methods)):
            part.withColumns(text).write.mode("overwrite").parquet(f"{at}/rows/version={n}")
            if n % COMPACT_EVERY == COMPACT_EVERY - 1:
                compact(spark, at, n, schema, merged)

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
