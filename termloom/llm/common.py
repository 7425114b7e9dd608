"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import checkpoint_folder, remove_folder

#: The white space that separates words: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the checkpoint folder; its lineage ends there. Spark removes it when nothing refers to it any more,
    if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one operator, as Parquet in a folder of their own in the checkpoint folder, which goes at the end.

    Calling it writes a DataFrame there and rereads it. As after checkpointed() its lineage ends there; in addition Spark
    knows its size, so it packs small files into few tasks and needs no shuffle to join small tables. What the operator
    returns must not depend on the folder: it is checkpointed before the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{checkpoint_folder(spark)}/scratch-{uuid.uuid4()}"

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4()}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove_folder(self.spark, self.folder)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many _ before it as make it no column of df (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(df: DataFrame) -> list[Column]:
    """df's columns, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once a row, however often body's lambdas look at it."""
    return F.transform(F.array(value), body).getItem(0)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. lower() does the same where every character is one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def blank_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
