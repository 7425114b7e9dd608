"""The corpus pipeline: quality rules, line dedup, near dedup, decontamination, tokens.

Each stage reads what the stage before has written. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import bpe
from termloom.llm.common import free_name, quoted, table
from termloom.llm.decontamination import decontaminate
from termloom.llm.line_dedup import deduplicate_lines
from termloom.llm.near_dup import drop_near_duplicates
from termloom.llm.quality import with_judgement
from termloom.plans.iterate import checkpoint_folder, remove_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the label model reject go."""
    out = free_name(docs, "judged")
    return with_judgement(docs, out=out).where(F.col(out)["kept"]).select(quoted(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go; n_chars follows."""
    return deduplicate_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(quoted(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose 5-word shingles overlap by 80 percent or more, the one with the smallest id stays."""
    return drop_near_duplicates(docs, width=5, percent=80).select(quoted(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(quoted(docs))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and whether they decode to its text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return docs.select("doc_id", "lang", "source", bpe.round_trip(F.col("text"), path, public_tokenizers.PATTERN).alias("t")).select("doc_id", "lang", "source", F.size("t.token_ids").cast("long").alias("n_tokens"), "t.token_ids", "t.round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: EM, MinHash and BPE have no SQL form; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written as Parquet to the shared checkpoint folder and reread. Once the
    next one is written, its table goes."""
    docs, last = table(spark, sf_dir, "documents"), None
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove_folder(spark, f"{folder}/{last}")
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
