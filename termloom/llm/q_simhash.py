"""Query of SimHash near-dedup. SQL has no XXH64; tests/llm/test_simhash.py compares with all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .simhash import simhash_duplicates


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


QUERIES = {"op11_simhash_near_dedup": op11_simhash_near_dedup}
ORACLES: dict[str, str] = {}
