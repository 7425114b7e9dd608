"""Query of the quality rules. EM has no SQL form; tests hold it against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality import FIGURES, with_judgement


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = with_judgement(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return judged.select("doc_id", *(f"judged.{c}" for c in (*FIGURES, "kept", "quality")))


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES: dict[str, str] = {}
