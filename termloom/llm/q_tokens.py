"""Queries of the tokenizers. SQL can't express them; tests hold them against plain versions and a round trip."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, token_counts
from .common import table


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = docs.select("doc_id", bpe.digests(F.col("text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).alias("d"))
    return done.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = docs.select("doc_id", token_counts.token_counts(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).alias("c"))
    return done.select("doc_id", "c.n_pretokens", "c.n_pieces", "c.cost")


QUERIES = {"op5_byte_bpe": op5_byte_bpe, "op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
