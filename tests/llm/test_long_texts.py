"""Texts of a million characters: every operator over documents takes them whole."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

queries = pytest.importorskip("termloom.llm.queries")

from test_simhash import plain_fingerprint  # noqa: E402
from test_text import prose  # noqa: E402

SHARED = "\n".join(prose(k, 12) for k in range(40))
ONE_WORD = "x" * 1_000_000
LONG = SHARED + "\n" + "\n".join(prose(1000 + k, 1500) for k in range(150)) + " cc by"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("long")
    texts = [SHARED, LONG, ONE_WORD, LONG + " end", ("a " * 500_000).strip()]
    assert min(map(len, texts[1:])) > 900_000
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([("i", LONG[500_000:520_000])], "item_id string, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), texts


def rows(spark, folder, name):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, folder[0]).collect()}


def test_line_dedup_and_near_dedup(spark, folder):
    got = rows(spark, folder, "op2_line_dedup")
    assert got[1]["n_dropped"] == 40 and got[2]["kept_sha256"] == hashlib.sha256(ONE_WORD.encode()).hexdigest()
    near = rows(spark, folder, "op3_minhash_near_dedup")
    assert [near[k]["component_id"] for k in range(5)] == [0, 1, 2, 1, 4] and near[4]["n_shingles"] == near[2]["n_shingles"] == 1


def test_bpe_gives_the_text_back(spark, folder):
    got = rows(spark, folder, "op5_byte_bpe")
    assert [got[k]["decoded_sha256"] for k in range(5)] == [hashlib.sha256(t.encode()).hexdigest() for t in folder[1]]


def test_decontamination(spark, folder):
    got = rows(spark, folder, "op7_decontamination")
    assert got[1]["n_hit"] == got[3]["n_hit"] > 2000 and got[1]["n_items"] == 1 and not got[1]["contaminated"] and got[2]["n_words"] == 1


def test_quality_and_licenses(spark, folder):
    quality = rows(spark, folder, "op9_quality_rules")
    assert [quality[k]["n_words"] for k in range(5)] == [len(t.split()) for t in folder[1]] and quality[4]["n_repeat_words"] == 500_000
    found = rows(spark, folder, "op10_license_scan")
    assert found[1]["n_base"] == 1 and found[1]["base_labels"] == "cc-by" and found[2]["n_words"] == 1


def test_simhash_and_phrases(spark, folder):
    got = rows(spark, folder, "op11_simhash_near_dedup")
    assert [int(got[k]["fingerprint"], 16) for k in (0, 1, 2)] == [plain_fingerprint(folder[1][k]) for k in (0, 1, 2)]
    top = queries.queries()["op12_phrase_mining"](spark, folder[0]).where(F.col("phrase") == "a a a a a").collect()
    assert [(r["a"], r["lang"]) for r in top] == [(499_996, "en")]
