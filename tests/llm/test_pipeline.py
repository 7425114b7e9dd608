"""The whole pipeline against plain versions of its stages on a small corpus."""

from __future__ import annotations

import random

import pytest

cp = pytest.importorskip("corpus_pipeline")
pytest.importorskip("termloom.llm.queries")

from test_text import DOCS, plain_components, plain_hits, plain_lines, prose  # noqa: E402


def test_pipeline(spark, tmp_path):
    items = [(k, prose(5000 + k, 40)) for k in range(3)]
    texts = [prose(k, 90) + "\n" + prose(700 + k % 3, 30) for k in range(40)]
    texts += [texts[0], " ".join([*texts[1].split()[:-2], "z", "z"]), prose(60, 70) + " " + items[1][1], "too short", None, ""]
    texts += [" ".join(f"{w}%%%" for w in prose(k, 100).split()) for k in range(8)]
    random.Random(1).shuffle(texts)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(i, t) for i, t in enumerate(texts) if t and len(t.split()) >= 50 and "%%%" not in t]
    kept = plain_lines(kept)
    comp = plain_components([t for _, t in kept], 5)
    kept = [x for k, x in enumerate(kept) if comp[k][1] == k]
    hits = plain_hits([t for _, t in kept], items)
    kept = [x for x, (n, hit, _) in zip(kept, hits, strict=True) if not (hit > 0 and 20 * hit >= n)]

    got = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in kept} and all(r.round_trip for r in got)
    assert [name for name, _ in cp.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "byte_level_bpe"]
