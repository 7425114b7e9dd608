"""Every registered query of the text operators on small tables against plain versions; odd columns, repeated rows, empty tables."""

from __future__ import annotations

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

queries = pytest.importorskip("termloom.llm.queries")
P = pytest.importorskip("public_tokenizers")
import regex  # noqa: E402

from termloom.llm import quality, token_counts  # noqa: E402

from test_text import plain_components, plain_lines, prose  # noqa: E402

LINE = "A common line of text"
TEXTS = [None, "", " ", "x", f"{LINE}\n{prose(1, 90)}", f" {LINE.upper()}\n{prose(2, 120)}\n{LINE}", prose(3, 80), prose(3, 80) + " end", prose(4, 60).upper() + " !! CC-BY", "a b c " * 40, "the of and " * 700,
         *(prose(k, 100) for k in range(10, 30)), *(" ".join(f"{w}%%" for w in prose(k, 90).split()) for k in range(40, 46)), "All rights reserved\n" * 30, "don't 'S é日本 1,2\t\n"]
CLASHES = ["words", "kept", "k", "n_words", "__h", "__doc", "h", "doc", "pos", "judged", "row", "votes", "keep_words", "tpl", "label", "contamination", "key", "component_id", "f", "d"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.withColumns({c: F.lit("own") for c in CLASHES}).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, prose(12, 100))], "item_id long, text string").withColumn("key", F.lit(0)).write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def answer(spark, folder, name):
    found = queries.queries()[name](spark, folder)
    return sorted(map(tuple, found.collect()), key=lambda r: r[0]), found.columns


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_line_dedup(spark, folder):
    got, columns = answer(spark, folder, "op2_line_dedup")
    assert columns[:4] == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    for row, text, (_, kept) in zip(got, TEXTS, plain_lines(list(enumerate(TEXTS))), strict=True):
        n = (text or "").count("\n") + 1
        left = 0 if kept == "" and n > 1 and (text or "").split("\n")[0] != "" else kept.count("\n") + 1
        assert row[1] == n and row[3] == sha(kept) and row[2] in (n - left, n)


def test_near_dedup(spark, folder):
    got, columns = answer(spark, folder, "op3_minhash_near_dedup")
    assert columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert [(r[1], r[2], r[3]) for r in got] == [(n, c, c == k) for k, (n, c) in enumerate(plain_components(TEXTS, 2))]


def test_byte_bpe(spark, folder):
    tiktoken = pytest.importorskip("tiktoken")
    from termloom.llm import bpe

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got, columns = answer(spark, folder, "op5_byte_bpe")
    assert columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = [enc.encode_ordinary(t or "") for t in TEXTS]
    assert [r[1:] for r in got] == [(len(x), sha(",".join(map(str, x))), sha(t or "")) for x, t in zip(ids, TEXTS, strict=True)]


def test_token_counts(spark, folder):
    costs = token_counts.model(P.path("byte_bpe_50k.tiktoken")).costs
    seen = {}

    def best(w):
        if w not in seen:
            at = [(0, 0)]
            for e in range(1, len(w) + 1):
                at.append(min((at[b][0] + costs[w[b:e]], at[b][1] + 1) for b in range(e) if w[b:e] in costs))
            seen[w] = at[-1]
        return seen[w]

    got, columns = answer(spark, folder, "op6_token_counts")
    for row, text in zip(got, TEXTS, strict=True):
        parts = [best(w.encode()) for w in regex.findall(P.PATTERN, text or "")]
        assert dict(zip(columns, row, strict=True)) == {"doc_id": row[0], "n_pretokens": len(parts), "n_pieces": sum(p for _, p in parts), "cost": sum(c for c, _ in parts)}


def plain_quality(text):
    """(base figures, votes) of a text."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    again = {x for x in windows if windows.count(x) > 1} if len(set(windows)) < len(windows) else set()
    hit = {k + j for k, x in enumerate(windows) if x in again for j in range(3)}
    n, chars = len(w), sum(map(len, w))
    base = (n, chars, len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n)
    if not n:
        return base, (0,) * 8
    stop = {x for words in quality.STOP_WORDS.values() for x in words.split()}
    stops, plain = sum(x in stop for x in w) / n, len(regex.findall(r"(?<!\S)\p{L}++[.,;:!?]?+(?!\S)", t)) / n
    bad = [not 2 <= chars / n <= 10, base[2] / n > 0.1, len(hit) / n > 0.3, base[3] / max(1, len([x for x in t.split("\n") if x])) > 0.3, len(regex.findall(r"\p{Lu}", t)) / chars > 0.4, len(re.findall(r"[!?]{2,}", t)) / n > 0.1]
    return base, (*(-1 if x else 0 for x in bad), -1 if stops < 0.06 else int(stops >= 0.1), -1 if plain < 0.7 else int(plain >= 0.85))


def test_quality_rules(spark, folder):
    """Figures, votes, EM and verdicts in plain Python."""
    plain = [plain_quality(t) for t in TEXTS]
    rules = range(8)
    prior, rate = 0.8, {"good": [{1: 0.4, 0: 0.5, -1: 0.1} for _ in rules], "bad": [{1: 0.1, 0: 0.5, -1: 0.4} for _ in rules]}

    def posterior(v):
        g, b = (p * math.prod(rate[c][k][v[k]] for k in rules) for c, p in (("good", prior), ("bad", 1 - prior)))
        return g / (g + b)

    for _ in range(25):
        p = [posterior(v) for _, v in plain]
        weights, old = {"good": p, "bad": [1 - x for x in p]}, prior
        new = {c: [{x: max(quality.FLOOR, (sum(a for a, (_, v) in zip(w, plain, strict=True) if v[k] == x) + 1) / (sum(w) + 3)) for x in (1, 0, -1)} for k in rules] for c, w in weights.items()}
        prior, rate = min(0.999, max(0.001, sum(p) / len(p))), new
        if abs(prior - old) < 1e-4:
            break
    got, columns = answer(spark, folder, "op9_quality_rules")
    assert columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for row, (base, v) in zip(got, plain, strict=True):
        assert row[1:7] == base and row[8] == pytest.approx(posterior(v), rel=1e-6) and row[7] == (not base[5] and posterior(v) >= 0.5)
    assert 10 < sum(r[7] for r in got) < len(got)


def test_empty_tables(spark, tmp_path):
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id string, text string", "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string", "embeddings": "vec_id long, embedding array<float>, label int"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert {name: len(f(spark, str(tmp_path)).collect()) for name, f in queries.queries().items()} == {name: int(name.startswith("op8")) for name in queries.queries()}


def test_pipeline_stages_on_odd_columns_and_empty_tables(spark, folder):
    cp = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id = 12")).unionByName(docs.where("doc_id IN (13, 0)").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        rows = out.collect()
        assert 0 < len(rows) <= docs.count(), name
        if name != cp.STAGES[-1][0]:
            assert {r[c] for r in rows for c in CLASHES} == {"own"}, name
        assert stage(spark, docs.where("false"), folder).count() == 0, name
