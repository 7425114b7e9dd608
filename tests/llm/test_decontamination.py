"""Decontamination: windows that very many items share, long matches, repeated rows, and the registered query."""

from __future__ import annotations

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

dec = pytest.importorskip("termloom.llm.decontamination")
from termloom.llm.q_decontamination import op7_decontamination  # noqa: E402

from test_text import plain_hits, prose  # noqa: E402


def test_a_window_that_thousands_of_items_share_is_linear():
    """2000 items and 2000 occurrences of their common window: 4 million pairs, none of which is listed."""
    common = prose(1, 13)
    items = [(str(k), f"{common} tail{k}") for k in range(2000)]
    texts = [" . ".join([common] * 2000), common, "other " + common.upper()]
    begin = time.time()
    got = dec.match_shard(texts, dec.TestSet(items))
    assert time.time() - begin < 20
    assert [(r[0], r[1], len(r[2])) for r in got] == [(26000, 26000, 2000), (13, 13, 2000), (14, 13, 2000)]
    assert got[0][3] == 13 and got[2][5] == 1


def test_longest_match_by_brute_force():
    r = random.Random(5)
    for _ in range(60):
        item_words = [[r.choice("abc") for _ in range(r.randint(1, 40))] for _ in range(6)]
        docs = [[r.choice("abcd") for _ in range(r.randint(0, 30))] + r.choice(item_words)[: r.randint(0, 40)] + [r.choice("abcd") for _ in range(5)] for _ in range(5)]
        test = dec.TestSet([(str(k), " ".join(w)) for k, w in enumerate(item_words)], window=4)
        for w, got in zip(docs, dec.match_shard([" ".join(d) for d in docs], test), strict=True):
            best, hit, names = 0, set(), set()
            for k, item in enumerate(item_words):
                least = min(4, len(item))
                for a in range(len(item)):
                    for p in range(len(w)):
                        n = 0
                        while a + n < len(item) and p + n < len(w) and item[a + n] == w[p + n]:
                            n += 1
                        if n >= least and (least == 4 or a == 0):
                            best = max(best, n)
                            hit |= set(range(p, p + n))
                            names.add(str(k))
            assert (got[0], got[1], got[2], got[3]) == (len(w), len(hit), sorted(names), best)
            if best:
                item = item_words[int(got[4])]
                assert any(item[a : a + best] == w[got[5] : got[5] + best] for a in range(len(item)))


@pytest.mark.parametrize("block", [10**9, 300])
def test_repeated_rows_ids_and_clashing_columns(spark, block):
    items = [(1, prose(1, 20)), (1, prose(2, 20)), (1, prose(1, 20)), (2, prose(3, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1))
    texts = [prose(1, 20) + " " + prose(2, 20)] * 2 + [prose(3, 20), None, None, ""]
    rows = [(7 if k < 2 else None if k == 3 else k, t, "old", 5, "k", "m", "s") for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, contamination string, n_words int, key string, m string, spans string").withColumn("a.b", F.lit("dot"))
    out = dec.find_contamination(d, bench, out="found", block_chars=block)
    assert out.columns == [*d.columns, "found"]
    got = sorted((r.found.n_words, r.found.n_hit, tuple(r.found["items"]), r.found.longest, r.contamination, r.key) for r in out.collect())
    assert got == sorted([(40, 40, ("1",), 20, "old", "k")] * 2 + [(20, 20, ("2",), 20, "old", "k")] + [(0, 0, (), 0, "old", "k")] * 3)
    kept = dec.decontaminate(d, bench)
    assert kept.columns == d.columns and kept.count() == 3


def test_query_matches_a_plain_version(spark, tmp_path):
    items = [(f"i{k}", prose(100 + k, 30)) for k in range(5)] + [("n", None), ("s", "short one")]
    texts = [None, "", prose(1, 50), prose(100, 30) + " " + prose(2, 900), prose(101, 13) + " " + prose(102, 30), "a short one is here"]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op7_decontamination(spark, str(tmp_path)).orderBy("doc_id").collect()
    for r, (n, hit, names) in zip(got, plain_hits(texts, items), strict=True):
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(names), digest, hit > 0 and 20 * hit >= n)


def test_many_blocks_equal_one(spark):
    """Items of all lengths in blocks of their own, with texts that hold windows, parts of windows or nothing of them."""
    r = random.Random(8)
    items = [(str(k), prose(300 + k, r.choice([1, 2, 5, 12, 13, 14, 40]))) for k in range(40)] + [(None, prose(7, 20)), ("e", "")]
    texts = [" ".join([prose(500 + k, 30), *(" ".join(t.split()[: r.randint(1, 40)]) for _, t in r.sample(items, 3)), prose(900 + k, r.choice([0, 30]))]) for k in range(60)] + [None, "", texts_of(items)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    one, many = (sorted(dec.find_contamination(d, bench, block_chars=n).collect(), key=lambda x: x.doc_id) for n in (10**9, 200))
    assert [x.contamination[:4] for x in one] == [x.contamination[:4] for x in many] and [x.contamination.spans for x in one] == [x.contamination.spans for x in many]
    assert 5 < sum(x.contamination.n_hit > 0 for x in one) < len(texts)


def texts_of(items):
    return " . ".join(t for _, t in items)
