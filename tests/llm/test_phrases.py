"""Phrase mining against plain counts."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

phrases = pytest.importorskip("termloom.llm.phrases")
from pyspark.sql import functions as F  # noqa: E402


def plain_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for part, text in rows:
        part = "und" if part is None else part
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[part] += len(w)
            f.update((part, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = {}
    frequent = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    inner = {(p, w[i : i + m]) for (p, w), a in frequent.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if a >= f[p, w[i : i + m]]}
    for (p, w), a in frequent.items():
        if (p, w) not in inner:
            score, _, l, r = min((1000 * a * n[p] // (f[p, w[:k]] * f[p, w[k:]]), k, f[p, w[:k]], f[p, w[k:]]) for k in range(1, len(w)))
            out.setdefault(p, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((p, k + 1, ph.decode(), -a, l, r, n[p], -s) for p, found in out.items() for k, (s, a, ph, l, r) in enumerate(sorted(found)[:top]))


def texts(seed, count):
    r = random.Random(seed)
    words = ["a", "B", "c\x01", "\x00", "d", "é", "日本", "x y", "e\x08", "f\x7f", "\U0001f600", "don't"]
    for _ in range(count):
        yield "".join(r.choice(words[: r.choice([2, 4, 12])]) + r.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", "\x0b"]) for _ in range(r.choice([0, 1, 5, 60, 300])))


ROWS = [(p, t) for k, p in enumerate(["en", "en", "en", "de", None, ""]) for t in texts(k, 25)] + [("en", None), (None, None), (None, "a b"), ("fr", ""), ("en", "new york city " * 40), ("en", "new york city " * 40)]


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    if small:  # shards, ranges, blocks and sweeps of a few windows, texts in slices
        for name, value in {"SHARD": 400, "SWEEP": 150, "BLOCK": 64, "RANGE_BYTES": 3000, "SLICE": 100}.items():
            monkeypatch.setattr(phrases, name, value)
    d = spark.createDataFrame(ROWS, "lang string, text string").withColumns({c: F.lit("own") for c in ("part", "g", "phrase", "a", "depth", "block")}).repartition(3)
    for least, top in ((2, 2000), (20, 7)):
        got = sorted(map(tuple, phrases.collocations(d, least=least, top=top).collect()))
        want = plain_collocations(ROWS, least, top)
        assert len(want) > 10 and got == want


def test_many_ranges_and_open_nodes_in_one_process(spark, monkeypatch):
    """With tiny limits most nodes lie on a border of several swept parts."""
    rows = [("en", t) for t in texts(9, 40)]
    monkeypatch.setattr(phrases, "RANGE_BYTES", 300)
    d = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    splitters, _, n = phrases.prefix_ranges(d.withColumnRenamed("lang", "part"))
    assert n > 5 and splitters["en"] == sorted(splitters["en"])
    monkeypatch.setattr(phrases, "SWEEP", 20)
    monkeypatch.setattr(phrases, "BLOCK", 8)
    assert sorted(map(tuple, phrases.collocations(d, least=2).collect())) == plain_collocations(rows, 2, 2000)


def test_blocks_round_trip():
    from termloom.llm.bpe import Numbered

    r = random.Random(5)
    words = [b"w%d" % k for k in range(50)]
    for n in (1, 2, 700):
        c = [[r.randrange(1, 51) for _ in range(n)] for _ in range(5)]
        for k in range(n):
            for d in range(r.randint(1, 5), 5):
                c[d][k] = 0
        w = phrases.Windows(phrases.np.array(c, phrases.np.int32), phrases.np.array([r.choice([1, 2**40 + 5]) for _ in range(n)]), words)
        known = Numbered()
        columns, counts = phrases.read_block(w.block(0, len(w)), known)
        back = phrases.Windows(columns, counts, list(known))
        assert [back.key(k) for k in range(len(back))] == [w.key(k) for k in range(len(w))] and (back.counts == w.counts).all()


def test_scores_beyond_64_bits(spark):
    """Counts of 10**9 and more: 1000 * a * n passes 64 bits."""
    nodes = [("p", "", 0, 3 * 10**12, True, []), ("p", "x", 1, 10**12, False, []), ("p", "y", 1, 7 * 10**11, False, []), ("p", "x y", 2, 6 * 10**11 + 1, False, [10**12])]
    held = spark.createDataFrame(nodes, phrases.NODES)
    from unittest.mock import patch

    with patch.object(phrases, "count_nodes", lambda texts, least: held):
        got = phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect()
    assert [tuple(r) for r in got] == [("p", 1, "x y", 6 * 10**11 + 1, 10**12, 7 * 10**11, 3 * 10**12, 1000 * (6 * 10**11 + 1) * 3 * 10**12 // (7 * 10**23))]


def test_empty_and_one_part(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).collect() == []
    one = phrases.collocations(spark.createDataFrame([("a", "x y"), ("b", "x y")], "lang string, text string"), part_col=None, least=2).collect()
    assert [tuple(r) for r in one] == [("", 1, "x y", 2, 2, 2, 4, 2000)]
