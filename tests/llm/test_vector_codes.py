"""Vector codes against plain arithmetic."""

from __future__ import annotations

import hashlib
import math
import random

import pytest

codes = pytest.importorskip("termloom.llm.vector_codes")
import numpy as np  # noqa: E402


def plain(rows, dims):
    kept = [(i, lab, [math.floor(x * 256) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [k for k in kept if len(k[2]) == dims]
    size = dims // 16
    ids = sorted({k[0] for k in kept}, key=lambda i: (i is None, i))[:64]
    first = [min(v for i, _, v in kept if i == x) for x in ids]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for v in first] for p in range(16)]
    near = lambda y, book: min((sum((a - b) ** 2 for a, b in zip(y, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(2):
        new = []
        for p in range(16):
            of = {}
            for _, _, v in kept:
                of.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            new.append([[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for i, lab, v in kept:
        found = [near(cut(v, p), books[p]) for p in range(16)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        sums[lab] = sums.get(lab, 0) + out[-1][2]
    return sorted(((i, c, e, sums[lab], digest) for i, c, e, lab in out), key=repr)


@pytest.mark.parametrize(("dims", "count"), [(16, 30), (64, 250), (96, 90)])
def test_compress(spark, dims, count):
    r = random.Random(dims)
    vector = lambda: [r.choice([r.gauss(0, 0.2), r.randint(-2, 2) / 256, 0.0]) for _ in range(dims)]
    rows = [(k, vector(), r.choice([1, 2, None])) for k in r.sample(range(1000), count)]
    rows += [(k, rows[0][1], 2) for k in range(2000, 2010)] + [rows[3], rows[3], (rows[3][0], vector(), 1), (None, vector(), 1), (5000, vector()[:-1] + [float("nan")], 1), (5001, [None] + vector()[1:], 1), (5002, None, 1)]
    rows += [(5003, [float("-inf")] + vector()[1:], 1), (5004, vector()[:-1], 1), (5005, [], 1), (None, [1e3] * dims, None)]
    d = spark.createDataFrame([(i, v, x, "own") for i, v, x in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = sorted(map(tuple, codes.compress(d).collect()), key=repr)
    assert got == plain(rows, dims)


def test_nearest_is_exact_with_ties():
    r = np.random.default_rng(3)
    for dims, spread in ((1, 3), (2, 4), (3, 2), (4, 100000), (8, 2), (6, 4_000_000)):
        x, e = r.integers(-spread, spread, (500, dims)), r.integers(-spread, spread, (40, dims))
        e[7], e[20] = e[3], x[5]
        d = ((x[:, None] - e[None]) ** 2).sum(axis=2)
        entry, error = codes.nearest(x, e)
        assert (entry == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_bounds_filter_entries():
    """Lower bounds never pass the distance, and finer ones are higher."""
    r = np.random.default_rng(4)
    x, e = r.integers(-300, 300, (200, 8)), r.integers(-300, 300, (64, 8))
    d, last = ((x[:, None] - e[None]) ** 2).sum(axis=2), None
    for (s, n), (es, en) in zip(codes.sketches(x), codes.sketches(e), strict=True):
        bound = codes.lower_bound(s[:, None], n[:, None], es[None], en[None], 8 / s.shape[1], 1.0)
        assert (bound <= d).all()
        assert last is None or bound.sum() > last.sum()
        last = bound
    assert codes.levels(8) == [1, 2, 4] and codes.levels(4) == [1, 2] and codes.levels(6) == [1, 2] and codes.levels(1) == [1]


def test_no_vectors_and_bad_lengths(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert codes.compress(d).collect() == []
    with pytest.raises(ValueError, match="16 equal parts"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 5, 1)], "vec_id long, embedding array<float>, label int"))
