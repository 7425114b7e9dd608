"""SimHash near-dedup against all pairs."""

from __future__ import annotations

import random
import re

import pytest

simhash = pytest.importorskip("termloom.llm.simhash")
import numpy as np  # noqa: E402
import xxhash  # noqa: E402

from test_text import prose  # noqa: E402


def plain_fingerprint(text, width=3):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    """Component of each row: smallest id over links of at most 3 bits and equal ids; none for null ids."""
    rows = [k for k, i in enumerate(ids) if i is not None]
    at = {k: k for k in rows}

    def top(k):
        while at[k] != k:
            k = at[k]
        return k

    for x in rows:
        for y in rows:
            if x < y and (ids[x] == ids[y] or (fps[x] ^ fps[y]).bit_count() <= 3):
                at[top(x)] = top(y)
    low = {}
    for k in rows:
        low[top(k)] = min(low.get(top(k), ids[k]), ids[k])
    return [low[top(k)] if k in at else None for k in range(len(ids))]


def answer(spark, rows, **options):
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = simhash.simhash_duplicates(d, **options).collect()
    return sorted(map(tuple, got), key=repr)


def test_texts(spark):
    texts = [None, "", " \t\n", "x", "X", "a b", "A  b", "a b c", "é日本 ẞ don't", *(prose(k, 60) for k in range(8)), prose(1, 60) + " end", prose(2, 60).upper(), prose(3, 400), prose(3, 400)[:-4], "word " * 3000]
    rows = list(enumerate(texts)) + [(3, prose(1, 60)), (None, "x"), (None, None), (0, "x")]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, plain_components([i for i, _ in rows], fps), strict=True)]
    assert answer(spark, rows) == sorted(want, key=repr)


def test_long_text_in_slices(monkeypatch):
    text = "\n".join(prose(k, 200) for k in range(20))
    monkeypatch.setattr(simhash, "SLICE", 50)
    monkeypatch.setattr(simhash, "SLAB", 7)
    for t in (text, text + " ", "a b", "a" * 300, "a " * 60 + "b" * 120, " "):
        assert simhash.fingerprint(t, 3) & (1 << 64) - 1 == plain_fingerprint(t)


@pytest.mark.parametrize("long_list", [simhash.LONG_LIST, 4])
def test_links_connect_what_all_pairs_connect(spark, long_list):
    """Families of near fingerprints, dense ones and such at a distance of 3 and 4; lists that are cut further, too."""
    r = random.Random(long_list)
    fps = {0, 2**64 - 1, *(r.getrandbits(64) for _ in range(60))}
    for _ in range(25):
        base = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 30])):
            fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))))
    base = r.getrandbits(64)
    fps |= {base ^ sum(1 << b for b in r.sample(range(12), r.randint(0, 12))) for _ in range(120)}
    fps = sorted(fps)
    d = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    links = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.fingerprint_links(d, long_list).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    place = {f: k for k, f in enumerate(fps)}
    at = list(range(len(fps)))

    def top(k):
        while at[k] != k:
            k = at[k]
        return k

    for a, b in links:
        at[top(place[a])] = top(place[b])
    low = {}
    for k in range(len(fps)):
        low[top(k)] = min(low.get(top(k), k), k)
    assert [low[top(k)] for k in range(len(fps))] == plain_components(list(range(len(fps))), fps)
    few, many = simhash.postings(d, long_list)
    assert few.count() + many.count() == 64 * len(fps) and (many.count() > 0) == (long_list == 4)


def test_a_pair_counts_under_one_of_its_keys():
    r = random.Random(1)
    for _ in range(300):
        differ = sum(1 << b for b in r.sample(range(64), r.randint(1, 5)))
        under = [k for k in range(64) if simhash.counts_here(np.array([differ], np.uint64), k)[0]]
        assert len(under) == (differ.bit_count() <= 3)


def test_ids_of_any_type(spark):
    d = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), ("c", "else")], "doc_id string, text string")
    assert {r["doc"]: r["component_id"] for r in simhash.simhash_duplicates(d).collect()} == {"a": "a", "b": "a", "c": "c"}
