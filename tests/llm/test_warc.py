"""The Merkle audit against a plain comparison of multisets, and WARC files of any payload."""

from __future__ import annotations

import gzip
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

warc = pytest.importorskip("termloom.llm.warc")
from termloom.llm.common import checkpointed  # noqa: E402

SCHEMA = "page_id long, url string, html string"


def plain_damage(a, b):
    """(key, how many altered, missing, extra) of two lists of (key, url, html)."""
    of = lambda rows: {k: Counter((u or "", h or "") for x, u, h in rows if x == k) for k in {x[0] for x in rows}}
    a, b, out = of(a), of(b), {}
    for k in a.keys() | b.keys():
        gone, new = (a.get(k, Counter()) - b.get(k, Counter())).total(), (b.get(k, Counter()) - a.get(k, Counter())).total()
        if gone or new:
            out[k] = (min(gone, new), max(0, gone - new), max(0, new - gone))
    return out


def found_damage(spark, a, b):
    ma, mb = (checkpointed(warc.manifest(spark.createDataFrame(x, SCHEMA))) for x in (a, b))
    out = {}
    for r in warc.audit_records(ma, mb, checkpointed).collect():
        at = out.setdefault(r.key, [0, 0, 0])
        at[["altered", "missing", "extra"].index(r.damage)] += 1
    return {k: tuple(v) for k, v in out.items()}


ROWS = [(k, f"http://x/{k}", f"text {k}") for k in range(40)]
SWAPPED = [(19 if k == 3 else 3 if k == 19 else k, u, h) for k, u, h in ROWS]


@pytest.mark.parametrize(
    "case",
    [
        (ROWS, SWAPPED),
        ([*ROWS, (None, "n", "x")], [*SWAPPED, (None, "n", "x")]),
        ([*ROWS, (None, "n", "x")], [*ROWS, (0, "n", "x")]),  # null is a key of its own
        ([(2**60 + k if k else 0, u, h) for k, u, h in ROWS], [(2**60 + k if k else 0, u, h) for k, u, h in SWAPPED]),
        ([(k, "u", str((k or 0) % 7)) for k in (-(2**63), -1, 0, 2**63 - 1, None, -(2**62))], [(k, "u", str((k or 0) % 5)) for k in (-(2**63), -1, 0, 2**63 - 1, None, -(2**62))]),
    ],
)
def test_swaps_null_and_wide_keys(spark, case):
    a, b = case
    want = plain_damage(a, b)
    assert want and found_damage(spark, a, b) == want


def test_random_damage_matches_a_plain_comparison(spark):
    r = random.Random(3)
    keys = [None, None, 7, 7, 7, -5, 2**61, *range(60)]
    a = [(k, r.choice("uv"), r.choice(["", None, "p", "q" * r.randint(1, 9)])) for k in keys for _ in range(r.randint(1, 4))]
    b = [(k, u, "z" if r.random() < 0.05 else h) for k, u, h in a if r.random() > 0.05] + [(r.choice(keys), "w", "new") for _ in range(3)]
    r.shuffle(b)
    assert found_damage(spark, a, b) == plain_damage(a, b)
    assert found_damage(spark, a, r.sample(a, len(a))) == {}


def test_keys_must_be_integers(spark):
    d = spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string")
    with pytest.raises(ValueError):
        warc.manifest(d)


def test_roots_follow_records_order_and_lengths(spark):
    of = lambda rows: warc.root(warc.manifest(spark.createDataFrame(rows, SCHEMA)), checkpointed).first()
    first = of(ROWS)
    assert first.n == 40 and first.hash == of(ROWS[::-1]).hash and first.hash != of(SWAPPED).hash != of(ROWS[1:]).hash
    assert of([]).hash == of([]).hash


@pytest.mark.parametrize("compress", [True, False])
def test_files_of_any_payload(spark, tmp_path, compress):
    """Payloads that look like records, a null, white space; offsets of the manifest find each record."""
    odd = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 999\r\n\r\nx\r\n\r\nWARC/1.0\r\n"
    rows = [(k, f"http://x/{k}", [odd, None, "é\r\n\r\n", "", "y" * 5_000_000 if k == 4 else "日本"][k % 5]) for k in range(23)] + [(None, None, odd), (2**62 + 1, "a\r\nb", "big")]
    path = str(tmp_path / "w")
    m = warc.write_warc(spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit(1)).repartition(3), path, compress=compress)
    got = [tuple(r) for r in warc.read_warc(spark, path).collect()]
    assert Counter(got) == Counter(((u or "").replace("\r", " ").replace("\n", " "), h or "") for _, u, h in rows)
    listed = m.collect()
    assert Counter(r.key for r in listed) == Counter(k for k, _, _ in rows)
    for r in listed:
        data = Path(path, r.file).read_bytes()[r.begin : r.end]
        data = gzip.decompress(data) if compress else data
        assert data.startswith(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:") and b"\r\nWARC-Date: " in data and data.endswith(b"\r\n\r\n")
    plain = {(r.key, r.digest) for r in warc.manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {(r.key, r.digest) for r in listed} == plain
    assert warc.audit_records(m, m, checkpointed).count() == 0
