"""Sinks: files and blobs give the lines back."""

from __future__ import annotations

import base64
import gzip

from termloom.sources import sinks as S


def test_gzip_members_join_as_base64():
    texts = [b"", b"a", b"ab\n" * 100, bytes(range(256)), "é日本\n".encode() * 7]
    members = [S.gzip_member(t) for t in texts]
    assert all(len(m) % 3 == 0 and gzip.decompress(m) == t for m, t in zip(members, texts, strict=True))
    assert gzip.decompress(base64.b64decode("".join(base64.b64encode(m).decode() for m in members))) == b"".join(texts)


def test_blobs_give_the_lines_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PIECE_BYTES", 200)
    df = spark.createDataFrame([(f"key{k}", f"é{k}" if k % 3 else None) for k in range(300)], "a string, b string").repartition(5).sortWithinPartitions("a")
    S.write_tsv(df, str(tmp_path / "tsv"))
    S.write_blob(df, str(tmp_path / "blob"))
    read = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    whole = "".join(read("blob").split("\n"))
    assert gzip.decompress(base64.b64decode(whole)).decode() == read("tsv") and read("blob").count("\n") > 10
    assert gzip.decompress(base64.b64decode(S.small_blob(df))).decode() == read("tsv")
    numbers = [int(x) for r in S.byte_numbers(df).orderBy("piece").collect() for x in r["value"].split(",")]
    assert bytes(x % 256 for x in numbers).decode() == read("tsv") and min(numbers) < 0
