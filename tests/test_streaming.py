from __future__ import annotations

import json
import os

from termloom.operators.relations import resolved_arguments
from termloom.streaming import relations as S


def test_batches_merge_into_versions(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def add(name, count):
        doc = {"id_property": "id", "documents": [{"name": "d1", "db": False, "relations": {"t": [{"count": count, "args": [["b"], ["a"]]}]}}]}
        (tmp_path / "in" / name).write_text(json.dumps(doc))
        S.start_import(S.relation_stream(spark, folder), out, state, available_now=True).awaitTermination(120)

    add("1.json", 2)
    add("2.json", 5)
    found = [tuple(r) for r in S.read_version(spark, out, 1).collect()]
    assert found == [("t", "a", "b", "d1", 5)] and S.read_version(spark, out, 0).first()["count"] == 2
    assert S.read_version(spark, out, -1).count() == 0


def test_databases_keep_their_first_method(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def add(name, *documents):
        (tmp_path / "in" / name).write_text(json.dumps({"id_property": "id", "documents": list(documents)}))
        S.start_import(S.relation_stream(spark, folder), out, state, available_now=True).awaitTermination(120)

    relation = lambda a, b, **more: {"t": [{"count": 1, "args": [[a], [b]], **more}]}
    add("1.json", *({"name": f"d{k}", "relations": relation(f"a{k}", f"b{k}")} for k in range(30)), {"name": "db1", "isDb": True, "relations": relation("x", "y", method="m")})
    add("2.json", {"name": "d7", "relations": {"t": [{"count": 9, "args": [["a7"], ["b7"]]}]}}, {"name": "db1", "isDb": True, "relations": {"t": [{"count": 1, "args": [["x"], ["y"]], "method": "other"}, {"count": 1, "args": [["p"], ["q"]]}]}})
    assert {tuple(r) for r in S.read_version(spark, out, 1).collect()} == {("t", f"a{k}", f"b{k}", f"d{k}", 9 if k == 7 else 1) for k in range(30)}
    assert {tuple(r) for r in S.read_databases(spark, out, 1).collect()} == {("t", "x", "y", "db1", "m"), ("t", "p", "q", "db1", "<unknown>")}
    assert {tuple(r) for r in S.read_databases(spark, out, 0).collect()} == {("t", "x", "y", "db1", "m")}


def test_batches_of_any_size_give_one_result(spark, tmp_path, monkeypatch):
    """Files with the same document: the last overwrites, whether they come in one batch or in many; so do bases."""
    (tmp_path / "in").mkdir()
    for k, count in enumerate([2, 3, 7, 4, 5]):
        docs = [{"name": "d", "relations": {"t": [{"count": count, "args": [["b"], ["a"]]}, {"count": 1, "args": [["a"], ["b"]]}]}}]
        docs += [{"name": "db", "db": True, "relations": {"t": [{"count": 1, "method": f"m{k}", "args": [["a"], ["b"]]}]}}, {"name": f"e{k}", "relations": {"t": [{"count": k, "args": [["a"], ["c"]]}]}}]
        path = tmp_path / "in" / f"{9 - k}.json"  # times, not names, give the order
        path.write_text(json.dumps({"id_property": "id", "documents": docs}))
        os.utime(path, (1_000_000 + k, 1_000_000 + k))
    monkeypatch.setattr(S, "COMPACT_EVERY", 2)
    found = []
    for size in (1, 2, 100):
        out = str(tmp_path / f"out{size}")
        S.start_import(S.relation_stream(spark, str(tmp_path / "in"), size), out, str(tmp_path / f"state{size}"), available_now=True).awaitTermination(300)
        last = -(-5 // size) - 1
        read = lambda: ({tuple(r) for r in S.read_version(spark, out, last).collect()}, {tuple(r) for r in S.read_databases(spark, out, last).collect()})  # noqa: B023, E731
        found.append(read())
        S.expire(spark, out, last)
        assert read() == found[-1]
        if size == 1:
            assert sorted(x.name for x in (tmp_path / "out1" / "rows").glob("version=*")) == ["version=4"]
    assert found[0] == found[1] == found[2]
    assert found[0][0] == {("t", "a", "b", "d", 6), *(("t", "a", "c", f"e{k}", k) for k in range(5))} and found[0][1] == {("t", "a", "b", "db", "m0")}


def test_arguments_are_resolved_in_the_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    docs = [{"name": "d", "relations": {"t": [{"count": 2, "args": [["7", "ORG"], ["id:tid1"], ["8"], ["7", "OTHER"]]}]}}]
    (tmp_path / "in" / "1.json").write_text(json.dumps({"id_property": "originalId", "documents": docs}))
    concepts = spark.createDataFrame([(10, "tid0", "7", "ORG"), (11, "tid1", "7", "ORG2"), (12, "tid2", "8", "ORG")], "node long, id string, original_id string, original_source string")
    sources = spark.createDataFrame([], "node long, source_id string, source string")
    resolve = lambda rows: resolved_arguments(rows, concepts, sources)
    out = str(tmp_path / "out")
    S.start_import(S.relation_stream(spark, str(tmp_path / "in")), out, str(tmp_path / "state"), available_now=True, resolve=resolve).awaitTermination(120)
    assert [tuple(r) for r in S.read_version(spark, out, 0).collect()] == [("t", "10", "11", "d", 2)]
