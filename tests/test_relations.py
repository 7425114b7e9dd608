"""Relations: the gene fixture with its golden requests, upserts, argument resolution."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from termloom.operators import paths as P
from termloom.operators import relations as R
from termloom.sources import documents as D

GROUPS = {"genegroup2475": ["2475", "100136723", "102220301"], "genegroup57147": ["57147", "105927877"], "toporthology1": ["genegroup69358", "genegroup767801"], "genegroup69358": ["120356739", "101702382"], "genegroup767801": ["102229680"]}
NAMES = {"MTOR": ["genegroup2475", "2475", "100136723", "102220301"], "SCYL3": ["genegroup57147", "57147", "105927877"], "LRRC51": ["toporthology1", "genegroup69358", "genegroup767801", "120356739", "101702382", "102229680"], "LOC117183042": ["117183042"]}
RELATIONS = [("doc1", "R", "2475", "57147", 2), ("doc1", "B", "2475", "57147", 1), ("doc2", "P", "117183042", "105927877", 1), ("doc2", "B", "117183042", "100136723", 1), ("doc3", "P", "102229680", "102220301", 3), ("doc4", "P", "120356739", "100136723", 1)]
M, S, T, L = "genegroup2475", "genegroup57147", "toporthology1", "117183042"
THREE = {(M, S, 3), (M, L, 1), (M, T, 4)}
GOLDEN = [
    (["2475"], None, "R", False, {(M, S, 2)}),
    ([L], None, "P", False, {(L, S, 1)}),
    (["2475"], None, "RPB", False, THREE),
    ([M], None, "RPB", False, THREE),
    (["2475", "120356739", "57147"], None, "RPB", True, THREE | {(T, M, 4), (S, L, 1), (S, M, 3)}),
    (["2475", "120356739", "57147"], None, "RPB", False, {(M, L, 1), (S, L, 1)}),
    (["2475"], ["57147"], "R", False, {(M, S, 2)}),
    (["2475"], ["120356739"], "P", False, {(M, T, 4)}),
    ([M], [T], "P", False, {(M, T, 4)}),
    (["120356739", "105927877"], [L], "P", False, {(S, L, 1)}),
    ([L, M], [T, "105927877"], "PR", False, {(M, S, 2), (M, T, 4), (L, S, 1)}),
]


@pytest.fixture(scope="module")
def graph(spark):
    pairs = spark.createDataFrame([(t, [a, b], d, 0, c) for d, t, a, b, c in RELATIONS], "type string, args array<string>, doc string, entry int, count int")
    docs = R.counted(R.relation_pairs(pairs)).cache()
    elements = spark.createDataFrame([(a, e) for a, es in GROUPS.items() for e in es], "aggregate string, element string").cache()
    names = spark.createDataFrame([(x, n) for n, xs in NAMES.items() for x in xs], "node string, name string").cache()
    return docs, elements, P.top_aggregates(elements).cache(), names


@pytest.mark.parametrize("a, b, types, inter, expected", GOLDEN)
def test_golden_requests(spark, graph, a, b, types, inter, expected):
    nodes = lambda xs: spark.createDataFrame([(x,) for x in xs], "node string")
    found = R.one_sided(nodes(a), *graph, list(types), inter) if b is None else R.two_sided(nodes(a), nodes(b), *graph, list(types))
    rows = found.collect()
    assert {(r.arg1_id, r.arg2_id, r["count"]) for r in rows} == expected and len(rows) == len(expected)
    name = {x: n for n, xs in NAMES.items() for x in xs}
    assert all((r.arg1_name, r.arg2_name) == (name[r.arg1_id], name[r.arg2_id]) for r in rows)


def counts(spark, rows):
    return R.counted(R.relation_pairs(spark.createDataFrame(rows, "type string, args array<string>, doc string, entry int, count int")))


def test_counts_add_up_within_an_entry_and_are_undirected(spark):
    docs = counts(spark, [("t", ["0", "1"], "docId1", 0, 3), ("t", ["1", "0"], "docId2", 1, 3), ("t", ["0", "1"], "docId2", 1, 1)])
    r = R.parallel_arrays(docs).collect()
    assert [(x.total_count, x.doc_ids, x.counts) for x in r] == [(7, ["docId1", "docId2"], [3, 4])]


def test_three_arguments(spark):
    docs = counts(spark, [("t", ["0", "1", "2"], "d", 0, 2), ("t", ["2", "1"], "d", 0, 1)])
    assert {(r.u, r.v, r["count"]) for r in docs.collect()} == {("0", "1", 2), ("0", "2", 2), ("1", "2", 3)}


def test_later_entries_and_imports_overwrite(spark):
    first = counts(spark, [("t", ["0", "1"], "d", 0, 3), ("t", ["0", "1"], "d", 1, 5)])
    again = R.upsert_counts(first, counts(spark, [("t", ["0", "1"], "d", 0, 1), ("t", ["0", "1"], "e", 0, 2)]))
    assert {(r.doc, r["count"]) for r in again.collect()} == {("d", 1), ("e", 2)} and first.first()["count"] == 5


def test_unresolved_and_equal_arguments_are_left_out(spark):
    assert counts(spark, [("t", ["0", None, "0"], "d", 0, 1)]).count() == 0


def test_databases_keep_their_first_method(spark):
    schema = "type string, u string, v string, db_name string, method string"
    stored = spark.createDataFrame([("t", "0", "1", "someDB", "gtpase assay")], schema)
    new = spark.createDataFrame([("t", "0", "1", "anotherDB", " ", 0), ("t", "0", "1", "someDB", "x", 1)], schema + ", ord int")
    assert {(r.db_name, r.method) for r in R.upsert_databases(stored, new).collect()} == {("someDB", "gtpase assay"), ("anotherDB", "<unknown>")}


def test_argument_parts(spark):
    given = [(["12"],), (["id:tid3"],), (["sourceIds:GO:0001", "GO"],), (["GO:0001"],)]
    parts = R.argument_parts(spark.createDataFrame(given, "arg array<string>"), default_source="NCBI").collect()
    assert [(p.id_property, p.id, p.id_source) for p in parts] == [("originalId", "12", "NCBI"), ("id", "tid3", "NCBI"), ("sourceIds", "GO:0001", "GO"), ("originalId", "GO:0001", "NCBI")]


def test_relation_and_variant_documents(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"id_property": "originalId", "id_source": "s", "documents": [{"name": "d", "db": True, "relations": {"t": [{"count": 2, "method": "m", "args": [["1"], ["2", "x"]]}]}}]}))
    r = D.read_relations(spark, str(p)).collect()
    assert [(x.doc, x.is_db, x.type, x["count"], x.method, x.args) for x in r] == [("d", True, "t", 2, "m", [["1"], ["2", "x"]])]
    p.write_text(json.dumps({"conceptTerms": json.dumps({"tid0": {"doc1": {"var1": 1, "var 2": 2}}}), "conceptAcronyms": json.dumps({"tid0": {"doc1": {"V": 4}}})}))
    v = D.read_variants(spark, str(p)).select("kind", "concept", "doc", "name", F.col("count").alias("n")).collect()
    assert sorted((x.kind, x.name, x.n) for x in v) == [("acronym", "V", 4), ("writing_variant", "var 2", 2), ("writing_variant", "var1", 1)]


def test_pairs_of_several_nodes_are_an_error_only_where_they_are_asked_for(spark):
    concepts = spark.createDataFrame([(1, "tid1", "a", "A"), (2, "tid2", "b", "A")], "node long, id string, original_id string, original_source string")
    sources = spark.createDataFrame([(1, "s", "S"), (2, "s", "S"), (2, "t", "S")], "node long, source_id string, source string")
    ask = lambda *args: spark.createDataFrame([("originalId", "A", [list(a) for a in args])], "id_property string, id_source string, args array<array<string>>")
    found = R.resolved_arguments(ask(["a"], ["sourceIds:t", "S"], ["sourceIds:s", "T"], ["id:tid2"]), concepts, sources).first()
    assert found.args == [1, 2, None, 2]
    with pytest.raises(Exception, match="several nodes with sourceIds s of S"):
        R.resolved_arguments(ask(["sourceIds:s", "S"]), concepts, sources).collect()
