"""Queries, paths, aggregates, mappings, variants, exports on small graphs; contract queries against their SQL."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from termloom.functions import exprs as X
from termloom.operators import aggregates as A
from termloom.operators import exports as E
from termloom.operators import mappings as M
from termloom.operators import paths as P
from termloom.operators import query as Q
from termloom.operators import text_index as I
from termloom.operators import variants as V
from termloom.operators.facets import ensure_no_facet, insert_facets, resolve_facet
from termloom.operators.graph import Graph
from termloom.plans import contract
from termloom.plans.components import connected_components
from termloom.plans.iterate import closure, ends_of_chains, heights, keep
from termloom.sources import sinks

SF = "/root/testdata/sf0.001"


def edges(spark, pairs, facet=None):
    return spark.createDataFrame([(a, b, "IS_BROADER_THAN", facet) for a, b in pairs], "src string, dst string, type string, facet string")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_paths_of_several_parents(spark):
    e = edges(spark, [("s1", "s3"), ("s2", "s3"), ("s3", "s4"), ("s3", "s5"), ("s5", "s6")])
    roots = nodes(spark, ["s1", "s2"])
    assert P.paths_from_roots(nodes(spark, ["s1", "s3"]), e, roots).count() == 3
    found = {tuple(r.path) for r in P.paths_from_roots(nodes(spark, ["s4", "s6"]), e, roots).collect()}
    assert found == {("s1", "s3", "s4"), ("s2", "s3", "s4"), ("s1", "s3", "s5", "s6"), ("s2", "s3", "s5", "s6")}


def test_cycles_end(spark):
    e = edges(spark, [("a", "b"), ("b", "a")])
    assert P.paths_from_roots(nodes(spark, ["b"]), e, nodes(spark, ["a"])).count() == 1
    assert closure(nodes(spark, ["a"]).withColumn("origin", F.lit(0)), e).count() == 2
    with pytest.raises(RuntimeError):
        ends_of_chains(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"), 8)
    with pytest.raises(RuntimeError):
        heights(spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string"), 4)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 200)] + [(300, 300 + k) for k in range(1, 30)]
    found = {r.node: r.label for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), keep).collect()}
    assert {found[i] for i in range(41)} == {0} and found[102] == 100 and found[200] == 200 and {found[300 + k] for k in range(30)} == {300}
    assert connected_components(spark.createDataFrame([], "a long, b long"), keep).count() == 0


def test_majority_vote(spark):
    names = ["apfelsine", "apfelsine", "orange", "orangendings"]
    e = spark.createDataFrame([("agg", str(k)) for k in range(4)], "aggregate string, element string")
    v = spark.createDataFrame([(str(k), "name", n) for k, n in enumerate(names)], "node string, property string, value string")
    r = A.rolled_up(e, v).first()
    assert (r.value, r.divergent) == ("apfelsine", ["orange", "orangendings"])
    s = spark.createDataFrame([(["oraNgE", "orange", "apfelsine"], ["orange"])], "s array<string>, d array<string>")
    assert s.select(A.merged_synonyms(F.col("s"), F.col("d"))).first()[0] == ["apfelsine", "oraNgE"]


def test_mapping_components_and_inserts(spark):
    m = spark.createDataFrame([("1", "2", "EQUAL"), ("2", "3", "OTHER_EQUAL"), ("4", "5", "EQUAL")], "id1 string, id2 string, mapping_type string")
    n = spark.createDataFrame([(str(k), str(k), ["f"] if k < 3 else None) for k in range(1, 7)], "id string, node string, facets array<string>")
    every, new = M.insert_mappings(m, n)
    assert new.count() == 3 and {(r.aggregate, r.element) for r in A.mapping_elements(every, n, ["EQUAL", "OTHER_EQUAL"]).collect()} == {("1", "1"), ("1", "2"), ("1", "3"), ("4", "4"), ("4", "5")}
    more = spark.createDataFrame([("2", "1", "new_type"), ("1", "2", "Loom"), ("x", "1", "EQUAL")], m.schema)
    again, new = M.insert_mappings(more, n, every)
    assert new.count() == 0 and {tuple(r.mapping_types) for r in again.where("u = '1'").collect()} == {("EQUAL", "new_type")}
    with pytest.raises(Exception, match="lacks"):
        M.insert_mappings(spark.createDataFrame([("1", " ", "EQUAL")], m.schema), n)[0].collect()


def test_delete_aggregates(spark):
    c = spark.createDataFrame([("a", ["AGGREGATE", "X"]), ("b", ["CONCEPT", "X"])], "node string, labels array<string>")
    e = edges(spark, [("a", "b")]).select("src", "dst")
    left, kept, elements, n = A.delete_aggregates(c, e, spark.createDataFrame([("a", "b")], "aggregate string, element string"), ["X"])
    assert [(r.node, r.labels) for r in left.collect()] == [("b", ["CONCEPT"])] and kept.count() == elements.count() == 0
    assert n.first().asDict() == {"num_nodes": 1, "num_relationships": 2}
    assert [r.node for r in A.matching_aggregates(c.withColumn("mapping_type", F.array(F.lit("q"), F.lit("p"))), ["p", "q"], "AGGREGATE").collect()] == ["a"]


def test_variants(spark):
    rows = spark.createDataFrame([("v", "c", "doc1", "Var1", 1, 0), ("v", "c", "doc1", "var1 ", 2, 1), ("v", "c", "doc2", "var1", 3, 0)], "kind string, concept string, doc string, name string, count int, ord int")
    known = nodes(spark, ["c"])
    none = spark.createDataFrame([], "kind string, concept string, norm string, name string, doc string, count long")
    stored = V.upsert_variants(none, V.counted_variants(rows), known)
    again = V.upsert_variants(stored, V.counted_variants(rows.where("doc = 'doc2'").withColumn("count", F.lit(9))), known)
    r = V.variants_of(again, "v", "c").first()
    assert (r.norm, r.name, r.documents, r.counts) == ("var1", "Var1", ["doc1", "doc2"], [3, 9])
    assert V.upsert_variants(none, V.counted_variants(rows), nodes(spark, ["other"])).count() == 0
    t = spark.createDataFrame([("one Two-three",), ("two",), (None,)], "t string")
    assert [r[0] for r in t.select(V.has_phrase(F.col("t"), "TWO three")).collect()] == [True, False, False]
    assert [r[0] for r in t.select(V.has_token(F.col("t"), "Two-three")).collect()] == [True, False, False]


def test_facets(spark):
    g, out = insert_facets(Graph.empty(spark), [{"name": "a", "facetGroup": {"name": "g", "position": 1}}, {"name": "b", "facetGroup": "g"}])
    assert [x["id"] for x in out] == ["fid0", "fid1"] and g.groups.count() == 1
    assert resolve_facet(g, {"name": "b"})[1] == "fid1" and resolve_facet(g, None)[1] is None
    assert ensure_no_facet(ensure_no_facet(g, "fid0"), "fid0").facets.count() == 3
    with pytest.raises(ValueError):
        resolve_facet(g, {"id": "fid9"})
    with pytest.raises(ValueError):
        insert_facets(g, [{"name": "x"}])


def test_dictionary_and_sinks(spark, tmp_path):
    c = spark.createDataFrame([("n1", "pref  name1", ["CONCEPT"], ["CONCEPT1"], ["TEST_DATA"], "ORG1", "ORG_SRC"), ("n2", "ab", ["CONCEPT"], ["C2"], ["T"], "O2", "S")], "node string, pref_name string, labels array<string>, sourceIds array<string>, sources array<string>, originalId string, originalSource string")
    d = E.dictionary_lines(c, ["sourceIds", "originalId"], {"sourceIds": "sources", "originalId": "originalSource"})
    assert [(r.key, r.ids) for r in d.collect()] == [("pref name1", "TEST_DATA:CONCEPT1||ORG_SRC:ORG1")]
    sinks.write_tsv(E.unique_keys(d), str(tmp_path / "d"), compressed=True)
    assert spark.read.text(str(tmp_path / "d")).first()[0] == "pref name1\tTEST_DATA:CONCEPT1||ORG_SRC:ORG1"
    assert sinks.small_blob(E.unique_keys(d))
    with pytest.raises(ValueError):
        sinks.small_blob(spark.range(3), 2)
    with pytest.raises(Exception, match="unequal"):
        E.dictionary_lines(c.withColumn("sourceIds", F.array(F.lit("a"), F.lit("b"))), ["sourceIds", "originalId"]).collect()
    sinks.write_json(spark.createDataFrame([(1, None, [])], "a int, b string, c array<string>"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1}'


def test_expressions(spark):
    d = spark.createDataFrame([(["a", "b"], ["b", "c"], " x  y ", None)], "p array<string>, q array<string>, s string, z array<string>")
    r = d.select(
        X.ordered_union("p", "q").alias("u"), X.ordered_union("z", "q").alias("n"), X.normalized_space("s").alias("s"), X.first_position("p", F.lit("b")).alias("i"), X.first_position("p", F.lit("k")).alias("m"),
        X.appended("p", F.lit("a")).alias("a"), X.appended("p", F.lit("a"), True).alias("aa"), X.is_blank(F.lit(" \t")).alias("bl"), X.same_set("p", F.array(F.lit("b"), F.lit("a"))).alias("ss"), X.contradicts(F.lit(1), F.lit(2)).alias("c"),
        X.distinct_ignoring_case(F.array(F.lit("A"), F.lit("a"), F.lit("b"))).alias("dc"), X.as_string_array(d, "s").alias("sa"), X.without("p", F.lit("a")).alias("w"), X.null_if_empty(F.array().cast("array<string>")).alias("e"),
    ).first()
    assert r.u == ["a", "b", "c"] and r.n == ["b", "c"] and r.s == "x y" and (r.i, r.m) == (1, -1) and r.a == ["a", "b"] and r.aa == ["a", "b", "a"] and r.bl and r.ss and r.c and r.dc == ["A", "b"] and r.sa == [" x  y "] and r.w == ["b"] and r.e is None


def test_lookup_raises_on_several(spark):
    n = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "node string, k int")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    assert [r.node for r in Q.lookup(n, "k", keys(1, 1), "k").collect()] == ["a"]
    with pytest.raises(Exception, match="more than one"):
        Q.lookup(n, "k", keys(2), "k").collect()
    assert Q.single(n.where("k = 1")).count() == 1
    with pytest.raises(ValueError):
        Q.single(n)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["children", "facets_by_group", "relations_one_sided", "mapping_aggregates", "coordinate_lookup", "aggregate_rollup_nested", "dictionary_unique"])
def test_contract_queries(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = con.execute(contract.ORACLES[name])
    names = [c[0] for c in r.description]
    expected = sorted((tuple(x) for x in r.fetchall()), key=repr)
    assert sorted((tuple(x[n] for n in names) for x in contract.QUERIES[name](spark, SF).collect()), key=repr) == expected


def test_source_accessors(spark):
    """Places follow the order of ids; ids and nodes that aren't there, null sources and empty tables have defined answers."""
    from termloom.operators import resolve as C

    schema = "node long, source_id string, source string, is_unique boolean, ord int"
    rows = [(1, "b", "s1", False, 0), (1, "a", "s2", True, 1), (1, "a", "s1", False, 1), (1, "c", None, None, 2), (2, "b", "s9", True, 0)]
    sources = spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame([(1, "a", "s2"), (1, "a", "s1"), (1, "c", None), (1, "x", "s1"), (3, "a", "s2"), (2, "b", "s9")], "node long, source_id string, source string")
    found = {(r.node, r.source_id, r.source): (r.position, r.sources, r.unique_sources, r.is_unique) for r in C.source_access(sources, asked).collect()}
    assert found == {
        (1, "a", "s2"): (1, ["s1", "s2"], ["s2"], True), (1, "a", "s1"): (1, ["s1", "s2"], ["s2"], False), (1, "c", None): (2, [None], [], False),
        (1, "x", "s1"): (-1, [], [], False), (3, "a", "s2"): (-1, [], [], False), (2, "b", "s9"): (0, ["s9"], ["s9"], True),
    }
    lists = {r.node: (r.source_ids, r.sources, r.n) for r in C.source_lists(sources).collect()}
    assert lists == {1: (["b", "a", "c"], ["s1", "s1", "s2", None], 3), 2: (["b"], ["s9"], 1)}
    none = spark.createDataFrame([], schema)
    assert C.source_lists(none).count() == 0 and C.source_access(none, asked).where("position <> -1").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_tables_are_not_broadcast(spark):
    a, b = (keep(spark.range(50).select(F.col("id").alias("node"))) for _ in range(2))
    for joined in (a.join(b.where("node > 3").distinct(), "node"), a.join(spark.range(9).withColumnRenamed("id", "node"), "node", "left_anti")):
        assert "BroadcastHashJoin" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)
    assert "BroadcastHashJoin" in plan_of(a.join(F.broadcast(b), "node"))  # by hand it still is


def test_mapping_elements_broadcast_no_table(spark):
    links = spark.createDataFrame([(1, 2, ["EQUAL"]), (3, 4, ["EQUAL"]), (4, 5, ["LOOM"])], "u long, v long, mapping_types array<string>")
    concepts = spark.createDataFrame([(k, ["CONCEPT"] if k != 3 else []) for k in range(1, 6)], "node long, labels array<string>")
    found = A.mapping_elements(links, concepts, ["EQUAL"], "CONCEPT")
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 2)] and "Broadcast" not in plan_of(found)


def test_lookup_joins_once(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "node long, name string")
    keys = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "k string")
    found = Q.lookup(nodes, "name", keys, "k")
    assert list(map(tuple, found.collect())) == [(1, "a")] and found.columns == ["node", "name"] and plan_of(found).count("Join") == 1
    with pytest.raises(Exception, match="more than one node for b"):
        Q.lookup(nodes, "name", nodes.select(F.col("name").alias("k")), "k").collect()


def test_words_of_texts_are_counted_where_their_document_is(spark):
    texts = [(1, "en", "The the THE\u00a0 a\u00a0b  A\u00a0\u00a0B \u00a0"), (1, "en", "the x"), (2, "en", "Then THE"), (2, None, "The"), (3, "en", None), (4, "en", "  ")]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    v = V.counted_variants(V.words_of_texts(docs, F.col("lang"), F.col("doc_id"), F.col("text"), "[ \\t\\n]+"))
    got = sorted((str(r.concept), r.doc, r.norm, r.name, r["count"]) for r in v.collect())
    assert got == [
        ("None", 2, "the", "The", 1), ("en", 1, "", "\u00a0", 1), ("en", 1, "a b", "A\u00a0\u00a0B", 2), ("en", 1, "the", "THE\u00a0", 4),
        ("en", 1, "x", "x", 1), ("en", 2, "the", "THE", 1), ("en", 2, "then", "Then", 1),
    ]
    assert v._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_index_shuffles_texts_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "PART", 1)
    docs = spark.createDataFrame([(1, "a B, a"), (2, "b-a"), (3, None), (4, " ")], "doc_id long, text string")
    made = I.postings(docs, "doc_id", "text")
    assert sorted((r.token, r.doc, r.positions) for r in made.collect()) == [("a", "1", [0, 2]), ("a", "2", [1]), ("b", "1", [1]), ("b", "2", [0])]
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    I.write_index(docs, "doc_id", "text", f"{tmp_path}/index")
    index = I.read_index(spark, f"{tmp_path}/index")
    assert sorted(map(tuple, I.find_phrase(index, "b A").collect())) == [("1", 1), ("2", 0)] and index.count() == 4


def test_pairs_are_counted_where_their_document_is(spark):
    pairs = contract.QUERIES["relation_pairs"](spark, "/root/testdata/sf0.001")
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2  # lines by document, totals by pair


def test_long_chains_take_few_tables(spark):
    tables = []

    def counting(df):
        tables.append(df)
        return keep(df)

    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = connected_components(chain, counting, max_rounds=1)  # a chain is one node after one round, however long it is
    assert found.count() == 301 and found.where("label <> 0").isEmpty() and len(tables) <= 8
