"""The services end to end on one imported graph."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from test_ingest import FACET, concept, coords, rows

from termloom.operators import service as S
from termloom.operators.graph import NODE_COLUMNS, SCHEMAS, Graph, _numbers, next_number, next_numbers
from termloom.operators.ingest import insert_concepts
from termloom.sources import documents as D


@pytest.fixture(scope="module")
def graph(spark):
    group = lambda k, label, *xs: {"preferredName": f"g{k}", "aggregate": True, "aggregateIncludeInHierarchy": True, "labels": [label], "coordinates": {"sourceId": f"G{k}", "source": "GROUPS"}, "elementCoordinates": [coords(x, original=False) for x in xs]}
    given = [concept(1, synonyms=["syn one"]), concept(2, 1), concept(3, 1, preferredName="prefname2"), concept(4, 2), group(0, "AGGREGATE_GENEGROUP", 2, 4), group(1, "AGGREGATE_GENEGROUP", 3)]
    return insert_concepts(Graph.empty(spark), rows(spark, given), FACET)[0]


def got(df):
    return {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()}


def test_queries(graph):
    both = ("IS_BROADER_THAN", "IS_BROADER_THAN_fid0")
    assert got(S.get_children_of_concepts(graph, ["tid0", "tid0", "none"])) == {("tid0", "tid1", both), ("tid0", "tid2", both)}
    assert got(S.get_paths_to_facetroots(graph, ["tid3"], facet_id="fid0", sort_result=True)) == {("tid3", ("tid0", "tid1", "tid3"))}
    assert got(S.get_facet_roots(graph, ["fid0"], {"fid0": ["tid0"]})) == {("fid0", "tid0")}
    assert got(S.update_children_information(graph)) == {("tid0", ("fid0",)), ("tid1", ("fid0",))}
    assert got(S.get_facets(graph)) == {("fgid0", ("fid0",))}
    assert got(S.get_facet_size(graph)) == {("fid0", 6)}


def test_exports(graph):
    assert ("CONCEPT1", "tid0") in got(S.export_concept_id_mapping(graph))
    assert got(S.export_hypernyms(graph)) == {("tid1", "tid0"), ("tid2", "tid0"), ("tid3", "tid0|tid1")}
    assert ("tid0", "fid0") in got(S.export_concept_facet_map(graph))
    assert {("prefname1", "tid0"), ("syn one", "tid0"), ("prefname2", "tid1")} <= got(S.export_dictionary(graph, exclusion_labels=["AGGREGATE"], unique_keys=True))


def test_relations(spark, graph):
    doc = spark.createDataFrame([("sourceIds", "TEST_DATA", [("d1", False, None, {"t": [(2, None, [["CONCEPT2"], ["CONCEPT3"]]), (1, None, [["CONCEPT4"], ["id:tid0"], ["CONCEPT99"]])]})])], D.RELATIONS)
    g = S.insert_ie_relations(graph, D.relation_rows(doc))
    ask = {"a_list": {"id_property": "sourceIds", "ids": ["CONCEPT2"]}, "relationTypes": ["t"]}
    assert got(S.retrieve_ie_relations(g, ask)) == {("G0", "g0", "G1", "g1", 2), ("G0", "g0", "CONCEPT1", "prefname1", 1)}
    assert got(S.retrieve_ie_relations(g, ask | {"b_list": {"id_property": "sourceIds", "ids": ["CONCEPT3", "unknown"]}})) == {("G0", "g0", "G1", "g1", 2)}


def test_mapping_aggregates_and_terms(spark, graph):
    m = spark.createDataFrame([("CONCEPT1", "CONCEPT2", "EQUAL"), ("CONCEPT3", "CONCEPT4", "LOOM")], "id1 string, id2 string, mapping_type string")
    g, n = S.insert_mappings(graph, m)
    assert n == 1
    g = S.copy_aggregate_properties(S.build_aggregates_by_mappings(g, ["EQUAL"], "MAPPED", "CONCEPT"))
    a = [r for r in g.concepts.collect() if r.id == "atid2"]
    assert len(a) == 1 and a[0].pref_name == "prefname1" and a[0].synonyms == ["prefname2", "syn one"] and a[0].mapping_type == ["EQUAL"]
    left, counts = S.delete_aggregates(g, ["MAPPED"])
    assert counts.first().asDict() == {"num_nodes": 1, "num_relationships": 2} and not left.concepts.where(F.array_contains("labels", "MAPPED")).count()
    g = S.build_aggregates_by_preferred_name(graph, ["CONCEPT"], ["SAME"], ["preferredName"])
    assert g.elements.count() == graph.elements.count() + 2
    v = spark.createDataFrame([("acronym", "tid0", "d", "PN1", 2, 0)], "kind string, concept string, doc string, name string, count int, ord int")
    assert ("PN1", "tid0") in got(S.export_dictionary(S.add_concept_terms(graph, v)))


def test_aggregates_copy_what_they_list(spark):
    c = "node long, id string, labels array<string>, pref_name string, synonyms array<string>, descriptions array<string>, copy_properties array<string>, props map<string,string>"
    plain = [(k, f"tid{k}", ["CONCEPT"], n, [f"s{k}"], [f"d{k}"], None, {"color": f'"{x}"', "size": "1"}) for k, (n, x) in enumerate([("one", "red"), ("one", "red"), ("two", "blue")])]
    groups = [(k, f"atid{k}", [x, "AGGREGATE"], None, None, None, p, {"own": '"x"'} if k == 3 else None) for k, x, p in ((3, "A", ["preferredName"]), (4, "A", ["color", "descriptions"]), (5, "B", None), (6, "C", ["color"]), (7, "A", ["descriptions", "preferredName", "synonyms"]))]
    empty = Graph.empty(spark)
    g = empty.with_(concepts=empty.concepts.unionByName(spark.createDataFrame(plain + groups, c), allowMissingColumns=True), elements=spark.createDataFrame([(a, e) for a in (3, 4, 5, 6) for e in (0, 1, 2)] + [(7, 4), (7, 0)], "aggregate long, element long"))
    done, counts = S.copied_aggregate_properties(g, aggregated_labels=("A",))
    r = {x.node: x for x in done.concepts.collect()}
    assert counts == {"numAggregates": 3, "numElements": 11 - 3, "numProperties": 3 + 6 + 4}
    assert (r[3].pref_name, r[3].synonyms, r[3].descriptions, r[3].props) == ("one", ["two"], None, {"own": '"x"', "preferredName_divergentProperty": '["two"]'})
    assert (r[4].pref_name, r[4].synonyms, r[4].descriptions, r[4].props) == (None, None, ["d0", "d1", "d2"], {"color": '"red"', "color_divergentProperty": '["blue"]'})
    assert (r[7].pref_name, r[7].synonyms, r[7].descriptions) == ("one", ["s0"], ["d0", "d1", "d2"])
    assert all(r[k][1:] == tuple(x) for k in (0, 5, 6) for x in [[y for y in z][1:] for z in g.concepts.where(f"node = {k}").collect()])


def test_deleted_aggregates_take_all_that_hangs_on_them(spark, graph):
    """Source ids, roots, mappings, relations and variants go and are counted; numbers and ids don't come back."""
    g = S.build_aggregates_by_preferred_name(graph, ["CONCEPT"], ["SAME"], ["preferredName"])
    node, gone = (g.concepts.where(F.array_contains("labels", "SAME")).first()[c] for c in ("node", "id"))
    add = lambda table, *rows: getattr(g, table).unionByName(spark.createDataFrame(rows, SCHEMAS[table]))
    g = g.with_(
        sources=add("sources", (node, "agg1", "AGG", True, 0)),
        roots=add("roots", ("fid0", node, False)),
        edges=add("edges", (node, 0, "x", None, None, 0), (0, node, "x", None, None, 0), (node, node, "x", None, None, 0)),
        mappings=add("mappings", (0, node, ["EQUAL"])),
        relation_docs=add("relation_docs", ("t", 0, node, "d1", 1), ("t", 0, node, "d2", 1), ("t", 0, 1, "d2", 1)),
        relation_dbs=add("relation_dbs", ("t", 0, node, "db", "m")),
        variants=add("variants", ("acronym", gone, "a", "A", "d1", 1), ("acronym", gone, "b", "B", "d1", 1), ("acronym", "tid0", "a", "A", "d1", 1)),
    )
    left, counts = S.delete_aggregates(g, ["SAME"])
    assert counts.first().asDict() == {"num_nodes": 1, "num_relationships": 2 + 1 + 3 + 1 + 1 + 1 + 1}
    for table, columns in NODE_COLUMNS.items():
        for c in columns:
            assert getattr(left, table).where(F.col(c) == node).count() == 0, (table, c)
    assert left.variants.count() == 1 and left.relation_docs.count() == 1 and left.concepts.count() == graph.concepts.count()
    again = S.build_aggregates_by_preferred_name(left, ["CONCEPT"], ["SAME"], ["preferredName"])
    new = again.concepts.where(F.array_contains("labels", "SAME")).first()
    assert S.n_built(left, again) == 1 and S.n_built(graph, g) == 1 and S.n_aggregates(again, ["SAME"]) == 1 and S.n_built(again, again) == 0
    assert (new["node"], new["id"]) == (node + 1, f"atid{int(gone[4:]) + 1}") and again.sources.where(F.col("node") == new["node"]).count() == 0


def test_marks_are_written_with_a_version(spark, graph, tmp_path):
    g = S.build_aggregates_by_preferred_name(graph, ["CONCEPT"], ["SAME"], ["preferredName"])
    S.delete_aggregates(g, ["SAME"])[0].write(str(tmp_path / "v"))
    back = Graph.read(spark, str(tmp_path / "v"))
    assert next_number(back, "atid") == next_number(g, "atid") > next_number(graph, "atid") and next_number(Graph.empty(spark), "fid") == 0


def test_dictionary_ids_of_elements_and_prefixes(spark):
    empty = Graph.empty(spark)
    c = "node long, id string, labels array<string>, pref_name string, original_id string, original_source string"
    concepts = spark.createDataFrame([(0, "tid0", ["CONCEPT"], "name one", "O9", "ORG"), (1, "tid1", ["CONCEPT"], "name two", "O1", "ORG"), (2, "atid0", ["SAME", "AGGREGATE"], "name all", None, None), (3, "tid3", ["BARE"], "name bare", "O3", None)], c)
    g = empty.with_(
        concepts=empty.concepts.unionByName(concepts, allowMissingColumns=True),
        elements=spark.createDataFrame([(2, 0), (2, 1)], "aggregate long, element long"),
        sources=spark.createDataFrame([(0, "S0", "SRC", True, 0), (1, "S1", "SRC", True, 0)], "node long, source_id string, source string, is_unique boolean, ord int"),
    )
    assert got(S.export_dictionary(g, "sourceIds", label="SAME")) == {("name all", "S0"), ("name all", "S1")}
    assert got(S.export_dictionary(g, "sourceIds,originalId", label="SAME", add_source_prefix=True)) == {("name all", "SRC:S0||ORG:O9"), ("name all", "SRC:S1||ORG:O1")}
    assert got(S.export_dictionary(g, ["id", "sourceIds"], add_source_prefix=True)) == {("name one", "id:tid0||SRC:S0"), ("name two", "id:tid1||SRC:S1")}
    with pytest.raises(Exception, match="no value of sourceIds at tid3"):
        S.export_dictionary(g, "sourceIds", label="BARE").collect()
    with pytest.raises(Exception, match="no source of originalId at tid3"):
        S.export_dictionary(g, "originalId", label="BARE", add_source_prefix=True).collect()
    with pytest.raises(Exception, match="unequal length"):
        S.export_dictionary(g, ["id", "sourceIds"], label="SAME").collect()


def test_facets_by_property_and_morphology(spark, graph):
    assert {r.facet for r in S.get_all_facets(graph).collect()} == {"fid0"}
    assert S.get_all_facets(graph, "name", "testfacet1").count() == 1 and S.get_all_facets(graph, "name", "other").count() == 0
    assert S.get_all_facets(graph, "labels", "hidden").count() == 1 and S.get_all_facets(graph, "custom_id").count() == 0 and S.get_all_facets(graph, value="hidden").count() == 1
    rows = [("acronym", c, "pn", "PN", "d", 2) for c in ("tid0", "tid1", "atid0")] + [("writing_variant", "tid0", "x", "X", "d", 1)]
    g = graph.with_(variants=spark.createDataFrame(rows, SCHEMAS["variants"]))
    assert got(S.get_morphology(g, ["tid0", "atid0"], "acronym")) == {("tid0", "PN", "d", 2), ("atid0", "PN", "d", 2)}
    assert got(S.get_morphology(g, ["tid0", "atid0"], "acronym", "AGGREGATE_GENEGROUP")) == {("atid0", "PN", "d", 2)}


def test_node_maps(spark):
    given = [concept(1, synonyms=['s "q"'], additional_properties={"n": 5, "t": "[x]", "l": ["a", 1], "o": {"k": [True]}, "preferredName": "no"}), concept(2)]
    g = insert_concepts(Graph.empty(spark), rows(spark, given), FACET)[0]
    found = {json.loads(r["json"])["preferredName"]: json.loads(r["json"]) for r in S.node_maps(g).collect()}
    one = found["prefname1"]
    assert one["synonyms"] == ['s "q"'] and (one["n"], one["t"], one["l"], one["o"]) == (5, "[x]", ["a", 1], {"k": [True]}) and one["labels"] == ["CONCEPT"]
    assert one["sourceIds"] == ["CONCEPT1"] and one["uniqueSourceIds"] == [False] and one["facets"] == ["fid0"] and "writingVariants" not in found["prefname2"]
    assert S.node_maps(g, ["tid1"]).count() == 1


def test_saved_tables_are_joined_without_a_shuffle_of_edges(spark, graph):
    from termloom.plans.iterate import closure

    name = f"saved_{id(graph)}"
    graph.save(name, buckets=4)
    back = Graph.load(spark, name)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        front = spark.createDataFrame([(0, 0)], "origin long, node long")
        step = front.join(back.edges.select("src", "dst").distinct(), F.col("node") == F.col("src"))
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan, plan
        reach = lambda g: got(closure(g.roots.select(F.lit(0).alias("origin"), "node"), g.edges))
        assert reach(back) == reach(graph)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got(S.export_hypernyms(back)) == got(S.export_hypernyms(graph))
    for table in SCHEMAS:
        spark.sql(f"DROP TABLE {name}_{table}")


def test_numbers_read_each_table_once(spark, graph):
    plan = _numbers(graph, ["node", "tid", "atid"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max") == 3 and plan.count("Exchange") == 1
    assert next_numbers(graph, ["node", "atid"]) == [next_number(graph, "node"), next_number(graph, "atid")]


def test_copied_properties_write_few_tables(spark, graph, monkeypatch):
    g = S.build_aggregates_by_preferred_name(graph, ["CONCEPT"], ["SAME"], ["preferredName", "synonyms"])
    tables, plain = [], S.keep
    monkeypatch.setattr(S, "keep", lambda df: tables.append(df) or plain(df))
    monkeypatch.setattr(type(g.concepts), "count", None)  # nothing is counted that isn't asked for
    filled = S.copy_aggregate_properties(g, aggregated_labels=("SAME",))
    assert len(tables) == 9 and filled.concepts.where(F.array_contains("labels", "SAME")).first()["pref_name"]
