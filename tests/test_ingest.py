"""Imports: identity, placeholders, merged properties, taxonomy, aggregates."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from termloom.operators.graph import SCHEMAS, Graph, numbered
from termloom.operators.ingest import Options, insert_concepts
from termloom.sources import documents as D

FACET = {"name": "testfacet1", "labels": ["hidden"], "sourceType": "hierarchical", "facetGroup": {"name": "facetGroup1", "position": 1, "labels": ["showForSearch"]}}


def coords(k, source="TEST_DATA", original=True):
    c = {"sourceId": f"CONCEPT{k}", "source": source}
    return c | ({"originalId": f"CONCEPT{k}", "originalSource": "ORG"} if original else {})


def concept(k, *parents, **more):
    return {"preferredName": f"prefname{k}", "descriptions": [f"desc of term{k}"], "coordinates": coords(k), "parentCoordinates": [coords(p) for p in parents]} | more


def rows(spark, concepts):
    schema = "ord long, " + D.CONCEPT_JSON[len("struct<") : -1]
    text = spark.createDataFrame([(json.dumps(c | {"ord": i}),) for i, c in enumerate(concepts)], "j string")
    return text.select(D.typed_concept(F.from_json("j", schema)).alias("c")).select("c.*")


def load(spark, concepts, graph=None, facet=FACET, **options):
    return insert_concepts(graph or Graph.empty(spark), rows(spark, concepts), facet, Options(**options))


def by_name(g):
    return {r.pref_name: r for r in g.concepts.collect()}


def test_hierarchy(spark):
    g, counts = load(spark, [concept(1), concept(2, 1), concept(3, 1), concept(2, 1), concept(4, 2)])
    found = by_name(g)
    assert counts["concepts"] == 4 and counts["facet"] == "fid0"
    assert [found[f"prefname{k}"].id for k in (1, 2, 3, 4)] == ["tid0", "tid1", "tid2", "tid3"]
    name = {r.node: r.pref_name[-1] for r in found.values()}
    edges = sorted((name[e.src], name[e.dst], e.type) for e in g.edges.collect())
    assert edges == sorted((a, b, t) for a, b in (("1", "2"), ("1", "3"), ("2", "4")) for t in ("IS_BROADER_THAN", "IS_BROADER_THAN_fid0"))
    assert [name[r.node] for r in g.roots.collect()] == ["1"]
    assert all(r.facets == ["fid0"] and r.labels == ["CONCEPT"] for r in found.values())


def test_repeated_import_changes_nothing(spark):
    g, _ = load(spark, [concept(1), concept(2, 1)])
    again, counts = load(spark, [concept(1), concept(2, 1)], g)
    assert counts["concepts"] == 0 and counts["relationships"] == 0
    assert {k: v.id for k, v in by_name(again).items()} == {k: v.id for k, v in by_name(g).items()}


def test_hollow_parent_is_filled_later(spark):
    g, _ = load(spark, [concept(2, 1)])
    hollow = [r for r in g.concepts.collect() if "HOLLOW" in r.labels]
    assert len(hollow) == 1 and hollow[0].id is None and [r.node for r in g.roots.collect()] == [hollow[0].node]
    g, counts = load(spark, [concept(1, 0)], g)
    found = g.concepts.collect()
    assert counts["concepts"] == 1 and len(found) == 3
    filled = by_name(g)["prefname1"]
    assert filled.node == hollow[0].node and filled.id == "tid1" and "HOLLOW" not in filled.labels
    still = [r.node for r in found if "HOLLOW" in r.labels]
    assert [r.node for r in g.roots.collect()] == still


def test_no_hollow_parents_and_cut_parents(spark):
    g, counts = load(spark, [concept(2, 1)], do_not_create_hollow_parents=True)
    assert counts["concepts"] == 1 and g.edges.count() == 0 and g.roots.count() == 1
    g, _ = load(spark, [concept(1), concept(2, 1)], cut_parents=("CONCEPT1",))
    assert g.edges.count() == 0 and g.roots.count() == 2


def test_parentless_go_to_the_no_facet(spark):
    g, _ = load(spark, [concept(1), concept(2, 1)], parentless_to_no_facet=True)
    assert [(r.facet, r.is_no_facet) for r in g.roots.collect()] == [("fid0", True)]
    assert g.facets.where("is_no_facet").count() == 1 and g.groups.count() == 2


def test_ids_and_sources_merge(spark):
    a = {"preferredName": "n", "coordinates": {"sourceId": "CONCEPT0", "source": "src1", "originalId": "orgId", "originalSource": "org"}}
    b = {"preferredName": "m", "coordinates": {"sourceId": "CONCEPT0", "source": "src2", "originalId": "orgId", "originalSource": "org"}, "synonyms": ["n", "s"]}
    c = {"coordinates": {"sourceId": "CONCEPT42", "source": None, "originalId": "orgId", "originalSource": "org"}}
    g = None
    for x in (a, b, c):
        g, _ = load(spark, [x], g)
    node = g.concepts.collect()
    assert len(node) == 1 and node[0].pref_name == "n" and node[0].synonyms == ["s"]
    found = sorted((r.ord, r.source_id, r.source) for r in g.sources.collect())
    assert found == [(0, "CONCEPT0", "src1"), (0, "CONCEPT0", "src2"), (1, "CONCEPT42", "<unknown>")]


def test_properties_merge(spark):
    g, _ = load(spark, [concept(1, synonyms=["a", "b"], labels=["L1"], additional_properties={"x": "1"})])
    g, _ = load(spark, [concept(1, synonyms=["b", "c"], labels=["L2"], additional_properties={"x": "2", "y": "3"}, preferredName="other")], g)
    n = g.concepts.first()
    assert n.synonyms == ["a", "b", "c"] and n.props == {"x": '"1"', "y": '"3"'} and n.pref_name == "prefname1" and n.labels == ["CONCEPT", "L1", "L2"]
    g, _ = load(spark, [concept(1, preferredName="other")], g, override_preferred_name=True)
    assert g.concepts.first().pref_name == "other"


def test_merging_without_facet_skips_unknown_concepts(spark):
    g, _ = load(spark, [concept(1)])
    g, counts = load(spark, [{"coordinates": coords(1), "synonyms": ["new"]}, {"coordinates": coords(9)}], g, facet=None)
    assert counts["concepts"] == 0 and g.concepts.count() == 1 and g.concepts.first().synonyms == ["new"]


def test_explicit_relationships(spark):
    rel = {"targetCoordinates": coords(7), "type": "HAS_SAME_NAMES", "properties": {"p": "1"}}
    g, _ = load(spark, [concept(1, relationships=[rel])])
    assert [(e.type, e.props) for e in g.edges.collect()] == [("HAS_SAME_NAMES", {"p": '"1"'})]
    g, _ = load(spark, [concept(1, relationships=[rel | {"properties": {"q": "2"}}])], g)
    assert [e.props for e in g.edges.collect()] == [{"p": '"1"', "q": '"2"'}]
    g, _ = load(spark, [concept(1, relationships=[rel | {"properties": {"p": "9"}}])], g)
    assert sorted(e.props["p"] for e in g.edges.collect()) == ['"1"', '"9"']


def test_aggregates(spark):
    agg = {"preferredName": "agg", "aggregate": True, "coordinates": {"sourceId": "A", "source": "AGGS"}, "elementCoordinates": [coords(1, original=False), coords(2, original=False), coords(5, original=False)], "copyProperties": ["prefName"], "labels": ["GROUP"]}
    g, _ = load(spark, [concept(1), agg, concept(2)])
    a = by_name(g)["agg"]
    assert a.id == "atid0" and {"AGGREGATE", "GROUP"} <= set(a.labels) and g.elements.count() == 2
    g, _ = load(spark, [concept(1), agg, concept(2)], create_hollow_aggregate_elements=True)
    assert g.elements.count() == 3


def test_unique_source_ids_unite(spark):
    a = {"preferredName": "a", "coordinates": {"sourceId": "X", "source": "s1", "uniqueSourceId": True}}
    b = {"preferredName": "b", "coordinates": {"sourceId": "X", "source": "s2", "uniqueSourceId": True}}
    assert load(spark, [a, b])[0].concepts.count() == 1
    assert load(spark, [a, b], unite_unique_source_ids=False)[0].concepts.count() == 2


@pytest.mark.parametrize("bad", [{"preferredName": "x"}, {"coordinates": {"sourceId": "a", "originalId": "b"}}, {"coordinates": {"source": "a"}}])
def test_incomplete_concepts_are_errors(spark, bad):
    with pytest.raises(ValueError):
        load(spark, [bad])


def test_contradicting_original_ids_are_errors(spark):
    g, _ = load(spark, [{"coordinates": {"sourceId": "a", "source": "s", "originalId": "1", "originalSource": "o"}}])
    with pytest.raises(Exception, match="inconsistent data"):
        load(spark, [{"coordinates": {"sourceId": "a", "source": "s", "originalId": "2", "originalSource": "o"}}], g)


def test_versions_are_written_and_read(spark, tmp_path):
    g, _ = load(spark, [concept(1), concept(2, 1)])
    g.write(str(tmp_path / "v1"))
    h = Graph.read(spark, str(tmp_path / "v1"))
    assert h.concepts.count() == 2 and h.edges.count() == 2
    with pytest.raises(Exception, match="exist"):
        g.write(str(tmp_path / "v1"))


def test_document_file(spark, tmp_path):
    p = tmp_path / "doc.json"
    p.write_text(json.dumps({"facet": {"name": "f", "facetGroup": "grp"}, "importOptions": {"merge": False}, "concepts": [concept(1), concept(2, 1)]}))
    facet, options, found = D.read_import(spark, str(p))
    f = facet.first().asDict(True)
    assert f["facetGroup"]["name"] == "grp" and options.first()["merge"] is False
    g, _ = insert_concepts(Graph.empty(spark), found, f)
    assert g.concepts.count() == 2


def test_numbers_are_dense(spark):
    n = numbered(spark.range(1000).withColumn("k", F.xxhash64("id")), ["k"], "n", 5)
    assert [r.n for r in n.orderBy("k").collect()] == list(range(5, 1005))


def test_edge_properties_with_lists(spark):
    got = {s: p for s, p in folded(spark, [(1, {"a": ["x", "y"], "b": 1}), (3, None)], [(1, {"a": ["y", "z"], "c": 2}), (3, {"a": ["q"]})])}
    assert got == {1: {"a": ["x", "y", "z"], "b": 1, "c": 2}, 3: {"a": ["q"]}}
    other = folded(spark, [(1, {"a": ["x", "y"], "b": 1})], [(1, {"a": ["z"], "b": 2})])
    assert sorted(p["b"] for _, p in other) == [1, 2]
    with pytest.raises(Exception, match="single value"):
        folded(spark, [(1, {"a": ["x"]})], [(1, {"a": "x"})])


def folded(spark, stored, incoming):
    """[(src, props)] after upsert_edges of edges src -> 0; props with JSON values."""
    from termloom.operators.ingest import upsert_edges

    text = lambda p: p and {k: json.dumps(v, separators=(",", ":"), ensure_ascii=False) for k, v in p.items()}
    s = spark.createDataFrame([(x, 0, "t", None, text(p), k) for k, (x, p) in enumerate(stored)], SCHEMAS["edges"])
    i = spark.createDataFrame([(x, 0, "t", None, text(p), (0, k)) for k, (x, p) in enumerate(incoming)], "src long, dst long, type string, facet string, props map<string,string>, at struct<ord:long,k:int>")
    found = upsert_edges(s, i.repartition(3)).orderBy("src", "nth").collect()
    return [(r.src, r.props and {k: json.loads(v) for k, v in r.props.items()}) for r in found]


def test_edges_of_one_import_are_folded_in_order(spark):
    both = [(1, {"x": 1, "a": 1}), (1, {"x": 1, "b": 2})]
    assert folded(spark, [(1, {"x": 1})], both) == [(1, {"x": 1, "a": 1, "b": 2})]
    assert folded(spark, [], both) == [(1, {"x": 1, "a": 1})]  # the first creation of an import stands for later ones
    assert folded(spark, [(1, {"x": 1})], [(1, {"x": 2}), (1, {"x": 1, "c": 3})]) == [(1, {"x": 1}), (1, {"x": 2})]
    # the first that fits takes it, in the order in which they came
    assert folded(spark, [(1, {"x": 1}), (1, {"y": 1})], [(1, {"y": 2}), (1, {"y": 1, "x": 9})]) == [(1, {"x": 1, "y": 2}), (1, {"y": 1, "x": 9})]
    assert folded(spark, [(2, None)], [(1, None), (1, None), (1, {"k": True})]) == [(1, None), (2, None)]


def test_kinds_of_values_stay(spark):
    """A text that looks like a list is a text; 5 and "5" are different values; lists of any elements are united."""
    assert folded(spark, [(1, {"n": "[draft] note"})], [(1, {"n": "[final] note"})]) == [(1, {"n": "[draft] note"}), (1, {"n": "[final] note"})]
    assert folded(spark, [(1, {"n": "[draft] note"})], [(1, {"n": "plain"})]) == [(1, {"n": "[draft] note"}), (1, {"n": "plain"})]
    assert folded(spark, [(1, {"n": 5, "l": [1, "a", {"q": [2]}]})], [(1, {"n": 5, "l": ["a", 2, {"q": [2]}, True]})]) == [(1, {"n": 5, "l": [1, "a", {"q": [2]}, 2, True]})]
    assert len(folded(spark, [(1, {"n": 5})], [(1, {"n": "5"})])) == 2
    g, _ = load(spark, [concept(1, additional_properties={"t": "[draft] \"é\" note", "n": 5, "b": True, "l": ["a", 1], "o": {"k": [1]}, "none": None})])
    got = {k: json.loads(v) for k, v in g.concepts.first().props.items()}
    assert got == {"t": "[draft] \"é\" note", "n": 5, "b": True, "l": ["a", 1], "o": {"k": [1]}}


def write_import(path, concepts, facet="f", **options):
    path.write_text(json.dumps({"facet": {"name": facet, "facetGroup": "grp"}, "importOptions": {"merge": False, **options}, "concepts": concepts}))


def test_several_files_are_one_import_in_order(spark, tmp_path):
    (tmp_path / "many").mkdir()
    given = [concept(1), concept(2, 1), concept(3, 2), concept(4, 1, synonyms=["s"])]
    write_import(tmp_path / "many" / "a.json", given[:2])
    write_import(tmp_path / "many" / "b.json", given[2:])
    write_import(tmp_path / "one.json", given)
    tables = []
    for path in ("many", "one.json"):
        facet, _, found = D.read_import(spark, str(tmp_path / path))
        g, counts = insert_concepts(Graph.empty(spark), found, facet.first().asDict(True))
        tables.append((counts, sorted(map(tuple, g.concepts.select("id", "pref_name", "node", "synonyms").collect()), key=repr), sorted(map(tuple, g.edges.select("src", "dst", "type").collect()))))
    assert tables[0] == tables[1] and [r[:2] for r in tables[0][1]] == [(f"tid{k}", f"prefname{k + 1}") for k in range(4)]


def test_files_of_several_imports(spark, tmp_path):
    write_import(tmp_path / "a.json", [concept(1)], "f")
    write_import(tmp_path / "b.json", [concept(2)], "g")
    with pytest.raises(ValueError, match="several facets"):
        D.read_import(spark, str(tmp_path))
    g = Graph.empty(spark)
    for facet, _, found in D.read_imports(spark, str(tmp_path)):
        g, _ = insert_concepts(g, found, facet.first().asDict(True))
    assert sorted((r.pref_name, r.id, r.facets) for r in g.concepts.collect()) == [("prefname1", "tid0", ["fid0"]), ("prefname2", "tid1", ["fid1"])]
    write_import(tmp_path / "b.json", [concept(2)], "f", merge=True)
    with pytest.raises(ValueError, match="several options"):
        D.read_import(spark, str(tmp_path))


@pytest.mark.parametrize("numbered_lines", [True, False])
def test_lines_keep_their_order_with_and_without_numbers(spark, tmp_path, numbered_lines):
    given = [concept(k) for k in (5, 3, 9, 1, 7)]
    for name, part in (("a", given[:2]), ("b", given[2:])):
        lines = [json.dumps(c | ({"ord": given.index(c)} if numbered_lines else {})) for c in part]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    g, counts = insert_concepts(Graph.empty(spark), D.read_concept_lines(spark, str(tmp_path)), FACET)
    assert counts["concepts"] == 5 and sorted((r.id, r.pref_name) for r in g.concepts.collect()) == [(f"tid{i}", f"prefname{k}") for i, k in enumerate((5, 3, 9, 1, 7))]


def test_paths_by_any_property(spark):
    from termloom.operators import service as S
    from termloom.operators.graph import Graph

    with pytest.raises(ValueError, match="no concept with originalId"):
        S.get_paths_to_facetroots(Graph.empty(spark), ["x"], id_property="originalId")


def test_only_rows_with_several_keys_need_components(spark, monkeypatch):
    from termloom.operators import resolve

    schema = "ord long, original_id string, original_source string, source_id string, source string, unique_source_id boolean"
    rows = [(1, None, None, "a", "s", False), (2, None, None, "b", "s", False), (3, None, None, "a", "s", False), (4, None, None, None, None, None), (5, "o", "x", None, None, None)]
    linked = [(6, "o", "x", "b", "s", True), (7, None, None, "b", "t", True), (8, "o", "x", "b", "s", True)]
    got = resolve.unite_batch(spark.createDataFrame(rows + linked, schema))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 2), (6, 2), (7, 2), (8, 2)]
    with pytest.raises(Exception, match="two original ids in 2"):
        resolve.unite_batch(spark.createDataFrame([*rows, *linked, (9, "p", "x", "b", "t", False)], schema)).collect()
    monkeypatch.setattr(resolve, "connected_components", None)
    assert sorted(map(tuple, resolve.unite_batch(spark.createDataFrame(rows, schema)).collect())) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5)]
