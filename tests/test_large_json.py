"""One large document read by many tasks against the plain reader."""

from __future__ import annotations

import json
import random

import pytest

from termloom.sources import documents as D
from termloom.sources import large_json as L

ODD = ['a "quoted" {text}', "back\\slash\\", "[not a list]", "}{", "é日本\U0001f600", "line\nbreak", '\\"', "", "}" * 40, '"concepts": [']


def concept(r, k):
    text = lambda: r.choice(ODD)
    c = {"preferredName": f"n{k}", "synonyms": [text() for _ in range(r.randint(0, 4))], "coordinates": {"sourceId": f"C{k}", "source": text() or "s"}}
    if r.random() < 0.3:
        c["additional_properties"] = {"t": text(), "n": k, "l": [text(), {"x": [text()]}], "o": {"concepts": [1]}}
    if r.random() < 0.2:
        c["descriptions"] = [text() * 30]
    return c


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("block", "indent"), [(700, None), (997, 2), (100_000, None)])
def test_import_equals_the_plain_reader(spark, tmp_path, small_blocks, block, indent):
    r = random.Random(block)
    doc = {"facet": {"name": "f {[", "facetGroup": {"name": "g", "labels": ["x", "y"]}, "labels": ["l"]}, "importOptions": {"merge": False, "cutParents": ["a"]}, "name_num_concepts": 90, "concepts": [concept(r, k) for k in range(90)]}
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(indent)))
    facet, options, concepts = D.read_import(spark, str(path))
    plain = [sorted(map(repr, df.collect())) for df in (facet, options, concepts)]
    small_blocks(block)
    facet, options, concepts = L.read_large_import(spark, str(path))
    if block < 1000:
        assert L._lines(spark, str(path)).rdd.getNumPartitions() > 10
    assert [sorted(map(repr, df.collect())) for df in (facet, options, concepts)] == plain


def test_arrays_and_keys_after_the_array(spark, tmp_path, small_blocks):
    rows = [{"id1": f"a{k}}}", "id2": f"b{k}", "mappingType": "EQUAL"} for k in range(60)]
    path = tmp_path / "m.json"
    path.write_text(json.dumps(rows))
    small_blocks(300)
    got = L.read_large_array(spark, str(path), "id1 string, id2 string, mappingType string").orderBy("ord").collect()
    assert [r.asDict() for r in got] == [{"ord": k, **x} for k, x in enumerate(rows)]
    path.write_text(json.dumps({"head": {"a": [1]}, "concepts": rows, "tail": [{"x": 1}], "more": {"y": 2}}))
    found, head = L.read_elements(spark, str(path), "concepts")
    assert sorted((r.ord, json.loads(r.json)["id2"]) for r in found.collect()) == [(k, f"b{k}") for k in range(60)]
    assert json.loads(head + '"concepts": []}') == {"head": {"a": [1]}, "concepts": []}
    path.write_text("[]")
    assert L.read_elements(spark, str(path))[0].collect() == []
    path.write_text('{"other": [{"a": 1}]}')
    with pytest.raises(ValueError, match="no key concepts"):
        L.read_elements(spark, str(path), "concepts")
