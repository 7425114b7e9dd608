"""Facets and their groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .graph import SCHEMAS, Graph, next_number

HIERARCHICAL = "hierarchical"


def ensure_group(
    graph: Graph, name: str, position: int | None = None, labels: list[str] | None = None, kind: str | None = None, no_facet: bool = False,
) -> tuple[Graph, str]:
    """(graph, group id): the group of that name under its root; a group that is there gets new labels."""
    found = graph.groups.where((F.col("name") == name) & (F.col("is_no_facet") == no_facet)).first()
    if found:
        union = F.when(
            F.col("grp") == found["grp"],
            F.array_union(F.coalesce("labels", F.array().cast("array<string>")), F.array(*map(F.lit, labels or [])).cast("array<string>")),
        ).otherwise(F.col("labels"))
        return graph.with_(groups=graph.groups.withColumn("labels", union)), found["grp"]
    grp = f"fgid{next_number(graph, 'fgid')}"
    new = graph.groups.sparkSession.createDataFrame([(grp, name, position, kind, labels or [], no_facet)], SCHEMAS["groups"])
    return graph.with_(groups=graph.groups.unionByName(new)), grp


def create_facet(graph: Graph, facet: dict) -> tuple[Graph, str]:
    """(graph, facet id): always a new facet. It needs a facetGroup (a name, or a dict with name, position, labels, type)."""
    group = facet.get("facetGroup")
    group = {"name": group} if isinstance(group, str) else group
    if not group or not group.get("name"):
        raise ValueError("a facet needs a facet group")
    no_facet = bool(facet.get("noFacet"))
    graph, grp = ensure_group(graph, group["name"], group.get("position"), group.get("labels"), group.get("type"), no_facet)
    fid = f"fid{next_number(graph, 'fid')}"
    row = (
        fid, facet.get("name"), facet.get("shortName"), facet.get("customId"), facet.get("labels") or [],
        facet.get("sourceType") or HIERARCHICAL, grp, no_facet,
    )
    return graph.with_(facets=graph.facets.unionByName(graph.facets.sparkSession.createDataFrame([row], SCHEMAS["facets"]))), fid


def insert_facets(graph: Graph, facets: list[dict]) -> tuple[Graph, list[dict]]:
    """(graph, [{name, id}]) in input order: always new facets, all of them in one job. Each needs a facetGroup, as create_facet
    says; groups that are there get new labels, others are made."""
    asked: dict[tuple[str, bool], dict] = {}  # the groups named, with what is said of them first and all their labels
    of = []
    for f in facets:
        group = f.get("facetGroup")
        group = {"name": group} if isinstance(group, str) else group
        if not group or not group.get("name"):
            raise ValueError("a facet needs a facet group")
        key = (group["name"], bool(f.get("noFacet")))
        first = asked.setdefault(key, {**group, "labels": []})
        first["labels"] = list(dict.fromkeys([*first["labels"], *(group.get("labels") or [])]))
        of.append(key)
    spark = graph.groups.sparkSession
    there = {
        (r["name"], bool(r["is_no_facet"])): r["grp"]
        for r in graph.groups.where(F.col("name").isin([n for n, _ in asked])).select("name", "is_no_facet", "grp").collect()
    }
    start = next_number(graph, "fgid")
    made = {key: f"fgid{start + k}" for k, key in enumerate(key for key in asked if key not in there)}
    rows = [(grp, key[0], asked[key].get("position"), asked[key].get("type"), asked[key]["labels"], key[1]) for key, grp in made.items()]
    more = spark.createDataFrame([(grp, asked[key]["labels"]) for key, grp in there.items() if key in asked], "grp string, more array<string>")
    none = F.array().cast("array<string>")
    grown = graph.groups.join(F.broadcast(more), "grp", "left")  # no more rows than facets given
    groups = grown.withColumn(
        "labels", F.when(F.col("more").isNotNull(), F.array_union(F.coalesce("labels", none), "more")).otherwise(F.col("labels")),
    ).select(graph.groups.columns)
    grp_of, first_id = {**there, **made}, next_number(graph, "fid")
    new = [(f"fid{first_id + k}", f.get("name"), f.get("shortName"), f.get("customId"), f.get("labels") or [], f.get("sourceType") or HIERARCHICAL, grp_of[key], key[1]) for k, (f, key) in enumerate(zip(facets, of, strict=True))]
    graph = graph.with_(
        groups=groups.unionByName(spark.createDataFrame(rows, SCHEMAS["groups"])),
        facets=graph.facets.unionByName(spark.createDataFrame(new, SCHEMAS["facets"])),
    )
    return graph, [{"name": f.get("name"), "id": row[0]} for f, row in zip(facets, new, strict=True)]


def resolve_facet(graph: Graph, facet: dict | None) -> tuple[Graph, str | None]:
    """By id (an unknown one is an error), else by name, else a new facet. None: no facet, which means merging."""
    if not facet:
        return graph, None
    if facet.get("id"):
        if not graph.facets.where(F.col("facet") == facet["id"]).first():
            raise ValueError(f"no facet {facet['id']}")
        return graph, facet["id"]
    found = graph.facets.where(
        (F.col("name") == facet.get("name")) & ~F.col("is_no_facet")
    ).agg(F.min_by("facet", F.struct(F.length("facet"), "facet")).alias("f")).first()["f"]
    return (graph, found) if found else create_facet(graph, facet)


def ensure_no_facet(graph: Graph, fid: str) -> Graph:
    """The facet's twin among the no-facets: its properties and id, below a group of the same name."""
    if graph.facets.where((F.col("facet") == fid) & F.col("is_no_facet")).first():
        return graph
    own = graph.facets.where(F.col("facet") == fid).first()
    group = graph.groups.where(F.col("grp") == own["grp"]).first()
    graph, grp = ensure_group(graph, group["name"], group["position"], group["labels"], group["type"], True)
    row = (fid, own["name"], own["short_name"], own["custom_id"], [], own["source_type"], grp, True)
    return graph.with_(facets=graph.facets.unionByName(graph.facets.sparkSession.createDataFrame([row], SCHEMAS["facets"])))
