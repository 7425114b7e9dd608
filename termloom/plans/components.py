"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an undirected edge list; label is the component's smallest node.

    Every node points to the smallest of itself and its neighbours; pointers are followed to their ends, each write making
    them four times as long, edges are redrawn between these ends, and those within one node vanish. So a chain of any
    length is one node after a round, and jobs grow with the logarithm of its length. It is done once no edge is left. keep
    writes a round's tables and cuts their lineage (checkpoint()). Nothing is collected but whether rows remain. Null ends
    are left out; loops give their node a component of its own.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    e, labels = keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    for _ in range(max_rounds):
        both = e.union(e.select("b", "a"))
        p = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to"))
        p = keep(_followed(p))
        while not p.where("moved").isEmpty():
            p = keep(_followed(p))
        p = p.select("node", "to")
        labels = p.withColumnRenamed("to", "label") if labels is None else keep(
            labels.join(p, labels["label"] == p["node"], "left").select(labels["node"], F.coalesce("to", "label").alias("label")),
        )
        pa, pb = p.select(F.col("node").alias("a"), F.col("to").alias("ta")), p.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = e.join(pa, "a").join(pb, "b").where("ta <> tb")
        e = keep(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        if e.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def _followed(p: DataFrame) -> DataFrame:
    """Pointers (node, to) followed twice, and whether the second time still moved them."""
    for _ in range(2):
        q = p.select(F.col("node").alias("mid"), F.col("to").alias("next")).hint("merge")  # as large as p: never through the driver
        p = p.join(q, p["to"] == q["mid"], "left").select("node", F.coalesce("next", "to").alias("to"), F.coalesce(F.col("next") != F.col("to"), F.lit(False)).alias("moved"))
    return p
