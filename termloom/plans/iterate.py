"""Iteration over DataFrames: checkpoints, closures, paths and pointer chains."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share. Only a local session without that
    setting gets a folder of its own."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="termloom-"))
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder; its lineage ends there.

    Joins with it are merge joins unless the other side is broadcast by hand: Spark guesses its size from compressed files, and
    tables that grow with the input would be broadcast through the driver."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True).hint("merge")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of the file system that path names, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def closure(start: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(origin, node): start's rows and all that edges (src, dst) reach from them, each once; cycles end."""
    seen = front = keep(start.select("origin", "node").distinct())
    for k in range(1, max_rounds + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("origin", F.col("dst").alias("node")).distinct()
        front = keep(step.join(seen, ["origin", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.union(front)
        if k % 16 == 0:  # each front is written already; now and then they become one table
            seen = keep(seen)
    raise RuntimeError(f"closure did not end within {max_rounds} rounds")


def all_paths(start: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(origin, node, path): every walk from start's nodes along edges that meets no node twice, the empty one included."""
    front = keep(start.select("origin", "node", F.array("node").alias("path")))
    parts = [front]
    for _ in range(max_rounds):
        step = front.join(edges, front["node"] == edges["src"]).where(~F.array_contains("path", F.col("dst")))
        front = keep(step.select("origin", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")))
        if front.isEmpty():
            out = parts[0]
            for p in parts[1:]:
                out = out.union(p)
            return out
        parts.append(front)
    raise RuntimeError(f"paths did not end within {max_rounds} rounds")


def ends_of_chains(parents: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, top): where each node's chain of parents (node, parent) ends; chains are halved each round.

    A node must have one parent. A cycle raises an error.
    """
    at = keep(parents.select("node", F.col("parent").alias("top")))
    for _ in range(max_rounds):
        nxt = at.select(F.col("node").alias("mid"), F.col("top").alias("next"))
        moved = keep(at.join(nxt, at["top"] == nxt["mid"], "left").select(
            "node", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("moved"),
        ))
        at = moved.select("node", "top")
        if moved.where("moved").isEmpty():
            return at
    raise RuntimeError("chains of parents have a cycle")


def heights(children: DataFrame, max_height: int = 256) -> DataFrame:
    """(node, height) of each parent in (parent, child): 1 above what is no parent, else 1 more than its highest child.
    A chain longer than max_height, as a cycle has, raises an error."""
    kids = keep(children.select("parent", "child").distinct())
    done = keep(kids.select(F.col("parent").alias("node")).distinct().withColumn("height", F.lit(1)))
    front = done
    for k in range(2, max_height + 1):
        above = kids.join(front.select(F.col("node").alias("child")), "child", "left_semi")
        front = keep(above.select(F.col("parent").alias("node")).distinct().withColumn("height", F.lit(k)))
        if front.isEmpty():
            return done
        done = done.join(front.select("node"), "node", "left_anti").union(front)
        if k % 8 == 0:
            done = keep(done)
    raise RuntimeError(f"aggregates are nested more than {max_height} deep, or contain each other")
