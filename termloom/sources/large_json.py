"""Reading one large JSON document with many tasks.

A document is cut into file blocks, as lines that end with a closing brace. What a block does to the nesting depends only on
whether it begins inside a string, so each block is summed up for both cases; the sums, one row for each block, then give
every block's true beginning. In a second pass each block gives the elements that lie in it as text; those that lie across
blocks are put together from their pieces. No task or row holds more than a block and one element.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import CONCEPT_JSON, IMPORT, typed_concept, with_group

#: What changes strings or nesting; an escaped character is passed over as one.
TOKEN = re.compile(r'\\.|"|[{}\[\]]', re.S)
KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:')
SUMS = "block long, began_in_string boolean, ends_in_string boolean, depth int, opens map<int,long>"
FOUND = "kind string, number long, block long, text string"


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Iterator[str]]]:
    """Each block's lines in order, each with the brace that ended it."""
    held: list = [None, []]
    for batch in batches:
        for block, value in zip(batch["block"].tolist(), batch["value"].tolist(), strict=True):
            if held[0] is not None and block != held[0]:
                yield held[0], held[1]
                held = [None, []]
            held[0] = block
            held[1].append(value + "}")
    if held[0] is not None:
        yield held[0], held[1]


def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas function: lines (block, value) to SUMS, two rows for each block. opens counts brackets that open, by the depth
    at which they do, from the block's beginning."""
    for block, lines in _blocks(batches):
        depth, opens, quotes = [0, 0], [Counter(), Counter()], 0
        for line in lines:
            for m in TOKEN.finditer(line):
                t = m[0]
                if t == '"':
                    quotes ^= 1
                elif t[0] != "\\":
                    # a block that begins outside (0) or inside (1) a string is outside of strings after an even or odd number of quotes
                    if t in "{[":
                        opens[quotes][depth[quotes]] += 1
                        depth[quotes] += 1
                    else:
                        depth[quotes] -= 1
        rows = [(block, bool(s), bool(s ^ quotes), depth[s], dict(opens[s])) for s in (0, 1)]
        yield pd.DataFrame(rows, columns=["block", "began_in_string", "ends_in_string", "depth", "opens"])


@dataclass(frozen=True)
class Begin:
    """How a block begins: inside a string, at which depth, and how many elements have begun before."""

    in_string: bool
    depth: int
    number: int


def beginnings(sums: list, level: int) -> dict[int, Begin]:
    """Each block's beginning, from the sums of all; elements open at depth level."""
    by = {(r["block"], r["began_in_string"]): r for r in sums}
    in_string, depth, number, out = False, 0, 0, {}
    for block in sorted({b for b, _ in by}):
        r = by[block, in_string]
        out[block] = Begin(in_string, depth, number)
        number += r["opens"].get(level - depth, 0)
        in_string, depth = r["ends_in_string"], depth + r["depth"]
    return out


def pieces(begins: dict[int, Begin], level: int, name: str | None):
    """mapInPandas function: lines to FOUND: whole elements; first, further and last pieces of those that go across blocks; keys of
    the document's object, with the number of the next element; the text before key `name`, if it is in the first block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, lines in _blocks(batches):
            b = begins[block]
            inside, depth, number = b.in_string, b.depth, b.number
            rows, held, head = [], [] if depth > level else None, [] if block == min(begins) else None
            across = held is not None  # began in another block
            for line in lines:
                start = 0  # of what is held, in this line
                for m in TOKEN.finditer(line):
                    t = m[0]
                    if t[0] == "\\":
                        continue
                    if t == '"':
                        if not inside and depth == 1 and level == 2 and (key := KEY.match(line, m.start())):
                            rows.append(("key", number, block, key[1]))
                            if head is not None and key[1] == name:
                                rows.append(("head", number, block, "".join(head) + line[: m.start()]))
                                head = None
                        inside = not inside
                    elif inside:
                        continue
                    elif t in "{[":
                        if depth == level:
                            held, start, across = [], m.start(), False
                            number += 1
                        depth += 1
                    else:
                        depth -= 1
                        if depth == level and held is not None:
                            held.append(line[start : m.end()])
                            rows.append(("piece" if across else "whole", number - 1, block, "".join(held)))
                            held = None
                if held is not None:
                    held.append(line[start:])
                if head is not None:
                    head.append(line)
            if held is not None:
                rows.append(("piece", number - 1, block, "".join(held)))
            yield pd.DataFrame(rows, columns=["kind", "number", "block", "text"])

    return run


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="}").select(F.col("_metadata.file_block_start").alias("block"), "value")


def read_elements(spark: SparkSession, path: str, name: str | None = None) -> tuple[DataFrame, str | None]:
    """(elements, head): the elements (ord, json) of one file's array: the document itself, or the array under key name of
    its object. Elements are objects or arrays. head is the document's text before that key, which must stand in the file's
    first block; what follows the array is left out.
    """
    level, lines = 2 if name else 1, _lines(spark, path)
    sums = lines.mapInPandas(summed, SUMS).collect()  # two small rows for each block
    begins = beginnings(sums, level)
    found = lines.mapInPandas(pieces(begins, level, name), FOUND)
    low, high, head = 0, None, None
    if name:
        marks = sorted((r["number"], r["block"], r["kind"], r["text"]) for r in found.where("kind IN ('key', 'head')").collect())  # a row for each key
        at = [k for k, (_, _, kind, text) in enumerate(marks) if kind == "key" and text == name]
        heads = [text for _, _, kind, text in marks if kind == "head"]
        if not at or not heads:
            raise ValueError(f"no key {name} in the first block of {path}")
        low, head = marks[at[0]][0], heads[0]
        later = [number for number, _, kind, text in marks if kind == "key" and text != name and number > low]
        high = min(later, default=None)
    own = found.where((F.col("kind").isin("whole", "piece")) & (F.col("number") >= low) & (F.lit(True) if high is None else F.col("number") < high))
    whole = own.where("kind = 'whole'").select("number", "text")
    cut = own.where("kind = 'piece'").groupBy("number").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("p"))
    cut = cut.select("number", F.array_join(F.col("p")["text"], "").alias("text"))
    return whole.unionByName(cut).select((F.col("number") - low).alias("ord"), F.col("text").alias("json")), head


def read_large_import(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents.read_import of one large file: facet and options come before the concepts, which are read by many tasks."""
    elements, head = read_elements(spark, path, "concepts")
    doc = spark.createDataFrame([(head + '"concepts":[]}',)], "j string").select(F.from_json("j", IMPORT).alias("d")).select("d.*")
    facet = with_group(doc.where("facet IS NOT NULL").select("facet.*"))
    concepts = elements.select("ord", typed_concept(F.from_json("json", CONCEPT_JSON)).alias("c")).select("ord", "c.*")
    return facet, doc.where("importOptions IS NOT NULL").select("importOptions.*"), concepts


def read_large_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of one large file whose document is an array (mappings, facets), with their place ord."""
    elements, _ = read_elements(spark, path)
    return elements.select("ord", F.from_json("json", schema).alias("c")).select("ord", "c.*")
