"""Removal of lines that other documents hold as well.

Line hashes are dealt by ranges, with documents and positions as secondary sort keys, and each partition is streamed once
to find first occurrences. Hashes are uniform, so equal ranges need no sampling. A line that very many documents share
would fill one range: such hashes are few, their first document is found by partial aggregates, and their lines stay
where they are. What is returned are per-document keep bitmaps, never text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, ascii_lower, checkpointed, free_name

#: Ranges that the line hashes are cut into, as a power of 2.
RANGE_BITS = 14
#: A hash is hot if it has this share of all lines or more; so there are at most as many hot ones as its inverse.
HOT_SHARE = 1 / 1024
KEEP = "__keep_words"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    """Lines between \\n; null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hot_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2, first): the first document of each hash that has HOT_SHARE of the lines, and of some others. At most a few
    for each of 1 / HOT_SHARE values of h1, so it can be broadcast. Null documents come last."""
    often = lines.freqItems(["h1"], HOT_SHARE).select(F.explode("h1_freqItems").alias("h1"))
    return lines.join(F.broadcast(often), "h1").groupBy("h1", "h2").agg(F.min("doc").alias("first"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """(doc, text_hash, keep_words): for each text that loses lines, its keep bitmap as 64-bit words from the first
    line on, the lowest bit first; lines beyond the last word are kept. Texts that lose nothing have no row.

    A key of at least min_chars code points keeps its lines only in the smallest id that holds it. Rows that repeat
    an id count as that document; null ids together are one document after all others. Null texts are one empty line.
    Other columns, whatever their names, don't matter. An empty table has no bitmaps. Texts are cut into lines once.
    """
    lines = keep(
        docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    hot = F.broadcast(keep(hot_lines(lines)))
    late_hot = lines.join(hot, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("first")))
    rest = lines.join(hot, ["h1", "h2"], "left_anti").withColumn("range", F.shiftright("h1", 64 - RANGE_BITS)).repartition("range")
    in_order = W.partitionBy("range", "h1", "h2").orderBy(F.col("doc").asc_nulls_last(), "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    late = rest.withColumn("first", F.first("doc").over(in_order)).where(~F.col("doc").eqNullSafe(F.col("first")))
    dropped = late.select("doc", "text_hash", "pos").union(late_hot.select("doc", "text_hash", "pos"))
    words = dropped.groupBy("doc", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    packed = words.groupBy("doc", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops"))
    dense = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("drops"))), lambda i: F.bitwise_not(F.coalesce(F.try_element_at("drops", i), F.lit(0).cast("long"))))
    return packed.select("doc", "text_hash", dense.alias("keep_words"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_col: str = KEEP) -> DataFrame:
    """docs with each row's bitmap (null: keep all) in column keep_col; other columns and repeated rows stay as they are."""
    h, doc, text_hash = (free_name(docs, c) for c in ("h", "bitmap_doc", "bitmap_hash"))
    b = bitmaps.select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("keep_words").alias(keep_col))
    return docs.withColumn(h, F.xxhash64(text_col)).join(b, F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(h) == F.col(text_hash)), "left").drop(doc, text_hash, h)


def is_kept(pos: Column, keep_col: str = KEEP) -> Column:
    """Whether keep_col keeps the line at pos."""
    word = F.coalesce(F.get(keep_col, F.floor(pos / 64).cast("int")), F.lit(-1).cast("long"))
    return F.getbit(word, F.pmod(pos, F.lit(64)).cast("int")) == 1


def kept_text(text: Column, keep_col: str = KEEP) -> Column:
    """The lines that keep_col keeps, joined by \\n."""
    return F.when(F.col(keep_col).isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(lines_of(text), lambda line, i: is_kept(i, keep_col)), "\n"))


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs with repeated lines cut from text_col; all rows, columns and other values stay. A null text stays null."""
    keep_col = free_name(docs, "keep_words")
    # the lines' hashes stand as Parquet and are gone before texts are shuffled
    with Scratch(docs.sparkSession) as scratch:
        bitmaps = checkpointed(keep_bitmaps(docs, id_col, text_col, min_chars, scratch))
    cut = with_bitmaps(docs, bitmaps, id_col, text_col, keep_col)
    return cut.withColumn(text_col, F.when(F.col(text_col).isNotNull(), kept_text(F.col(text_col), keep_col))).drop(keep_col)
