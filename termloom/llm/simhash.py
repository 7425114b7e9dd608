"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; two of them are linked at DISTANCE = 3 or fewer differing bits. Cut into two segments of 32 bits,
fewer than the four that exact matches would need, such a pair has a segment that differs by at most one bit. So each
fingerprint is posted under each of its segments with each of its bits left out, 64 keys in all, and linked pairs share a
key. Equal fingerprints are one node.

Postings are joined with themselves by key: sorted by key and streamed, so that a key's members meet and are verified. A
pair counts under one of its keys only, and a key yields a spanning forest of its links, not all pairs. Keys that very many
fingerprints share are cut further: the 32 bits that are left in the other segment differ by at most three as well, so they
get two segments and deletion variants in turn. Then at most 18 bits are open, which bounds a key's distinct members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from .common import Scratch, checkpointed
from .near_dup import HOT_SHARE, look_up

DISTANCE = 3
SEGMENT = 32
SEED = 42
#: Fingerprints that share a segment's bits beyond this make its keys ones that are cut further. It decides only how pairs
#: are found, never which.
LONG_LIST = 4096
#: Shingles whose bits are counted at once, bytes of text that are cut into words at once.
SLAB, SLICE = 1 << 16, 1 << 22


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's space-joined shingles in order, repeats included; fewer words are one shingle, none have none."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    digest, last, at, n = xxhash.xxh64_intdigest, [], 0, 0
    while at < len(raw):
        to = min(len(raw), at + SLICE)
        while to < len(raw) and raw[to : to + 1].strip():  # on to the end of the word
            to += 1
        words = last + raw[at:to].split()
        n += len(words) - len(last)
        if len(words) >= width:
            yield np.array([digest(b" ".join(words[k : k + width]), SEED) for k in range(len(words) - width + 1)], np.uint64)
        last, at = words[max(0, len(words) - width + 1) :] if width > 1 else [], to
    if 0 < n < width:
        yield np.array([digest(b" ".join(last), SEED)], np.uint64)


def fingerprint(text: str | None, width: int) -> int:
    """Bits that are set in over half of the hashes, as a signed number; 0 if there are none."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        n += len(hashes)
        for k in range(0, len(hashes), SLAB):
            bits = np.unpackbits(hashes[k : k + SLAB].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, width: int) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return of(text)


def variants(value: Column, bits: int) -> Column:
    """Of a segment of so many bits: (place, rest) for each bit that is left out."""
    places = F.array(*(F.struct(F.lit(p).alias("place"), F.lit(~(1 << p)).cast("long").alias("mask")) for p in range(bits)))
    return F.transform(places, lambda x: F.struct(x["place"].alias("place"), value.bitwiseAND(x["mask"]).alias("rest")))


def segments(nodes: DataFrame) -> DataFrame:
    """(fp, seg, value): both segments of each fingerprint, the low one first."""
    low, high = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1)), F.shiftrightunsigned("fp", SEGMENT)
    pair = F.array(F.struct(F.lit(0).alias("seg"), low.alias("value")), F.struct(F.lit(1).alias("seg"), high.alias("value")))
    return nodes.select("fp", F.inline(pair))


def postings(nodes: DataFrame, long_list: int, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> tuple[DataFrame, DataFrame]:
    """(fp, key) of keys that few share, and (fp, key, value) of keys that many may share, where value is the other segment.

    Only values of a segment that more than half of long_list fingerprints have can make a key's list long; their places
    are noted on these values and on those that are one bit away."""
    cut = segments(nodes)
    many = cut.groupBy("seg", "value").agg(F.count("*").alias("size")).where(F.col("size") > long_list // 2)
    near = many.select("seg", "value", F.explode(variants(F.col("value"), SEGMENT)).alias("v"))
    both = near.select("seg", F.explode(F.array("v.rest", F.col("v.rest").bitwiseOR(F.expr("shiftleft(1L, v.place)")))).alias("value"), "v.place")
    noted = keep(both.groupBy("seg", "value").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("long_places")))
    cut = cut.join(noted, ["seg", "value"], "left") if not noted.isEmpty() else cut.withColumn("long_places", F.lit(0).cast("long"))
    posts = cut.select("fp", "seg", F.coalesce("long_places", F.lit(0)).alias("long_places"), F.explode(variants(F.col("value"), SEGMENT)).alias("v"))
    key = F.shiftleft(F.col("v.rest"), 6).bitwiseOR(F.col("seg") * 32 + F.col("v.place"))
    is_long = F.getbit("long_places", F.col("v.place")) == 1
    other = F.when(F.col("seg") == 0, F.shiftrightunsigned("fp", SEGMENT)).otherwise(F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1)))
    return posts.where(~is_long).select("fp", key.alias("key")), posts.where(is_long).select("fp", key.alias("key"), other.alias("value"))


def cut_further(posts: DataFrame) -> DataFrame:
    """(fp, key, sub): long lists by the deletion variants of the other segment's halves."""
    half = SEGMENT // 2
    pair = F.array(F.struct(F.lit(0).alias("seg"), F.col("value").bitwiseAND(F.lit((1 << half) - 1)).alias("half")), F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned("value", half).alias("half")))
    sub = posts.select("fp", "key", F.inline(pair)).select("fp", "key", "seg", F.explode(variants(F.col("half"), half)).alias("v"))
    return sub.select("fp", "key", F.shiftleft(F.col("v.rest"), 5).bitwiseOR(F.col("seg") * 16 + F.col("v.place")).cast("int").alias("sub"))


def counts_here(differ: np.ndarray, key: int | np.ndarray) -> np.ndarray:
    """Whether pairs whose fingerprints differ in these bits are linked and count under this key: the low segment's if it
    differs by one bit at most, that of the bit, or of the first place if there is none."""
    key = np.asarray(key, np.int64)
    seg, place = key & 32, (key & 31).astype(np.uint64)
    low, high = differ & np.uint64(0xFFFFFFFF), differ >> np.uint64(32)
    own = np.where(seg > 0, high, low)
    expected = np.where(own == 0, place == 0, own == np.uint64(1) << place)
    return (np.bitwise_count(differ) <= DISTANCE) & expected & ((seg == 0) | (np.bitwise_count(low) > 1))


def forest(fps: np.ndarray, key: int) -> list[tuple[int, int]]:
    """A spanning forest of the links that count under a key, between distinct fingerprints."""
    left, out = np.arange(1, len(fps)), []
    front = [0]
    while front or len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
        x = front.pop()
        ok = counts_here(fps[left] ^ fps[x], key)
        found = left[ok].tolist()
        left = left[~ok]
        out += [(int(fps[x]), int(fps[y])) for y in found]
        front += found
    return out


def joined_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas function: postings sorted by key (and sub) to links (a, b). A list may go on in the next batch."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch])
        keys = rest.drop(columns="fp").to_numpy()
        same_as_last = (keys == keys[-1]).all(axis=1)
        done = len(keys) - int(same_as_last.sum())
        if done:
            yield _links(rest[:done])
            rest = rest[done:]
    if rest is not None:
        yield _links(rest)


def _links(rows: pd.DataFrame) -> pd.DataFrame:
    fps, keys = rows["fp"].to_numpy().view(np.uint64), rows["key"].to_numpy()
    new = np.ones(len(rows), bool)
    new[1:] = keys[1:] != keys[:-1]
    if "sub" in rows:
        new[1:] |= rows["sub"].to_numpy()[1:] != rows["sub"].to_numpy()[:-1]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(rows)))
    two = starts[sizes == 2]
    two = two[counts_here(fps[two] ^ fps[two + 1], keys[two])]
    found = [(a, b) for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True) for a, b in forest(fps[s : s + n], int(keys[s]))]
    more = np.array(found, np.uint64).reshape(-1, 2)
    return pd.DataFrame({"a": np.append(fps[two], more[:, 0]).view(np.int64), "b": np.append(fps[two + 1], more[:, 1]).view(np.int64)})


def fingerprint_links(nodes: DataFrame, long_list: int = LONG_LIST, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that connect all that DISTANCE or fewer bits link."""
    few, many = postings(nodes, long_list, keep)
    links = few.repartition("key").sortWithinPartitions("key").mapInPandas(joined_links, "a long, b long")
    more = cut_further(many).repartition("key", "sub").sortWithinPartitions("key", "sub").mapInPandas(joined_links, "a long, b long")
    return links.unionByName(more)


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, long_list: int = LONG_LIST) -> DataFrame:
    """(doc, fingerprint, component_id) for each row of docs: its SimHash over width-word shingles as 16 hex digits, and the
    smallest id that links of DISTANCE or fewer bits reach.

    A-Z are lower-cased, words are [^\\x20\\x09-\\x0D]+. Fewer words than width are one shingle; null, empty and blank texts
    have fingerprint zero and are linked like any other. Rows that repeat an id are one document: the links of each are the
    document's. A row without id links nothing and its component is null. Ids are of any type that has an order. Other
    columns, whatever their names, don't matter. An empty table gives an empty result. Texts are taken whole.
    """
    with Scratch(docs.sparkSession) as keep:
        return checkpointed(_components(docs, id_col, text_col, width, long_list, keep))


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, long_list: int, keep: Scratch) -> DataFrame:
    own = keep(docs.select(F.col(id_col).alias("doc"), fingerprints(F.col(text_col), width).alias("fp")))
    some = own.where("doc IS NOT NULL")
    classes = keep(some.groupBy("fp").agg(F.min("doc").alias("first"), F.count("*").alias("copies")))
    links = [fingerprint_links(classes.select("fp"), long_list, keep)]
    repeated = keep(some.groupBy("doc").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("doc", "a"))
    if not repeated.isEmpty():
        links.append(some.join(repeated, "doc").where("fp <> a").select("a", F.col("fp").alias("b")))
    label = connected_components(keep(reduce(DataFrame.union, links).distinct()), keep)
    of = classes.join(label, classes["fp"] == label["node"], "left").select("fp", "first", "copies", F.coalesce("label", "fp").alias("label"))
    lowest = of.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    n_classes, n_rows = classes.count(), own.count()
    hot = F.col("members") > HOT_SHARE * n_classes
    of = look_up(of.select("fp", "copies", "label"), lowest, "label", hot).select("fp", "copies", "component_id")
    found = look_up(some, of, "fp", F.col("copies") > HOT_SHARE * n_rows).select("doc", "fp", "component_id")
    alone = own.where("doc IS NULL").select("doc", "fp", F.col("doc").alias("component_id"))
    return found.union(alone).select("doc", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
