"""Near-duplicates by an inverted join over MinHash signature coordinates.

A document's word shingles become a signature of COORDS coordinates, each of ROWS minima. Documents with equal shingle
sets form a class with one representative. Representatives are posted under each pair of coordinate and value. A pair is
a candidate if it agrees in at least MATCHES coordinates and its sets are near enough in size; candidates are confirmed
on the full shingle sets. That rule holds however long a list is.

Pairs that agree in MATCHES coordinates must meet in one of the first COORDS - MATCHES + 1 of them, so only this prefix
is posted. Members of a list are first paired with one of them, another in each coordinate, and what this links is one
component; only lists whose members are then in different components need more, and of lists with the same members only
one is merged, the others are skipped. Lists of at most LONG_LIST members are merged as pairs of rows; longer ones as
matrices, in blocks of members of like size, which count the collisions and the common shingles of all pairs at once and
yield a spanning forest of the links, no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.components import connected_components
from .bpe import Numbered, shards
from .common import Scratch, checkpointed

#: A pair of similarity 0.8 agrees in a coordinate with probability 0.8 ** ROWS, and in fewer than MATCHES of COORDS
#: with a probability of about 1 in 80,000; one of 0.05 agrees in a coordinate once in 160,000 times.
COORDS, ROWS, MATCHES = 32, 4, 3
#: How lists are merged (never which pairs count): longer ones than LONG_LIST in blocks of about BLOCK_DOCS documents and
#: BLOCK_SHINGLES shingles.
LONG_LIST, BLOCK_DOCS, BLOCK_SHINGLES, SLAB = 48, 1024, 1_000_000, 2048
#: A key is hot if it holds more than this share of the rows; so there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 1024
#: 64-bit words of the filter that keeps texts without candidates out of shuffles; it is broadcast.
SIFT_WORDS = 1 << 17
_ODD = np.random.default_rng(20).integers(0, 2**63, (COORDS * ROWS, 2), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15], np.uint64)
FEATURES = "n_shingles long, set_key binary, signature array<long>"


def words(text: str | None) -> list[bytes]:
    """[^\\x20\\x09-\\x0D]+ after A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word hashes' shingles; fewer words than width are one shingle."""
    n, take = len(ids), min(width, len(ids))
    out = np.full(max(0, n - take + 1) if n else 0, take, np.uint64)
    for k in range(take):
        out = _mixed(out * _MIX[2] + ids[k : n - take + 1 + k])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):  # bounded memory however long the text
        np.minimum(low, (_ODD[:, :1] * shingles[None, k : k + 4096] + _ODD[:, 1:]).min(axis=1), out=low)
    value = np.arange(COORDS, dtype=np.uint64)
    for r in range(ROWS):
        value = _mixed(value * _MIX[2] + low[r::ROWS])
    return value.view(np.int64)


def features(text: Column, width: int) -> Column:
    """Struct FEATURES of a text; without words: 0, null, null."""

    @F.pandas_udf(FEATURES)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out, texts = [], texts.tolist()
            for begin, end in shards(texts):  # each with word numbers of its own, which bounds memory
                known, rows = Numbered(), []
                for text in texts[begin:end]:
                    w = words(text)
                    rows.append(np.fromiter(map(known.__getitem__, w), np.int32, len(w)))
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
                for row in rows:
                    s = shingle_hashes(hashes[row], width)
                    out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s)) if len(s) else (0, None, None))
            yield pd.DataFrame(out, columns=["n_shingles", "set_key", "signature"])

    return of(text)


def shingle_set(text: str | None, width: int) -> set:
    w = words(text)
    return {tuple(w)} if 0 < len(w) < width else set(zip(*(w[k:] for k in range(width)), strict=False))


def confirmed(a: Column, b: Column, width: int, percent: int) -> Column:
    """Whether the shingle sets of two texts overlap by percent of their union, by the words themselves."""

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, kept = None, set()
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                if y != last:  # pairs come sorted by the right text's document
                    last, kept = y, shingle_set(y, width)
                mine = shingle_set(x, width)
                both = len(mine & kept)
                out.append(100 * both >= percent * (len(mine) + len(kept) - both))
            yield pd.Series(out, dtype=bool)

    return linked(a, b)


def sifted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose doc may be in ids, found before any shuffle: ids mark bits of a filter that has at most
    SIFT_WORDS words, whatever the number of ids. Some others get through."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * SIFT_WORDS))
    marks = ids.select(bit(ids.columns[0]).alias("k")).groupBy(F.expr("k div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 64 as int))")).alias("bits"))
    k = texts.withColumn("k", bit("doc"))
    return k.join(F.broadcast(marks), F.expr("k div 64") == marks["word"]).where(F.getbit("bits", F.expr("cast(k % 64 as int)")) == 1).select(texts.columns)


def look_up(left: DataFrame, right: DataFrame, on: str, hot: Column) -> DataFrame:
    """left joined with right, whose keys are unique. Rows of right that are hot, which must be of a bounded number, are
    broadcast; no task gets all rows of a hot key."""
    few = F.broadcast(right.where(hot))
    return left.join(few, on).unionByName(left.join(few.select(on), on, "left_anti").join(right.where(~hot), on))


def _confirm(near: DataFrame, texts: DataFrame, width: int, percent: int, keep: Scratch) -> DataFrame:
    """The pairs (a, b) whose shingle sets confirm them. The texts of hot b, with which very many pairs are, go to as many
    slices of them."""
    if near.isEmpty():
        return near
    texts = sifted(texts, near.select("a").union(near.select("b")))
    most = max(4096, int(HOT_SHARE * near.count()))
    hot = F.broadcast(near.groupBy("b").agg(F.ceil(F.count("*") / most).cast("int").alias("slices")).where("slices > 1"))
    near = near.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("slices", F.lit(1))).cast("int").alias("slice"))
    told_a = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    told_b = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")).join(hot, "b", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    both = near.join(told_a, "a").join(told_b.drop("slices"), ["b", "slice"])
    return keep(both.where(confirmed(F.col("text_a"), F.col("text_b"), width, percent)).select("a", "b"))


def _colliding(pairs: DataFrame, classes: DataFrame, percent: int, keep: Scratch) -> DataFrame:
    """The pairs (a, b) that agree in MATCHES coordinates and whose sets are near enough in size. What many pairs have as b
    is broadcast."""
    pairs = keep(pairs)
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"sig_{x}"))
    most = max(4096, int(HOT_SHARE * pairs.count()))
    hubs = pairs.groupBy("b").agg(F.count("*").alias("__met")).where(F.col("__met") > most)
    known = side("b").join(F.broadcast(hubs), "b", "left")
    near = look_up(pairs.join(side("a"), "a"), keep(known), "b", F.col("__met").isNotNull())
    alike = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.size(F.array_intersect("sig_a", "sig_b")) >= MATCHES)
    return keep(near.where(alike).select("a", "b"))


def numbered_shingles(texts: list[list[int]], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as numbers that are equal only for equal shingles; texts are lists of word numbers."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.fromiter((w for t in texts for w in t), np.int64, int(sizes.sum()))
    number = flat
    for k in range(1, width):  # numbers of the first k + 1 words from those of the first k
        number = np.unique((number[:-1] << 32) | flat[k:], return_inverse=True)[1].astype(np.int64) if len(number) > 1 else number[:0]
    out, at, short = [], 0, {}
    for t, n in zip(texts, sizes.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(number[at : at + n - width + 1]))
        else:  # the whole text is one shingle
            out.append(np.array([-1 - short.setdefault(tuple(t), len(short))] if n else [], np.int64))
        at += n
    return out


def linked_forest(sets: list[np.ndarray], signatures: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between candidates with different labels, from their shingle numbers and signatures."""
    flat = np.concatenate(sets)
    shared, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    ok = counts[at] > 1
    place = np.cumsum(counts > 1) - 1  # shingles of one member link nothing
    rows, at, n_shared = rows[ok], place[at[ok]], int((counts > 1).sum())
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.int32)
    for k in range(0, n_shared, SLAB):  # bounded memory however many shingles; a slab's counts are exact as floats
        lo, hi = np.searchsorted(at, [k, k + SLAB])
        part = np.zeros((len(sets), SLAB), np.float32)
        part[rows[lo:hi], at[lo:hi] - k] = 1
        both += (part @ part.T).astype(np.int32)
    agree = np.zeros(both.shape, np.uint8)
    for k in range(signatures.shape[1]):
        agree += signatures[:, k, None] == signatures[None, :, k]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    left, out = np.ones(len(sets), bool), []
    for start in range(len(sets)):
        front = [start] if left[start] else []
        left[start] = False
        while front:
            x = front.pop()
            common = both[x].astype(np.int64)
            new = np.flatnonzero((100 * common >= percent * (sizes[x] + sizes - common)) & (agree[x] >= MATCHES) & (labels != labels[x]) & left).tolist()
            left[new] = False
            out += [(x, y) for y in new]
            front += new
    return out


def _block_links(width: int, percent: int):
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("rep")
        known = Numbered()
        sets = numbered_shingles([[known[w] for w in words(text)] for text in rows["text"]], width)
        found = linked_forest(sets, np.stack(rows["signature"]), rows["label"].to_numpy(), percent)
        rep = rows["rep"].to_numpy()
        return pd.DataFrame([(min(rep[x], rep[y]), max(rep[x], rep[y])) for x, y in found], columns=["a", "b"], dtype="int64")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the block pair that may go on in the next batch
        for batch in batches:
            for g, rows in batch.groupby("g", sort=False):
                if held and held[0]["g"].iloc[0] != g:
                    yield links(pd.concat(held))
                    held = []
                held.append(rows)
        if held:
            yield links(pd.concat(held))

    return stream


def _block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(rep, label, g): members (list, rep, label, n) dealt to the pairs g of blocks that they are compared in. Blocks hold
    sets of like size: those that can link are in the same band of sizes or in neighbouring ones."""
    banded = members.withColumn("band", F.floor(F.log("n") / float(np.log(100 / percent))).cast("int"))
    sizes = banded.groupBy("list", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # the neighbours' blocks: at most a row for each band of a list
    near = sizes.select("list", "band", F.create_map(F.lit(0), "blocks").alias("m"))
    for step in (-1, 1):
        near = near.unionByName(sizes.select("list", (F.col("band") + step).alias("band"), F.create_map(F.lit(-step), "blocks").alias("m")))
    near = near.groupBy("list", "band").agg(*(F.max(F.col("m").getItem(k)).alias(c) for k, c in ((0, "own"), (-1, "below"), (1, "above"))))
    placed = banded.join(near, ["list", "band"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("own")).cast("int"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    meets = F.concat(
        F.transform(upto("own"), lambda j: F.struct(F.col("band").alias("band"), F.least("block", j).alias("x"), F.greatest("block", j).alias("y"), F.lit(0).alias("step"))),
        F.transform(upto("above"), lambda j: F.struct(F.col("band").alias("band"), F.col("block").alias("x"), j.alias("y"), F.lit(1).alias("step"))),
        F.transform(upto("below"), lambda j: F.struct((F.col("band") - 1).alias("band"), j.alias("x"), F.col("block").alias("y"), F.lit(1).alias("step"))),
    )
    return placed.select("list", "rep", "label", F.explode(meets).alias("m")).select("rep", "label", F.xxhash64("list", "m").alias("g"))


def _late_links(posts: DataFrame, classes: DataFrame, label: DataFrame, texts: DataFrame, width: int, percent: int, n_classes: int, keep: Scratch) -> list[DataFrame]:
    """Links (a, b) between members of a list that are still in different components."""
    labelled = posts.join(label, posts["rep"] == label["node"], "left").select("list", "rep", "n", F.coalesce("label", "rep").alias("label"))
    members = F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("members")
    still = labelled.groupBy("list").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("size"), members).where("l0 <> l1")
    still = still.groupBy("size", "members").agg(F.min("list").alias("list")).select("list", "size")  # lists of the same members count once
    still = keep(look_up(labelled, still, "list", F.col("size") > max(LONG_LIST, HOT_SHARE * n_classes)))
    x, y = (still.where(F.col("size") <= LONG_LIST).select("list", F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("label").alias(f"label_{k}")) for k in ("a", "b"))
    across = x.join(y, "list").where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    links = _confirm(_colliding(across.select("a", "b").distinct(), classes, percent, keep), texts, width, percent, keep)
    long = still.where(F.col("size") > LONG_LIST)
    if long.isEmpty():
        return [links]
    signed = sifted(texts, long.select("rep")).select(F.col("doc").alias("rep"), "text").join(classes.select("rep", "signature"), "rep")
    told = _block_pairs(long, percent).join(signed, "rep").repartition("g").sortWithinPartitions("g")
    return [links, keep(told.mapInPandas(_block_links(width, percent), "a long, b long").distinct())]


def _same_ids(some: DataFrame, classes: DataFrame, keep: Scratch) -> list[DataFrame]:
    """(a, b): the classes of each id whose rows have different texts, with that id; none if there are no such ids."""
    odd = keep(some.groupBy("doc").agg(F.min("set_key").alias("k0"), F.max("set_key").alias("k1")).where("k0 <> k1").select("doc"))
    if odd.isEmpty():
        return []
    return [some.select("doc", "set_key").join(odd, "doc", "left_semi").join(classes.select("set_key", "rep"), "set_key").where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """For each row of docs: doc, n_shingles and component_id, the smallest id that links reach.

    Texts are linked if their sets of width-word shingles overlap by percent of their union. Null, empty and blank
    texts are linked with nothing. Rows that repeat an id are one document: the links of each are the document's. A
    row without id is linked with nothing and its component is null. Ids of other types than whole numbers are an error. Other columns of docs, whatever their names, don't
    matter. An empty table gives an empty result. Texts of any length are taken whole.
    """
    if percent < 80:
        raise ValueError("the signature's size is set for 80 percent and more")
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number: number the documents first")
    with Scratch(docs.sparkSession) as keep:
        return checkpointed(_components(docs, id_col, text_col, width, percent, keep))


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, keep: Scratch) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    own = keep(texts.select("doc", features(F.col("text"), width).alias("f")).select("doc", "f.*"))
    some = own.where("n_shingles > 0 AND doc IS NOT NULL")
    classes = keep(some.groupBy("set_key").agg(F.min("doc").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.count("*").alias("copies")))
    n_rows, n_classes = own.count(), classes.count()
    posts = classes.select("rep", "n", F.posexplode(F.slice("signature", 1, COORDS - MATCHES + 1)).alias("coord", "value"))
    posts = posts.select("rep", "n", F.struct("coord", "value").alias("list"))
    # in each coordinate another order of the ids, so that a group's members meet different ones of them
    salt = F.xxhash64("list.coord").bitwiseXOR
    lists = posts.groupBy("list").agg(F.count("*").alias("size"), F.min(salt(F.col("rep"))).alias("first")).where("size > 1")
    lists = keep(lists.select("list", "size", salt(F.col("first")).alias("hub")))
    star = look_up(posts.select("list", "rep"), lists, "list", F.col("size") > HOT_SHARE * n_classes).where("rep <> hub")
    pairs = star.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    texts = texts.where("doc IS NOT NULL")
    links = reduce(DataFrame.union, _same_ids(some, classes, keep), _confirm(_colliding(pairs, classes, percent, keep), texts, width, percent, keep))
    label = connected_components(links, keep)
    late = [x for x in _late_links(posts, classes, label, texts, width, percent, n_classes, keep) if not x.isEmpty()]
    if late:
        label = connected_components(reduce(DataFrame.union, late, links), keep)
    of = classes.join(label, classes["rep"] == label["node"], "left").select("set_key", "copies", F.coalesce("label", "rep").alias("component"))
    alone = own.where("n_shingles = 0 OR doc IS NULL").select("doc", "n_shingles", F.col("doc").alias("component_id"))
    found = look_up(some.select("doc", "n_shingles", "set_key"), of, "set_key", F.col("copies") > HOT_SHARE * n_rows)
    return found.select("doc", "n_shingles", F.col("component").alias("component_id")).union(alone)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without those whose component has a smaller id; rows without id stay."""
    gone = near_duplicates(docs, id_col, text_col, width, percent).where("component_id <> doc").select(F.col("doc").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
