"""Phrase collocations from count tries that are merged by prefix range.

A task takes its texts in shards. A shard's windows of up to DEPTH words are a depth-limited trie; sorted, it is a list of
windows with counts, front-coded in blocks and cut at prefix ranges that all shards share. Each range is merged from the
sorted blocks of all shards in one sweep that holds what can still meet a later block, so memory doesn't depend on the
range. A walk over the merged trie counts nodes and reads the left parts off a node's ancestors. Right parts are found by
suffix links: the phrase without its first words is a node of another range, joined by its words. Nodes on the border of a
swept part may go on elsewhere; they are summed afterwards.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Numbered
from .common import UPPER, Scratch, checkpointed

DEPTH = 5
#: Tokens of a shard, windows that a sweep gathers before it looks for a finished part, windows of a block.
SHARD, SWEEP, BLOCK = 1_500_000, 1_500_000, 1 << 16
#: Bytes of text for each prefix range, the most ranges of a group, samples for each range. They only deal out work.
RANGE_BYTES, MOST_RANGES, SAMPLES = 6_000_000, 4096, 32
#: Long texts are cut into words in slices of about so many bytes.
SLICE = 4_000_000
#: Best phrases are first looked for in so many parts of a group.
PARTS = 64
#: Bytes in the order of windows: A-Z in lower case, separators of pieces as END, the tab as a space, and room for 0, which
#: separates words and comes before all that words hold.
_FROM = UPPER.encode() + b".,;:!?\n\x0b\x0c\r\t" + bytes(range(9))
_TO = UPPER.lower().encode() + b"\xff" * 10 + b" " + bytes(range(1, 10))
ORDER = bytes.maketrans(_FROM, _TO)
BACK = bytes.maketrans(bytes(range(1, 10)), bytes(range(9)))
END = b"\xff"
BLOCKS = "part string, g int, first binary, block binary"
NODES = "part string, phrase string, depth int, a long, open boolean, lefts array<long>"


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """A text's words in order, END between and after pieces, in slices that bound memory."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(ORDER)
    at = 0
    while at < len(raw):
        to = min(len(raw), at + SLICE)
        if to < len(raw):  # on to the end of the word
            found = [k for k in (raw.find(b" ", to), raw.find(END, to)) if k >= 0]
            to = min(found, default=len(raw))
        yield _words(raw[at:to])
        at = to
    yield [END]


def _words(raw: bytes) -> list[bytes]:
    return [w for w in raw.replace(END, b" \xff ").split(b" ") if w]


def window_key(words: list[bytes]) -> bytes:
    return b"\0".join(words)


class Windows:
    """Distinct windows in order: columns of word numbers, 0 beyond a window's end, else an index into words (sorted,
    the first is empty); counts."""

    def __init__(self, columns: np.ndarray, counts: np.ndarray, words: list[bytes]):
        """columns: DEPTH rows of numbers of words in any order; repeated windows are added up."""
        rank = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        to = np.zeros(len(words) + 1, np.int32)
        to[rank + 1] = np.arange(1, len(words) + 1)
        c = to[columns]
        if len(words) < 1 << 21:
            joined = lambda x, y: x.astype(np.int64) << 21 | y
            order = np.lexsort((joined(c[3], c[4]), joined(joined(c[0], c[1]), c[2])))
        else:
            order = np.lexsort(c[::-1])
        c, counts = c[:, order], counts[order]
        new = np.ones(c.shape[1], bool)
        new[1:] = (c[:, 1:] != c[:, :-1]).any(axis=0)
        starts = np.flatnonzero(new)
        self.columns, self.counts = c[:, starts], np.add.reduceat(counts, starts) if len(starts) else counts
        self.words = [b"", *(words[k] for k in rank.tolist())]

    def __len__(self) -> int:
        return len(self.counts)

    def key(self, k: int) -> bytes:
        return window_key([self.words[w] for w in self.columns[:, k].tolist() if w])

    def place(self, key: bytes) -> int:
        """Number of windows before key."""
        return bisect_left(range(len(self)), key, key=self.key)

    def shared(self, begin: int, end: int) -> np.ndarray:
        """How many leading words each window of a slice has from the window before it in the slice."""
        c = self.columns[:, begin:end]
        out = np.zeros(end - begin, np.uint8)
        same = np.ones(max(0, end - begin - 1), bool)
        for d in range(DEPTH):
            same &= (c[d, 1:] == c[d, :-1]) & (c[d, 1:] > 0)
            out[1:] += same
        return out

    def block(self, begin: int, end: int) -> bytes:
        """A slice, front-coded: words that are new against the window before, and counts."""
        c, lcp = self.columns[:, begin:end], self.shared(begin, end)
        depth = (c > 0).sum(axis=0).astype(np.uint8)
        d = np.arange(DEPTH)[:, None]
        flat = c.T[((d >= lcp) & (d < depth)).T]
        used, labels = np.unique(flat, return_inverse=True)
        planes = lambda x: np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()
        counts = self.counts[begin:end]
        parts = [b"\0".join(self.words[k] for k in used.tolist()), lcp.tobytes(), depth.tobytes(), planes(labels), planes(counts & 0x7FFFFFFF), planes(counts >> 31)]
        return zstandard.compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts), 3)


def read_block(block: bytes, known: Numbered) -> tuple[np.ndarray, np.ndarray]:
    """Columns and counts of a block; known numbers its words."""
    raw = zstandard.decompress(block)
    ends = np.cumsum(np.frombuffer(raw[:48], np.int64)) + 48
    words, lcp, depth, labels, low, high = (raw[b:e] for b, e in zip([48, *ends[:-1].tolist()], ends.tolist(), strict=True))
    whole = lambda x: np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.int32)[:, 0].astype(np.int64)
    lcp, depth = np.frombuffer(lcp, np.uint8).astype(np.int64), np.frombuffer(depth, np.uint8).astype(np.int64)
    number = np.fromiter((known[w] + 1 for w in words.split(b"\0")), np.int32)
    flat = number[whole(labels)]
    starts = np.cumsum(depth - lcp) - (depth - lcp)
    out, row = np.zeros((DEPTH, len(lcp)), np.int32), np.arange(len(lcp))
    for d in range(DEPTH):
        source = np.maximum.accumulate(np.where(lcp <= d, row, 0))  # the window that brought this word
        has = depth[source] > d
        at = np.where(has, starts[source] + d - lcp[source], 0)
        out[d] = np.where(has, flat[at], 0)
    return out, whole(low) + (whole(high) << 31)


def shard_windows(ids: np.ndarray, end: int, begin: int, stop: int) -> np.ndarray:
    """Columns (word number + 1, 0 beyond the end) of the windows that start in ids[begin:stop]; END has number end."""
    c = np.zeros((DEPTH, stop - begin), np.int32)
    alive = np.ones(stop - begin, bool)
    for d in range(DEPTH):
        part = np.full(stop - begin, end, np.int32)
        got = ids[begin + d : stop + d]
        part[: len(got)] = got
        alive &= part != end
        c[d] = np.where(alive, part + 1, 0)
    return c[:, c[0] > 0]


def renumbered(columns: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Columns with numbers of only those words that they have, and these words."""
    has = np.zeros(len(words) + 1, bool)
    has[columns] = True
    has[0] = False
    used = np.flatnonzero(has)
    to = np.zeros(len(words) + 1, np.int32)
    to[used] = np.arange(1, len(used) + 1)
    return to[columns], [words[k - 1] for k in used.tolist()]


def tries(splitters: dict[str, list[bytes]], range_of: Callable[[str], int]):
    """mapInPandas function: texts (part, text) to the blocks of their shards' tries, by prefix range."""

    def blocks(held: dict[str, tuple[Numbered, list[np.ndarray]]]) -> Iterator[pd.DataFrame]:
        for part, (known, arrays) in held.items():
            ids, words = np.concatenate(arrays), list(known)
            for begin in range(0, len(ids), SHARD):
                c = shard_windows(ids, known[END], begin, min(len(ids), begin + SHARD))
                if not c.shape[1]:
                    continue
                c, own = renumbered(c, words)
                w = Windows(c, np.ones(c.shape[1], np.int64), own)
                cuts = [0, *(w.place(k) for k in splitters.get(part, ())), len(w)]
                rows, at = [], range_of(part)
                for r, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows += [(part, at + r, w.key(k), w.block(k, min(hi, k + BLOCK))) for k in range(lo, hi, BLOCK)]
                yield pd.DataFrame(rows, columns=["part", "g", "first", "block"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = {}, 0
        for batch in batches:
            for part, text in zip(batch["part"], batch["text"], strict=True):
                known, arrays = held.setdefault(part, (Numbered(), []))
                for words in pieces(text):
                    arrays.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                    n += len(words)
                if n >= SHARD:
                    yield from blocks(held)
                    held, n = {}, 0
        yield from blocks(held)

    return run


def trie_nodes(w: Windows, n: int, part: str, least: int) -> pd.DataFrame:
    """The nodes of the first n windows with at least so many occurrences, and those on their first and last path, which
    may go on elsewhere: these are open. lefts: counts of a node's ancestors from depth 1, -1 for open ones."""
    c, counts = w.columns[:, :n], w.counts[:n]
    new = np.zeros(n, bool)
    new[0] = True
    starts, sums, opened, rows = [], [], [], []
    for d in range(DEPTH + 1):
        if d:
            new = new | np.r_[True, c[d - 1, 1:] != c[d - 1, :-1]]
        s = np.flatnonzero(new)
        starts.append(s)
        sums.append(np.add.reduceat(counts, s))
        opened.append((np.arange(len(s)) == 0) | (np.arange(len(s)) == len(s) - 1))
        keep = np.flatnonzero(((sums[d] >= least) | opened[d]) & ((c[d - 1, s] > 0) if d else True))
        lefts = np.full((len(keep), max(0, d - 1)), -1, np.int64)
        for k in range(1, d):
            up = np.searchsorted(starts[k], s[keep], "right") - 1
            lefts[:, k - 1] = np.where(opened[k][up], -1, sums[k][up])
        labels = c[:d, s[keep]].T.tolist()
        for of, a, o, left in zip(labels, sums[d][keep].tolist(), opened[d][keep].tolist(), lefts.tolist(), strict=True):
            rows.append((part, b" ".join(w.words[x] for x in of).translate(BACK).decode("utf-8", "surrogatepass"), d, a, o, left))
    return pd.DataFrame(rows, columns=["part", "phrase", "depth", "a", "open", "lefts"])


def sweep(least: int):
    """mapInPandas function: blocks sorted by range and first window to the nodes of the merged trie."""

    class Pending:
        def __init__(self, part: str):
            self.part, self.known, self.columns, self.counts, self.n, self.look_at = part, Numbered(), [], [], 0, SWEEP

        def add(self, block: bytes) -> None:
            columns, counts = read_block(block, self.known)
            self.columns.append(columns)
            self.counts.append(counts)
            self.n += len(counts)

        def finished(self, before: bytes | None) -> Iterator[pd.DataFrame]:
            """Nodes of all windows before a key; the others stay."""
            w = Windows(np.concatenate(self.columns, axis=1), np.concatenate(self.counts), list(self.known))
            n = len(w) if before is None else w.place(before)
            if n:
                yield trie_nodes(w, n, self.part, least)
            rest, words = renumbered(w.columns[:, n:], w.words[1:])
            self.known = Numbered()
            for word in words:
                self.known[word]
            self.columns, self.counts, self.n = [rest], [w.counts[n:]], rest.shape[1]
            self.look_at = max(SWEEP, 2 * self.n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, of = None, None
        for batch in batches:
            for part, g, first, block in zip(batch["part"], batch["g"], batch["first"], batch["block"], strict=True):
                if held and (part, g) != of:
                    yield from held.finished(None)
                    held = None
                if held and held.n >= held.look_at:
                    yield from held.finished(first)
                held, of = held or Pending(part), (part, g)
                held.add(block)
        if held:
            yield from held.finished(None)

    return run


def sampled(steps: dict[str, int], every: int):
    """mapInPandas function: windows at even steps of the texts' bytes, to deal out the ranges. Tasks begin at places of their
    own, so that many small tasks give as many windows as few large ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: dict[str, int] = {}
        place = crc32(str(TaskContext.get().partitionId()).encode())
        for batch in batches:
            rows = []
            for part, text in zip(batch["part"], batch["text"], strict=True):
                if not (step := steps.get(part)):
                    continue
                raw = (text or "").encode("utf-8", "surrogatepass").translate(ORDER)
                at = rest.get(part, place % step)
                while at < len(raw):
                    words = _words(raw[at : at + every])[1:-1]
                    words = words[: words.index(END)] if END in words else words
                    if words:
                        rows.append((part, window_key(words[:DEPTH])))
                    at += step
                rest[part] = at - len(raw)
            yield pd.DataFrame(rows, columns=["part", "key"])

    return run


def prefix_ranges(texts: DataFrame) -> tuple[dict[str, list[bytes]], Callable[[str], int], int]:
    """Windows at which the ranges of large parts are cut, the first range of a part, the number of ranges.

    A part gets a range for each RANGE_BYTES of text, all together at most MOST_RANGES; so there are at most that many
    large parts, and at most SAMPLES times as many samples. Small parts share ranges by hash."""
    size = texts.groupBy("part").agg(F.sum(F.octet_length("text")).alias("size")).where(F.col("size") > 0)
    total = size.agg(F.sum("size")).first()[0] or 0
    each = max(RANGE_BYTES, total // MOST_RANGES)
    large = {r["part"]: r["size"] for r in size.where(F.col("size") > 2 * each).collect()}
    splitters: dict[str, list[bytes]] = {}
    if large:
        found = texts.mapInPandas(sampled(dict.fromkeys(large, max(1, each // SAMPLES)), 400), "part string, key binary").toPandas()
        for part, keys in found.groupby("part")["key"]:
            keys, n = sorted(map(bytes, keys)), max(1, round(large[part] / each))
            splitters[part] = sorted({keys[k * len(keys) // n] for k in range(1, n)})
    own, at = {}, 0
    for part in sorted(large):
        own[part] = at
        at += len(splitters.get(part, ())) + 1
    shared = max(1, (total - sum(large.values())) // each + 1)
    return splitters, lambda part: own.get(part, at + crc32(part.encode("utf-8", "surrogatepass")) % shared), at + shared


def count_nodes(texts: DataFrame, least: int) -> DataFrame:
    """NODES of texts (part, text)."""
    splitters, range_of, n = prefix_ranges(texts)
    blocks = texts.mapInPandas(tries(splitters, range_of), BLOCKS)
    return blocks.repartitionById(n, F.col("g")).sortWithinPartitions("g", "part", "first").mapInPandas(sweep(least), NODES)


def joined(words: Column, begin: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, begin, n), " ")


def collocations(docs: DataFrame, text_col: str = "text", part_col: str | None = "lang", least: int = 100, top: int = 2000) -> DataFrame:
    """(part, rank, phrase, a, l, r, n, score): the best phrases of 2 to DEPTH words of each part.

    Texts are lower-cased (A-Z) and cut at [.,;:!?\\x0A-\\x0D] into pieces, pieces into words [^\\x20\\x09]+. a is how often
    a phrase occurs within pieces, overlaps included, at least `least` times. Of its cuts into l and r the one with the
    lowest floor(1000 * a * n / (l * r)) counts, the shortest left part of equals; n counts all words of the part. A phrase
    that lies in a longer one which occurs as often is dropped. Best by score, a, phrase. Null and empty texts have no words;
    rows of a null part are the part `und`; part_col None makes one part `` of all. Repeated rows count as often as they
    are there. An empty table gives an empty result. Other columns, whatever their names, don't matter.
    """
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("und")) if part_col else F.lit("")
    with Scratch(docs.sparkSession) as keep:
        nodes = count_nodes(docs.select(part.alias("part"), F.col(text_col).alias("text")), least)
        return checkpointed(_best(keep(nodes), least, top, keep))


def _best(nodes: DataFrame, least: int, top: int, keep: Scratch) -> DataFrame:
    opened = keep(nodes.where("open").groupBy("part", "phrase", "depth").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (F.col("depth") == 0)))
    n_of = opened.where("depth = 0").select("part", F.col("a").alias("n"))
    whole = nodes.where("NOT open AND depth > 0").select("part", "phrase", "depth", "a", "lefts")
    whole = whole.unionByName(opened.where("depth > 0").withColumn("lefts", F.lit(None).cast("array<long>")))
    found = whole.where("depth > 1").withColumn("words", F.split("phrase", " ")).select("*", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
    walked = F.nullif(F.get("lefts", F.col("k") - 1), F.lit(-1))
    found = found.select("part", "phrase", "depth", "a", "k", walked.alias("walked"), joined(F.col("words"), 1, F.col("k")).alias("left"), joined(F.col("words"), F.col("k") + 1, F.col("depth") - F.col("k")).alias("right"))
    links = whole.select("part", F.col("phrase").alias("right"), F.col("a").alias("r"))
    borders = opened.where("depth > 0").select("part", F.col("phrase").alias("left"), F.col("a").alias("summed"))
    found = found.join(links, ["part", "right"]).join(borders, ["part", "left"], "left").withColumn("l", F.coalesce("walked", "summed")).drop("walked", "summed")
    cuts = keep(found)
    same = cuts.where("k = depth - 1 AND k > 1 AND l = a").select("part", F.col("left").alias("phrase"))
    same = same.union(cuts.where("k = 1 AND depth > 2 AND r = a").select("part", F.col("right").alias("phrase"))).distinct()
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.join(same, ["part", "phrase"], "left_anti").join(n_of, "part").withColumn("score", score)
    best = scored.groupBy("part", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("part", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    share = best.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = share.withColumn("rank", F.row_number().over(W.partitionBy("part", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("part", "rank", "phrase", "a", "l", "r", "n", "score")
