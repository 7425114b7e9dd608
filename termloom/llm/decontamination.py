"""Benchmark decontamination with suffix arrays over the training text.

Documents are taken in shards. Words that no benchmark item has end a run, as no match can cross them; the remaining runs
get a suffix array, sorted by their first WINDOW words. Every suffix of every test item is looked up in it by binary
search, once for all suffixes that begin with the same window. Matches become hit words, items and the longest verbatim
match of each document. A large benchmark goes to the executors one block at a time, and then only documents that share
window hashes with it are searched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import shards
from .common import Scratch, ascii_lower, checkpointed, free_name, quoted
from .near_dup import shingle_hashes, sifted

WINDOW = 13
#: Between words.
NOT_WORD = "[\\x00-/:-`\\x7B-\\x7F]+"
#: Test items go to the executors in blocks of at most so many code points (or one item, if that is longer).
BLOCK_CHARS = 8_000_000
# All bytes but those of [^\x00-\x2F\x3A-\x60\x7B-\x7F] become blanks.
_TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
RESULT = "n_words long, n_hit long, items array<string>, longest int, longest_item string, longest_at int, spans array<array<int>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_WORDS).split()


def ranked(ids: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each position by its first depth words; what lies beyond the end counts as 0."""
    rank, have = ids, 1
    while have < depth:  # ranks by the first `have` words, doubled till depth
        step = min(have, depth - have)
        joined = rank * (int(rank.max(initial=0)) + 1) + np.append(rank[step:], np.zeros(min(step, len(rank)), np.int64))
        rank, have = np.unique(joined, return_inverse=True)[1].astype(np.int64), have + step
    return rank


class TestSet:
    """Items as word numbers from 1 on, side by side, each followed by a 0, and their distinct windows.

    starts, lengths: a place of each distinct window and its size; places, cuts: where all its occurrences begin (only for
    windows of full size, which may be parts of longer matches); sets: the numbers of the sets of items that hold it.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window, self.vocabulary, flat = window, {}, []
        self.names: list[str | None] = []
        begins, short = [], {}
        full, owners = [], []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if not ids:
                continue
            if len(ids) < window:
                short.setdefault(tuple(ids), (len(flat), []))[1].append(len(self.names))
            else:
                full.append(np.arange(len(flat), len(flat) + len(ids) - window + 1))
                owners.append(np.full(len(ids) - window + 1, len(self.names)))
            begins.append(len(flat))
            self.names.append(name)
            flat += [*ids, 0]
        self.flat, self.begins = np.array(flat + [0] * window, np.int64), np.array(begins, np.int64)
        full, owners = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (full, owners))
        which = ranked(self.flat, window)[full]
        order = np.lexsort((full, which))
        self.places, owners = full[order], owners[order]
        heads = np.flatnonzero(np.append(True, np.diff(which[order]) != 0)) if len(full) else full
        self.cuts = np.append(heads, len(full))
        self.starts = np.append(self.places[heads], [at for at, _ in short.values()]).astype(np.int64)
        self.lengths = np.append(np.full(len(heads), window), [len(x) for x in short]).astype(np.int64)
        self.item_sets, known = [], {}

        def number(of: np.ndarray) -> int:
            key = of.tobytes()
            if key not in known:
                known[key] = len(self.item_sets)
                self.item_sets.append(of)
            return known[key]

        of_full = [number(np.unique(owners[a:b])) for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True)]
        self.sets = np.array(of_full + [number(np.unique(np.array(x, np.int64))) for _, x in short.values()], np.int64)
        self.shortest = int(self.lengths.min(initial=window))

    def items_of(self, windows: np.ndarray) -> list[str]:
        """Names of the items that hold any of the windows, sorted; those without name are left out."""
        held = [self.item_sets[k] for k in np.unique(self.sets[windows]).tolist()]
        return sorted({self.names[x] for x in np.unique(np.concatenate(held)).tolist()} - {None})

    def item_at(self, place: int) -> str | None:
        return self.names[int(np.searchsorted(self.begins, place, side="right")) - 1]

    def longest(self, windows: np.ndarray, at: np.ndarray) -> tuple[int, str | None, int]:
        """(words, item, position) of the longest verbatim match from windows at ascending positions; of equals the first.
        Windows that follow each other in an item and in the text are one longer match. Only the item places of two
        positions are held at a time."""
        best, item, where, last = 0, None, 0, -2
        places = begun = np.empty(0, np.int64)  # item places of the last window, and where the matches there began
        for w, p in zip(windows.tolist(), at.tolist(), strict=True):
            if self.lengths[w] < self.window:
                if self.lengths[w] > best:
                    best, item, where = int(self.lengths[w]), self.item_at(int(self.starts[w])), p
                continue
            now = self.places[self.cuts[w] : self.cuts[w + 1]]
            start = np.full(len(now), p)
            if p == last + 1:
                k = np.minimum(np.searchsorted(places, now - 1), len(places) - 1)
                start = np.where(places[k] == now - 1, begun[k], p)
            places, begun, last = now, start, p
            first = int(np.argmin(start))
            if p - start[first] + self.window > best:
                best, where = int(p - start[first] + self.window), int(start[first])
                item = self.item_at(int(now[first]))
        return best, item, where


class SuffixArray:
    """Positions of ids, sorted by the depth words that begin there; what lies beyond the end counts as 0."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, depth: int):
        self.text, self.depth = np.concatenate([ids, np.zeros(depth, np.int64)]), depth
        rank = ranked(self.text, depth)
        self.order = at[np.argsort(rank[at], kind="stable")]

    def less(self, at: np.ndarray, patterns: np.ndarray, starts: np.ndarray, lengths: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether the suffixes at `at` come before (or match) the patterns' words."""
        decided, out = np.zeros(len(at), bool), np.zeros(len(at), bool)
        for k in range(self.depth):
            a, b = self.text[at + k], patterns[starts + k]
            now = ~decided & (k < lengths) & (a != b)
            out[now] = a[now] < b[now]
            decided |= now
        out[~decided] = or_equal
        return out

    def bound(self, patterns: np.ndarray, starts: np.ndarray, lengths: np.ndarray, or_equal: bool) -> np.ndarray:
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order), np.int64)
        while len(todo := np.flatnonzero(lo < hi)):
            mid = (lo[todo] + hi[todo]) // 2
            up = self.less(self.order[mid], patterns, starts[todo], lengths[todo], or_equal)
            lo[todo[up]], hi[todo[~up]] = mid[up] + 1, mid[~up]
        return lo

    def find(self, patterns: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern number, position) of every occurrence."""
        low = self.bound(patterns, starts, lengths, False)
        size = self.bound(patterns, starts, lengths, True) - low
        which = np.repeat(np.arange(len(starts)), size)
        return which, self.order[np.repeat(low - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(len(which))]


def match_shard(texts: list[str | None], test: TestSet) -> list[tuple]:
    """RESULT for each text."""
    ids, ends = [], []
    for text in texts:
        ids += map(test.vocabulary.get, words(text), repeat(0))
        ids.append(0)
        ends.append(len(ids))
    ids, ends = np.array(ids, np.int64), np.array(ends, np.int64)
    begins = np.append(0, ends[:-1])
    # runs of known words; a suffix matters where at least the shortest window fits in before its run ends
    stops = np.flatnonzero(ids == 0)
    left = stops[np.searchsorted(stops, np.arange(len(ids)))] - np.arange(len(ids)) if len(ids) else ids
    at = np.flatnonzero(left >= test.shortest)
    # only what lies in such runs stays in the array's text
    keep = np.zeros(len(ids) + 1, bool)
    run_start = np.unique(at[np.append(True, np.diff(at) != 1)]) if len(at) else at
    for s in run_start.tolist():
        keep[s : s + left[s] + 1] = True
    kept = np.flatnonzero(keep[:-1])
    array = SuffixArray(ids[kept], np.searchsorted(kept, at), test.window)
    which, where = array.find(test.flat, test.starts, test.lengths) if len(at) and len(test.starts) else (np.empty(0, np.int64),) * 2
    where = kept[where] if len(kept) else where  # a position begins one window of each size at most
    doc = np.searchsorted(ends, where, side="right")
    order = np.lexsort((where, doc))
    which, where, doc = which[order], where[order], doc[order]
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for k in range(len(texts)):
        n = int(ends[k] - begins[k] - 1)
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            out.append((n, 0, [], 0, None, None, []))
            continue
        w, p = which[a:b], where[a:b] - begins[k]
        delta = np.zeros(n + 1, np.int64)
        np.add.at(delta, p, 1)
        np.add.at(delta, p + test.lengths[w], -1)
        covered = np.cumsum(delta[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
        length, item, first = test.longest(w, p)
        out.append((n, int(covered.sum()), test.items_of(w), length, item, first, edges.reshape(-1, 2).tolist()))
    return out


def _matches(text: Column, test) -> Column:
    @F.pandas_udf(RESULT)
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = texts.tolist()
            rows = [row for begin, end in shards(texts) for row in match_shard(texts[begin:end], test.value)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return match(text)


def blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of at most block_chars code points (or one item), of which the driver holds one at a time."""
    rows, size = [], 0
    for r in items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        if rows and size + len(r.t or "") > block_chars:
            yield rows
            rows, size = [], 0
        rows.append((r.i, r.t))
        size += len(r.t or "")
    yield rows


def window_hashes(text: Column, sizes: list[int] | None = None) -> Column:
    """64-bit hashes of a text's windows of each of sizes; without sizes, of an item's windows: WINDOW words, or all if fewer."""

    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                w = words(t)
                ids = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
                of = [shingle_hashes(ids, n) for n in sizes if n <= len(ids)] if sizes else [shingle_hashes(ids, WINDOW)]
                out.append(np.unique(np.concatenate([np.empty(0, np.uint64), *of])).view(np.int64))
            yield pd.Series(out, dtype=object)

    return hashes(text)


def documents_hit(docs: DataFrame, key: Column, text: Column, items: DataFrame, item_text: str, keep: Scratch) -> DataFrame:
    """(key, text) of each distinct text that holds a window of an item, by one shuffle of window hashes, and perhaps a few others.

    Hashes of texts that no item has are sifted out before, as far as a filter of bounded size can tell."""
    own = items.select(window_hashes(F.col(item_text)).alias("h"), F.least(F.size(_words(F.col(item_text))), F.lit(WINDOW)).alias("n"))
    sizes = [r["n"] for r in own.where("n > 0").select("n").distinct().collect()]  # at most WINDOW
    asked = keep(own.select(F.explode("h").alias("doc")).distinct())
    texts = docs.select(key.alias("key"), text.alias("text"))
    held = texts.select("key", F.explode(window_hashes(F.col("text"), sizes)).alias("doc"))
    met = sifted(held, asked).join(asked, "doc", "left_semi").select("key").distinct()
    return keep(texts.join(keep(met), "key", "left_semi").dropDuplicates(["key"]))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _all_blocks(docs: DataFrame, text: Column, near: DataFrame, tests: Iterator[TestSet], out: str, keep: Scratch) -> DataFrame:
    """docs with `out` from many blocks: each is broadcast alone, its matches in the texts near are written, and given up."""
    sc = docs.sparkSession.sparkContext
    key, parts = F.sha2(text.cast("binary"), 256), []
    for block in tests:
        test = sc.broadcast(block)
        parts.append(keep(near.select("key", _matches(F.col("text"), test).alias("m")).where("m.n_hit > 0")))
        test.destroy()
    n_words = F.size(_words(text)).cast("long")
    whole = reduce(DataFrame.union, parts)
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("m.spans")), lambda s: F.sequence(s[0], s[1] - 1))))
    best = F.max(F.struct(F.col("m.longest").alias("longest"), (-F.col("m.longest_at")).alias("at"), F.col("m.longest_item").alias("item")))
    whole = whole.groupBy("key").agg(F.sort_array(covered).alias("covered"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("m.items")))).alias("items"), best.alias("best"))
    # word positions back to [from, to) pairs
    heads, tails = (F.array_except("covered", F.transform("covered", lambda x: x + step)) for step in (1, -1))  # noqa: B023
    whole = whole.withColumn("spans", F.zip_with(heads, tails, lambda a, b: F.array(a, b + 1)))
    found = F.struct(
        F.col("n_words"), F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("best.longest", F.lit(0)).alias("longest"),
        F.col("best.item").alias("longest_item"), (-F.col("best.at")).alias("longest_at"), F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"),
    )
    rows = docs.select(F.struct(*quoted(docs)).alias("row"), key.alias("key"), n_words.alias("n_words"))
    return rows.join(whole, "key", "left").select("row.*", F.when(F.lit(True), found).alias(out))


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "contamination", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with the struct `out`: n_words, n_hit, items (ids of items with windows in the text, sorted as strings),
    longest, longest_item, longest_at (the longest verbatim match of a window or more in words, the item and the word it
    begins at) and spans (hit words as [from, to) pairs).

    A window is 13 consecutive item words, or a whole shorter item. Null or empty texts have no words, null or empty
    items no windows. Items that repeat an id count once; one whose id is null hits words as others do, but isn't in
    items. Repeated rows of docs each get their result, other columns stay, whatever their names; one called `out` is
    replaced. Empty tables give empty results or no hits. One block of items needs no shuffle. For more, window hashes of
    items and texts are joined once, and only texts that hold one are searched, with one block at a time on the driver and
    in each worker; so the corpus is read three times at most, however large the benchmark.
    """
    docs = docs.drop(out)
    tests = map(TestSet, blocks(items, item_id, item_text, block_chars))
    first, second = next(tests), next(tests, None)
    if second is None:
        return docs.withColumn(out, _matches(F.col(text_col), docs.sparkSession.sparkContext.broadcast(first)))
    text = F.col(text_col)
    with Scratch(docs.sparkSession) as keep:
        near = documents_hit(docs, F.sha2(text.cast("binary"), 256), text, items, item_text, keep)
        return checkpointed(_all_blocks(docs, text, near, chain([first, second], tests), out, keep))


def is_contaminated(found: Column) -> Column:
    """Whether at least a twentieth of the words are hit."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that aren't contaminated, as they were."""
    out = free_name(docs, "contamination")
    found = find_contamination(docs, items, text_col, out=out)
    return found.where(~is_contaminated(F.col(out))).drop(out)


def items_digest(found: Column) -> Column:
    return F.sha2(F.array_join(found["items"], ",").cast("binary"), 256)
