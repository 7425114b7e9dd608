"""Byte-level BPE by merge replay.

A batch of texts is one shard of the corpus. Its distinct pre-tokens lie side by side in one array of symbols, linked
to their neighbours; an inverted index leads from a pair's rank to the positions that hold such a pair. Ranks are
applied from the lowest up to all their positions at once, and only the neighbours of a merge are looked up anew.
Texts then become lists of pre-token numbers, so that each distinct pre-token is merged once a shard.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = np.iinfo(np.int32).max
SHARD_CHARS = 4_000_000
#: White space in which pre-tokens of single words can't be told from the words alone.
LONG_BLANK = regex.compile(r"\s \s|\s \Z")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """Ranks as tables: token bytes by rank, and each pair of tokens whose joined bytes are a token, as sorted keys."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"ranks lack the bytes {missing[:5]}")
        self.ranks, self.bytes_of = ranks, {r: b for b, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a << 32 | b, r) for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys, self.to = np.append(table[:, 0], np.iinfo(np.int64).max), np.append(table[:, 1], NONE).astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it can't merge."""
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], np.int32(NONE))

    def slowly(self, word: bytes) -> list[int]:
        """One word by the plain rule: the lowest pair, the leftmost of equals, one at a time."""
        parts = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        while len(parts) > 1:
            near = [self.ranks.get(self.bytes_of[a] + self.bytes_of[b], NONE) for a, b in zip(parts, parts[1:], strict=False)]
            if (low := min(near)) == NONE:
                break
            i = near.index(low)
            parts[i : i + 2] = [low]
        return parts

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        if not n:
            return [[] for _ in words]
        sym = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        filled = sizes > 0
        nxt[ends[filled] - 1] = -1
        prv[(ends - sizes)[filled]] = -1
        pair = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(nxt >= 0)
        pair[inner] = self.rank(sym[inner], sym[inner + 1])
        live, odd = np.ones(n, bool), set()
        # the inverted index: positions by rank, first those of the text and then those that merges add
        index: dict[int, list[np.ndarray]] = defaultdict(list)

        def post(at: np.ndarray) -> None:
            at = at[pair[at] < NONE]
            if not len(at):
                return
            at = at[np.argsort(pair[at], kind="stable")]
            r = pair[at]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for part in np.split(at, cuts) if len(cuts) else [at]:
                rank = int(pair[part[0]])
                if rank not in index:
                    heapq.heappush(heap, rank)
                index[rank].append(part)

        heap: list[int] = []
        post(inner)
        while heap:
            rank = heapq.heappop(heap)
            at = np.concatenate(index.pop(rank))
            at = np.unique(at[live[at] & (pair[at] == rank)])
            if not len(at):
                continue
            if len(at) > 1:  # of pairs that overlap, every other one from the left
                follows = np.append(False, at[1:] == nxt[at[:-1]])
                starts = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - starts) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at], nxt[at], live[gone], pair[gone] = rank, after, False, NONE
            has = after >= 0
            prv[after[has]] = at[has]
            pair[at] = NONE
            pair[at[has]] = self.rank(sym[at[has]], sym[after[has]])
            before = prv[at]
            before = before[before >= 0]
            pair[before] = self.rank(sym[before], sym[nxt[before]])
            new = np.concatenate([at, before])
            if (early := new[pair[new] < rank]).size:  # a lower rank came up late: such words are done one merge at a time
                odd.update(word_of[early].tolist())
            post(np.unique(new))
        ids = sym[live]
        counts = np.bincount(word_of[live], minlength=len(words))
        split = np.cumsum(counts)
        flat = ids.tolist()
        out = [flat[a:b] for a, b in zip((split - counts).tolist(), split.tolist(), strict=True)]
        for k in odd:
            out[k] = self.slowly(words[k])
        return out


@functools.lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(read_ranks(path))


class Numbered(defaultdict):
    """Gives each new key the next number."""

    def __init__(self):
        super().__init__(count().__next__)


def encode_batch(texts: list[str | None], table: Merges, pattern: str) -> Iterator[tuple[np.ndarray, list[list[int]]]]:
    """For each text the numbers of its pieces, and the pieces' token ids (one list for each shard of the batch).

    A piece is a word with the space before it, cut into pre-tokens once; texts with long runs of white space are
    cut by the pattern as a whole, and their pieces are the pre-tokens. A shard has at most SHARD_CHARS code points,
    or one text, which bounds memory.
    """
    for begin, end in shards(texts):
        yield from _encode_shard(texts[begin:end], table, pattern)


def shards(texts: list[str | None], chars: int = SHARD_CHARS) -> Iterator[tuple[int, int]]:
    """[begin, end) of runs of texts with at most chars code points, or one text, each."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > chars:
            yield begin, k
            begin, size = k, 0
        size += len(t or "")
    yield begin, len(texts)


def _encode_shard(texts: list[str | None], table: Merges, pattern: str) -> Iterator[tuple[np.ndarray, list[list[int]]]]:
    cut = regex.compile(pattern)
    pieces = Numbered()
    rows = []
    for text in texts:
        if not text:
            rows.append(np.empty(0, np.int32))
        elif LONG_BLANK.search(text):
            tokens = cut.findall(text)
            rows.append(np.fromiter(map(pieces.__getitem__, tokens), np.int32, len(tokens)))
        else:
            words = text.split(" ")
            words[1:] = [" " + w for w in words[1:]]
            if not words[0]:
                del words[0]
            rows.append(np.fromiter(map(pieces.__getitem__, words), np.int32, len(words)))
    pre = Numbered()
    parts = [[pre[t] for t in cut.findall(p)] for p in pieces]
    done = table.replay([t.encode("utf-8", "surrogatepass") for t in pre])
    ids = [done[p[0]] if len(p) == 1 else [i for k in p for i in done[k]] for p in parts]
    del pieces, pre, parts, done  # what is left lives until the last text is read
    for row in rows:
        yield row, ids


def _joined(batch: Iterator[tuple[np.ndarray, list[list[int]]]]) -> Iterator[np.ndarray]:
    """Each text's ids in one array."""
    seen = None
    for row, ids in batch:
        if seen is not ids:  # once a batch
            seen, flat = ids, np.fromiter((i for p in ids for i in p), np.int32)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            begins = np.cumsum(sizes) - sizes
        take = sizes[row]
        yield flat[np.repeat(begins[row] - np.cumsum(take) + take, take) + np.arange(int(take.sum()))]


def encode(text: Column, path: str, pattern: str) -> Column:
    """Token ids of text by the rank file at path (which every executor has); null and empty texts have none."""

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = merges(path)
        for texts in batches:
            yield pd.Series(list(_joined(encode_batch(texts.tolist(), table, pattern))), dtype=object)

    return encoded(text)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """Struct of token_ids and of round_trip: whether the ids decode to the text's bytes."""

    @F.pandas_udf("token_ids array<int>, round_trip boolean")
    def tripped(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = merges(path)
        of = table.bytes_of
        for texts in batches:
            ids = list(_joined(encode_batch(texts.tolist(), table, pattern)))
            same = [b"".join(map(of.__getitem__, i.tolist())) == (t or "").encode("utf-8", "surrogatepass") for t, i in zip(texts, ids, strict=True)]
            yield pd.DataFrame({"token_ids": pd.Series(ids, dtype=object), "round_trip": same})

    return tripped(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes that ids stand for; null where ids is null. An unknown id raises an error."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = merges(path).bytes_of
        for rows in batches:
            yield rows.map(lambda r: None if r is None else b"".join(of[i] for i in r))

    return decoded(ids)


def digests(text: Column, path: str, pattern: str) -> Column:
    """Struct n_tokens, ids_sha256, decoded_sha256: encoded, and decoded again from the ids, without moving either."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = merges(path)
        of = table.bytes_of
        for texts in batches:
            out, seen = [], None
            for row, ids in encode_batch(texts.tolist(), table, pattern):
                if seen is not ids:  # once a batch
                    seen, sizes = ids, np.fromiter(map(len, ids), np.int64, len(ids))
                    written = [",".join(map(str, i)) for i in ids]
                    back = [b"".join([of[x] for x in i]) for i in ids]
                at = row.tolist()
                out.append((int(sizes[row].sum()), hashlib.sha256(",".join([written[k] for k in at]).encode()).hexdigest(), hashlib.sha256(b"".join([back[k] for k in at])).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)
