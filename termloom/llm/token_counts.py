"""Token counts under a unigram model, by dynamic programming over a trie.

The distinct pre-tokens of a batch are visited in the order of their trie. Forward scores belong to prefixes, so those
that a pre-token shares with the one before it are there already; only the rest of its letters is scored. The best
path's number of pieces is stored where the pre-token ends, and texts add up what their pre-tokens hold.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bpe import LONG_BLANK, Numbered, read_ranks, shards

RESULT = "n_pieces long, n_pretokens long, cost long"


def rank_costs(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Cost of each piece in thousandths: the logarithm of its rank, as frequencies fall with the rank (Zipf)."""
    return {piece: round(1000 * math.log(rank + 2)) for piece, rank in ranks.items()}


class Unigram:
    """Pieces with costs (negative log probabilities). Every single byte must be a piece."""

    def __init__(self, costs: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in costs]:
            raise ValueError(f"pieces lack the bytes {missing[:5]}")
        self.costs, self.longest = costs, max(map(len, costs))
        # the longest piece that ends in each byte
        self.reach = [0] * 256
        for p in costs:
            self.reach[p[-1]] = max(self.reach[p[-1]], len(p))

    def counts(self, words: list[bytes]) -> dict[bytes, tuple[int, int]]:
        """(pieces, cost) of each word's cheapest path; of equally cheap ones the one with fewest pieces."""
        out = {}
        cost, pieces, last = [0], [0], b""  # forward scores of every prefix of the last word
        get = self.costs.get
        for word in sorted(words):
            shared = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                shared += 1
            del cost[shared + 1 :], pieces[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                low, few = -1, 0
                for begin in range(max(0, end - self.reach[word[end - 1]]), end):
                    c = get(word[begin:end])
                    if c is not None:
                        c += cost[begin]
                        if low < 0 or c < low or c == low and pieces[begin] + 1 < few:
                            low, few = c, pieces[begin] + 1
                cost.append(low)
                pieces.append(few)
            out[word], last = (pieces[-1], cost[-1]), word
        return out


@functools.lru_cache(maxsize=2)
def model(path: str) -> Unigram:
    return Unigram(rank_costs(read_ranks(path)))


def count_batch(texts: list[str | None], table: Unigram, pattern: str) -> Iterator[tuple[int, int, int]]:
    """RESULT for each text; each shard has a trie of its own, which bounds memory."""
    cut = regex.compile(pattern)
    for begin, end in shards(texts):
        units, rows = Numbered(), []
        for text in texts[begin:end]:
            if not text:
                of = []
            elif LONG_BLANK.search(text):
                of = cut.findall(text)
            else:  # a word and the space before it fall into the same pre-tokens wherever they stand
                of = text.split(" ")
                of[1:] = [" " + w for w in of[1:]]
            rows.append(np.fromiter(map(units.__getitem__, of), np.int32, len(of)))
        parts = [[p.encode("utf-8", "surrogatepass") for p in cut.findall(u)] for u in units]
        done = table.counts(list({p for ps in parts for p in ps}))
        sums = np.array([(sum(done[p][0] for p in ps), len(ps), sum(done[p][1] for p in ps)) for ps in parts], np.int64).reshape(-1, 3)
        for row in rows:
            yield tuple(sums[row].sum(axis=0).tolist())


def token_counts(text: Column, path: str, pattern: str) -> Column:
    """Struct RESULT of text by the rank file at path; null and empty texts have zeros."""

    @F.pandas_udf(RESULT)
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = model(path)
        for texts in batches:
            yield pd.DataFrame(list(count_batch(texts.tolist(), table, pattern)), columns=["n_pieces", "n_pretokens", "cost"])

    return counted(text)
