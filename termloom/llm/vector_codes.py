"""Compression of vectors to codes of their parts' nearest codebook entries, with lower bounds from segment means.

Vectors become integers and are cut into PARTS parts; each part position has a codebook of up to ENTRIES entries. For the
nearest entry, sums over ever finer blocks bound the distance from below: with blocks of one length, the squared distance is
at least the sum over blocks of (difference of sums) ** 2 / length, plus the squared difference of the residual norms (what
is left of the vectors without their block means). Bounds are lowered by more than rounding can add. The entry with the
lowest coarse bound gets its exact distance; entries whose bounds are above it are out, level by level, and the rest get
exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checkpointed
from .near_dup import HOT_SHARE, look_up

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are compared at once.
SLAB = 8192
#: Components are below this, so that sums of squares are exact in 64 bits.
LIMIT = 1 << 24


def is_kept(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def integers(vector: Column) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * SCALE))


def levels(dims: int) -> list[int]:
    """Numbers of blocks from coarse to fine: 1, 2, 4 ..., below dims, as far as they divide it."""
    out = [1]
    while out[-1] * 2 < dims and dims % (out[-1] * 2) == 0:
        out.append(out[-1] * 2)
    return out


def sketches(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the block sums of x's rows, and the norms of the rows without their block means."""
    squares, out = (x * x).sum(axis=1).astype(float), []
    for blocks in levels(x.shape[1]):
        sums = x.reshape(len(x), blocks, -1).sum(axis=2).astype(float)
        out.append((sums, np.sqrt(np.maximum(0, squares - (sums * sums).sum(axis=1) * blocks / x.shape[1]))))
    return out


def lower_bound(sums: np.ndarray, norm: np.ndarray, entry_sums: np.ndarray, entry_norm: np.ndarray, length: float, slack: float) -> np.ndarray:
    """Conservative bound of the squared distances: rows of sums against rows of entry_sums (or all by broadcasting)."""
    d = sums - entry_sums
    return (d * d).sum(axis=-1) / length + (norm - entry_norm) ** 2 - slack


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first entry of the smallest squared distance, and that distance. All are integers."""
    n, dims = x.shape
    if not dims:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    top = float(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    slack = 1e-6 * (1 + dims * top * top)  # norms are off by the root of a rounding error, their squared difference by less
    mine, theirs, exact = sketches(x), sketches(entries), lambda r, e: ((x[r] - entries[e]) ** 2).sum(axis=1)
    bound = lower_bound(mine[0][0][:, None], mine[0][1][:, None], theirs[0][0][None], theirs[0][1][None], dims, slack)
    best = exact(np.arange(n), bound.argmin(axis=1))
    row, entry = np.nonzero(bound <= best[:, None])
    for (sums, norm), (e_sums, e_norm) in zip(mine[1:], theirs[1:], strict=True):
        ok = lower_bound(sums[row], norm[row], e_sums[entry], e_norm[entry], dims / sums.shape[1], slack) <= best[row]
        row, entry = row[ok], entry[ok]
    d = exact(row, entry)
    starts = np.searchsorted(row, np.arange(n))  # each row has the entry of its smallest distance at least
    least = np.minimum.reduceat(d, starts) if n else d
    at = np.flatnonzero(d == least[row])
    first = at[np.unique(row[at], return_index=True)[1]]
    return entry[first], least


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), dims)
    if np.abs(out).max(initial=0) >= LIMIT:
        raise ValueError(f"vector components times {SCALE} must be below {LIMIT}")
    return out


def assignments(batch: pd.Series, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(parts, codes, errors) of slabs of vectors: codes and errors have a column for each part."""
    for k in range(0, len(batch), SLAB):
        x = _matrix(batch[k : k + SLAB], books.shape[0] * books.shape[2])
        cut = x.reshape(len(x), books.shape[0], -1)
        found = [nearest(cut[:, p], books[p]) for p in range(books.shape[0])]
        yield cut, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def entry_sums(books: np.ndarray):
    """mapInPandas function: a task's vectors to (part, entry, count, sums), a row for each entry that they use."""
    parts, size, dims = books.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, dims), object if dims else np.int64)
        for batch in batches:
            for cut, codes, _ in assignments(batch["x"], books):
                for p in range(parts):
                    counts[p] += np.bincount(codes[:, p], minlength=size)
                    for j in range(dims):
                        part = np.zeros(size, np.int64)
                        np.add.at(part, codes[:, p], cut[:, p, j])
                        sums[p, :, j] += part
        rows = [(p, e, int(counts[p, e]), [str(v) for v in sums[p, e]]) for p in range(parts) for e in range(size) if counts[p, e]]
        yield pd.DataFrame(rows, columns=["part", "entry", "n", "sums"])

    return run


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose used entries are the floored means of the parts that are nearest to them. A row for each entry, which
    are of a fixed number, reaches the driver."""
    dims = books.shape[2]
    rows = vectors.mapInPandas(entry_sums(books), "part int, entry int, n long, sums array<string>")
    total = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(dims)))
    out = books.copy()
    for r in total.collect():
        out[r["part"], r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(dims)]
    return out


def codes(x: Column, books: np.ndarray) -> Column:
    """Struct of a vector's code, two hex digits for each part, and its squared distance from what the code stands for."""

    @F.pandas_udf("code string, error long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            code, error = [], []
            for _, c, e in assignments(batch, books):
                code += [bytes(row).hex() for row in c.astype(np.uint8)]
                error += e.sum(axis=1).tolist()
            yield pd.DataFrame({"code": pd.Series(code, dtype=object), "error": pd.Series(error, dtype="int64")})

    return of(x)


def first_books(vectors: DataFrame) -> np.ndarray:
    """Codebooks of the parts of the smallest ids' vectors, ascending. Null is the last id; of an id's vectors the smallest
    counts."""
    ids = vectors.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(ENTRIES)
    first = F.broadcast(ids.withColumnRenamed("id", "first"))
    rows = vectors.join(first, F.col("id").eqNullSafe(F.col("first"))).groupBy("id").agg(F.min("x").alias("x"))
    x = np.array([r["x"] for r in rows.orderBy(F.col("id").asc_nulls_last()).collect()], np.int64)
    return np.ascontiguousarray(x.reshape(len(x), PARTS, -1).transpose(1, 0, 2))


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of the rows whose vector is there and has finite components only.

    A component x becomes floor(256 * x). Each part's codebook starts as that part of the ENTRIES smallest ids' vectors and
    is refined ROUNDS times. Rows of null or repeated ids are rows like others; as an id, null comes last. label_error is the
    error summed over rows of a label, null labels together. Vectors must have a multiple of PARTS components. Those of
    another length than the smallest id's can't be compared with it and are left out. A component of 2**16 or more is an
    error. Other columns, whatever their names, don't matter. An empty table gives an empty result.
    """
    with Scratch(rows.sparkSession) as keep:
        return checkpointed(_compressed(rows, id_col, vector_col, label_col, keep))


def _compressed(rows: DataFrame, id_col: str, vector_col: str, label_col: str, keep: Scratch) -> DataFrame:
    vector = F.col(vector_col)
    own = keep(rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("v")).where(is_kept(F.col("v"))).select("id", "label", integers(F.col("v")).alias("x")))
    least = own.orderBy(F.col("id").asc_nulls_last(), "x").select(F.size("x").alias("n")).first()
    dims = least["n"] if least else 0
    if dims % PARTS:
        raise ValueError(f"vectors of {dims} components can't be cut into {PARTS} equal parts")
    own = own.where(F.size("x") == dims)
    if least is None:
        books = np.zeros((PARTS, 0, 0), np.int64)
    else:
        books = first_books(own)
        for _ in range(ROUNDS):
            books = refined(own, books)
    done = keep(own.select("id", F.struct("label").alias("of"), codes(F.col("x"), books).alias("c")).select("id", "of", "c.*"))
    sums = keep(done.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    found = look_up(done, sums, "of", F.col("n") > HOT_SHARE * done.count())
    return found.select("id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
