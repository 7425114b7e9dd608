"""Files that exports become: tab-separated lines, gzipped lines, and JSON without nulls."""

from __future__ import annotations

import base64
import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a blob's piece.
PIECE_BYTES = 16_000_000


def lines(df: DataFrame) -> DataFrame:
    """One column, value: the columns joined by tabs. Nulls are empty."""
    return df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value"))


def write_tsv(df: DataFrame, path: str, compressed: bool = False) -> None:
    lines(df).write.mode("errorifexists").option("compression", "gzip" if compressed else "none").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; nulls, and empty arrays and maps, are left out."""
    kept = df.select(*(F.when(F.size(c) > 0, F.col(c)).alias(c) if t.startswith(("array", "map")) else F.col(c) for c, t in df.dtypes))
    kept.write.option("ignoreNullFields", "true").json(path)


def gzip_member(text: bytes) -> bytes:
    """A gzip member whose length is a multiple of three, so that Base64 texts of members can be joined: the header's file name
    takes what is missing."""
    body = gzip.compress(text, mtime=0)
    missing = -(len(body) + 1) % 3  # a name ends with a zero byte
    # Fixed values of the format: flags stand at byte 3, bit 3 says that a name follows the ten bytes of the header.
    return body[:3] + bytes([body[3] | 8]) + body[4:10] + b"x" * missing + b"\0" + body[10:]


def blob_pieces(df: DataFrame) -> DataFrame:
    """(piece, value): Base64 texts, the pieces of one: joined in order they are the Base64 text of gzipped lines, in the order of
    df's partitions. Each partition makes pieces of at most PIECE_BYTES of lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        at = TaskContext.get().partitionId() << 32

        def piece() -> pd.DataFrame:
            nonlocal held, size, at
            out = pd.DataFrame({"piece": [at], "value": [base64.b64encode(gzip_member("".join(held).encode())).decode()]})
            held, size, at = [], 0, at + 1
            return out

        for batch in batches:
            for line in batch["value"]:
                held.append(line + "\n")
                size += len(line) + 1
                if size >= PIECE_BYTES:
                    yield piece()
        if held:
            yield piece()

    return lines(df).mapInPandas(run, "piece long, value string")


def write_blob(df: DataFrame, path: str) -> None:
    """Writes blob_pieces as text, in files whose order of names is that of pieces: joined without line ends they are one
    Base64 text of gzipped lines. No line goes through the driver."""
    blob_pieces(df).select("value").write.mode("errorifexists").text(path)


def byte_numbers(df: DataFrame) -> DataFrame:
    """(piece, value): the lines' UTF-8 bytes as comma-joined numbers from -128 to 127, a text for each line; joined by commas
    in order, between brackets, they are the JSON array that some web clients take."""
    text = lines(df).select(F.monotonically_increasing_id().alias("piece"), F.concat("value", F.lit("\n")).cast("binary").alias("b"))
    signed = lambda i: (F.conv(F.hex(F.substring(F.col("b"), i, 1)), 16, 10).cast("int") + 128) % 256 - 128
    return text.select("piece", F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length("b")), lambda i: signed(i).cast("string")), ",").alias("value"))


def small_blob(df: DataFrame, max_lines: int = 1_000_000) -> str:
    """The lines as one Base64 text of gzipped bytes, as web clients take it. Only for exports of at most max_lines;
    larger ones raise an error and belong in write_blob."""
    rows = lines(df).limit(max_lines + 1).collect()
    if len(rows) > max_lines:
        raise ValueError(f"more than {max_lines} lines: write files instead")
    return base64.b64encode(gzip.compress("".join(r.value + "\n" for r in rows).encode())).decode()
