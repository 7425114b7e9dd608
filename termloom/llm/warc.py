"""WARC files and a Merkle audit of their replicas.

A record's digest and length make a leaf. Above the leaves stand a node for each of a key's buckets of digests, one for
each key, and then one for each aligned range of FANOUT nodes below, up to one root. A node's hash is over the ordered
list of its children, each with its place, the number of bytes its range covers and its hash, so it fixes the order and
the offset ranges within the node, while damage elsewhere, which shifts all that follows, leaves it as it is. Each
replica's tree is built without the other's. An audit compares the roots and goes down only where hashes differ.
A key's records are a multiset: a key that very many records share is spread over up to BUCKETS nodes.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

#: Children of a node, as a power of 2.
FANOUT_BITS = 8
#: Leading hex digits of a digest that name its bucket, and how many buckets that makes.
BUCKET_DIGITS, BUCKETS = 4, 16**4
#: Records with so many consecutive keys share an archive file.
FILE_KEYS = 1024
#: Date of records whose pages have none; the format wants one.
NO_DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 20


# Files


def record_head(uri: Column, payload: Column, date: Column | None = None) -> Column:
    """Header of a response record, with the blank line that ends it. The record id follows from address and payload."""
    uri, body, date = F.coalesce(uri, F.lit("")), F.coalesce(payload, F.lit("")), F.lit(NO_DATE) if date is None else F.coalesce(date.cast("string"), F.lit(NO_DATE))
    h = F.md5(F.concat(uri, F.lit("\n"), body).cast("binary"))
    name = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), name, F.lit(">\r\nWARC-Date: "), date, F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(uri, "[\\r\\n]", " "),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )


def record_text(uri: Column, payload: Column, date: Column | None = None) -> Column:
    """A whole record; a null payload is empty, line ends in an address are blanks."""
    return F.concat(record_head(uri, payload, date), F.coalesce(payload, F.lit("")), F.lit("\r\n\r\n"))


def _integral(df: DataFrame, column: str) -> Column:
    if df.schema[column].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{column} must be an integer column")
    return F.col(column).cast("long")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", compress: bool = True) -> DataFrame:
    """Writes WARC files into the folder path, which all executors reach, and returns their manifest (key, file, begin, end,
    digest), which is kept in path/manifest. Each record is a gzip member of its own (or plain), so that begin and end find it.

    A task writes one file, records in the order of keys, one at a time. A task that is run again writes a file of another
    name; the manifest lists only files of tasks that ended well. Nulls are as in manifest().
    """
    rows = pages.select(_integral(pages, id_col).alias("key"), record_text(F.col(uri_col), F.col(payload_col)).alias("record"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key").select(F.col("key").cast("string").alias("key"), "record")  # numbers with nulls would come as floats

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, folder = arrow_fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc{'.gz' if compress else ''}"
        at, out = 0, None
        for batch in batches:
            found = []
            for key, record in zip(batch["key"], batch["record"], strict=True):
                if out is None:
                    where.create_dir(folder, recursive=True)
                    out = where.open_output_stream(f"{folder}/{name}", compression=None)
                data = record.encode("utf-8", "surrogatepass")
                stored = gzip.compress(data, 6, mtime=0) if compress else data
                out.write(stored)
                found.append((key, name, at, at + len(stored), hashlib.sha256(data).hexdigest()))
                at += len(stored)
            yield pd.DataFrame(found, columns=["key", "file", "begin", "end", "digest"])
        if out is not None:
            out.close()

    stored = rows.mapInPandas(store, "key string, file string, begin long, end long, digest string")
    stored.select(F.col("key").cast("long").alias("key"), "file", "begin", "end", "digest").write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.parquet(f"{path}/manifest")


class _Bytes:
    """Plain bytes of a stream of gzip members or of a plain stream, as many as asked for."""

    def __init__(self, raw, compressed: bool):
        self.raw, self.compressed, self.held, self.unpack, self.rest = raw, compressed, bytearray(), None, b""

    def _more(self) -> bool:
        data = self.rest or self.raw.read(CHUNK)
        self.rest = b""
        if not data:
            return False
        if not self.compressed:
            self.held += data
            return True
        self.unpack = self.unpack or zlib.decompressobj(31)
        self.held += self.unpack.decompress(data)
        if self.unpack.eof:
            self.rest, self.unpack = self.unpack.unused_data, None
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def head(self) -> bytes | None:
        """Up to the next blank line; None at the end."""
        seen = 0
        while (at := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.held)
            if not self._more():
                return None
        return self.take(at + 4)


def records_in(raw, compressed: bool) -> Iterator[tuple[str, str]]:
    """(uri, payload) of each record of a stream, by the length that its header gives, so that a payload may hold anything."""
    data = _Bytes(raw, compressed)
    while (head := data.head()) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").strip().split("\r\n")[1:])
        yield fields.get("WARC-Target-URI", ""), data.take(int(fields["Content-Length"])).decode("utf-8", "surrogatepass")
        data.take(4)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(uri, payload) of the records in the files of a manifest that write_warc has left in the folder path.

    A task reads whole files as streams; no more than a record and a chunk are held at a time.
    """
    files = spark.read.parquet(f"{path}/manifest").select("file").distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, folder = arrow_fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for batch in batches:
            for name in batch["file"]:
                with where.open_input_stream(f"{folder}/{name}", compression=None) as raw:
                    out, held = [], 0
                    for uri, payload in records_in(raw, name.endswith(".gz")):
                        out.append((uri, payload))
                        held += len(payload)
                        if held > 8 * CHUNK:
                            yield pd.DataFrame(out, columns=["uri", "payload"])
                            out, held = [], 0
                    yield pd.DataFrame(out, columns=["uri", "payload"])

    return files.mapInPandas(read, "uri string, payload string")


# Manifests


def running(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the sum of value over each group's rows up to each row, in the order of columns. Rows are dealt by ranges of
    group and order, whose sums are added up first, so that a group may be larger than a task. Null groups are groups."""
    ranged = keep(df.withColumn("__v", value).repartitionByRange(*group, *order).withColumn("__p", F.spark_partition_id()))
    sums = ranged.groupBy("__p", *group).agg(F.sum("__v").alias("__s"))  # a row for each group of a range
    sums = sums.withColumn("__o", F.coalesce(F.sum("__s").over(W.partitionBy(*group).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.select(F.col("__p").alias("__q"), *(F.col(g).alias(f"__{g}") for g in group), "__o")
    here = F.sum("__v").over(W.partitionBy("__p", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    same = F.col("__p") == F.col("__q")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return ranged.withColumn("__h", here).join(sums, same).withColumn(out, F.col("__o") + F.col("__h")).drop("__p", "__q", "__v", "__o", "__h", *(f"__{g}" for g in group))


def manifest(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", file_keys: int = FILE_KEYS, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """(key, file, begin, end, digest) of every record in plain archive files of file_keys keys each: its file, its byte
    range there and its SHA-256, without writing the files.

    Texts stay where they are; only digests and lengths move. id_col must be an integer column; null keys are a key and
    a file of their own. Null addresses and payloads are empty. Repeated rows are records of their own, side by side.
    Other columns, whatever their names, are left out. An empty table has an empty manifest.
    """
    rec = record_text(F.col(uri_col), F.col(payload_col))
    rows = pages.select(_integral(pages, id_col).alias("key"), F.octet_length(rec).cast("long").alias("size"), F.sha2(rec.cast("binary"), 256).alias("digest"))
    file = F.expr(f"CASE WHEN key < 0 THEN -((-(key + 1)) div {file_keys}) - 1 ELSE key div {file_keys} END")
    rows = keep(rows.withColumn("file", file).withColumn("tie", F.monotonically_increasing_id()))  # texts are read and hashed once
    ends = running(rows, ["file"], ["key", "digest", "tie"], F.col("size"), "end", keep)
    return ends.select("key", "file", (F.col("end") - F.col("size")).alias("begin"), "end", "digest")


# Trees


def _hash_of(children: Column) -> Column:
    """SHA-256 over the children's lines in order. Groups are small: FANOUT nodes, a key's BUCKETS, or a bucket's digests."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(children)), "\n").cast("binary"), 256)


def addressed(records: DataFrame) -> DataFrame:
    """records with their place in the tree: no_key, node (their key) and bucket."""
    return records.withColumns({"no_key": F.col("key").isNull(), "node": F.coalesce("key", F.lit(0).cast("long")), "bucket": F.substring("digest", 1, BUCKET_DIGITS)})


def tree(records: DataFrame, n_levels: int, keep: Callable[[DataFrame], DataFrame], by: tuple[str, ...] = ()) -> list[DataFrame]:
    """Level by level, leaves first and root last: (place columns, hash, n records, n_bytes). Null keys stay a node of their
    own up to the root. Records that differ in the columns by are in trees of their own, which are built side by side; one
    without records has no rows."""
    size = (F.col("end") - F.col("begin")).alias("size")
    one = addressed(records).groupBy(*by, "no_key", "node", "bucket", "digest", size).agg(F.count("*").alias("n"))
    totals = (F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"))
    line = F.concat_ws(":", "digest", "size", "n")
    one = one.withColumn("n_bytes", F.col("n") * F.col("size"))
    out = [keep(one.groupBy(*by, "no_key", "node", "bucket").agg(_hash_of(line).alias("hash"), *totals))]
    line = F.concat_ws(":", "bucket", "n_bytes", "hash")
    out.append(keep(out[0].groupBy(*by, "no_key", "node").agg(_hash_of(line).alias("hash"), *totals)))
    slot = F.lpad(F.hex(F.col("node").bitwiseAND(F.lit((1 << FANOUT_BITS) - 1))), 2, "0")
    line = F.concat_ws(":", slot, "n_bytes", "hash")
    for _ in range(n_levels):
        up = out[-1].withColumn("line", line)
        above = F.shiftright("node", FANOUT_BITS).alias("node")
        out.append(keep(up.groupBy(*by, "no_key", above).agg(_hash_of(F.col("line")).alias("hash"), *totals)))
    line = F.concat_ws(":", F.col("no_key").cast("int"), "node", "n_bytes", "hash")
    top = out[-1].select(*by, line.alias("line"), "n", "n_bytes")
    out.append(keep(top.groupBy(*by).agg(_hash_of(F.col("line")).alias("hash"), *totals)))
    return out


def levels(low: int | None, high: int | None) -> int:
    """Levels above the keys from low to high until they are at most two nodes (keys of both signs never share one)."""
    if low is None or high is None:
        return 0
    k = 0
    while (low >> FANOUT_BITS * k) != (high >> FANOUT_BITS * k) and k * FANOUT_BITS < 64:
        k += 1
    return k


def _span(records: DataFrame) -> int:
    ends = records.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    return levels(ends["lo"], ends["hi"])


def root(records: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row: the root's hash, its records and its bytes."""
    return tree(records, _span(records), keep)[-1]


def odd_buckets(held: DataFrame, other: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(no_key, node, bucket): the buckets of keys whose records differ between two manifests, found from the roots down.
    Both trees are built in the same jobs, a level in each."""
    sides = [t.select("key", "begin", "end", "digest", F.lit(k).alias("side")) for k, t in enumerate((held, other))]
    both = sides[0].unionByName(sides[1])
    n = _span(both)
    whole = tree(both, n, keep, ("side",))
    none = whole[0].select("no_key", "node", "bucket").where("false")
    tops = {r["side"]: r["hash"] for r in whole[-1].select("side", "hash").collect()}  # two rows at most
    if tops.get(0) == tops.get(1):
        return none
    odd, height = None, n
    for level in whole[-2::-1]:
        at = [c for c in ("no_key", "node", "bucket") if c in level.columns]
        if odd is not None:  # only below nodes that differ
            bits = FANOUT_BITS if height >= 0 else 0
            up = odd.select(F.col("no_key").alias("k"), F.col("node").alias("up"))
            level = level.join(up, (level["no_key"] == up["k"]) & (F.shiftright(level["node"], bits) == up["up"]), "left_semi")
        seen = level.groupBy(*at).agg(F.count("*").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        odd = keep(seen.where("n < 2 OR lo <> hi").select(*at))
        height -= 1
        if odd.isEmpty():
            return none
    return odd


# Audits


def audit_records(held: DataFrame, other: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row for each record in which two manifests differ: key, file, begin, end (by held; by other if extra), digest by held
    and found_digest by other, and damage: altered, missing (other lacks it) or extra (held lacks it).

    Records of a key have no order of their own; those whose digests both replicas hold are intact, as often as both hold
    them, and of equal records the last are the ones too many. What is left of a key on both sides is paired in the order
    of digests as altered, the rest is missing or extra. Null keys are one key. Equal replicas, two empty ones included,
    give no rows.
    """
    odd = odd_buckets(held, other, keep)
    sides = addressed(held.withColumn("side", F.lit(0)).unionByName(other.withColumn("side", F.lit(1)))).join(odd, ["no_key", "node", "bucket"], "left_semi")
    sides = keep(sides.select("side", "no_key", "node", "digest", "file", "begin", "end"))
    is_held = F.lit(1) - 2 * F.col("side")
    counts = sides.groupBy("no_key", "node", "digest").agg(F.sum(is_held).alias("more"), F.sum((1 - F.col("side"))).alias("n_0"), F.sum("side").alias("n_1"))
    both = sides.join(counts.where("more <> 0"), ["no_key", "node", "digest"]).where((F.col("more") > 0) == (F.col("side") == 0))
    nth = running(both, ["side", "no_key", "node", "digest"], ["file", "begin"], F.lit(1), "nth", keep).where(F.col("nth") > F.least("n_0", "n_1"))
    left = running(nth.select("side", "no_key", "node", "digest", "file", "begin", "end"), ["side", "no_key", "node"], ["digest", "file", "begin"], F.lit(1), "i", keep)
    side = lambda k: left.where(F.col("side") == k).select("no_key", "node", "i", *(F.col(c).alias(f"{c}_{k}") for c in ("digest", "file", "begin", "end")))
    out = side(0).join(side(1), ["no_key", "node", "i"], "full_outer")
    damage = F.when(F.col("digest_1").isNull(), "missing").when(F.col("digest_0").isNull(), "extra").otherwise("altered")
    # one side gives all three, as a null file is a file
    place = [F.when(F.col("digest_0").isNotNull(), F.col(f"{c}_0")).otherwise(F.col(f"{c}_1")).alias(c) for c in ("file", "begin", "end")]
    return out.select(F.when(~F.col("no_key"), F.col("node")).alias("key"), *place, F.col("digest_0").alias("digest"), F.col("digest_1").alias("found_digest"), damage.alias("damage"))


def audit(held: DataFrame, other: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row for each key whose records differ, whatever their number, with the columns of audit_records: the first file and
    the smallest differing digest of either side, and the range from the first to the last differing record."""
    one = audit_records(held, other, keep).groupBy("key").agg(
        F.min("file").alias("file"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("digest").alias("digest"), F.min("found_digest").alias("found_digest")
    )
    damage = F.when(F.col("found_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("altered")
    return one.withColumn("damage", damage)
