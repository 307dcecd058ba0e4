"""Saved scans: Parquet with the case policy, root and version; and a compact binary file."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

VERSION = 1
COLUMNS = ("relative_path", "size", "last_write_time", "attributes", "file_id", "is_directory", "seq", "digest")

# Fixed values of the binary layout.
MAGIC, BINARY_VERSION, MOST_PATH, MOST_ENTRIES = 0x49535642, 1, 1 << 24, 1 << 31
#: Entries of a binary snapshot that a task reads.
RANGE_ENTRIES = 100_000


class SnapshotError(ValueError):
    """Not a snapshot, or a damaged one."""


@dataclass(frozen=True)
class Snapshot:
    entries: DataFrame
    root: str
    case_sensitive: bool

    def has_digests(self) -> bool:
        return not self.entries.where(F.col("digest").isNotNull()).isEmpty()


def write(entries: DataFrame, path: str, root: str, case_sensitive: bool) -> None:
    """One row per key. Files that could not be hashed have a null digest."""
    rows = entries if "digest" in entries.columns else entries.withColumn("digest", F.lit(None).cast("binary"))
    rows.select(*COLUMNS).write.mode("overwrite").parquet(f"{path}/entries")
    about = {"version": VERSION, "root": root, "case_sensitive": case_sensitive}
    rows.sparkSession.createDataFrame([(json.dumps(about),)], "about string").write.mode("overwrite").text(f"{path}/about")


def read(spark: SparkSession, path: str) -> Snapshot:
    try:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        entries = spark.read.parquet(f"{path}/entries")
    except Exception as e:
        raise SnapshotError(f"{path} isn't a snapshot: {str(e).splitlines()[0]}") from e
    if about.get("version") != VERSION or any(c not in entries.columns for c in COLUMNS):
        raise SnapshotError(f"{path} has another version or other columns")
    return Snapshot(entries, about["root"], about["case_sensitive"])


def write_binary(entries: DataFrame, file: str, root: str, case_sensitive: bool) -> None:
    """A single little-endian file, streamed from the executors one partition at a time."""
    totals = entries.agg(F.count_if(~F.col("is_directory")), F.count_if(F.col("is_directory")), F.coalesce(F.sum(F.when(~F.col("is_directory"), F.col("size"))), F.lit(0)), F.count(F.lit(1))).first()
    where = root.encode()
    with open(file, "wb") as out:
        out.write(struct.pack("<IIBQ", MAGIC, BINARY_VERSION, case_sensitive, len(where)) + where + struct.pack("<4Q", *totals))
        for r in entries.select(*COLUMNS).toLocalIterator():
            path = r.relative_path.encode()
            out.write(struct.pack("<Q", len(path)) + path + struct.pack("<QQIQBB", r.size, r.last_write_time, r.attributes, r.file_id, r.is_directory, r.digest is not None))
            if r.digest is not None:
                out.write(bytes(r.digest))


def _exactly(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise SnapshotError("damaged snapshot: it is cut off")
    return data


def _header(f: BinaryIO) -> tuple[str, bool, int]:
    """(root, case policy, number of entries)."""
    magic, version, exact, n = struct.unpack("<IIBQ", _exactly(f, 17))
    if magic != MAGIC or version != BINARY_VERSION or n > MOST_PATH:
        raise SnapshotError("wrong magic number or version")
    try:
        root = _exactly(f, n).decode()
    except UnicodeDecodeError as e:
        raise SnapshotError(f"damaged snapshot: {e}") from e
    count = struct.unpack("<4Q", _exactly(f, 32))[3]
    if count > MOST_ENTRIES:
        raise SnapshotError("too many entries")
    return root, bool(exact), count


def _rows(f: BinaryIO, first: int, count: int) -> Iterator[tuple]:
    for seq in range(first, first + count):
        (n,) = struct.unpack("<Q", _exactly(f, 8))
        if n > MOST_PATH:
            raise SnapshotError("a path is too long")
        try:
            path = _exactly(f, n).decode()
        except UnicodeDecodeError as e:
            raise SnapshotError(f"damaged snapshot: {e}") from e
        size, time, attributes, file_id, is_dir, hashed = struct.unpack("<QQIQBB", _exactly(f, 30))
        if max(size, time, file_id) >= 1 << 63:
            raise SnapshotError("damaged snapshot: a number is too large")
        yield path, size, time, attributes, file_id, bool(is_dir), seq, _exactly(f, 32) if hashed else None


@dataclass
class _Range(InputPartition):
    offset: int
    first: int
    count: int


class _BinaryReader(DataSourceReader):
    def __init__(self, path: str, ranges: str):
        self.path, self.ranges = path, ranges

    def partitions(self):
        return [_Range(*r) for r in json.loads(self.ranges)]

    def read(self, partition):
        with open(self.path, "rb") as f:
            f.seek(partition.offset)
            yield from _rows(f, partition.first, partition.count)


class BinarySnapshot(DataSource):
    """Options: ``path``, and ``ranges`` (offset, first entry, entries), which ``read_binary`` finds."""

    @classmethod
    def name(cls):
        return "binary_snapshot"

    def schema(self):
        return "relative_path string, size long, last_write_time long, attributes long, file_id long, is_directory boolean, seq long, digest binary"

    def reader(self, schema):
        return _BinaryReader(self.options["path"], self.options.get("ranges", "[]"))


def read_binary(spark: SparkSession, file: str) -> Snapshot:
    """The driver goes through the file once, holding one entry at a time, which finds any damage (a
    ``SnapshotError``) and where each ``RANGE_ENTRIES`` begin; executors, who must see the path, read
    these ranges."""
    ranges = []
    with open(file, "rb") as f:
        root, exact, count = _header(f)
        for first in range(0, count, RANGE_ENTRIES):
            n = min(RANGE_ENTRIES, count - first)
            ranges.append((f.tell(), first, n))
            for _ in _rows(f, first, n):
                pass
    spark.dataSource.register(BinarySnapshot)
    # A source without partitions isn't read, so an empty snapshot has one empty range.
    entries = spark.read.format("binary_snapshot").option("ranges", json.dumps(ranges or [(0, 0, 0)])).load(file)
    return Snapshot(entries, root, exact)
