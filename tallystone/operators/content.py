"""Digests of files: cached where possible, read in chunks on executors otherwise."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.spec import DigestState

CHUNK = 1 << 20
#: What one task reads, about.
READER_BYTES, READER_FILES = 1 << 30, 10_000
#: 100 ns ticks between 1601 and 1970.
EPOCH_TICKS = 116_444_736_000_000_000


def ticks(mtime_ns: int) -> int:
    return mtime_ns // 100 + EPOCH_TICKS


def file_digest(path: str, size: int, last_write_time: int) -> tuple[bytes | None, str, bool]:
    """(SHA-256, state, changed) of a file that was listed with ``size`` and ``last_write_time``."""
    try:
        before = os.stat(path)
        if (before.st_size, ticks(before.st_mtime_ns)) != (size, last_write_time):
            return None, DigestState.OK.value, True
        digest = hashlib.sha256()
        with open(path, "rb") as f:
            while chunk := f.read(CHUNK):
                digest.update(chunk)
        after = os.stat(path)
        changed = (after.st_size, after.st_mtime_ns) != (before.st_size, before.st_mtime_ns)
        return digest.digest(), DigestState.OK.value, changed
    except PermissionError:
        return None, DigestState.NO_ACCESS.value, False
    except OSError:
        return None, DigestState.READ_ERROR.value, False


def digests(files: DataFrame, cache: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """From (abs_path, size, last_write_time): the same with digest, content_state, changed and
    from_cache. A cached digest counts if path, size and time are equal; only misses are read.
    Every executor must see the paths. ``partitions`` limits the readers; without it there is one for
    about every ``READER_BYTES`` or ``READER_FILES`` to read."""
    rows = files.select("abs_path", "size", "last_write_time").distinct()
    schema = "abs_path string, size long, last_write_time long, digest binary, content_state string, changed boolean"
    keys = ["abs_path", "size", "last_write_time"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [file_digest(*r) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.string(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*keys, "digest", "content_state", "changed"])

    misses = rows if cache is None else rows.join(cache, keys, "left_anti")
    if not partitions:
        todo = misses.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
        partitions = max(-(-todo[0] // READER_BYTES), -(-todo[1] // READER_FILES), min(todo[1], rows.sparkSession.sparkContext.defaultParallelism), 1)
    read = misses.repartition(partitions).mapInArrow(run, schema).withColumn("from_cache", F.lit(False))
    if cache is None:
        return read
    hits = rows.join(cache.select(*keys, "digest"), keys).select(*keys, "digest", F.lit(DigestState.OK.value).alias("content_state"), F.lit(False).alias("changed"), F.lit(True).alias("from_cache"))
    return hits.unionByName(read)
