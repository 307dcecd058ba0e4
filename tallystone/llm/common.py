"""Helpers shared by the operators: scratch tables, Arrow batches, column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python operator handles at a time.
SLICE_BYTES = 8 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only where the session has none, on a single machine, a temporary folder is set. On a cluster
    every executor would write to a folder of its own, so there it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallystone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/tallystone/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of an executor, and an expensive or
    non-repeatable step runs once. ``drop_scratch`` frees the tables.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def drop_scratch(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_scratch_path", None):
            remove_path(df.sparkSession, path)


#: Rows of a key from which it is hot, and the number of hot keys that are broadcast (some 100 bytes
#: each): the first is doubled until the second holds.
HOT_ROWS, HOT_KEYS = 10_000, 100_000


def hot_keys(counts: DataFrame, n: str = "count") -> DataFrame | None:
    """The hot keys of ``counts`` (one row for each key, cheap to compute, and its number of rows in
    ``n``), or None if there are none."""
    least = HOT_ROWS
    while (many := (hot := counts.where(F.col(n) >= least).drop(n)).count()) > HOT_KEYS:
        least *= 2
    return hot if many else None


def join_unique(rows: DataFrame, unique: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``unique``, which has one row for each ``key``. The keys in ``hot`` (a table
    of that column, or None) meet by broadcast, so none of them is one task's work; all others by
    shuffle. ``how``: inner or left."""
    if hot is None:
        return rows.join(unique, key, how)
    one = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(unique.join(F.broadcast(hot), key, "left_semi")), key, how)
    return one.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(unique, key, how))


#: Bits of a filter: for each key, and at most (64 MB).
KEY_BITS, MOST_BITS = 64, 1 << 29


def maybe_among(rows: DataFrame, place: str, wanted: DataFrame, key_bits: int = KEY_BITS) -> DataFrame:
    """``rows`` whose hash ``place`` (long, not null) may be one of ``wanted`` (a table of one long
    column, written): all that are, and one in ``key_bits`` of the others; more where ``MOST_BITS`` are few.
    A filter before a join, broadcast as 4 KB bitmaps."""
    n, bits = wanted.count(), 1 << 15
    while bits < min(key_bits * n, MOST_BITS):
        bits *= 2
    at = F.pmod(F.col(wanted.columns[0]), F.lit(bits))
    maps = wanted.select(F.shiftright(at, 15).alias("__map"), at.bitwiseAND(32767).alias("__bit")).repartition("__map")
    maps = maps.groupBy("__map").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    found = rows.withColumn("__at", F.pmod(F.col(place), F.lit(bits))).join(F.broadcast(maps), F.shiftright("__at", 15) == F.col("__map"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast((__at & 32767) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.expr("shiftleft(1, cast(__at & 7 as int))").bitwiseAND(byte) != 0
    return found.where(is_set).drop("__at", "__map", "__bits")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8_size(name: str = "text") -> Column:
    return F.octet_length(text_or_empty(name)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], text_at: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if batch.column(text_at).nbytes <= most:
            yield batch
            continue
        lengths = pc.binary_length(batch.column(text_at)).fill_null(0).to_pylist()
        begin = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)


def release_memory() -> None:
    """Give freed memory back to the system. Python workers stay after a task, several per executor;
    called at a task's end, so that idle ones hold no more than their caches."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
