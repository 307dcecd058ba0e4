"""Digests that are kept between runs: (abs_path, size, last_write_time) -> digest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.spec import DigestState

KEYS = ("abs_path", "size", "last_write_time")
SCHEMA = "abs_path string, size long, last_write_time long, digest binary"


def _current(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return fs, []
    return fs, sorted((s.getPath() for s in fs.listStatus(hadoop) if s.isDirectory() and s.getPath().getName().startswith("v")), key=lambda p: p.getName())


def read(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(cache, warning). A cache that isn't there is empty; a damaged one is empty with a
    warning: all its pages are read once for that, as damage behind the footer shows only then."""
    empty = spark.createDataFrame([], SCHEMA)
    _, versions = _current(spark, path)
    if not versions:
        return empty, None
    try:
        found = spark.read.parquet(versions[-1].toString())
        found = found.select(*KEYS, "digest")
        found.agg(F.max(F.xxhash64(*KEYS, "digest"))).first()
        return found, None
    except Exception as e:
        return empty, f"the digest cache can't be read: {str(e).splitlines()[0]}"


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` and what ``new`` (content.digests) has read without error or change; new wins."""
    good = new.where((F.col("content_state") == DigestState.OK.value) & ~F.col("changed") & F.col("digest").isNotNull()).select(*KEYS, "digest")
    paths = good.select("abs_path").distinct()
    return old.join(paths, "abs_path", "left_anti").select(*KEYS, "digest").unionByName(good.dropDuplicates(list(KEYS)))


def save(cache: DataFrame, path: str) -> None:
    """Write a new version, then drop the older ones; the folder that is read is never overwritten."""
    spark = cache.sparkSession
    fs, versions = _current(spark, path)
    number = int(versions[-1].getName()[1:].split("-")[0]) + 1 if versions else 0
    cache.select(*KEYS, "digest").write.parquet(f"{path}/v{number:010d}-{uuid.uuid4().hex[:8]}")
    for old in versions:
        fs.delete(old, True)
