"""The counters of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.spec import Status

COUNTERS = ("source_files", "source_dirs", "dest_files", "dest_dirs", "identical_files", "identical_dirs", "missing_files", "missing_dirs", "extra_files", "extra_dirs", "size_mismatch", "content_mismatch", "read_errors", "access_denied", "changed_during_scan", "bytes_source", "bytes_dest")


def _scan_counts(side: str) -> dict[str, Column]:
    is_dir = F.col("is_directory")
    return {f"{side}_files": F.count_if(~is_dir), f"{side}_dirs": F.count_if(is_dir), f"bytes_{side}": F.sum(F.when(~is_dir, F.col("size")))}


def _status_counts() -> dict[str, Column]:
    status, is_dir = F.col("status"), F.col("is_directory")
    out = {f"{name}_{kind}": F.count_if((status == s.value) & (is_dir if kind == "dirs" else ~is_dir)) for name, s in (("identical", Status.IDENTICAL), ("missing", Status.MISSING), ("extra", Status.EXTRA)) for kind in ("files", "dirs")}
    return out | {name: F.count_if(status == s.value) for name, s in (("size_mismatch", Status.SIZE_MISMATCH), ("content_mismatch", Status.CONTENT_MISMATCH), ("read_errors", Status.READ_ERROR), ("access_denied", Status.ACCESS_DENIED), ("changed_during_scan", Status.CHANGED_DURING_SCAN))}


def _row(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.coalesce(counts.get(c, F.lit(0)), F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def counters(source: DataFrame, dest: DataFrame, results: DataFrame) -> DataFrame:
    """One row of ``COUNTERS``: the deduplicated source, the raw destination, and all results
    (identical rows and every directory included)."""
    parts = [_row(source, _scan_counts("source")), _row(dest, _scan_counts("dest")), _row(results, _status_counts())]
    return reduce(DataFrame.unionAll, parts).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def errors_total(stats: DataFrame) -> DataFrame:
    return stats.select((F.col("read_errors") + F.col("access_denied") + F.col("changed_during_scan")).alias("errors"))
