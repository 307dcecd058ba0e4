"""Any table as ``entries``: keys, a size and a payload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def table_entries(df: DataFrame, path: Sequence[Column | str] | Column, size: Column | str | None = None, payload: Sequence[Column | str] | None = None, seq: Column | str | None = None, last_write_time: Column | str | None = None, is_directory: Column | None = None, separator: str = "\\") -> DataFrame:
    """Entries of ``df``. ``path`` is one expression or the parts of the path; ``payload`` columns are
    hashed (nulls and column bounds are part of what is hashed); without ``seq`` repeated keys have
    no defined order and must not occur."""
    rel = path if isinstance(path, Column) else F.concat_ws(separator, *[as_column(c).cast("string") for c in path])
    if payload is None:
        digest = F.lit(None).cast("binary")
    elif len(payload) == 1:
        digest = F.unhex(F.sha2(as_column(payload[0]).cast("binary"), 256))
    else:
        cells = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in map(as_column, payload)]
        digest = F.unhex(F.sha2(F.concat(*cells).cast("binary"), 256))
    return df.select(
        rel.alias("relative_path"),
        (F.lit(0) if size is None else as_column(size)).cast("long").alias("size"),
        (F.lit(0) if last_write_time is None else as_column(last_write_time)).cast("long").alias("last_write_time"),
        F.lit(0).cast("long").alias("attributes"),
        F.lit(0).cast("long").alias("file_id"),
        (F.lit(False) if is_directory is None else is_directory).alias("is_directory"),
        (F.lit(0) if seq is None else as_column(seq)).cast("long").alias("seq"),
        digest.alias("digest"),
    )
