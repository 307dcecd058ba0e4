"""The full outer join and the status of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.spec import DigestState, Mode, Status

#: Columns of classified rows.
COLUMNS = ("key", "status", "relative_path", "size_source", "size_dest", "is_directory", "hash_source", "hash_dest", "error_message")


def _side(entries: DataFrame, name: str) -> DataFrame:
    digest = F.col("digest") if "digest" in entries.columns else F.lit(None).cast("binary")
    carried = [c for c in ("last_write_time", "content_state", "changed") if c in entries.columns]
    return entries.select("key", F.col("relative_path").alias(f"path_{name}"), F.col("size").alias(f"size_{name}"), F.col("is_directory").alias(f"dir_{name}"), digest.alias(f"hash_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in carried], F.lit(True).alias(f"in_{name}"))


def joined(source: DataFrame, dest: DataFrame) -> DataFrame:
    """One row per key of either side. Both sides must hold a key once."""
    return _side(source, "source").join(_side(dest, "dest"), "key", "full_outer")


def known_status(mode: Mode) -> Column:
    """Status by presence, type and size; null for pairs whose content must be compared."""
    in_source, in_dest, dir_source, dir_dest = (F.col(c) for c in ("in_source", "in_dest", "dir_source", "dir_dest"))
    out = F.when(in_dest.isNull(), Status.MISSING.value).when(in_source.isNull(), Status.EXTRA.value).when(dir_source & dir_dest, Status.IDENTICAL.value).when(dir_source | dir_dest, Status.SIZE_MISMATCH.value)
    if mode == Mode.PRESENCE:
        return out.otherwise(Status.IDENTICAL.value)
    out = out.when(F.col("size_source") != F.col("size_dest"), Status.SIZE_MISMATCH.value)
    return out.otherwise(F.lit(None) if mode == Mode.CONTENT else Status.IDENTICAL.value)


def classified(source: DataFrame, dest: DataFrame, mode: Mode) -> DataFrame:
    """Joined rows with ``status`` (null: compare the content), the path that is shown (the
    destination's spelling if it has one) and ``is_directory``."""
    rows = joined(source, dest).withColumn("status", known_status(mode))
    kind = F.when(F.col("in_source").isNotNull() & F.col("in_dest").isNotNull(), F.col("dir_source") & F.col("dir_dest")).otherwise(F.coalesce("dir_source", "dir_dest"))
    rows = rows.withColumn("relative_path", F.coalesce("path_dest", "path_source")).withColumn("is_directory", kind)
    return rows.withColumns({"size_source": F.coalesce("size_source", F.lit(0).cast("long")), "size_dest": F.coalesce("size_dest", F.lit(0).cast("long"))})


def content_status(rows: DataFrame) -> DataFrame:
    """Decide rows without status from hash_source, hash_dest, and where present
    content_state_source / _dest (ok, no_access, read_error) and changed_source / _dest. A digest
    that is null without a state reads as an error."""
    has = rows.columns
    state = lambda side: F.coalesce(F.col(f"content_state_{side}") if f"content_state_{side}" in has else F.lit(None), F.when(F.col(f"hash_{side}").isNull(), DigestState.READ_ERROR.value).otherwise(DigestState.OK.value))
    changed = F.lit(False)
    for side in ("source", "dest"):
        if f"changed_{side}" in has:
            changed = changed | F.coalesce(F.col(f"changed_{side}"), F.lit(False))
    s, d = state("source"), state("dest")
    both = (s == DigestState.OK.value) & (d == DigestState.OK.value)
    decided = F.when(changed, Status.CHANGED_DURING_SCAN.value).when(both & (F.col("hash_source") == F.col("hash_dest")), Status.IDENTICAL.value).when(both, Status.CONTENT_MISMATCH.value).when((s == DigestState.NO_ACCESS.value) | (d == DigestState.NO_ACCESS.value), Status.ACCESS_DENIED.value).otherwise(Status.READ_ERROR.value)
    return rows.withColumn("status", F.coalesce("status", decided))


def shown(rows: DataFrame) -> DataFrame:
    """``COLUMNS`` of decided rows; digests are shown for content mismatches only."""
    different = F.col("status") == Status.CONTENT_MISMATCH.value
    message = F.col("error_message") if "error_message" in rows.columns else F.lit(None).cast("string")
    return rows.select("key", "status", "relative_path", "size_source", "size_dest", "is_directory", *[F.when(different, F.col(c)).alias(c) for c in ("hash_source", "hash_dest")], message.alias("error_message"))


def duplicates_as_extra(others: DataFrame) -> DataFrame:
    """Destination rows whose key an earlier row has taken."""
    none = F.lit(None)
    return others.select("key", F.lit(Status.EXTRA.value).alias("status"), "relative_path", F.lit(0).cast("long").alias("size_source"), F.col("size").alias("size_dest"), "is_directory", none.cast("binary").alias("hash_source"), none.cast("binary").alias("hash_dest"), none.cast("string").alias("error_message"))


def errors_as_rows(errors: DataFrame) -> DataFrame:
    """Scan errors (path, message, code, lost_device) as result rows."""
    from tallystone.functions import text

    status = F.when(F.col("code") == text.ACCESS_DENIED_CODE, Status.ACCESS_DENIED.value).otherwise(Status.READ_ERROR.value)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("binary")
    return errors.select(F.col("path").alias("key"), status.alias("status"), F.col("path").alias("relative_path"), zero.alias("size_source"), zero.alias("size_dest"), F.lit(True).alias("is_directory"), none.alias("hash_source"), none.alias("hash_dest"), F.col("message").alias("error_message"))
