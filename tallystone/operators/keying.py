"""Keys, and which row of a repeated key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import paths


class NullKeyError(ValueError):
    """A row without a path can't be reconciled: it would be both missing and extra."""


def keyed(entries: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """``entries`` with ``key``. A null path raises while the rows are read."""
    path = F.when(F.col("relative_path").isNull(), F.raise_error(F.lit("relative_path is null"))).otherwise(F.col("relative_path"))
    return entries.withColumn("key", paths.comparison_key(path, case_sensitive))


def last_wins(entries: DataFrame) -> DataFrame:
    """The row of the highest ``seq`` of each key; equal ones go by the other columns. Partial maxima
    leave one row per key and task before the shuffle, however often a key repeats."""
    return _extreme(entries, F.max)


def first_match(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The row of the lowest ``seq`` of each key (equal ones go by the other columns), and all other
    rows of repeated keys. Rows that are equal in every column are one first row and others."""
    whole = _ordered(entries)
    again = entries.groupBy("key").agg(F.min(whole).alias("__first"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select("key", "__first")
    rows = entries.join(again, "key").withColumn("__row", whole)
    later = rows.where(F.col("__row") > F.col("__first")).select(*entries.columns)
    equal = rows.where(F.col("__row") == F.col("__first")).groupBy("key").agg(F.min("__first").alias("__row"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    equal = _fields(equal.withColumn("__copy", F.explode(F.sequence(F.lit(2).cast("long"), F.col("__n")))), entries)
    return _extreme(entries, F.min), later.unionByName(equal)


def _ordered(entries: DataFrame) -> Column:
    return F.struct("seq", *[c for c in entries.columns if c not in ("key", "seq")])


def _fields(rows: DataFrame, entries: DataFrame) -> DataFrame:
    return rows.select("key", *[F.col("__row")[c].alias(c) for c in entries.columns if c != "key"]).select(*entries.columns)


def _extreme(entries: DataFrame, pick) -> DataFrame:
    return _fields(entries.groupBy("key").agg(pick(_ordered(entries)).alias("__row")), entries)
