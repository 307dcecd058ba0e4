"""Directories that only repeat what their descendants say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.functions import paths


def without_descendants(rows: DataFrame, separator: str = paths.BACKSLASH) -> DataFrame:
    """All files of ``rows``, and the directories that have no descendant in ``rows``.

    A prefix condition would compare all pairs. Each key's strict ancestors are listed instead,
    reduced to distinct ones, and taken away by an anti join on equality.
    """
    covered = rows.select(F.explode(paths.ancestors(F.col("key"), separator)).alias("key")).distinct()
    files, dirs = rows.where(~F.col("is_directory")), rows.where(F.col("is_directory"))
    return files.unionByName(dirs.join(covered, "key", "left_anti").select(*rows.columns))


def under(rows: DataFrame, roots: DataFrame, name: str = "under_error", separator: str = paths.BACKSLASH) -> DataFrame:
    """``rows`` with a flag: the key or an ancestor of it is a ``key`` of ``roots``."""
    own = F.concat(paths.ancestors(F.col("key"), separator), F.array("key"))
    hit = rows.select("key", F.explode(own).alias("__root")).join(roots.select(F.col("key").alias("__root")).distinct(), "__root", "left_semi").select("key").distinct().withColumn(name, F.lit(True))
    return rows.drop(name).join(hit, "key", "left").withColumn(name, F.coalesce(name, F.lit(False)))
