"""Mixing sources to target weights (operator 5).

The words of each source are summed, targets follow from the sources' weights, and
rate = target / words of the source. A document is emitted floor(rate) times, and once more if a
number drawn from the hash of seed, source and id is below the rate's fraction. The draw depends on
the document alone, so reruns and any partitioning agree.

DataFrame functions only. One aggregation with partial sums per source; the sources' table is then
broadcast if it is small (checked), else joined by shuffle, where adaptive execution splits a hot
source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
SEED = "mix-1"
#: Sources up to which their table is broadcast (about 100 bytes each).
BROADCAST_SOURCES = 50_000

WORD = r"[^\x20\x09-\x0D]+"


def word_count(name: str = "text") -> Column:
    return F.regexp_count(common.text_or_empty(name), F.lit(WORD)).cast("long")


def targets(df: DataFrame, source_col: str = "source", size_col: str = "size", weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source (null is one): ``source_col``, source_size long, weight int, target.

    Sources by code point, null last, take the weights in turn. The targets' sum is ``share`` of all
    sizes, by weight; a target stops at ``most`` times its source's size and the excess goes to the
    others by weight. With sources sorted by the level at which they stop (most x size / weight), the
    stopped ones are a prefix: the first source whose own level isn't below the level that the
    rest would get ends it. That is one pass of running sums over the sources.
    """
    sums = df.groupBy(source_col).agg(F.coalesce(F.sum(size_col), F.lit(0)).cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(turn, F.lit(len(weights))) + 1)
    sums = sums.withColumn("weight", weight)
    cap = F.col("source_size") * most
    by_level = Window.orderBy(F.col("source_size") * most / F.col("weight"), F.col(source_col).asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    sums = sums.withColumn("__place", F.row_number().over(by_level)).withColumn("__level", left / F.sum("weight").over(after))
    fits = F.col("__level") <= cap / F.col("weight")
    level = F.min(F.when(fits, F.struct("__place", "__level"))).over(everything)["__level"]
    target = F.least(cap.cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return sums.select(source_col, "source_size", "weight", target.alias("target"))


def with_copies(df: DataFrame, size_col: str = "size", source_col: str = "source", id_col: str = "doc_id", seed: str = SEED, **options) -> DataFrame:
    """``df`` with source_size, weight, target, ``copies`` int: how often the mix takes each row.

    ``size_col`` must be there (``word_count``). Null sources are one source, null ids draw as one
    id, rows of the same id and source draw alike, sources without words get no copies. Columns of
    these names are replaced, so none of them may be ``size_col``, ``source_col`` or ``id_col``, and
    names that begin with ``__`` must not occur.
    """
    made = ("source_size", "weight", "target", "copies")
    if clash := [c for c in (size_col, source_col, id_col) if c in made]:
        raise ValueError(f"{clash[0]} is a column that the mix makes")
    if clash := [c for c in df.columns if c in ("__source", "__rate", "__copy")]:
        raise ValueError(f"{clash[0]} is a name that the mix uses")
    df = df.drop(*made)
    found = common.written(targets(df, source_col, size_col, **options), "targets")
    many = found.count()
    found = found.withColumnRenamed(source_col, "__source")
    joined = df.join(F.broadcast(found) if many <= BROADCAST_SOURCES else found, F.col(source_col).eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.concat(F.lit(seed + "|"), F.coalesce(F.col(source_col), F.lit("")), F.lit("|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return joined.withColumn("__rate", rate).withColumn("copies", (F.floor("__rate") + F.when(drawn < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)).cast("int")).drop("__rate")


def emit(df: DataFrame) -> DataFrame:
    """Each row ``copies`` times; ``copies`` goes."""
    return df.where(F.col("copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__copy", "copies")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: what the mix takes of each document."""
    sized = common.written(common.documents(spark, sf_dir).select("doc_id", "source", word_count().alias("size")), "sizes")
    mixed = with_copies(sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, row_number() OVER w AS place,
         (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
         / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM s WINDOW w AS (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), source NULLS LAST)
), t AS (
  SELECT source, source_size,
         least(CAST(2 * source_size AS DOUBLE), weight * (SELECT arg_min(level, place) FROM l WHERE level <= 2 * source_size / CAST(weight AS DOUBLE))) AS target
  FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('{SEED}|' || coalesce(d.source, '') || '|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS drawn
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(floor(rate) AS INTEGER) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM r
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies FROM c
"""
