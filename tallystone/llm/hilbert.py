"""Sharding along a Hilbert curve (operator 2).

Several metadata columns are quantised to ``bits`` bits each, the cells are put in the order of the
Hilbert curve, and the rows in that order are cut into runs of equal counts. Neighbours on the curve
are near in every dimension, so each shard spans a small box and a filter on any of the dimensions
skips most shards.

DataFrame functions only. The exact position of a row comes without a global sort: a histogram of
the cells (at most 2**(bits x dimensions) rows, whatever the input) gives each cell's first
position; rows of a cell are spread by the hash of all their columns over buckets of about
``bucket_rows``, whose counts give the bucket's first position; ``row_number`` does the rest within a
bucket. The query shuffles ids and sizes, never texts, and no cell is too large, as it has buckets in
proportion to its rows; repeated or missing ids don't matter, unless rows are equal in all columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm import common

SHARDS = 40
BITS = 5
BUCKET_ROWS = 8192
LAW = "rows"


@dataclass(frozen=True)
class Dimension:
    """A metadata column. kind: ``string`` (order-preserving), ``log`` (integers, quarter octaves)
    or ``linear`` (integers). Null has cell 0 of its own; negative logs count as 0."""

    column: str
    kind: str


DIMENSIONS = (Dimension("source", "string"), Dimension("lang", "string"), Dimension("n_chars", "log"))


def _raw(dim: Dimension, skip: int = 0) -> Column:
    """A whole number below 2**48 (linear: any) in the order of the column."""
    c = F.col(dim.column)
    if dim.kind == "string":
        digits = F.substring(F.hex(F.encode(c.cast("string"), "UTF-8")), 1 + 2 * skip, 12)
        return F.conv(F.rpad(digits, 12, "0"), 16, 10).cast("long")
    if dim.kind == "log":
        y = F.greatest(c.cast("long"), F.lit(0)) + 1
        exponent = F.length(F.bin(y)) - 1
        # Two more bits below the leading one; small numbers are widened first.
        quarter = F.expr(f"shiftright(shiftleft(greatest(cast(`{dim.column}` as bigint), 0) + 1, 2), length(bin(greatest(cast(`{dim.column}` as bigint), 0) + 1)) - 1)")
        return (exponent * 4 + quarter.bitwiseAND(3)).cast("long")
    return c.cast("long")


def _common_prefix(a: str, b: str) -> int:
    x, y = a.encode(), b.encode()
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n


def quantised(df: DataFrame, dims: Sequence[Dimension], bits: int) -> list[Column]:
    """A column from 0 to 2**bits - 1 for each dimension; null: 0. One aggregate finds the ranges."""
    ends = df.agg(*[f(F.col(d.column).cast("string") if d.kind == "string" else F.col(d.column).cast("long")).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for i, d in enumerate(dims):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None:
            out.append(F.lit(0).cast("long"))
            continue
        skip = _common_prefix(lo, hi) if d.kind == "string" else 0
        first, last = _plain(d, lo, skip), _plain(d, hi, skip)
        # A string's code is below 2**48, so its product fits a long; linear ranges may not.
        wide = "decimal(20,0)" if d.kind == "linear" else "long"
        part = F.call_function("div", (_raw(d, skip).cast(wide) - F.lit(first).cast(wide)) * F.lit(2**bits - 1).cast("decimal(5,0)" if d.kind == "linear" else "long"), F.lit(last - first + 1).cast("decimal(20,0)" if d.kind == "linear" else "long"))
        out.append(F.when(F.col(d.column).isNull(), 0).otherwise(1 + part).cast("long"))
    return out


def _plain(dim: Dimension, value, skip: int) -> int:
    """``_raw`` of one value, on the driver."""
    if dim.kind == "string":
        return int(value.encode().hex()[2 * skip :][:12].ljust(12, "0"), 16)
    if dim.kind == "log":
        y = max(int(value), 0) + 1
        e = y.bit_length() - 1
        return 4 * e + ((y << 2) >> e & 3)
    return int(value)


def with_curve(df: DataFrame, codes: Sequence[Column], bits: int, name: str = "curve") -> DataFrame:
    """``df`` with the position of a cell on the Hilbert curve, by Skilling's transposition in array
    functions. Each step is a projection of its own, so nothing is evaluated twice."""
    n, zero = len(codes), F.lit(0).cast("long")
    turns = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        p, xi, x0 = s["q"] - 1, F.element_at(x, s["i"] + 1), F.element_at(x, 1)
        swap = x0.bitwiseXOR(xi).bitwiseAND(p)
        inverted = xi.bitwiseAND(s["q"]) != 0
        # For dimension 0 itself the swap is of equal numbers, so nothing changes.
        change = lambda j: F.when(inverted, F.when(j == 0, p).otherwise(zero)).otherwise(F.when((j == 0) | (j == s["i"]), swap).otherwise(zero))
        return F.transform(x, lambda v, j: v.bitwiseXOR(change(j)))

    x = F.array(*[c.cast("long") for c in codes])
    df = df.withColumn("__x", F.aggregate(turns, x, turn) if bits > 1 else x)
    df = df.withColumn("__x", F.transform("__x", lambda v, j: F.aggregate(F.slice("__x", 1, j + 1), zero, lambda a, b: a.bitwiseXOR(b))))
    masks = [F.when(F.element_at("__x", n).bitwiseAND(1 << b) != 0, (1 << b) - 1).otherwise(0).cast("long") for b in range(bits - 1, 0, -1)]
    df = df.withColumn("__flip", reduce(lambda a, b: a.bitwiseXOR(b), masks, zero))
    digits = [F.shiftleft(F.shiftright(F.element_at("__x", i + 1).bitwiseXOR(F.col("__flip")), b).bitwiseAND(1), b * n + n - 1 - i) for b in range(bits) for i in range(n)]
    return df.withColumn(name, reduce(lambda a, b: a.bitwiseOR(b), digits)).drop("__x", "__flip")


def with_position(df: DataFrame, key: Sequence[str], dims: Sequence[Dimension] = DIMENSIONS, bits: int = BITS, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """``df`` with ``curve`` (index of the row's cell) and ``position`` (0 to n - 1 along the
    curve), and n. Within a cell, rows follow a hash of ``key`` and then ``key``.

    Nulls are a cell of their own in each dimension; repeated rows take neighbouring positions. Other
    columns named ``curve`` or ``position`` are replaced, but dimensions and keys must not have these
    names, nor any column one that begins with ``__``.
    """
    if clash := [c for c in [*key, *(d.column for d in dims)] if c in ("curve", "position", "shard", "slot")]:
        raise ValueError(f"{clash[0]} is a column that sharding makes")
    if bits * len(dims) > 16:
        raise ValueError("bits x dimensions must be at most 16: the histogram of cells is broadcast")
    df = df.drop("curve", "position")
    codes = quantised(df, dims, bits)
    cell = reduce(lambda a, b: a * (1 << bits) + b, codes)
    keyed = df.withColumn("__cell", cell)
    parts = F.array(*[F.shiftright("__cell", bits * (len(dims) - 1 - i)).bitwiseAND((1 << bits) - 1) for i in range(len(dims))])
    cells = keyed.groupBy("__cell").agg(F.count(F.lit(1)).alias("__rows")).withColumn("__parts", parts)
    cells = common.written(with_curve(cells, [F.col("__parts")[i] for i in range(len(dims))], bits).drop("__parts"), "cells")
    n = cells.agg(F.sum("__rows")).first()[0] or 0
    # Bounded: one row for each of at most 2**16 cells.
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("__first", before).withColumn("__buckets", F.ceil(F.col("__rows") / bucket_rows))
    hashed = [f.name for f in df.schema.fields if f.name not in key and "map<" not in f.dataType.simpleString()]
    bucket = F.pmod(F.xxhash64(*key, *hashed), F.col("__buckets"))
    dealt = keyed.join(F.broadcast(cells.drop("__rows")), "__cell").withColumn("__bucket", bucket)
    counts = dealt.groupBy("__cell", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    inner = F.coalesce(F.sum("__n").over(Window.partitionBy("__cell").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("__cell", "__bucket", inner.alias("__inner"))
    within = F.row_number().over(Window.partitionBy("__cell", "__bucket").orderBy(*[F.col(k).asc_nulls_first() for k in key])) - 1
    placed = dealt.join(firsts, ["__cell", "__bucket"]).withColumn("position", F.col("__first") + F.col("__inner") + within)
    return placed.drop("__cell", "__bucket", "__buckets", "__first", "__inner"), n


def shard(df: DataFrame, key: Sequence[str], shards: int = SHARDS, **options) -> DataFrame:
    """``df`` with curve, position, ``shard`` int and ``slot`` long: runs along the curve whose
    counts are at most one apart. An empty table gives an empty one."""
    placed, n = with_position(df.drop("shard", "slot"), key, **options)
    number = F.floor(F.col("position") * shards / F.lit(max(n, 1))) if n < 1 else F.expr(f"(position * {shards}) div {n}")
    first = F.expr(f"(shard * cast({n} as bigint) + {shards - 1}) div {shards}")
    return placed.withColumn("shard", number.cast("int")).withColumn("slot", F.col("position") - first)


def write_shards(df: DataFrame, path: str, key: Sequence[str], dims: Sequence[Dimension] = DIMENSIONS, shards: int = SHARDS, **options) -> DataFrame:
    """Write one folder ``shard=k`` per shard, rows in slot order, and return the manifest: shard,
    n and for each dimension min_<column> and max_<column>. An empty table gives an empty folder and
    manifest."""
    placed = shard(df, key, shards, dims=dims, **options)
    placed.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), *[f(d.column).alias(f"{name}_{d.column}") for d in dims for name, f in (("min", F.min), ("max", F.max))])


def pruned(manifest: DataFrame, **ranges: tuple) -> DataFrame:
    """Shards that may hold rows whose columns lie in the given closed ranges."""
    return manifest.where(reduce(lambda a, b: a & b, [(F.col(f"min_{c}") <= hi) & (F.col(f"max_{c}") >= lo) for c, (lo, hi) in ranges.items()], F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents in 40 shards along the curve of source, language and length."""
    size = (common.utf8_size() + 16).alias("size")
    rows = common.documents(spark, sf_dir).select("doc_id", size, F.crc32(common.text_or_empty().cast("binary")).alias("text_crc32"), *[d.column for d in DIMENSIONS])
    placed = shard(rows, ["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
