"""Record graphs of file tables, ingested as DataFrames: references, extents, children, chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.sources.scratch import fixed

#: Records up to this number whose name begins with ``$`` belong to the file system.
LAST_META_RECORD = 23
MOST_CHAIN = 16


def split_ref(ref: Column) -> tuple[Column, Column]:
    """Record number (48 bits) and sequence (16 bits) of a 64-bit reference."""
    return ref.bitwiseAND(0xFFFFFFFFFFFF), F.shiftrightunsigned(ref, 48)


def user_record(record: Column, name: Column) -> Column:
    return ~((record <= LAST_META_RECORD) & name.startswith("$"))


def extents(runs: DataFrame) -> DataFrame:
    """From (file, i, length, delta) in the order of i: file, i, vcn, lcn, length. Deltas are signed
    steps between the runs' first clusters."""
    own = Window.partitionBy("file").orderBy("i")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("file", "i", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("vcn"), F.sum("delta").over(own).cast("long").alias("lcn"), "length")


def containing_extent(points: DataFrame, of: DataFrame, width: int = 1024) -> DataFrame:
    """Points (file, cluster) with the extent that contains them and ``absolute``. Extents are listed
    under each block of ``width`` clusters that they touch, so the join is on equality."""
    blocks = of.withColumn("block", F.explode(F.sequence(F.expr(f"vcn div {width}"), F.expr(f"(vcn + length - 1) div {width}"))))
    inside = (F.col("cluster") >= F.col("vcn")) & (F.col("cluster") < F.col("vcn") + F.col("length"))
    return points.withColumn("block", F.expr(f"cluster div {width}")).join(blocks, ["file", "block"]).where(inside).withColumn("absolute", F.col("lcn") + F.col("cluster") - F.col("vcn")).drop("block")


def picked_names(names: DataFrame) -> DataFrame:
    """One name per record from (record, parent, space, name): namespace 1, then 3, 0, 2."""
    rank = F.element_at(F.create_map(*[F.lit(x) for p in ((1, 0), (3, 1), (0, 2), (2, 3)) for x in p]), F.col("space").cast("int"))
    return names.groupBy("record").agg(F.min_by(F.struct("parent", "space", "name"), F.struct(rank, F.col("name"))).alias("n")).select("record", "n.*")


def diagnostic_names(names: DataFrame) -> DataFrame:
    """One name per record from (record, i, parent, space, name), the way diagnostic tools choose: the
    last in the order of i of namespace 1 or 3, else the first of any. Equal i go by the other columns."""
    shown = F.col("space").isin(1, 3)
    row = F.struct("parent", "space", "name")
    place = F.struct("i", "parent", "space", "name")
    last, first = F.max_by(row, F.when(shown, place)), F.min_by(row, place)
    return names.groupBy("record").agg(F.coalesce(last, first).alias("n")).select("record", "n.*")


def children(index: DataFrame, parents: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(children, violations). ``index`` (parent, record, sequence) lists what directories name,
    ``parents`` (parent, record, sequence) what records say of their parent, ``records`` (record,
    sequence, in_use) what is live. The index wins; its entries without a live record of that
    sequence are violations."""
    live = records.where("in_use").select("record", "sequence")
    named = index.join(live, ["record", "sequence"], "left_semi").withColumn("origin", F.lit(0))
    violations = index.join(live, ["record", "sequence"], "left_anti")
    said = parents.join(live, ["record", "sequence"], "left_semi").withColumn("origin", F.lit(1))
    both = named.select("parent", "record", "origin").unionByName(said.select("parent", "record", "origin"))
    return both.groupBy("record").agg(F.min_by("parent", F.struct("origin", "parent")).alias("parent"), F.min("origin").alias("origin")), violations


def reverse_index(records: DataFrame) -> DataFrame:
    return records.groupBy("parent").agg(F.sort_array(F.collect_list("record")).alias("children"))


def walk(records: DataFrame, root, separator: str = "\\") -> DataFrame:
    """(record, depth, path) of all records (record, parent, name) below ``root``, level by level.
    A level is one join on the parent, written to the shared folder; it ends with the first empty
    level. No record is listed below itself, so cycles end too; a record of several parents is
    listed below each."""
    edges = fixed(records.where(F.col("record") != F.col("parent")).select("record", "parent", "name"), "walk-edges")
    first = edges.where(F.col("parent") == root)
    level = fixed(first.select("record", F.lit(1).alias("depth"), F.col("name").alias("path"), F.array("parent", "record").alias("__above")), "walk-1")
    levels = [level]
    while not level.isEmpty():
        up = level.select(F.col("record").alias("parent"), F.col("path").alias("__path"), "__above")
        below = edges.join(up, "parent").where(~F.array_contains("__above", F.col("record")))
        depth = len(levels) + 1
        level = fixed(below.select("record", F.lit(depth).alias("depth"), F.concat("__path", F.lit(separator), "name").alias("path"), F.concat("__above", F.array("record")).alias("__above")), f"walk-{depth}")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).select("record", "depth", "path")


def parent_chain(records: DataFrame, start: DataFrame, root, most: int = MOST_CHAIN) -> DataFrame:
    """(start, step, record, state) from each ``record`` of ``start`` up: LIVE, or STALE where the
    parent's record or sequence is not there. ``records``: record, sequence, parent,
    parent_sequence. It ends at ``root``, at a stale parent, or after ``most`` steps (cycles too)."""
    at = start.select(F.col("record").alias("start"), "record").join(records, "record")
    at = at.select("start", "record", "parent", "parent_sequence")
    known = records.select(F.col("record").alias("r"), F.col("sequence").alias("s"), F.col("parent").alias("p"), F.col("parent_sequence").alias("ps"))
    out = None
    for step in range(1, most + 1):
        above = at.where(F.col("record") != root).join(known, (F.col("parent") == F.col("r")) & (F.col("parent_sequence") == F.col("s")), "left")
        one = above.select("start", F.lit(step).alias("step"), F.col("parent").alias("record"), F.when(F.col("r").isNull(), "STALE").otherwise("LIVE").alias("state"))
        out = one if out is None else out.unionByName(one)
        at = above.where(F.col("r").isNotNull()).select("start", F.col("r").alias("record"), F.col("p").alias("parent"), F.col("ps").alias("parent_sequence"))
        if at.isEmpty():
            break
    return out
