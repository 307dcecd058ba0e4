"""Best-fit packing with certified bounds (operator 6).

Documents become token pieces of at most ``capacity`` ids. Pieces are dealt into groups of bounded
size, and best-fit decreasing packs each group. A lower bound from dual-feasible functions
certifies a group whose bin count reaches it: such a group is closed. Groups with a gap give up their
bins that hold free room; the pieces of these meet in new groups, and best-fit decreasing runs
again, as long as there are gaps and this saves bins. Only then the same bound, over the pieces of
all open bins together, tells whether open bins of certified groups could be saved too: each group
alone may need its last bin, and all of them together fewer. Where it says so, they meet as well; at
the bound, nothing is moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm import common, tokens

CAPACITY = 4096
END_ID = 1
#: Pieces in a group: what one task packs at once.
GROUP_ROWS = 20_000
#: A sequence's number is its round, group and bin: 10, 33 and 20 bits.
MOST_ROUNDS, MOST_GROUPS, GROUP_BITS = 1 << 10, 1 << 33, 20
ADDED = ("sequence_id", "offset", "certified")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual-feasible functions over the lengths' histogram.

    Every function f maps fractions of a bin to fractions of a bin so that any set that fits still
    fits; then no packing has fewer than ceil(sum f) bins. Used are the step functions
    u_k(x) = floor((k+1)x)/k (x itself where (k+1)x is whole) for k = 1..8, after the cut-offs
    that round lengths above capacity - e up to a full bin and those below e down to none.
    All sums are whole numbers, so no rounding weakens the certificate.
    """
    return histogram_bound(np.bincount(lengths, minlength=capacity + 1), capacity)


def histogram_bound(count: np.ndarray, capacity: int) -> int:
    """``lower_bound`` from the number of pieces of each length from 0 to ``capacity``."""
    count = count.astype(np.int64)[: capacity + 1]
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    cuts = np.arange(0, capacity // 2 + 1)
    above = np.cumsum(count[::-1])[::-1]
    full = np.array([above[capacity - e + 1] if e else 0 for e in cuts])  # longer than capacity - e
    for k in range(0, 9):
        if k == 0:
            unit, value = capacity, x
        else:
            whole = (k + 1) * x % capacity == 0
            unit, value = k * capacity, np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        run = np.concatenate(([0], np.cumsum(count * value)))
        inner = run[capacity - cuts + 1] - run[cuts]  # e <= x <= capacity - e
        best = max(best, int((full - (-inner // unit)).max()))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins. Ties: earlier rows first.

    Open bins are stacked by free room; a whole number with a bit for each non-empty stack finds
    the fullest bin that still takes a piece.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bits, n_bins = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_bits >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            stack = stacks[room]
            at = stack.pop()
            if not stack:
                open_bits ^= 1 << room
        else:
            room, at, n_bins = capacity, n_bins, n_bins + 1
        bins[i], offsets[i] = at, capacity - room
        room -= n
        if room:
            if not stacks[room]:
                open_bits |= 1 << room
            stacks[room].append(at)
    return bins, offsets, n_bins


def sequence_ids(round_: int, group: int, bins: np.ndarray) -> np.ndarray:
    return (round_ * MOST_GROUPS + group << GROUP_BITS) + bins.astype(np.int64)


def _packer(length_col: str, capacity: int, fields: list[str], round_: int):
    def pack_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__pid", "ascending")])
        lengths = table[length_col].to_numpy().astype(np.int64)
        group = table["__group"][0].as_py()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        certified = n == lower_bound(lengths, capacity)
        ids = sequence_ids(round_, group, bins)
        added = {"sequence_id": ids, "offset": offsets, "certified": np.full(len(bins), certified), "__room": capacity - fill[bins]}
        table = table.select(fields)
        for name, values in added.items():
            table = table.append_column(name, pa.array(values))
        return table

    return pack_group


def pack(df: DataFrame, length_col: str = "length", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, rounds: int | None = None) -> DataFrame:
    """Pack rows of ``length_col`` tokens into sequences of at most ``capacity``.

    Returns the rows with ``sequence_id`` long, ``offset`` long (gapless from 0 within a sequence)
    and ``certified`` boolean (the group that packed the row needs no bin fewer). Same-named
    columns of the input are replaced. Lengths must be whole numbers up to ``capacity``: a longer one
    raises an error while rows are read; null, 0 and negative ones are packed as rows of no length at
    the end of a sequence of their group. Repeated rows are packed each. An empty table gives an
    empty one. ``rounds`` bounds the exchanges; None goes on while they save bins.
    """
    if group_rows >= 1 << GROUP_BITS:
        raise ValueError("group_rows must be below 2**20")
    length = F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0)).cast("long")
    df = df.drop(*ADDED, "__pid", "__group", "__room").withColumn(length_col, F.when(length > capacity, F.raise_error(F.lit(f"a length is above the capacity of {capacity}"))).otherwise(length))
    fields = df.columns + ["__pid"]
    todo = common.written(df.withColumn("__pid", F.monotonically_increasing_id()), "pack-in")
    schema = T.StructType([*todo.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("certified", T.BooleanType()), T.StructField("__room", T.LongType())])

    def packed_once(rows: DataFrame, n: int, round_: int) -> DataFrame:
        groups = min(max(1, -(-n // group_rows)), MOST_GROUPS)
        dealt = rows.withColumn("__group", F.pmod(F.xxhash64("__pid", F.lit(round_)), F.lit(groups)))
        return common.written(dealt.groupBy("__group").applyInArrow(_packer(length_col, capacity, fields, round_), schema), f"packed-{round_}")

    def bins(rows: DataFrame) -> int:
        return rows.agg(F.count_distinct("sequence_id")).first()[0]

    def bound(rows: DataFrame) -> int:
        # One row for each length: bounded by the capacity.
        count = np.zeros(capacity + 1, np.int64)
        for r in rows.groupBy(length_col).count().toLocalIterator():
            count[r[0]] = r[1]
        return histogram_bound(count, capacity)

    tables = [packed_once(todo, todo.count(), 0)]
    common.drop_scratch(todo)
    round_, last = 0, MOST_ROUNDS - 1 if rounds is None else min(rounds, MOST_ROUNDS - 1)
    for among in (~F.col("certified"), F.lit(True)):  # gaps first, then open bins of all groups
        moved = (F.col("__room") > 0) & among
        kept, fresh = [], tables  # only the fresh tables hold bins to move
        while round_ < last:
            given = reduce(DataFrame.unionByName, fresh).where(moved)
            total = given.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sequence_id").alias("bins")).first()
            if not total.n or total.bins <= bound(given):
                break
            round_ += 1
            again = packed_once(given.select(*fields), total.n, round_)
            if bins(again) >= total.bins:
                common.drop_scratch(again)
                break
            # A sequence is given up whole, as its pieces have the same room and group.
            kept += [t.where(~moved) for t in fresh]
            fresh = [again]
        tables = kept + fresh
    return reduce(DataFrame.unionByName, tables).drop("__pid", "__room")


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = tokens.DEFAULT_VOCABULARY, with_ids: bool = True) -> DataFrame:
    """Tokens of each whole text (null: empty) and ``end_id``, cut only where a document is longer
    than ``capacity``: ``id_col``, piece int, start long, length long, ids_crc32 long (unsigned,
    little-endian unsigned 32-bit ids) and, with ``with_ids``, ids binary (the same bytes).
    Documents of the same id stay apart rows. Other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        for batch in common.slices(batches):
            ids, offsets = encode(batch.column(1))
            n = batch.num_rows
            out = np.empty(len(ids) + n, np.uint32)
            ends = offsets[1:] + np.arange(n)
            keep = np.ones(len(out), bool)
            keep[ends] = False
            out[keep], out[ends] = ids, end_id
            begin = np.concatenate(([0], ends[:-1] + 1))
            total = ends + 1 - begin
            pieces = -(-total // capacity)
            doc = np.repeat(np.arange(n), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, total[doc] - start)
            first = begin[doc] + start
            raw = memoryview(out.astype("<u4", copy=False)).cast("B")
            cut = [raw[4 * a : 4 * (a + b)] for a, b in zip(first.tolist(), length.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cut], pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([bytes(c) for c in cut], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def pack_documents(df: DataFrame, capacity: int = CAPACITY, with_ids: bool = True, **names) -> DataFrame:
    """``token_pieces`` and then ``pack``."""
    return pack(token_pieces(df, capacity=capacity, with_ids=with_ids, **names), "length", capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence: sequence_id, length long, ids binary (little-endian unsigned 32
    bit) and document_starts array<long>. A sequence is never longer than the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("parts.ids", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length")).select("sequence_id", "length", joined.alias("ids"), F.col("parts.offset").alias("document_starts"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: where each piece of each document lies."""
    return pack_documents(common.documents(spark, sf_dir), with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
