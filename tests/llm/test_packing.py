import itertools
import zlib

import numpy as np
import pytest
from odd_rows import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallystone.llm import packing, tokens


def fewest(lengths, capacity):
    """Bins of the best packing, by search."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= lengths[i]:
                place(i + 1, bins[:k] + [bins[k] - lengths[i]] + bins[k + 1 :])
        place(i + 1, bins + [capacity - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_is_never_above_the_best(lengths):
    assert packing.lower_bound(np.array(lengths), 20) <= fewest(lengths, 20)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60))
def test_best_fit_decreasing_by_hand(lengths):
    bins, offsets, n = packing.best_fit_decreasing(np.array(lengths), 50)
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length and r > 0]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(50 - length)
    assert n == len(rooms)
    for b in range(n):
        at = sorted((o, length) for o, length, k in zip(offsets.tolist(), lengths, bins.tolist(), strict=True) if k == b)
        assert all(o == s for (o, _), s in zip(at, itertools.accumulate([0] + [x for _, x in at]), strict=False))
        assert sum(x for _, x in at) <= 50


def test_bound_beats_the_sum():
    assert packing.lower_bound(np.array([6] * 5), 10) == 5
    assert packing.lower_bound(np.array([4, 4, 4, 4]), 10) == 2
    assert packing.lower_bound(np.array([34] * 6), 100) == 3


def placed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_groups_exchange_open_bins(spark):
    df = spark.range(3000).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(70)) + 1).cast("long").alias("length"))
    rows = packing.pack(df, "length", 100, group_rows=50).collect()
    assert len(rows) == 3000
    n = placed(rows, 100)
    alone = packing.pack(df, "length", 100, group_rows=50, rounds=0).select("sequence_id").distinct().count()
    least = -(-sum(r.length for r in rows) // 100)
    assert least <= n < alone


def test_documents_of_odd_rows(spark, odd, none):
    pieces = packing.pack_documents(odd, capacity=64)
    rows = pieces.collect()
    placed(rows, 64)
    encode = tokens.encoder().encode_one
    want = []
    for i, t, *_ in ODD:
        ids = [*encode(t or ""), packing.END_ID]
        want += [(i if i is not None else -1, k // 64, k, ids[k : k + 64]) for k in range(0, len(ids), 64)]
    got = [(r.doc_id if r.doc_id is not None else -1, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows]
    assert sorted(got) == sorted(want)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 for r in rows)
    whole = packing.sequences(pieces).collect()
    assert sum(r.length for r in whole) == sum(len(ids) for *_, ids in want)
    assert all(len(r.ids) == 4 * r.length <= 256 for r in whole)
    assert packing.pack_documents(none).count() == 0


def test_clashing_names_and_null_lengths(spark):
    df = spark.createDataFrame([(1, 5, "x", "y"), (2, None, "x", "y"), (3, 0, "x", "y")], "id int, length long, sequence_id string, certified string")
    rows = packing.pack(df, "length", 10).collect()
    assert sorted((r.id, r.length, r.offset) for r in rows) == [(1, 5, 0), (2, 0, 5), (3, 0, 5)]


def test_query_reaches_the_bound(spark):
    rows = packing.query(spark, "/root/testdata/sf0.001").collect()
    n = placed(rows, packing.CAPACITY)
    assert n == packing.lower_bound(np.array([r.length for r in rows]), packing.CAPACITY)
    for r in rows:
        assert r.length == packing.CAPACITY or r.start + r.length == max(q.start + q.length for q in rows if q.doc_id == r.doc_id)


@pytest.mark.parametrize("bad", [1 << 20])
def test_group_limit(spark, bad):
    with pytest.raises(ValueError, match="group_rows"):
        packing.pack(spark.range(1).withColumn("length", F.lit(1)), group_rows=bad)


def test_exchange_goes_on_while_it_saves_bins(spark):
    df = spark.range(3000).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(70)) + 1).cast("long").alias("length"))
    rows = packing.pack(df, "length", 100, group_rows=8).collect()
    assert sorted(r.id for r in rows) == list(range(3000))
    three = packing.pack(df, "length", 100, group_rows=8, rounds=3).select("sequence_id").distinct().count()
    assert placed(rows, 100) < three


def test_closed_groups_stay_and_gaps_exchange(spark):
    # The first group of each table is the one of round 0; its certificate is exact for these lengths.
    df = spark.range(2000).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(60)) + 20).cast("long").alias("length"))
    alone = {r.id: (r.sequence_id, r.offset, r.certified) for r in packing.pack(df, "length", 100, group_rows=40, rounds=0).collect()}
    fill = {}
    for r in packing.pack(df, "length", 100, group_rows=40, rounds=0).collect():
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    once = {r.id: (r.sequence_id, r.offset, r.certified) for r in packing.pack(df, "length", 100, group_rows=40, rounds=1).collect()}
    certified = {i for i, (_, _, c) in alone.items() if c}
    full = {i for i, (s, _, _) in alone.items() if fill[s] == 100}
    assert certified - full and set(alone) - certified - full
    moved = {i for i in alone if once[i][:2] != alone[i][:2]}
    assert moved == set(alone) - certified - full


def test_bound_over_open_bins_of_certified_groups(spark):
    # Each group is certified, and only together they need fewer bins.
    df = spark.range(64).select(F.col("id"), F.lit(25).cast("long").alias("length"))
    alone = packing.pack(df, "length", 100, group_rows=16, rounds=0).collect()
    assert all(r.certified for r in alone) and placed(alone, 100) > 16
    rows = packing.pack(df, "length", 100, group_rows=16).collect()
    assert placed(rows, 100) == 16
    exact = spark.range(64).select(F.col("id"), F.lit(51).cast("long").alias("length"))
    rows = packing.pack(exact, "length", 100, group_rows=8).collect()
    assert placed(rows, 100) == 64 and all(r.sequence_id < packing.MOST_GROUPS << packing.GROUP_BITS for r in rows)


def test_sequence_numbers_stay_apart():
    most = (1 << packing.GROUP_BITS) - 1
    first = packing.sequence_ids(0, (1 << 20) + 5, np.array([0, most]))
    assert first.max() < packing.sequence_ids(0, (1 << 20) + 6, np.array([0]))[0]
    assert packing.sequence_ids(0, packing.MOST_GROUPS - 1, np.array([most]))[0] < packing.sequence_ids(1, 0, np.array([0]))[0]
    assert 0 < packing.sequence_ids(packing.MOST_ROUNDS - 1, packing.MOST_GROUPS - 1, np.array([most]))[0] == 2**63 - 1


def test_length_above_capacity_is_an_error(spark):
    with pytest.raises(Exception, match="above the capacity of 10"):
        packing.pack(spark.createDataFrame([(1, 11)], "id int, length long"), "length", 10).collect()


def test_query_pieces_equal_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    encode = tokens.encoder().encode_one
    want = []
    for i, t in docs.items():
        ids = [*encode(t or ""), 1]
        want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.query(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want)
