"""Records, index blocks and run lists against their writers, and against damage."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallystone.sources import file_records as fr

NAMES = st.text(st.characters(codec="utf-16-le"), min_size=1, max_size=20)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2**40), st.one_of(st.none(), st.integers(-(2**50), 2**50))), max_size=20))
def test_run_lists(runs):
    assert fr.run_list(fr.encoded_runs(runs)) == runs
    assert fr.run_list(fr.encoded_runs(runs) + b"rest") == runs


def test_published_run_list():
    # 0x18 clusters at 0x5634, then a step back.
    assert fr.run_list(bytes.fromhex("211834562128eef800")) == [(0x18, 0x5634), (0x28, 0xF8EE - 0x10000)]


@pytest.mark.parametrize("data", ["21", "2118", "0001", "1100", "01", "9118", "1900000000000000000001"])
def test_damaged_run_lists(data):
    data = bytes.fromhex(data)
    if data[:1] == b"\0":
        assert fr.run_list(data) == []
    else:
        with pytest.raises(fr.RecordError):
            fr.run_list(data)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 65535), st.integers(0, 3), st.lists(st.tuples(st.integers(0, 2**48 - 1), st.integers(0, 65535), st.integers(0, 3), NAMES), max_size=3), st.one_of(st.none(), st.integers(0, 2**62)), st.lists(st.tuples(st.integers(1, 2**48 - 1), st.integers(0, 65535), NAMES), max_size=5))
def test_records(sequence, flags, names, size, children):
    block = fr.written_record(sequence, flags, names, size, children, [(3, 9), (1, -2)])
    got = fr.record_of(block)
    assert (got.sequence, got.in_use, got.is_directory, got.size) == (sequence, bool(flags & 1), bool(flags & 2), size or 0)
    assert (got.names, got.index, got.index_block, got.index_runs) == (names, children, 4096, [(3, 9), (1, -2)])
    for k in range(1, len(block) // fr.SECTOR + 1):
        torn = bytearray(block)
        torn[k * fr.SECTOR - 1] ^= 1
        with pytest.raises(fr.RecordError, match="torn"):
            fr.record_of(bytes(torn))


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_damage_is_an_error_or_a_record(data):
    block = bytearray(fr.written_record(1, 3, [(5, 5, 1, "name")], 10, [(7, 1, "child")], [(3, 9)]))
    for _ in range(data.draw(st.integers(1, 6))):
        at = data.draw(st.integers(0, len(block) - 1))
        if at % fr.SECTOR < fr.SECTOR - 2:
            block[at] = data.draw(st.integers(0, 255))
    try:
        assert isinstance(fr.record_of(bytes(block)), fr.Record)
    except fr.RecordError:
        pass


def test_blocks(spark):
    children = [(i, i % 9, f"child {i}") for i in range(1, 30)]
    block = fr.written_block(children)
    torn = bytearray(block)
    torn[1023] ^= 1
    rows = [(1, bytearray(block)), (2, bytearray(4096)), (3, torn), (4, None), (5, bytearray(b"FILE" + block[4:])), (6, bytearray(fr.written_block([])))]
    got = {r.parent: r for r in fr.block_children(spark.createDataFrame(rows, "parent long, data binary")).collect()}
    assert [tuple(c) for c in got[1].children] == children
    assert all(got[k].children == [] and got[k].error is None for k in (2, 4, 6))
    assert "torn" in got[3].error and "INDX" in got[5].error


def test_a_dump_as_a_tree(spark):
    root = fr.written_record(5, 3, [(5, 5, 3, ".")], children=[(30, 1, "a"), (31, 9, "gone")])
    rows = [
        (5, root),
        (30, fr.written_record(1, 3, [(5, 5, 1, "a")], children=[])),
        (31, fr.written_record(2, 1, [(5, 5, 1, "reused.txt")], 4)),
        (32, fr.written_record(1, 1, [(30, 1, 2, "LONGNA~1.TXT"), (30, 1, 1, "long name.txt")], 77)),
        (33, fr.written_record(1, 0, [(30, 1, 1, "deleted")], 3)),
        (34, fr.written_record(1, 1, [(30, 1, 3, "in block")], 8)),
        (3, fr.written_record(1, 1, [(5, 5, 3, "$Volume")], 1)),
        (40, b"BAAD" + bytes(1020)),
    ]
    found = fr.parsed(spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "record long, data binary"))
    blocks = fr.block_children(spark.createDataFrame([(30, bytearray(fr.written_block([(34, 1, "in block")])))], "parent long, data binary"))
    entries, bad = fr.tree_of(found, blocks, 5)
    assert sorted((r.relative_path, r.size, r.is_directory) for r in entries.collect()) == [("a", 0, True), ("a\\in block", 8, False), ("a\\long name.txt", 77, False), ("reused.txt", 4, False)]
    assert sorted((r.parent, r.record, r.error) for r in bad.collect() if r.parent) == [(5, 31, "no live record")]
    assert [(r.record, r.error) for r in bad.collect() if not r.parent] == [(40, "no FILE block")]
    none = fr.parsed(spark.createDataFrame([], "record long, data binary"))
    assert none.count() == 0 and fr.block_children(spark.createDataFrame([], "parent long, data binary")).count() == 0


def test_values_beyond_a_long_are_damage(spark):
    block = bytearray(fr.written_record(1, 1, [(5, 5, 1, "f")], 123456))
    at = bytes(block).index((123456).to_bytes(8, "little"))  # the allocated size; the real one follows
    block[at + 15] = 0x80
    runs = fr.written_record(1, 3, [(5, 5, 1, "d")], children=[], index_runs=[(2**63, 1)])
    rows = [(1, block), (2, bytearray(runs)), (3, bytearray(1024)), (4, None)]
    got = {r.record: r for r in fr.parsed(spark.createDataFrame(rows, "record long, data binary")).collect()}
    assert "size" in got[1].error and "run" in got[2].error and got[4].error
    assert got[3].error is None and not got[3].in_use


def test_times_and_attributes():
    got = fr.record_of(fr.written_record(1, 1, [(5, 5, 1, "f")], 7, last_write_time=133_000_000_000_000_000))
    assert (got.last_write_time, got.attributes, got.size) == (133_000_000_000_000_000, 0, 7)


def test_a_reference_of_0_is_not_written():
    with pytest.raises(ValueError, match="reference of 0"):
        fr.written_block([(0, 0, "a")])
    assert fr.index_entries(fr.unfixed(fr.written_block([(0, 1, "a")]), fr.INDX)[24:]) == [(0, 1, "a")]
