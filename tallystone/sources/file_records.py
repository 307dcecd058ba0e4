"""File records of NTFS dumps as tables: bytes in, names, sizes, index entries and runs out.

A dump is a table of raw records (record number, 1 KB or so of bytes) and one of index blocks. Each is
decoded on its own, so executors work through Arrow batches of any dump; ``operators.records`` takes
the tables from there (name choice, children, extents, walks). What can't be decoded is a row with
``error``, never an exception. Raw volumes are not read here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.operators import records

# Fixed values of the format: signatures, attribute types and flags.
FILE, INDX = b"FILE", b"INDX"
TIMES, FILE_NAME, DATA, INDEX_ROOT, INDEX_ALLOCATION, END = 0x10, 0x30, 0x80, 0x90, 0xA0, 0xFFFFFFFF
IN_USE, DIRECTORY, LAST_ENTRY = 1, 2, 2
SECTOR = 512
#: Bytes of a name's fixed part, and of an index entry's and a record's header.
NAME_HEAD, ENTRY_HEAD, RECORD_HEAD = 66, 16, 48


class RecordError(ValueError):
    """Bytes that aren't a whole record or index block."""


def unfixed(block: bytes, signature: bytes) -> bytes:
    """``block`` with the last two bytes of each sector put back from its update sequence. A wrong
    signature, or a sector that doesn't end with the sequence number, is an error."""
    if block[:4] != signature or len(block) < 8 or len(block) % SECTOR:
        raise RecordError(f"no {signature.decode()} block")
    at, n = struct.unpack_from("<HH", block, 4)
    if n != len(block) // SECTOR + 1 or at % 2 or at + 2 * n > SECTOR - 2:
        raise RecordError("the update sequence has another size")
    number, out = block[at : at + 2], bytearray(block)
    for k in range(1, n):
        end = k * SECTOR
        if block[end - 2 : end] != number:
            raise RecordError(f"sector {k - 1} is torn")
        out[end - 2 : end] = block[at + 2 * k : at + 2 * k + 2]
    return bytes(out)


def run_list(data: bytes) -> list[tuple[int, int | None]]:
    """(length, signed step to the run's first cluster; None: no clusters) of each run, to the first
    zero byte. A run that is cut off, has no length, or more than a volume can have is an error."""
    out, at = [], 0
    while at < len(data) and data[at]:
        of_length, of_step = data[at] & 15, data[at] >> 4
        end = at + 1 + of_length + of_step
        length = int.from_bytes(data[at + 1 : at + 1 + of_length], "little")
        if end > len(data) or not 1 <= of_length <= 8 or of_step > 8 or not 0 < length < 1 << 63:
            raise RecordError("a run is damaged")
        out.append((length, int.from_bytes(data[at + 1 + of_length : end], "little", signed=True) if of_step else None))
        at = end
    return out


def name_of(value: bytes) -> tuple[int, int, int, str] | None:
    """(parent, its sequence, namespace, name) of a name attribute or an index key."""
    if len(value) < NAME_HEAD or len(value) < NAME_HEAD + 2 * value[64]:
        return None
    (ref,) = struct.unpack_from("<Q", value)
    return ref & 0xFFFFFFFFFFFF, ref >> 48, value[65], value[NAME_HEAD : NAME_HEAD + 2 * value[64]].decode("utf-16-le", "replace")


def index_entries(node: bytes) -> list[tuple[int, int, str | None]]:
    """(record, sequence, name) of the entries of an index node, which begins with its header. An
    entry whose reference is 0 names no file and is passed over."""
    if len(node) < 16:
        raise RecordError("an index node is cut off")
    at, end = struct.unpack_from("<II", node)
    if not 16 <= at < end <= len(node):
        raise RecordError("an index node's entries lie outside")
    out = []
    while at + ENTRY_HEAD <= end:
        ref, size, key, flags = struct.unpack_from("<QHHH", node, at)
        if flags & LAST_ENTRY:
            return out
        if size < ENTRY_HEAD + key or at + size > end:
            raise RecordError("an index entry is damaged")
        if ref:
            name = name_of(node[at + ENTRY_HEAD : at + ENTRY_HEAD + key])
            out.append((ref & 0xFFFFFFFFFFFF, ref >> 48, name and name[3]))
        at += size
    raise RecordError("an index node has no end")


@dataclass
class Record:
    sequence: int
    in_use: bool
    is_directory: bool
    size: int = 0
    last_write_time: int = 0
    attributes: int = 0
    names: list[tuple[int, int, int, str]] = field(default_factory=list)
    index: list[tuple[int, int, str | None]] = field(default_factory=list)
    index_block: int | None = None
    index_runs: list[tuple[int, int | None]] = field(default_factory=list)


def attributes(record: bytes, at: int) -> Iterator[tuple[int, bytes | None, bytes]]:
    """(type, value; None if it isn't resident, the whole attribute) of each unnamed attribute."""
    while at + 8 <= len(record):
        kind, size = struct.unpack_from("<II", record, at)
        if kind == END:
            return
        if size < 24 or at + size > len(record):
            raise RecordError("an attribute ends behind the record")
        whole = record[at : at + size]
        at += size
        if whole[8]:
            yield kind, None, whole
            continue
        length, offset = struct.unpack_from("<IH", whole, 16)
        if offset < 24 or offset + length > size:
            raise RecordError("a value ends behind its attribute")
        yield kind, whole[offset : offset + length], whole


def record_of(block: bytes) -> Record:
    """The record of ``block``; one without any bytes set was never in use."""
    if block and not any(block):
        return Record(0, False, False)
    data = unfixed(block, FILE)
    sequence, _, at, flags = struct.unpack_from("<HHHH", data, 16)
    if not RECORD_HEAD <= at <= len(data) - 8:
        raise RecordError("the attributes lie outside")
    out = Record(sequence, bool(flags & IN_USE), bool(flags & DIRECTORY))
    for kind, value, whole in attributes(data, at):
        if kind == TIMES and value is not None:
            if len(value) < 36:
                raise RecordError("the times are cut off")
            out.last_write_time, out.attributes = struct.unpack_from("<q16xI", value, 8)
        elif kind == FILE_NAME and value is not None:
            if (name := name_of(value)) and name[3]:
                out.names.append(name)
        elif kind == DATA and not whole[9]:  # streams with a name of their own aren't the file's size
            if value is None and len(whole) < 56:
                raise RecordError("an attribute is cut off")
            out.size = len(value) if value is not None else struct.unpack_from("<q", whole, 48)[0]
            if out.size < 0:
                raise RecordError("a size is above all volumes")
        elif kind == INDEX_ROOT and value is not None:
            if len(value) < 32:
                raise RecordError("an index root is cut off")
            out.index_block = struct.unpack_from("<I", value, 8)[0]
            out.index = index_entries(value[16:])
        elif kind == INDEX_ALLOCATION and value is None:
            out.index_runs = run_list(whole[struct.unpack_from("<H", whole, 32)[0] :])
    return out


_NAME = "struct<parent:bigint,parent_sequence:int,space:int,name:string>"
_CHILD = "struct<record:bigint,sequence:int,name:string>"
_RUN = "struct<length:bigint,step:bigint>"
RECORD_SCHEMA = f"record long, sequence int, in_use boolean, is_directory boolean, size long, names array<{_NAME}>, index array<{_CHILD}>, index_block long, index_runs array<{_RUN}>, last_write_time long, attributes long, error string"
_structs = lambda **kinds: pa.list_(pa.struct(list(kinds.items())))
_ARROW_NAMES = _structs(parent=pa.int64(), parent_sequence=pa.int32(), space=pa.int32(), name=pa.string())
_ARROW_CHILDREN = _structs(record=pa.int64(), sequence=pa.int32(), name=pa.string())
_ARROW_RUNS = _structs(length=pa.int64(), step=pa.int64())


def _dicts(rows: list[tuple], kind: pa.DataType) -> list[dict]:
    return [dict(zip([kind.value_type.field(i).name for i in range(kind.value_type.num_fields)], r, strict=True)) for r in rows]


def parsed(dump: DataFrame) -> DataFrame:
    """From (record long, data binary): ``RECORD_SCHEMA``. A record that can't be decoded has an
    ``error`` and no more. Null data is damaged data; repeated rows stay rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), _ARROW_NAMES, _ARROW_CHILDREN, pa.int64(), _ARROW_RUNS, pa.int64(), pa.int64(), pa.string()]
        names = ["record", "sequence", "in_use", "is_directory", "size", "names", "index", "index_block", "index_runs", "last_write_time", "attributes", "error"]
        for batch in batches:
            rows = []
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    r = record_of(data or b"")
                    rows.append((number, r.sequence, r.in_use, r.is_directory, r.size, _dicts(r.names, _ARROW_NAMES), _dicts(r.index, _ARROW_CHILDREN), r.index_block, _dicts(r.index_runs, _ARROW_RUNS), r.last_write_time, r.attributes, None))
                except (RecordError, struct.error) as e:
                    rows.append((number, *[None] * 10, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return dump.select(F.col("record").cast("long"), F.col("data").cast("binary")).mapInArrow(run, RECORD_SCHEMA)


def block_children(blocks: DataFrame) -> DataFrame:
    """From index blocks (parent long, data binary): parent, children array of (record, sequence, name)
    and error. A block without any bytes set is free and has no children; null data too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for data in batch.column(1).to_pylist():
                try:
                    found.append(_dicts(index_entries(unfixed(data, INDX)[24:]) if data and any(data) else [], _ARROW_CHILDREN))
                    errors.append(None)
                except (RecordError, struct.error) as e:
                    found.append([])
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW_CHILDREN), pa.array(errors, pa.string())], ["parent", "children", "error"])

    return blocks.select(F.col("parent").cast("long"), F.col("data").cast("binary")).mapInArrow(run, f"parent long, children array<{_CHILD}>, error string")


def tree_of(found: DataFrame, blocks: DataFrame, root: int, separator: str = "\\") -> tuple[DataFrame, DataFrame]:
    """(entries, violations) of ``parsed`` records and ``block_children``: record, path, size,
    is_directory, last_write_time and attributes of what lies below ``root``; what an index names without a live record, and damaged
    blocks and records, so that a caller can tell a scan that isn't complete."""
    live = found.where(F.col("error").isNull())
    names = live.where("in_use").select("record", F.explode("names").alias("n")).select("record", "n.*")
    index = live.where("in_use").select(F.col("record").alias("parent"), F.explode("index").alias("c")).unionByName(blocks.select("parent", F.explode("children").alias("c")))
    index = index.select("parent", F.col("c.record").alias("record"), F.col("c.sequence").alias("sequence"))
    said = names.join(live.select("record", "sequence"), "record").select("parent", "record", "sequence")
    kids, violations = records.children(index, said, live.select("record", "sequence", "in_use"))
    edges = kids.join(records.picked_names(names.select("record", "parent", "space", "name")).select("record", "name"), "record").where(records.user_record(F.col("record"), F.col("name")))
    walked = records.walk(edges.select("record", "parent", "name"), root, separator)
    entries = walked.join(live.select("record", "size", "is_directory", "last_write_time", "attributes"), "record").select("record", F.col("path").alias("relative_path"), F.when(F.col("is_directory"), 0).otherwise(F.col("size")).cast("long").alias("size"), "is_directory", "last_write_time", "attributes")
    bad = violations.select("parent", "record", F.lit("no live record").alias("error"))
    bad = bad.unionByName(blocks.where(F.col("error").isNotNull()).select("parent", F.lit(None).cast("long").alias("record"), "error"))
    return entries, bad.unionByName(found.where(F.col("error").isNotNull()).select(F.lit(None).cast("long").alias("parent"), "record", "error"))


# --- writers, for tests and queries --------------------------------------------------------------


def fixed_up(block: bytes, at: int, number: int = 7) -> bytes:
    """The inverse of ``unfixed``: the update sequence goes to ``at``."""
    out, mark = bytearray(block), struct.pack("<H", number)
    n = len(block) // SECTOR + 1
    struct.pack_into("<HH", out, 4, at, n)
    out[at : at + 2] = mark
    for k in range(1, n):
        out[at + 2 * k : at + 2 * k + 2] = block[k * SECTOR - 2 : k * SECTOR]
        out[k * SECTOR - 2 : k * SECTOR] = mark
    return bytes(out)


def encoded_runs(runs: list[tuple[int, int | None]]) -> bytes:
    out = bytearray()
    for length, step in runs:
        a = length.to_bytes(length.bit_length() // 8 + 1, "little")
        b = b"" if step is None else step.to_bytes(((step if step >= 0 else ~step).bit_length()) // 8 + 1, "little", signed=True)
        out += bytes([len(a) | len(b) << 4]) + a + b
    return bytes(out) + b"\0"


def _name(parent: int, sequence: int, space: int, name: str) -> bytes:
    raw = name.encode("utf-16-le")
    return struct.pack("<Q", parent | sequence << 48) + bytes(56) + bytes([len(raw) // 2, space]) + raw


def _node(children: list[tuple[int, int, str]], parent: int) -> bytes:
    out = b""
    for record, sequence, name in children:
        if not record | sequence:
            raise ValueError("a reference of 0 names no file: record 0 needs a sequence")
        key = _name(parent, 0, 1, name)
        size = -(-(ENTRY_HEAD + len(key)) // 8) * 8
        out += (struct.pack("<QHHHH", record | sequence << 48, size, len(key), 0, 0) + key).ljust(size, b"\0")
    out += struct.pack("<QHHHH", 0, ENTRY_HEAD, 0, LAST_ENTRY, 0)
    return struct.pack("<IIII", 16, 16 + len(out), 16 + len(out), 0) + out


def _resident(kind: int, value: bytes) -> bytes:
    size = -(-(24 + len(value)) // 8) * 8
    return (struct.pack("<IIBBHHHIHH", kind, size, 0, 0, 24, 0, 0, len(value), 24, 0) + value).ljust(size, b"\0")


def _extended(kind: int, size: int, runs: list[tuple[int, int | None]]) -> bytes:
    packed = encoded_runs(runs)
    whole = -(-(64 + len(packed)) // 8) * 8
    return (struct.pack("<IIBBHHHQQHHIQQQ", kind, whole, 1, 0, 64, 0, 0, 0, 0, 64, 0, 0, size, size, size) + packed).ljust(whole, b"\0")


def written_record(sequence: int, flags: int, names: list[tuple[int, int, int, str]], size: int | None = None, children: list[tuple[int, int, str]] | None = None, index_runs: list[tuple[int, int | None]] | None = None, record: int = 0, bytes_: int = 1024, last_write_time: int | None = None) -> bytes:
    """A file record; ``size`` is that of a stream outside the record."""
    body = b"" if last_write_time is None else _resident(TIMES, struct.pack("<4qI12x", 0, last_write_time, 0, 0, 0))
    body += b"".join(_resident(FILE_NAME, _name(*n)) for n in names)
    if size is not None:
        body += _extended(DATA, size, [(1, 1)])
    if children is not None:
        body += _resident(INDEX_ROOT, struct.pack("<IIII", FILE_NAME, 1, 4096, 1) + _node(children, record))
    if index_runs is not None:
        body += _extended(INDEX_ALLOCATION, 4096, index_runs)
    # The update sequence lies between the header and the attributes and grows with the block.
    bytes_ = max(bytes_, -(-(len(body) + len(body) // 256 + 128) // SECTOR) * SECTOR)
    at = -(-(RECORD_HEAD + 2 * (bytes_ // SECTOR + 1)) // 8) * 8
    head = FILE + bytes(12) + struct.pack("<HHHH", sequence, 1, at, flags)
    return fixed_up((head.ljust(at, b"\0") + body + struct.pack("<II", END, 0)).ljust(bytes_, b"\0"), RECORD_HEAD)


def written_block(children: list[tuple[int, int, str]], parent: int = 0, bytes_: int = 4096) -> bytes:
    """An index block; its node begins behind a header of 24 bytes and the update sequence."""
    node = _node(children, parent)
    at, end, room, flags = struct.unpack_from("<IIII", node)
    gap = 32
    node = struct.pack("<IIII", at + gap, end + gap, room + gap, flags) + bytes(gap) + node[16:]
    return fixed_up((INDX + bytes(20) + node).ljust(bytes_, b"\0"), 40)
