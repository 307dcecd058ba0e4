"""Token ids in files of independent zstandard frames with a trailing seek table (operator 9).

Layout of a file::

    frame 0 .. frame n-1      zstandard frames; each holds the ids of one or more whole documents
    skippable frame 0x184D2A5C the documents: one zstandard frame of int64 arrays doc_id, is_null,
                               n_tokens, frame
    skippable frame 0x184D2A5E the seek table: for each data frame u32 compressed size,
                               u32 size, u32 low half of xxh64 of the data; then u32 n,
                               u8 0x80 (checksums), u32 0x8F92EAB1

A standard zstandard reader sees the ids alone. A reader of a few documents fetches the tail, then
only the frames it needs. Ids are little-endian unsigned, of 16 bits where the vocabulary allows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm import common, tokens

# Fixed values of the zstandard seekable format.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEK_MAGIC, HAS_CHECKSUMS = 0x184D2A5E, 0x184D2A5C, 0x8F92EAB1, 0x80

END_ID = 2
#: Bytes of ids after which a frame is closed.
FRAME_BYTES = 1 << 18
LEVEL = 3


def open_output(path: str):
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(inner, compression=None)


def open_input(path: str):
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])
    return fs.open_input_file(inner)


class FrameWriter:
    """Writes documents, in the order given, to one file."""

    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.held: list[bytes] = []
        self.held_bytes = self.n_tokens = self.written = 0
        self.seek: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype(f"<u{self.width}").tobytes()
        if self.held and self.held_bytes + len(data) > self.frame_bytes:
            self.close_frame()
        self.docs.append((doc_id or 0, doc_id is None, len(ids), len(self.seek)))
        self.held.append(data)
        self.held_bytes += len(data)
        self.n_tokens += len(ids)

    def close_frame(self) -> None:
        import xxhash

        if not self.held:
            return
        data = b"".join(self.held)
        packed = self.compress(data)
        self.out.write(packed)
        self.written += len(packed)
        self.seek.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.held_bytes = [], 0

    def close(self) -> int:
        """Write the two trailing frames; returns the file's size."""
        self.close_frame()
        index = self.compress(struct.pack("<q", self.width) + np.array(self.docs, "<i8").reshape(-1, 4).T.tobytes())
        table = b"".join(struct.pack("<III", *entry) for entry in self.seek) + struct.pack("<IBI", len(self.seek), HAS_CHECKSUMS, SEEK_MAGIC)
        tail = struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index + struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table
        self.out.write(tail)
        self.out.close()
        return self.written + len(tail)


class FrameReader:
    """Random access to one file. Wrong checksums and damaged tails raise ``ValueError``."""

    def __init__(self, source):
        import zstandard

        self.source, self.size = source, source.size()
        self.decompress = zstandard.ZstdDecompressor().decompress
        n, flags, magic = struct.unpack("<IBI", self._at(self.size - 9, 9))
        if magic != SEEK_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        begin = self.size - 9 - 12 * n
        if struct.unpack("<II", self._at(begin - 8, 8)) != (SKIPPABLE_SEEK, 12 * n + 9):
            raise ValueError("the seek table's header is wrong")
        self.seek = np.frombuffer(self._at(begin, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.seek[:, 0])))
        magic, length = struct.unpack("<II", self._at(int(self.begins[-1]), 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("the documents' index is missing")
        index = self.decompress(self._at(int(self.begins[-1]) + 8, length))
        self.width = struct.unpack_from("<q", index)[0]
        self.doc_ids, self.nulls, self.n_tokens, self.frame_of = np.frombuffer(index, "<i8", offset=8).reshape(4, -1)
        self.starts = np.cumsum(self.n_tokens) - self.n_tokens
        self.frame_starts = np.concatenate(([0], np.cumsum(self.seek[:, 1]))) // self.width

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        import xxhash

        data = self.decompress(self._at(int(self.begins[k]), int(self.seek[k, 0])))
        if len(data) != self.seek[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.seek[k, 2]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(data, f"<u{self.width}")

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Position and ids of the documents at ``wanted`` positions (all), a frame at a time."""
        at, data = -1, None
        for i in (range(len(self.doc_ids)) if wanted is None else wanted):
            if (k := int(self.frame_of[i])) != at:
                at, data = k, self.frame(k)
            begin = int(self.starts[i] - self.frame_starts[k])
            yield int(i), data[begin : begin + int(self.n_tokens[i])]


def write_token_files(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, vocabulary: str = tokens.DEFAULT_VOCABULARY, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode every whole text (null: empty), append ``end_id`` and write files in ascending order
    of ``id_col`` (nulls first, repeated ids side by side).

    Returns the manifest, one row per file: shard long (ascending with the ids), path, n_docs,
    n_tokens, first_token (ids in earlier files) and n_bytes, all long. An empty table gives no file.

    Rows are dealt by range of the id and then of their place in the input, so a file is as large as a
    shuffle partition, even where most rows have one id or none. An attempt that is retried writes under a new name and only the attempt that counts is in the manifest;
    ``remove_orphans`` deletes the others.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = tokens.encoder(vocabulary)
        width = 2 if enc.whole.get_vocab_size() <= 1 << 16 else 4
        writer = path = None
        for batch in common.slices(batches):
            if writer is None:
                path = f"{folder}/{uuid.uuid4().hex}.ids.zst"
                writer = FrameWriter(open_output(path), width, frame_bytes)
            ids, offsets = enc.encode(batch.column(1))
            end = np.array([end_id], np.uint32)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                writer.add(doc_id, np.concatenate((ids[offsets[i] : offsets[i + 1]], end)))
        if writer is not None:
            n_bytes = writer.close()
            del ids, offsets, batch
            common.release_memory()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [path], "n_docs": [len(writer.docs)], "n_tokens": [writer.n_tokens], "n_bytes": [n_bytes]})

    # One row per file: one small table, and a bounded window without partitions.
    manifest = common.written(rows.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long, n_bytes long").repartition(1), "token-files")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("first_token", before)


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read files back, whole: doc_id, start long (ids of all documents before), n_tokens long,
    ids_crc32 long and, with ``with_ids``, ids binary (little-endian unsigned 32 bit)."""
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = FrameReader(open_input(path))
                held: list[tuple] = []
                size = 0
                for i, ids in reader.documents():
                    raw = ids.astype("<u4").tobytes()
                    held.append((None if reader.nulls[i] else int(reader.doc_ids[i]), first + int(reader.starts[i]), len(ids), zlib.crc32(raw), raw))
                    size += len(raw)
                    if len(held) >= 10_000 or with_ids and size > common.SLICE_BYTES:
                        yield _batch(held, with_ids)
                        held, size = [], 0
                if held:
                    yield _batch(held, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return manifest.select("path", "first_token").repartition(n).mapInArrow(run, schema)


def _batch(held: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(zip(*held, strict=True), kinds.values(), strict=True))[: 4 + with_ids]], list(kinds)[: 4 + with_ids])


def fetch(path: str, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
    """Ids of the requested documents of one file, decompressing only their frames."""
    reader = FrameReader(open_input(path))
    wanted = np.flatnonzero(np.isin(reader.doc_ids, doc_ids) & (reader.nulls == 0))
    found: dict[int, list[np.ndarray]] = {}
    for i, ids in reader.documents(wanted):
        found.setdefault(int(reader.doc_ids[i]), []).append(ids.astype(np.uint32))
    return found


def remove_orphans(manifest: DataFrame, folder: str) -> int:
    """Delete files of attempts that did not count; returns their number."""
    fs, inner = pafs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:])
    kept = {r.path.rpartition("/")[2] for r in manifest.select("path").toLocalIterator()}
    stray = [f.path for f in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)) if f.base_name not in kept]
    for path in stray:
        fs.delete_file(path)
    return len(stray)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: write every document's ids, read the files back, and return the digests."""
    manifest = write_token_files(common.documents(spark, sf_dir), common.scratch_path(spark, "ids"))
    return read_token_files(manifest, with_ids=False)
