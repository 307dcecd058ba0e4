"""TIFF media columns (operator 1).

``pages`` walks the image file directories of TIFF blobs, decodes PackBits, LZW, deflate and
uncompressed strips and tiles, undoes predictors, and gives one row per page; ``blocks`` gives one row
per strip or tile, for pages that are too large for a row. ``encode`` is the writer that tests and the
query use.

Read are classic TIFF (version 42) and BigTIFF (43) of either byte order; samples of 1, 2, 4, 8, 16, 32
or 64 bits, all of a page alike, chunky or planar; predictors 1, 2 (not below 8 bits) and 3 (floating
point, from 16 bits). Samples below 8 bits come out as a byte each. What can't be decoded gives a row
with ``error``; a blob whose header or directory chain is damaged gives its readable pages and one
row with ``error``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm import common

# Fixed values of the format: tags, field types and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits", OLD_DEFLATE: "deflate"}

#: A page's pixels, or a strip's or tile's, may take this much memory; beyond, the row has an error. A
#: larger page is read by ``blocks``.
MOST_PAGE_BYTES = 1 << 30


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more become (257 - n, byte), all else literal packets of up to 128."""
    if not data:
        return b""
    x = np.frombuffer(data, np.uint8)
    change = np.flatnonzero(np.diff(x)) + 1
    begins = np.concatenate(([0], change))
    lengths = np.diff(np.concatenate((begins, [len(x)])))
    out, literal = bytearray(), 0

    def literals(end: int) -> None:
        for i in range(literal, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(lengths >= 3).tolist():
        begin, n = int(begins[k]), int(lengths[k])
        literals(begin)
        literal = begin + n
        while n > 1:
            run = min(n, 128)
            out += bytes((257 - run, data[begin]))
            n -= run
        if n:
            literal -= 1
    literals(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        elif head > 128:
            if i + 1 >= n:
                raise ValueError("a PackBits run lacks its byte")
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first; the table is cleared before it is full. A reader's table lags by
    one entry, so it widens its codes one entry earlier than this writer."""
    codes, widths = [256], [9]
    table: dict[int, int] = {}
    next_code, width, prefix = 258, 9, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        found = table.get(key)
        if found is not None:
            prefix = found
            continue
        codes.append(prefix)
        widths.append(width)
        table[key] = next_code
        next_code += 1
        if next_code == 4095:
            codes.append(256)
            widths.append(12)
            table, next_code, width = {}, 258, 9
        elif next_code == 1 << width:
            width += 1
        prefix = byte
    if prefix >= 0:
        codes.append(prefix)
        widths.append(width)
        if next_code + 1 == 1 << width and width < 12:
            width += 1
    codes.append(257)
    widths.append(width)
    return _pack_bits(np.array(codes, np.int64), np.array(widths, np.int64))


def _pack_bits(codes: np.ndarray, widths: np.ndarray) -> bytes:
    left = np.repeat(np.cumsum(widths), widths) - 1 - np.arange(int(widths.sum()))
    values = (np.repeat(codes, widths) >> left) & 1
    return np.packbits(values.astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    held = bits = done = at = 0
    width, table, last, n = 9, [], None, len(data)
    while done < size:
        while bits < width:
            if at >= n:
                return b"".join(out)
            held = held << 8 | data[at]
            at += 1
            bits += 8
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, width, last = base.copy(), 9, None
            continue
        if code == 257:
            break
        if not table:
            raise ValueError("LZW data without a clear code")
        if last is None:
            piece = table[code]
        elif code < len(table):
            piece = table[code]
            table.append(last + piece[:1])
        elif code == len(table):
            piece = last + last[:1]
            table.append(piece)
        else:
            raise ValueError("an LZW code ahead of its table")
        out.append(piece)
        done += len(piece)
        last = piece
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def _decode(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        out = data
    elif kind == PACKBITS:
        out = packbits_decode(data, size)
    elif kind == LZW:
        out = lzw_decode(data, size)
    elif kind in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {kind} isn't supported")
    if len(out) < size:
        raise ValueError(f"a strip or tile holds {len(out)} bytes of {size}")
    return out[:size]


def _encode(kind: int, data: bytes) -> bytes:
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6)}[kind](data)


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = 128) -> bytes:
    """A little-endian TIFF of 8-bit grey pages (height x width, uint8), in strips or tiles
    (height, width; multiples of 16)."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        if tile:
            th, tw = tile
            padded = np.zeros((-(-height // th) * th, -(-width // tw) * tw), np.uint8)
            padded[:height, :width] = page
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, padded.shape[0], th) for x in range(0, padded.shape[1], tw)]
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            data = _encode(compression, np.ascontiguousarray(block).tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1])]
        if not tile:
            entries += [(STRIP_OFFSETS, 4, offsets), (SAMPLES, 3, [1]), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts), (PREDICTOR, 3, [predictor])]
        else:
            entries += [(SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor]), (TILE_WIDTH, 4, [tw]), (TILE_HEIGHT, 4, [th]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        fields = bytearray(struct.pack("<H", len(entries)))
        for tag, kind, values in entries:
            packed = struct.pack(f"<{len(values)}{TYPES[kind][0]}", *values)
            if len(packed) > 4:
                offset = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack("<I", offset)
            fields += struct.pack("<HHI4s", tag, kind, len(values), packed)
        if len(out) % 2:
            out += b"\0"
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + len(fields)
        out += fields + struct.pack("<I", 0)
    return bytes(out)


def directories(blob: bytes) -> Iterator[tuple[str, dict[int, tuple[int, ...]]]]:
    """Byte order and tags of each image file directory in the chain. Loops end with an error."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(blob[:2]))
    version = struct.unpack_from(order + "H", blob, 2)[0] if order and len(blob) >= 8 else None
    if version not in (42, 43) or version == 43 and (len(blob) < 16 or struct.unpack_from(order + "HH", blob, 4) != (8, 0)):
        raise ValueError("no TIFF header")
    # Letters of an offset and of a directory's length; sizes of the length, an entry and an offset.
    offset, length, head, size, wide = ("I", "H", 2, 12, 4) if version == 42 else ("Q", "Q", 8, 20, 8)
    at, seen = struct.unpack_from(order + offset, blob, wide)[0], set()
    while at:
        if at in seen or at + head > len(blob):
            raise ValueError("the chain of directories is damaged")
        seen.add(at)
        n = struct.unpack_from(order + length, blob, at)[0]
        if at + head + size * n + wide > len(blob):
            raise ValueError("a directory ends behind the file")
        tags: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            where = at + head + size * k
            tag, kind, count = struct.unpack_from(order + "HH" + offset, blob, where)
            if kind not in TYPES:
                continue
            letter, width = TYPES[kind]
            value = where + 4 + wide
            start = value if count * width <= wide else struct.unpack_from(order + offset, blob, value)[0]
            if start + count * width > len(blob):
                raise ValueError(f"tag {tag} lies behind the file")
            tags[tag] = struct.unpack_from(f"{order}{count}{letter}", blob, start)
        yield order, tags
        at = struct.unpack_from(order + offset, blob, at + head + size * n)[0]


def _unpacked(data: bytes, rows: int, samples: int, bits: int) -> np.ndarray:
    """Rows of ``samples`` numbers of 1, 2 or 4 bits, each row from a byte of its own."""
    single = np.unpackbits(np.frombuffer(data, np.uint8).reshape(rows, -1), axis=1)[:, : samples * bits]
    return (single.reshape(rows, samples, bits) << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def _unpredicted(block: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    # 3: a row's bytes are differences, a plane for each byte of a sample, most significant first.
    rows, width, depth = block.shape
    size = block.dtype.itemsize
    raw = np.ascontiguousarray(block).view(np.uint8).reshape(rows, -1, depth)
    planes = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, size, width * depth)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{size}").astype(block.dtype).reshape(block.shape)


def decode_blocks(blob: bytes, order: str, tags: dict[int, tuple[int, ...]]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first sample, y, x, samples: height x width x depth) of each strip or tile, cut to the page."""
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    width, height, samples, planar = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(PLANAR, 1)
    bits = tags.get(BITS, (1,))
    if width is None or height is None or len(set(bits)) != 1 or bits[0] not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError("only pages of 1, 2, 4, 8, 16, 32 or 64 bits a sample are supported")
    bits, compression, predictor = bits[0], one(COMPRESSION, 1), one(PREDICTOR, 1)
    if predictor not in (1, 2, 3) or predictor == 2 and bits < 8 or predictor == 3 and bits < 16:
        raise ValueError(f"predictor {predictor} isn't supported for {bits} bits")
    kind = np.dtype(f"{order}u{max(bits, 8) // 8}")
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    tiled = TILE_OFFSETS in tags
    offsets, counts = (tags.get(TILE_OFFSETS), tags.get(TILE_COUNTS)) if tiled else (tags.get(STRIP_OFFSETS), tags.get(STRIP_COUNTS))
    bh, bw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    if not offsets or not counts or len(offsets) != len(counts) or not bh or not bw or not depth:
        raise ValueError("strips or tiles are missing")
    if len(offsets) < -(-height // bh) * -(-width // bw) * planes:
        raise ValueError("strips or tiles are missing")
    if bh * bw * depth * kind.itemsize > MOST_PAGE_BYTES:
        raise ValueError("a strip or tile is too large")
    k = 0
    for plane in range(planes):
        for y in range(0, height, bh):
            for x in range(0, width, bw):
                rows = bh if tiled else min(bh, height - y)
                data = _decode(compression, blob[offsets[k] : offsets[k] + counts[k]], rows * -(-bw * depth * bits // 8))
                block = np.frombuffer(data, kind) if bits >= 8 else _unpacked(data, rows, bw * depth, bits)
                block = block.reshape(rows, bw, depth)
                # Predictor 3 has an order of bytes of its own.
                block = block.view(kind.newbyteorder("=")) if predictor == 3 else block.astype(kind.newbyteorder("="), copy=False)
                yield plane, y, x, _unpredicted(block, predictor)[: height - y, : width - x]
                k += 1


def decode_page(blob: bytes, order: str, tags: dict[int, tuple[int, ...]]) -> np.ndarray:
    """Samples of one page: height x width x samples."""
    height, width, samples = (tags.get(t, (d,))[0] for t, d in ((HEIGHT, 0), (WIDTH, 0), (SAMPLES, 1)))
    if height * width * samples * max(tags.get(BITS, (1,))[0], 8) // 8 > MOST_PAGE_BYTES:
        raise ValueError("the page is too large for a row: read its blocks")
    page = None
    for first, y, x, block in decode_blocks(blob, order, tags):
        if page is None:
            page = np.empty((height, width, samples), block.dtype)
        page[y : y + block.shape[0], x : x + block.shape[1], first : first + block.shape[2]] = block
    return page


_FAULTS = (ValueError, IndexError, zlib.error, struct.error)


def _about(number: int, tags: dict[int, tuple[int, ...]]) -> dict:
    return {"page": number, "width": tags.get(WIDTH, (None,))[0], "height": tags.get(HEIGHT, (None,))[0], "samples": tags.get(SAMPLES, (1,))[0], "bits": tags.get(BITS, (1,))[0], "compression": NAMES.get(tags.get(COMPRESSION, (1,))[0], "other"), "predictor": tags.get(PREDICTOR, (1,))[0], "tiled": TILE_OFFSETS in tags}


def _each_directory(blob: bytes, rows) -> Iterator[dict]:
    """``rows(order, tags)`` of each page, as far as it goes, with the page's columns; faults as rows."""
    blob, number, about = bytes(blob), 0, {}
    try:
        for order, tags in directories(blob):
            about = _about(number, tags)
            try:
                for row in rows(blob, order, tags):
                    yield about | row | {"error": None}
            except _FAULTS as e:
                yield about | {"error": str(e)}
            number += 1
    except (ValueError, struct.error) as e:
        yield {"page": number, "error": str(e)}


def read_pages(blob: bytes) -> Iterator[dict]:
    """One dict per page: page, width, height, samples, bits, compression, predictor, tiled, pixels
    (bytes, machine order, chunky) and error (None if it was decoded; else columns may be missing)."""
    return _each_directory(blob, lambda *page: [{"pixels": decode_page(*page).tobytes()}])


def read_blocks(blob: bytes) -> Iterator[dict]:
    """One dict per strip or tile: the columns of ``read_pages`` and first_sample, y, x, block_height,
    block_width; pixels are the block's. A page's rows end with the first that can't be decoded."""
    return _each_directory(blob, lambda *page: ({"first_sample": first, "y": y, "x": x, "block_height": block.shape[0], "block_width": block.shape[1], "pixels": block.tobytes()} for first, y, x, block in decode_blocks(*page)))


PAGE_SCHEMA = "page int, width long, height long, samples int, bits int, compression string, predictor int, tiled boolean, pixels binary, error string"
BLOCK_SCHEMA = "first_sample int, y long, x long, block_height long, block_width long, " + PAGE_SCHEMA
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _rows_of_media(df: DataFrame, id_col: str, media_col: str, keep: list[str], schema: str, read) -> DataFrame:
    fields = [x.split() for x in schema.split(", ")]
    names = {n for n, _ in fields}
    carried = [id_col, *(c for c in keep if c != id_col)]
    shown = [c if c not in names else f"{c}_in" for c in carried]
    rows = df.select(F.col(media_col).cast("binary").alias("__blob"), *[F.col(c).alias(n) for c, n in zip(carried, shown, strict=True)]).where(F.col("__blob").isNotNull())
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 0):
            held, of, size = [], [], 0
            for i in range(batch.num_rows):
                for row in read(batch.column(0)[i].as_py()):
                    held.append(row)
                    of.append(i)
                    size += len(row.get("pixels") or b"")
                    if size > common.SLICE_BYTES:
                        yield _media_batch(batch, held, of, shown, fields)
                        held, of, size = [], [], 0
            if held:
                yield _media_batch(batch, held, of, shown, fields)

    return rows.mapInArrow(run, ", ".join([*kinds, schema]))


def _media_batch(batch: pa.RecordBatch, held: list[dict], of: list[int], shown: list[str], fields: list[list[str]]) -> pa.RecordBatch:
    at = pa.array(of, pa.int64())
    return pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[1:]), *(pa.array([r.get(n) for r in held], _ARROW[t]) for n, t in fields)], [*shown, *(n for n, _ in fields)])


def pages(df: DataFrame, id_col: str, media_col: str, keep: list[str] | None = None) -> DataFrame:
    """One row per page of the TIFF blobs in ``media_col``: ``id_col``, the columns in ``keep``, and
    the columns of ``read_pages``. Pages of a blob are neighbours, from page 0 on, in one partition.

    Null blobs give no row, empty or damaged ones a row with ``error``; repeated rows give repeated
    pages; other columns are not carried. A carried column that is named like a page's gets ``_in``
    behind its name. A page above ``MOST_PAGE_BYTES`` has an error here: ``blocks`` reads it."""
    return _rows_of_media(df, id_col, media_col, keep or [], PAGE_SCHEMA, read_pages)


def blocks(df: DataFrame, id_col: str, media_col: str, keep: list[str] | None = None) -> DataFrame:
    """One row per strip or tile, as ``pages`` but with the columns of ``read_blocks``, so a page of
    any size takes the memory of one block."""
    return _rows_of_media(df, id_col, media_col, keep or [], BLOCK_SCHEMA, read_blocks)


#: Payload bytes per row of a page, and rows per page, of ``text_image``.
ROW_BYTES, PAGE_ROWS = 64, 1024
#: How a text is stored follows from its bytes: (compression, predictor, tile).
STORED = ((DEFLATE, 2, None), (DEFLATE, 1, (64, 32)), (LZW, 1, None), (PACKBITS, 1, (128, 64)), (LZW, 2, (64, 64)), (PACKBITS, 2, None), (DEFLATE, 1, None), (LZW, 1, (128, 64)))


def text_image(text: bytes) -> bytes:
    """A text as a TIFF of grey pages 64 samples wide; zero bytes fill the last row. The kinds of
    compression, predictor and tiling take turns by the text's checksum."""
    payload = text + b"\0" * (-len(text) % ROW_BYTES if text else ROW_BYTES)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    compression, predictor, tile = STORED[zlib.crc32(text) % len(STORED)]
    return encode([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], compression, predictor, tile)


def stored_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes long and ``media`` binary: each whole text (null: empty) as a TIFF."""
    rows = df.select(F.col(id_col), common.text_or_empty(text_col).cast("binary").alias("__text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([text_image(t) for t in texts], pa.binary())], [id_col, "n_bytes", "media"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From ``pages`` of stored texts, as it comes, with n_bytes, media_bytes and media_sha256 kept:
    the payloads' digests and features, a row per blob. A page that couldn't be decoded raises."""
    kind = found.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, blob, done = None, None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, compression, predictor, tiled, pixels, error = row[4:]
                if error:
                    raise ValueError(error)
                if page == 0:
                    if blob:
                        done.append(blob.row())
                    blob = _Payload(row[:4])
                blob.add(pixels, f"{compression}/{predictor}/{'tiles' if tiled else 'strips'}")
            if len(done) >= 1000:
                yield batch_of(done)
                done = []
        if blob:
            yield batch_of([*done, blob.row()])

    return found.select(id_col, "n_bytes", "media_bytes", "media_sha256", "page", "compression", "predictor", "tiled", "pixels", "error").mapInArrow(run, schema)


class _Payload:
    """What the pages of one blob add up to."""

    def __init__(self, about: tuple):
        self.about, self.digest, self.tail, self.size, self.n, self.how = about, hashlib.sha256(), b"", 0, 0, ""
        self.histogram = np.zeros(256, np.int64)

    def add(self, pixels: bytes, how: str) -> None:
        self.digest.update(pixels)
        self.tail, self.size, self.n, self.how = (self.tail + pixels)[-64:], self.size + len(pixels), self.n + 1, how
        self.histogram += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)

    def row(self) -> tuple:
        of, n_bytes, media_bytes, media_sha256 = self.about
        mean = float((self.histogram * np.arange(256)).sum() / self.size)
        p = self.histogram[self.histogram > 0] / self.size
        feature = f"{self.n}x{ROW_BYTES} {self.how} mean={mean:.6f} entropy={-float((p * np.log2(p)).sum()):.6f}"
        return of, n_bytes, self.size, self.digest.hexdigest(), zlib.crc32(self.tail), media_bytes, media_sha256, feature


def stored_and_read(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digests`` of ``pages`` of ``stored_texts``."""
    media = stored_texts(df, id_col, text_col).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return digests(pages(media, id_col, "media", ["n_bytes", "media_bytes", "media_sha256"]), id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every text through a TIFF and back, page by page."""
    return stored_and_read(common.documents(spark, sf_dir))
