import hashlib
import struct
import zlib

import numpy as np
import pytest
from odd_rows import ODD

from tallystone.llm import tiff

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16), (64, 32)])
def test_pages_round_trip(kind, predictor, tile):
    for shape in ((1, 1), (5, 7), (300, 64), (129, 65)):
        images = [RNG.integers(0, top, shape, dtype=np.uint8) for top in (2, 256)]
        found = list(tiff.read_pages(tiff.encode(images, kind, predictor, tile, rows_per_strip=50)))
        assert [p["pixels"] for p in found] == [i.tobytes() for i in images]
        assert {p["error"] for p in found} == {None}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 128, 129, 3836, 3837, 3838, 50_000])
@pytest.mark.parametrize("top", [1, 3, 256])
def test_codecs_round_trip(n, top):
    data = RNG.integers(0, top, n, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data
    assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data


def test_published_packbits_example():
    packed = bytes.fromhex("feaa028000 2afdaa0380002a22f7aa".replace(" ", ""))
    plain = bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa")
    assert tiff.packbits_decode(packed, len(plain)) == plain
    assert tiff.packbits_decode(tiff.packbits_encode(plain), len(plain)) == plain


def test_big_endian_planar_16_bit():
    """Two planes of 16-bit samples in big-endian order, written by hand."""
    planes = [np.array([[1, 500], [70, 9]], ">u2"), np.array([[65535, 2], [3, 4]], ">u2")]
    data = b"".join(p.tobytes() for p in planes)
    entries = [(256, 3, 1, 2), (257, 3, 1, 2), (258, 3, 2, (16 << 16) | 16), (259, 3, 1, 1), (273, 4, 2, 200), (277, 3, 1, 2), (279, 4, 2, 208), (284, 3, 1, 2)]
    ifd = struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHI", t, k, n) + (struct.pack(">HH", v, 0) if k == 3 and n == 1 else struct.pack(">I", v)) for t, k, n, v in entries) + struct.pack(">I", 0)
    blob = (struct.pack(">2sHI", b"MM", 42, 8) + ifd).ljust(200, b"\0") + struct.pack(">4I", 216, 224, 8, 8) + data
    (page,) = tiff.read_pages(blob)
    assert page["error"] is None
    assert np.frombuffer(page["pixels"], np.uint16).reshape(2, 2, 2).tolist() == np.stack(planes, axis=2).tolist()


def test_damaged_blobs_give_errors(spark):
    good = tiff.encode([np.zeros((40, 64), np.uint8)] * 2, tiff.LZW)
    loop = bytearray(good)
    (first,) = struct.unpack_from("<I", good, 4)
    n = struct.unpack_from("<H", good, first)[0]
    struct.pack_into("<I", loop, first + 2 + 12 * n, first)
    rows = [(1, b""), (2, b"junk" * 10), (3, good[:-30]), (4, bytes(loop)), (5, good), (5, good), (6, None)]
    found = tiff.pages(spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "id int, blob binary"), "id", "blob").collect()
    by = {i: [r for r in found if r.id == i] for i, _ in rows}
    assert [len(by[i]) for i in range(1, 7)] == [1, 1, 2, 2, 4, 0]
    assert by[1][0].error and by[2][0].error and by[3][-1].error and by[4][-1].error and by[4][0].error is None


@pytest.mark.parametrize("i", range(len(tiff.STORED)))
def test_every_way_of_storing_is_lossless(i):
    texts = [t for t in (b"%d text " % k * (k % 300) for k in range(60)) if zlib.crc32(t) % len(tiff.STORED) == i]
    assert texts
    for t in texts:
        got = b"".join(p["pixels"] for p in tiff.read_pages(tiff.text_image(t)))
        assert got == t + b"\0" * (-len(t) % 64 if t else 64)


def test_query_on_odd_rows(odd, none):
    found = tiff.stored_and_read(odd).collect()
    want = sorted((t or "").encode() for _, t, *_ in ODD)
    padded = [t + b"\0" * (-len(t) % 64 if t else 64) for t in want]
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == sorted((len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for t, p in zip(want, padded, strict=True))
    assert len({(r.media_sha256, r.feature) for r in found}) == len({t for t in want})
    assert tiff.stored_and_read(none).count() == 0


def directory(order, big, tags, data):
    """A file of one page by hand: tags (tag, type, values), then the data of strips at their offsets."""
    offset, size = ("Q", 8) if big else ("I", 4)
    head = struct.pack(order + ("2sHHHQ" if big else "2sHI"), b"II" if order == "<" else b"MM", *((43, 8, 0, 16) if big else (42, 8)))
    out, far = struct.pack(order + ("Q" if big else "H"), len(tags)), b""
    end = len(head) + len(out) + len(tags) * (20 if big else 12) + size
    for tag, kind, values in tags:
        packed = struct.pack(f"{order}{len(values)}{tiff.TYPES[kind][0]}", *values)
        if len(packed) > size:
            far, packed = far + packed, struct.pack(order + offset, end + len(far))
        out += struct.pack(order + "HH" + offset, tag, kind, len(values)) + packed.ljust(size, b"\0")
    blob = head + out + struct.pack(order + offset, 0) + far
    assert len(blob) <= 400
    return blob.ljust(400, b"\0") + data


@pytest.mark.parametrize("order, big", [("<", False), (">", False), ("<", True), (">", True)])
@pytest.mark.parametrize("bits", [1, 2, 4])
def test_samples_below_a_byte(order, big, bits):
    page = RNG.integers(0, 1 << bits, (7, 13), dtype=np.uint8)
    rows = [np.packbits(np.concatenate([[v >> b & 1 for b in range(bits - 1, -1, -1)] for v in row]).astype(np.uint8)).tobytes() for row in page]
    strips = [tiff.packbits_encode(b"".join(rows[y : y + 4])) for y in (0, 4)]
    tags = [(256, 3, [13]), (257, 3, [7]), (258, 3, [bits]), (259, 3, [tiff.PACKBITS]), (273, 4, [400, 400 + len(strips[0])]), (278, 3, [4]), (279, 4, [len(s) for s in strips])]
    (found,) = tiff.read_pages(directory(order, big, tags, b"".join(strips)))
    assert (found["error"], found["bits"], found["pixels"]) == (None, bits, page.tobytes())


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("size", [2, 4, 8])
def test_floating_point_predictor(order, size):
    page = RNG.normal(size=(5, 9)).astype(f"f{size}")
    data = b""
    for row in page:  # bytes by significance, then differences
        planes = np.frombuffer(row.astype(f">f{size}").tobytes(), np.uint8).reshape(9, size).T.reshape(-1)
        data += np.diff(planes, prepend=np.uint8(0)).tobytes()
    packed = zlib.compress(data)
    tags = [(256, 3, [9]), (257, 3, [5]), (258, 3, [8 * size]), (259, 3, [8]), (273, 4, [400]), (278, 3, [5]), (279, 4, [len(packed)]), (317, 3, [3])]
    (found,) = tiff.read_pages(directory(order, False, tags, packed))
    assert found["error"] is None and found["pixels"] == page.tobytes()


def test_a_large_page_is_read_by_blocks(spark, monkeypatch):
    page = RNG.integers(0, 256, (300, 70), dtype=np.uint8)
    blobs = [tiff.encode([page], tiff.LZW, 2, tile, rows_per_strip=50) for tile in (None, (64, 32))]
    monkeypatch.setattr(tiff, "MOST_PAGE_BYTES", 5000)
    for blob in blobs:
        (whole,) = tiff.read_pages(blob)
        assert "blocks" in whole["error"] and whole.get("pixels") is None
        built = np.zeros_like(page)
        for b in tiff.read_blocks(blob):
            assert b["error"] is None
            built[b["y"] : b["y"] + b["block_height"], b["x"] : b["x"] + b["block_width"]] = np.frombuffer(b["pixels"], np.uint8).reshape(b["block_height"], b["block_width"])
        assert (built == page).all()
    df = spark.createDataFrame([(1, bytearray(blobs[0])), (2, bytearray(b"junk")), (3, None)], "y int, blob binary")
    rows = tiff.blocks(df, "y", "blob").collect()
    assert [r.y_in for r in rows] == [1] * 6 + [2] and rows[-1].error


def test_clashing_names_and_empty_tables_of_pages(spark):
    blob = bytearray(tiff.encode([np.ones((2, 3), np.uint8)] * 3))
    df = spark.createDataFrame([(9, blob, "k", 1)], "page int, media binary, error string, more int")
    rows = tiff.pages(df, "page", "media", ["error", "more"]).collect()
    assert [(r.page_in, r.page, r.error_in, r.error, r.more) for r in rows] == [(9, k, "k", None, 1) for k in range(3)]
    assert tiff.pages(df.where("page = 0"), "page", "media").count() == 0 and tiff.blocks(df.where("page = 0"), "page", "media").count() == 0


def test_query_of_the_documents(spark, docs):
    got = {r.doc_id: r for r in tiff.query(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        padded, media = t + b"\0" * (-len(t) % 64 if t else 64), tiff.text_image(t)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
