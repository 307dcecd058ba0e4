import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from odd_rows import ODD
from pyspark.sql import functions as F

from tallystone.llm import common, tokens, zframes


class Sink(io.BytesIO):
    def close(self):
        self.data = self.getvalue()
        super().close()


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def file_of(documents, frame_bytes=64, width=2):
    sink = Sink()
    writer = zframes.FrameWriter(sink, width, frame_bytes)
    for doc_id, ids in documents:
        writer.add(doc_id, np.array(ids, np.uint32))
    assert writer.close() == len(sink.data)
    return sink.data


DOCUMENTS = [(None, [7]), (1, []), (2, list(range(500))), (2, [65535, 0]), (9, [3] * 20), (10, [1, 2, 3])]


@pytest.mark.parametrize("width, frame_bytes", [(2, 1), (2, 64), (4, 1 << 20)])
def test_round_trip_and_standard_readers(width, frame_bytes):
    data = file_of(DOCUMENTS, frame_bytes, width)
    reader = zframes.FrameReader(Source(data))
    assert [ids.tolist() for _, ids in reader.documents()] == [ids for _, ids in DOCUMENTS]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(plain, f"<u{width}").tolist() == [t for _, ids in DOCUMENTS for t in ids]


def test_only_requested_frames_are_read():
    data = file_of([(i, [i] * 50) for i in range(100)])
    source = Source(data)
    reader = zframes.FrameReader(source)
    opened = []
    real = reader.frame
    reader.frame = lambda k: opened.append(k) or real(k)
    assert [ids.tolist() for _, ids in reader.documents(np.array([40, 70]))] == [[40] * 50, [70] * 50]
    assert len(opened) == 2 < len(reader.seek)


def test_damage_is_found():
    data = bytearray(file_of(DOCUMENTS))
    for broken in (data[:-1], data[:20], bytes(40)):
        with pytest.raises((ValueError, OSError, zstandard.ZstdError, __import__("struct").error)):
            list(zframes.FrameReader(Source(bytes(broken))).documents())
    reader = zframes.FrameReader(Source(bytes(data)))
    reader.seek[0, 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(reader.documents())


def test_odd_rows(spark, odd, none):
    folder = common.scratch_path(spark, "ids")
    manifest = zframes.write_token_files(odd, folder)
    rows = zframes.read_token_files(manifest).collect()
    encode = tokens.encoder().encode_one
    want = sorted((-1 if i is None else i, [*encode(t or ""), zframes.END_ID]) for i, t, *_ in ODD)
    got = sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert got == want
    in_order = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in in_order] == np.cumsum([0] + [r.n_tokens for r in in_order])[:-1].tolist()
    ids = [r.doc_id for r in in_order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
    paths = [r.path for r in manifest.collect()]
    hits = [zframes.fetch(p, [4, 9]) for p in paths]
    assert sorted((k, len(v)) for h in hits for k, v in h.items()) == [(4, 2), (9, 1)]
    assert zframes.remove_orphans(manifest, folder) == 0
    zframes.open_output(f"{folder}/stray.ids.zst").close()
    assert zframes.remove_orphans(manifest, folder) == 1
    assert zframes.read_token_files(zframes.write_token_files(none, common.scratch_path(spark, "ids"))).count() == 0


def test_query_equals_the_library(spark, docs):
    rows = zframes.query(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    ids, offsets = tokens.encoder().encode(pa.array(texts))
    assert [r.n_tokens for r in rows] == (np.diff(offsets) + 1).tolist()
    assert [r.start for r in rows] == (offsets[:-1] + np.arange(len(rows))).tolist()
    assert rows[5].ids_crc32 == zlib.crc32(np.append(ids[offsets[5] : offsets[6]], 2).astype("<u4").tobytes())


def test_a_hot_id_is_cut_into_files(spark, tmp_path):
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = zframes.write_token_files(df.repartition(8), f"file://{tmp_path}/hot")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n_docs for r in manifest.collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 2 * 6000 / len(sizes) and len(sizes) > 3
    rows = zframes.read_token_files(manifest, with_ids=False).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
