import itertools

import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from tallystone.llm import hilbert


def curve(cell, bits):
    """Skilling's transposition, number by number."""
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out * 2 + ((v ^ t) >> b & 1)
    return out


@pytest.mark.parametrize("bits, n", [(3, 3), (4, 2), (2, 4), (1, 3)])
def test_curve(spark, bits, n):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, [f"a{i}" for i in range(n)])
    got = {tuple(r[:-1]): r[-1] for r in hilbert.with_curve(df, [F.col(f"a{i}") for i in range(n)], bits).collect()}
    assert got == {c: curve(c, bits) for c in cells}
    along = sorted(cells, key=got.get)
    assert all(sum(abs(p - q) for p, q in zip(a, b, strict=True)) == 1 for a, b in zip(along, along[1:], strict=False))


def test_quantised_codes_keep_order(spark):
    rows = [(None, None), ("src1", -5), ("src10", 0), ("src9", 1), ("src2", 10**12), ("srcé", 7)]
    df = spark.createDataFrame(rows, "s string, n long")
    s, n = hilbert.quantised(df, [hilbert.Dimension("s", "string"), hilbert.Dimension("n", "log")], 5)
    found = df.select("s", "n", s.alias("cs"), n.alias("cn")).collect()
    assert {(r.cs, r.cn) for r in found if r.s is None} == {(0, 0)}
    known = [r for r in found if r.s is not None]
    assert all(1 <= r.cs < 32 and 1 <= r.cn < 32 for r in known)
    by_s, by_n = sorted(known, key=lambda r: r.s.encode()), sorted(known, key=lambda r: r.n)
    assert [r.cs for r in by_s] == sorted(r.cs for r in known) and [r.cn for r in by_n] == sorted(r.cn for r in known)
    (c,) = hilbert.quantised(df, [hilbert.Dimension("n", "linear")], 4)
    assert [r[0] for r in df.where("n is not null").orderBy("n").select(c).collect()] == [1, 1, 1, 1, 15]


def check(rows, shards):
    counts = {}
    for r in rows:
        counts.setdefault(r.shard, []).append(r.slot)
    sizes = [len(counts.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert sorted(r.position for r in rows) == list(range(len(rows)))


def test_shards_of_odd_rows(odd, none):
    rows = hilbert.shard(odd, ["doc_id"], 4).collect()
    assert len(rows) == len(ODD)
    check(rows, 4)
    assert hilbert.shard(none, ["doc_id"], 4).count() == 0


def test_hot_cells_are_cut_into_buckets(docs):
    rows = hilbert.shard(docs.withColumn("source", F.lit("one")).withColumn("lang", F.lit("x")), ["doc_id"], 7, bucket_rows=5).collect()
    check(rows, 7)
    along = sorted(rows, key=lambda r: r.position)
    assert [r.curve for r in along] == sorted(r.curve for r in rows)


def test_query(spark, docs):
    rows = hilbert.query(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == docs.count() and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    again = hilbert.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, (r[:6] for r in rows))) == sorted(map(tuple, (r[:6] for r in again)))


def test_written_shards_prune(spark, docs, tmp_path):
    manifest = hilbert.write_shards(docs, str(tmp_path / "out"), ["doc_id"], shards=10)
    assert manifest.agg(F.sum("n")).first()[0] == docs.count()
    part = hilbert.pruned(manifest, source=("src1", "src1"), lang=("en", "en"))
    kept = {r.shard for r in part.collect()}
    assert 0 < len(kept) < 10
    holding = {r.shard for r in spark.read.parquet(str(tmp_path / "out")).where("source = 'src1' and lang = 'en'").select("shard").distinct().collect()}
    assert holding <= kept


def test_written_shards_of_an_empty_table(none, tmp_path):
    assert hilbert.write_shards(none, str(tmp_path / "none"), ["doc_id"]).count() == 0


def test_names_that_sharding_makes(docs):
    with pytest.raises(ValueError, match="position"):
        hilbert.shard(docs.withColumn("position", F.lit(1)), ["doc_id"], dims=[hilbert.Dimension("position", "linear")])


def test_repeated_ids_are_dealt_over_buckets(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(7).cast("long").alias("n_chars"), F.col("id").alias("size"))
    rows = hilbert.shard(df, ["doc_id"], 7, bucket_rows=100).collect()
    check(rows, 7)
    sizes = [r.size for r in sorted(rows, key=lambda r: r.position)]
    assert sorted(sizes) == list(range(4000)) and sizes[:100] != sorted(sizes[:100])


def test_query_equals_sql(spark):
    import duckdb
    import zlib

    path = "/root/testdata/sf0.01/documents.parquet"
    want = duckdb.sql(f"SELECT doc_id, strlen(coalesce(text, '')) + 16, count(*) OVER () FROM '{path}'").fetchall()
    rows = hilbert.query(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r.doc_id, r.size, len(rows)) for r in rows) == sorted(want)
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(path).collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    counts = [sum(r.shard == k for r in rows) for k in range(40)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(counts[k])) for k in range(40))
    # Shards follow each other on the curve.
    ends = [(min(r.curve for r in rows if r.shard == k), max(r.curve for r in rows if r.shard == k)) for k in range(40)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
