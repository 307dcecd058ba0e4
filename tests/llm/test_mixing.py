import duckdb
import pytest
from odd_rows import DATA, ODD
from pyspark.sql import functions as F

from tallystone.llm import mixing


def brute(sizes, weights=mixing.WEIGHTS, share=1.5, most=2):
    """Excess above the stops goes round by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        level = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        above = [s for s in rest if level[s] > most * sizes[s]]
        if not above:
            return stopped | level
        stopped |= {s: float(most * sizes[s]) for s in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 30, None: 7}, {"a": 5}, {"a": 0, "b": 9}, {None: 0}, {f"s{i}": (i * 37) % 101 for i in range(50)}, {"é": 1, "z": 1, "Z": 10**9}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute(sizes))


def test_words_of_odd_rows(odd):
    import re

    got = sorted(r[0] for r in odd.select(mixing.word_count()).collect())
    assert got == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in ODD)


def test_copies_and_emission(spark, docs, odd, none):
    mixed = mixing.with_copies(docs.withColumn("size", mixing.word_count()))
    rows = mixed.collect()
    assert len(rows) == docs.count()
    for r in rows:
        rate = r.target / r.source_size
        assert r.copies in (int(rate), int(rate) + 1) and r.copies <= 2
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.with_copies(docs.withColumn("size", mixing.word_count()).repartition(3)).collect()))
    emitted = mixing.emit(mixed)
    assert emitted.count() == sum(r.copies for r in rows)
    sized = odd.withColumn("size", mixing.word_count())
    found = mixing.with_copies(sized).collect()
    assert len(found) == len(ODD) and all(r.copies is not None for r in found)
    assert len({r.copies for r in found if r.doc_id == 4}) == 1
    assert mixing.emit(mixing.with_copies(none.withColumn("size", mixing.word_count()))).count() == 0


def test_large_source_tables_are_joined_by_shuffle(docs, monkeypatch):
    sized = docs.withColumn("size", mixing.word_count())
    small = sorted(map(tuple, mixing.with_copies(sized).select("doc_id", "copies").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.with_copies(sized).select("doc_id", "copies").collect())) == small


def test_expected_share_of_bernoulli_copies(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("size"))
    taken = mixing.with_copies(df).agg(F.sum("copies")).first()[0]
    assert taken == pytest.approx(30_000, rel=0.02)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(mixing.ORACLE_SQL)
    got = mixing.query(spark, DATA)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_names_that_the_mix_makes(docs):
    sized = docs.withColumn("weight", mixing.word_count())
    with pytest.raises(ValueError, match="weight"):
        mixing.with_copies(sized, size_col="weight")
    with pytest.raises(ValueError, match="__rate"):
        mixing.with_copies(sized.withColumn("size", F.lit(1)).withColumn("__rate", F.lit(1)))
    named = docs.select(F.col("doc_id").alias("n"), F.col("source").alias("place"), mixing.word_count().alias("w"), F.lit("x").alias("copies"))
    plain = mixing.with_copies(docs.withColumn("size", mixing.word_count()))
    assert sorted(map(tuple, mixing.with_copies(named, "w", "place", "n").select("n", "copies").collect())) == sorted(map(tuple, plain.select("doc_id", "copies").collect()))
