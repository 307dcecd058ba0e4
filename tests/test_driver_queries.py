"""Every driver query against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, values):
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    return columns, sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in values), key=key)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.sql(entry.oracle_sql()[name])
    assert rows(columns, [[r[c] for c in columns] for r in df.collect()]) == rows(sorted(found.columns), [[r[found.columns.index(c)] for c in columns] for r in found.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_each_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_texts_that_begin_alike_are_not_repeats(spark, tmp_path):
    head = "x" * 60
    rows = [(1, head + "a"), (2, head + "b"), (3, head + "a"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["dedupe_last_wins"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in found) == [2, 3]
    counts = {r.status: r.n for r in entry.queries()["dest_duplicates_extra"](spark, str(tmp_path)).collect()}
    assert counts == {"Identical": 1, "Extra": 2}


def test_order_0_is_a_child_of_its_index_block(spark, tmp_path):
    spark.createDataFrame([(0, 186), (1, 186), (500, 186), (2, 5), (3, 7)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = entry.queries()["index_blocks"](spark, str(tmp_path))
    sql = duckdb.connect().sql(entry.oracle_sql()["index_blocks"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'"))
    assert sorted(tuple(r) for r in found.select(*sql.columns).collect()) == sorted(sql.fetchall())
    assert (186, "0:0:o0,1:1:o1", False) in found.collect()
