import pytest
from pyspark.sql import functions as F

from tallystone.operators import classify, keying, leafdirs, records
from tallystone.plans import reconcile
from tallystone.spec import Mode, Status

SCHEMA = "relative_path string, size long, is_directory boolean, seq long, digest binary"


def entries(spark, rows):
    """(path, content or None for a directory)"""
    import hashlib

    return spark.createDataFrame([(p, 0 if c is None else len(c), c is None, i, None if c is None else hashlib.sha256(c).digest()) for i, (p, c) in enumerate(rows)], SCHEMA)


SOURCE = [("a.txt", b"sames\0\0\0"), ("b_missing.bin", b"x" * 28), ("d.bin", b"x" * 20), ("e.bin", b"AAAABBBB"), ("sub", None), ("sub\\f.txt", b"f0"), ("empty_src", None)]
DEST = [("a.txt", b"sames\0\0\0"), ("c_extra.bin", b"x" * 38), ("d.bin", b"x" * 40), ("e.bin", b"BBBBAAAA"), ("sub", None), ("sub\\f.txt", b"f0"), ("empty_dst", None)]


@pytest.mark.parametrize("mode, identical, size, content", [(Mode.PRESENCE, 4, 0, 0), (Mode.SIZE, 3, 1, 0), (Mode.CONTENT, 2, 1, 1)])
def test_differing_trees(spark, mode, identical, size, content):
    results, counters = reconcile.reconcile(entries(spark, SOURCE), entries(spark, DEST), mode)
    got = counters.first().asDict()
    assert (got["identical_files"], got["size_mismatch"], got["content_mismatch"]) == (identical, size, content)
    assert (got["identical_dirs"], got["missing_files"], got["missing_dirs"], got["extra_files"], got["extra_dirs"]) == (1, 1, 1, 1, 1)
    assert (got["source_files"], got["source_dirs"], got["bytes_source"], got["bytes_dest"]) == (5, 2, 66, 96)
    shown = reconcile.problems(results).orderBy("ord", "key").collect()
    assert all(r.status != Status.IDENTICAL.value for r in shown)
    with_hash = [r for r in shown if r.hash_source is not None]
    assert [r.status for r in with_hash] == ["ContentMismatch"] * content


def test_source_last_wins_and_dest_first_matches(spark):
    last = keying.last_wins(keying.keyed(entries(spark, [("Foo.txt", b"1"), ("foo.TXT", b"22")]))).collect()
    assert [(r.relative_path, r.size) for r in last] == [("foo.TXT", 2)]
    results, counters = reconcile.reconcile(entries(spark, [("K", b"1"), ("k", b"22")]), entries(spark, [("k", b"22"), ("K", b"333"), ("kk", b"")]), Mode.SIZE)
    assert sorted((r.status, r.relative_path, r.size_dest) for r in results.collect()) == [("Extra", "K", 3), ("Extra", "kk", 0), ("Identical", "k", 2)]
    assert counters.first().dest_files == 3


def test_case_policy(spark):
    a, b = entries(spark, [("Foo", None), ("Foo\\a.txt", b"x")]), entries(spark, [("foo", None), ("foo\\A.TXT", b"x")])
    assert reconcile.reconcile(a, b, Mode.CONTENT)[1].first().identical_files == 1
    exact = reconcile.reconcile(a, b, Mode.CONTENT, True)[1].first()
    assert (exact.missing_files, exact.extra_files, exact.identical_files) == (1, 1, 0)
    folded = reconcile.reconcile(a, b, Mode.PRESENCE)[0].where("not is_directory").first()
    assert folded.relative_path == "foo\\A.TXT"


def test_type_conflict_is_a_size_mismatch_in_every_mode(spark):
    for mode in Mode:
        row = reconcile.reconcile(entries(spark, [("x", None)]), entries(spark, [("x", b"")]), mode)[0].first()
        assert (row.status, row.is_directory) == ("SizeMismatch", False)


def test_leaf_directories(spark):
    source = entries(spark, [("a", None), ("a\\b", None), ("a\\b\\f", b"1"), ("e", None), ("e\\g", None), ("ab", None)])
    results, counters = reconcile.reconcile(source, entries(spark, []), Mode.PRESENCE)
    assert counters.first().missing_dirs == 5
    shown = reconcile.problems(results).orderBy("ord", "key").collect()
    assert [r.relative_path for r in shown] == ["a\\b\\f", "ab", "e\\g"]


def test_leaf_rule_uses_the_case_policy_on_both_sides(spark):
    extra = entries(spark, [("a", None), ("A", None), ("A\\x", b"1")])
    results, _ = reconcile.reconcile(entries(spark, []), extra, Mode.PRESENCE, True)
    assert sorted(r.relative_path for r in reconcile.problems(results).collect()) == ["A\\x", "a"]


def test_content_states(spark):
    rows = [("ok", b"1"), ("denied", b"1"), ("gone", b"1"), ("changed", b"1"), ("nodigest", b"1")]
    a = entries(spark, rows).withColumn("digest", F.when(F.col("relative_path") != "nodigest", F.col("digest")))
    b = entries(spark, rows).withColumn("content_state", F.when(F.col("relative_path") == "denied", "no_access").when(F.col("relative_path") == "gone", "read_error")).withColumn("changed", F.col("relative_path") == "changed")
    got = {r.relative_path: r.status for r in reconcile.reconcile(a, b, Mode.CONTENT)[0].collect()}
    assert got == {"ok": "Identical", "denied": "AccessDenied", "gone": "ReadError", "changed": "ChangedDuringScan", "nodigest": "ReadError"}


def test_empty_and_null(spark):
    none = entries(spark, [])
    assert reconcile.reconcile(none, none, Mode.CONTENT)[1].first().source_files == 0
    with pytest.raises(Exception, match="relative_path is null"):
        reconcile.reconcile(entries(spark, [(None, b"x")]), none, Mode.SIZE)[0].collect()


def test_under_flags_rows_below_errors(spark):
    rows = spark.createDataFrame([("A\\B",), ("A\\C\\D",), ("X",), ("A",)], "key string")
    got = leafdirs.under(rows, spark.createDataFrame([("A\\C",)], "key string")).collect()
    assert {r.key: r.under_error for r in got} == {"A\\B": False, "A\\C\\D": True, "X": False, "A": False}


def test_errors_become_rows(spark):
    errors = spark.createDataFrame([("p", "denied", 5, False), ("q", "io", 32, False)], "path string, message string, code int, lost_device boolean")
    assert sorted((r.status, r.relative_path, r.error_message) for r in classify.errors_as_rows(errors).collect()) == [("AccessDenied", "p", "denied"), ("ReadError", "q", "io")]


def test_filters(spark):
    results, _ = reconcile.reconcile(entries(spark, SOURCE), entries(spark, DEST), Mode.CONTENT)
    shown = reconcile.problems(results)
    assert {v: reconcile.filtered(shown, v).count() for v in ("all", "identical", "missing", "extra", "size", "content", "errors")} == {"all": 6, "identical": 0, "missing": 2, "extra": 2, "size": 1, "content": 1, "errors": 0}


def test_record_graph(spark):
    rows = spark.createDataFrame([(5, 5, "."), (6, 5, "a"), (7, 6, "b"), (8, 7, "c"), (9, 99, "orphan")], "record long, parent long, name string")
    assert {r.path: r.depth for r in records.walk(rows, 5).collect()} == {"a": 1, "a\\b": 2, "a\\b\\c": 3}
    refs = spark.createDataFrame([((3 << 48) | 42,), (-1,)], "ref long")
    record, sequence = records.split_ref(F.col("ref"))
    assert [tuple(r) for r in refs.select(record, sequence).collect()] == [(42, 3), (2**48 - 1, 65535)]
    keep = spark.createDataFrame([(5, "$x"), (5, "x"), (24, "$x")], "r long, n string")
    assert [r[0] for r in keep.select(records.user_record(F.col("r"), F.col("n"))).collect()] == [False, True, True]


def test_chain_ends_at_cycles_and_stale_parents(spark):
    rows = spark.createDataFrame([(1, 1, 2, 1), (2, 1, 1, 1), (3, 1, 9, 1)], "record long, sequence long, parent long, parent_sequence long")
    got = records.parent_chain(rows, rows, 0).collect()
    assert sum(r.start == 1 for r in got) == records.MOST_CHAIN
    assert [(r.record, r.state) for r in got if r.start == 3] == [(9, "STALE")]


def test_walk_has_no_depth_limit(spark):
    chain = spark.createDataFrame([(i, i - 1, f"d{i}") for i in range(1, 91)], "record long, parent long, name string")
    rows = sorted(records.walk(chain, 0).collect(), key=lambda r: r.depth)
    assert [(r.record, r.depth) for r in rows] == [(i, i) for i in range(1, 91)]
    assert rows[-1].path == "\\".join(f"d{i}" for i in range(1, 91))


def test_walk_ends_at_cycles_and_keeps_hard_links(spark):
    rows = spark.createDataFrame([(1, 4, "root"), (2, 1, "a"), (3, 2, "b"), (4, 3, "c"), (2, 3, "again"), (9, 1, "link"), (9, 3, "link")], "record long, parent long, name string")
    got = sorted(r.path for r in records.walk(rows, 1).collect())
    assert got == ["a", "a\\b", "a\\b\\c", "a\\b\\link", "link"]


def test_rows_of_one_key_and_order_are_all_counted(spark):
    rows = spark.createDataFrame([("k", 1, False, 0, None), ("K", 2, False, 0, None), ("k", 1, False, 0, None), ("k", 1, False, 0, None), ("x", 5, False, 0, None)], SCHEMA)
    first, others = keying.first_match(keying.keyed(rows))
    assert sorted((r.relative_path, r.size) for r in first.collect()) == [("K", 2), ("x", 5)]
    assert [(r.relative_path, r.size) for r in others.collect()] == [("k", 1)] * 3
    assert [(r.relative_path, r.size) for r in keying.last_wins(keying.keyed(rows.where("size < 5"))).collect()] == [("k", 1)]


def test_problems_join_once(spark):
    results, _ = reconcile.reconcile(entries(spark, SOURCE), entries(spark, DEST), Mode.SIZE)
    plan = reconcile.problems(results)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") <= 2


def test_lists_of_a_report(spark):
    rows = [("m%d" % i, "Missing") for i in range(4)] + [("x", "Extra"), ("s", "SizeMismatch"), ("c", "ContentMismatch"), ("same", "Identical")]
    found = reconcile.examples(spark.createDataFrame([(k, k, s) for k, s in rows], "key string, relative_path string, status string"), 2)
    assert sorted((r.kind, r.key) for r in found.collect()) == [("differs", "c"), ("differs", "s"), ("only_dest", "x"), ("only_source", "m0"), ("only_source", "m1")]


def test_names_of_diagnostic_tools(spark):
    rows = [(1, 0, 5, 3, "a"), (1, 1, 5, 1, "b"), (1, 2, 5, 2, "B~1"), (2, 0, 5, 2, "first"), (2, 1, 5, 0, "later")]
    names = spark.createDataFrame(rows, "record long, i int, parent long, space int, name string")
    assert sorted((r.record, r.name) for r in records.diagnostic_names(names).collect()) == [(1, "b"), (2, "first")]
