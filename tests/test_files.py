import hashlib
import io
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from trees import differing, fixture, put

from tallystone import cli
from tallystone.operators import content
from tallystone.plans import reconcile
from tallystone.sources import cache, export, file_records, listing, snapshot, tree
from tallystone.spec import Enumeration, ExportFormat, Mode, OptionError, ReconcileSpec
from tallystone.streaming import control


@pytest.fixture
def trees(tmp_path):
    source, dest = tmp_path / "s", tmp_path / "d"
    source.mkdir()
    dest.mkdir()
    return source, dest


def run(spark, source=None, dest=None, **options):
    return reconcile.run(spark, ReconcileSpec(str(source) if source else None, str(dest) if dest else None, **options))


def test_tree_lists_hidden_and_empty_and_does_not_follow_links(spark, tmp_path):
    put(tmp_path, ".hidden/_x", b"1")
    put(tmp_path, "a/b", b"22")
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path / "a", tmp_path / "link")
    entries, errors = tree.scan(spark, str(tmp_path))
    got = {r.relative_path: (r.size, r.is_directory) for r in entries.collect()}
    assert got == {".hidden": (0, True), ".hidden/_x": (1, False), "a": (0, True), "a/b": (2, False), "empty": (0, True), "link": (0, True)}
    assert errors.count() == 0
    assert entries.select("seq").distinct().count() == len(got)


def test_a_flat_directory_is_listed_in_parts(spark, tmp_path, monkeypatch):
    for i in range(60):
        put(tmp_path, f"flat/f{i}", b"1")
        put(tmp_path, f"g{i}", b"1")
    put(tmp_path, "flat/sub/x", b"1")
    monkeypatch.setattr(tree, "LIST_ENTRIES", 10)
    ranges = tree.FileTree({"path": str(tmp_path)}).reader(None).partitions()
    assert [(p.top, p.deep, p.parts) for p in ranges] == [("", False, 7)] * 7 + [("flat", False, 7)] * 7 + [("flat/sub", True, 1)]
    rows = [r for p in ranges for r in tree.FileTree({"path": str(tmp_path)}).reader(None).read(p)]
    assert sorted(r[0] for r in rows) == sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*"))
    assert len({r[6] for r in rows}) == len(rows)
    entries, _ = tree.scan(spark, str(tmp_path))
    assert entries.count() == len(rows)


def test_differing_trees_by_content(spark, trees):
    differing(*trees)
    report = run(spark, *trees)
    s = report.stats
    assert (s["identical_files"], s["identical_dirs"], s["missing_files"], s["missing_dirs"], s["extra_files"], s["extra_dirs"], s["size_mismatch"], s["content_mismatch"]) == (2, 1, 1, 1, 1, 1, 1, 1)
    assert report.hashed == 6  # three pairs of equal size


def test_self_compare_and_deep_paths(spark, trees):
    fixture(trees[0])
    for mode in (Mode.PRESENCE, Mode.CONTENT):
        report = run(spark, trees[0], trees[0], mode=mode)
        assert (report.stats["identical_files"], report.stats["identical_dirs"]) == (6, 23)
        assert report.problems.isEmpty()


def test_bad_roots(spark, trees):
    assert not run(spark, trees[0] / "no", trees[1]).source_ok
    assert not run(spark, trees[0], trees[1] / "no").dest_ok
    put(trees[0], "f", b"")
    assert not run(spark, trees[0] / "f", trees[1]).source_ok


def test_unreadable_and_vanished_files(tmp_path, monkeypatch):
    put(tmp_path, "f", b"abc")
    stat = os.stat(tmp_path / "f")
    args = str(tmp_path / "f"), 3, content.ticks(stat.st_mtime_ns)
    assert content.file_digest(*args) == (hashlib.sha256(b"abc").digest(), "ok", False)
    assert content.file_digest(args[0], 4, args[2])[2]
    assert content.file_digest(args[0], 3, args[2] - 1)[2]
    assert content.file_digest(str(tmp_path / "g"), 3, 0)[1] == "read_error"

    def denied(*_):
        raise PermissionError

    monkeypatch.setattr(os, "stat", denied)
    assert content.file_digest(*args)[1] == "no_access"


def test_errors_of_a_scan(tmp_path, monkeypatch):
    put(tmp_path, "denied/x", b"1")
    put(tmp_path, "ok/x", b"1")
    real = os.scandir

    def scandir(path):
        if str(path).endswith("denied"):
            raise PermissionError(13, "denied")
        return real(path)

    monkeypatch.setattr(tree.os, "scandir", scandir)
    rows = list(tree.walk(str(tmp_path)))
    assert [(r[0], r[6]) for r in rows if r[6] is not None] == [("denied", 5)]
    assert sorted(r[0] for r in rows if r[6] is None) == ["denied", "ok", "ok/x"]


def test_exports_byte_by_byte(spark, tmp_path):
    rows = spark.createDataFrame([(0, "SizeMismatch", 'sub,a"b\nc.txt', 10, 12, None, None), (1, "Missing", "=SUM(A1:A9).txt", 3, 0, None, None), (2, "ContentMismatch", "pàè.io", 5, 5, bytearray(range(32)), bytearray(32))], "ord int, status string, relative_path string, size_source long, size_dest long, hash_source binary, hash_dest binary")
    assert export.write(rows, str(tmp_path / "o.csv")) == ExportFormat.CSV
    hashed = bytes(range(32)).hex()
    assert (tmp_path / "o.csv").read_bytes() == ("\ufeffstatus,path,size_source,size_destination,hash_source,hash_destination\n" 'DIM_DIVERSA,"sub,a""b\nc.txt",10,12,,\n' "MANCANTE,\"'=SUM(A1:A9).txt\",3,0,,\n" f"CONTENUTO_DIVERSO,pàè.io,5,5,{hashed},{'00' * 32}\n").encode()
    assert export.write(rows, str(tmp_path / "o.JSON")) == ExportFormat.JSON
    raw = (tmp_path / "o.JSON").read_bytes()
    assert raw.startswith(b'[\n{"status":"DIM_DIVERSA","path":"sub,a\\"b\\nc.txt","size_source":10,"size_destination":12,"hash_source":"","hash_destination":""},\n')
    assert raw.endswith(b"}\n]\n") and len(json.loads(raw)) == 3
    export.write(rows.limit(0), str(tmp_path / "e.json"))
    assert (tmp_path / "e.json").read_bytes() == b"[\n\n]\n"


def test_snapshots(spark, trees, tmp_path):
    source, dest = trees
    put(source, "alpha.txt", b"hello world")
    put(source, "beta.bin", b"12345")
    saved = str(tmp_path / "snap")
    assert run(spark, source, snapshot_out=saved).snapshot_written
    put(dest, "alpha.txt", b"HELLO world")
    put(dest, "beta.bin", b"12345")
    report = run(spark, dest=dest, compare=saved)
    assert (report.stats["identical_files"], report.stats["content_mismatch"], report.degraded) == (1, 1, False)
    run(spark, source, snapshot_out=saved, mode=Mode.SIZE)
    report = run(spark, dest=dest, compare=saved)
    assert report.degraded and report.stats["identical_files"] == 2
    (tmp_path / "junk").mkdir()
    assert not run(spark, dest=dest, compare=str(tmp_path / "junk")).source_ok


def test_snapshot_case_policy_overrides(spark, trees, tmp_path):
    put(trees[0], "A.txt", b"1")
    put(trees[1], "a.txt", b"1")
    run(spark, trees[0], snapshot_out=str(tmp_path / "snap"), case_sensitive=True)
    report = run(spark, dest=trees[1], compare=str(tmp_path / "snap"))
    assert (report.stats["missing_files"], report.stats["extra_files"]) == (1, 1)


def test_binary_snapshots_are_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "RANGE_ENTRIES", 7)
    rows = spark.range(40).selectExpr("concat('d/', id) AS relative_path", "id AS size", "id AS last_write_time", "id AS attributes", "id AS file_id", "false AS is_directory", "id AS seq", "IF(id % 2 = 0, unhex(sha2(cast(id AS string), 256)), NULL) AS digest")
    file = str(tmp_path / "s.bin")
    snapshot.write_binary(rows, file, "/", False)
    back = snapshot.read_binary(spark, file).entries
    assert back.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    snapshot.write_binary(rows.limit(0), file, "/", False)
    assert snapshot.read_binary(spark, file).entries.count() == 0
    snapshot.write_binary(rows.limit(1), file, "/", False)
    data = bytearray(Path(file).read_bytes())
    data[data.index(b"d/0")] = 0xFF
    Path(file).write_bytes(data)
    with pytest.raises(snapshot.SnapshotError):
        snapshot.read_binary(spark, file)


def test_exports_as_folders(spark, tmp_path):
    rows = spark.range(100).selectExpr("cast(id % 3 AS int) AS ord", "cast(id AS string) AS key", "'Missing' AS status", "concat('p', id) AS relative_path", "id AS size_source", "0L AS size_dest", "cast(NULL AS binary) AS hash_source", "cast(NULL AS binary) AS hash_dest")
    export.write(rows, str(tmp_path / "o.csv"))
    export.write_folder(rows, str(tmp_path / "folder"))
    lines = [line for f in sorted((tmp_path / "folder").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == (tmp_path / "o.csv").read_text("utf-8-sig").splitlines()[1:]


def test_binary_snapshots(spark, tmp_path):
    rows = [("é/x", 5, 7, 32, 9, False, 0, bytearray(range(32))), ("é", 0, 1, 16, 2, True, 1, None)]
    df = spark.createDataFrame(rows, "relative_path string, size long, last_write_time long, attributes long, file_id long, is_directory boolean, seq long, digest binary")
    file = str(tmp_path / "s.bin")
    snapshot.write_binary(df, file, "/root é", True)
    back = snapshot.read_binary(spark, file)
    assert (back.root, back.case_sensitive) == ("/root é", True)
    assert sorted(map(tuple, back.entries.collect())) == sorted(map(tuple, df.collect()))
    data = Path(file).read_bytes()
    for broken in (b"junk", data[:-1], b"XXXX" + data[4:]):
        Path(file).write_bytes(broken)
        with pytest.raises(snapshot.SnapshotError):
            snapshot.read_binary(spark, file)


def test_cache(spark, trees, tmp_path):
    for i in range(20):
        put(trees[0], f"f{i}", b"%05d" % i)
        put(trees[1], f"f{i}", b"%05d" % i)
    kept = str(tmp_path / "cache")
    first = run(spark, *trees, hash_cache=kept)
    assert (first.cache_hits, first.hashed) == (0, 40)
    put(trees[1], "f3", b"xxxxx")
    os.utime(trees[1] / "f3", ns=(1, 1))
    second = run(spark, *trees, hash_cache=kept)
    assert (second.cache_hits, second.hashed, second.stats["content_mismatch"]) == (39, 1, 1)
    found, warning = cache.read(spark, kept)
    assert found.count() == 40 and warning is None
    assert cache.read(spark, str(tmp_path / "none"))[0].count() == 0


def test_a_cache_with_a_damaged_body_is_empty_with_a_warning(spark, tmp_path):
    kept = str(tmp_path / "cache")
    rows = spark.range(1000).selectExpr("concat('/f', id) AS abs_path", "id AS size", "id AS last_write_time", "unhex(sha2(cast(id AS string), 256)) AS digest")
    cache.save(rows.coalesce(1), kept)
    file = next(Path(kept).rglob("*.parquet"))
    data = bytearray(file.read_bytes())
    data[8 : len(data) // 2] = b"\xff" * (len(data) // 2 - 8)
    for checksum in file.parent.glob(".*.crc"):
        checksum.unlink()
    file.write_bytes(data)
    found, warning = cache.read(spark, kept)
    assert "can't be read" in warning and found.count() == 0


def dump_of(spark, root, folder, broken=False):
    """The file records of a tree, as a dump."""
    numbers = {"": 5} | {str(p.relative_to(root)): i for i, p in enumerate(sorted(root.rglob("*")), 40)}
    rows = []
    for path, number in numbers.items():
        stat, is_dir = os.stat(root / path), (root / path).is_dir()
        kids = [(numbers[str(p.relative_to(root))], 1, p.name) for p in (root / path).iterdir()] if is_dir else None
        name = (numbers[str(Path(path).parent).removeprefix(".")], 1, 1, Path(path).name) if path else (5, 1, 3, ".")
        rows.append((number, bytearray(file_records.written_record(1, 3 if is_dir else 1, [name], None if is_dir else stat.st_size, kids, last_write_time=content.ticks(stat.st_mtime_ns)))))
    if broken:
        rows[-1] = (rows[-1][0], bytearray(b"BAAD" + bytes(1020)))
    spark.createDataFrame(rows, "record long, data binary").write.parquet(f"{folder}/records")
    spark.createDataFrame([], "parent long, data binary").write.parquet(f"{folder}/blocks")
    return str(folder)


def test_sides_are_listed_from_dumps(spark, trees, tmp_path):
    differing(*trees)
    dumps = dict(source_records=dump_of(spark, trees[0], tmp_path / "sr"), dest_records=dump_of(spark, trees[1], tmp_path / "dr"))
    walked = run(spark, *trees)
    assert walked.listed == {"source": Enumeration.WALK, "dest": Enumeration.WALK}
    for options in (dumps, dumps | {"enum": Enumeration.RECORDS}):
        report = run(spark, *trees, **options)
        assert report.listed == {"source": Enumeration.RECORDS, "dest": Enumeration.RECORDS}
        assert report.stats == walked.stats and report.hashed == walked.hashed and not report.messages
        shown = lambda r: sorted((p.status, p.relative_path, p.size_source, p.size_dest) for p in r.problems.collect())
        assert shown(report) == shown(walked)
    one = run(spark, *trees, **(dumps | {"dest_records": None}))  # not all sides have a dump
    assert one.listed == walked.listed and not one.messages
    assert run(spark, *trees, enum=Enumeration.WALK, **dumps).listed == walked.listed


def test_an_incomplete_dump_is_walked_instead(spark, trees, tmp_path):
    differing(*trees)
    dumps = dict(source_records=dump_of(spark, trees[0], tmp_path / "sr"), dest_records=dump_of(spark, trees[1], tmp_path / "dr", broken=True))
    report = run(spark, *trees, **dumps)
    assert report.listed == {"source": Enumeration.RECORDS, "dest": Enumeration.WALK}
    assert len(report.messages) == 1 and "dest: the dump isn't complete" in report.messages[0]
    assert report.stats == run(spark, *trees).stats
    with pytest.raises(listing.IncompleteDump):
        listing.from_records(spark, dumps["dest_records"])
    report = run(spark, *trees, enum=Enumeration.RECORDS, dest_records=str(tmp_path / "no"))
    assert len(report.messages) == 2 and report.stats == run(spark, *trees).stats


def test_a_changed_file_is_reported_and_not_cached(spark, trees, tmp_path):
    put(trees[0], "f", b"1")
    rows = spark.createDataFrame([(str(trees[0] / "f"), 1, 5)], "abs_path string, size long, last_write_time long")
    found = content.digests(rows)
    assert found.first().changed
    assert cache.merged(spark.createDataFrame([], cache.SCHEMA), found).count() == 0


def test_options():
    for bad in (dict(), dict(source="a"), dict(source="a", compare="c", dest="d"), dict(compare="c"), dict(snapshot_out="s"), dict(compare="c", snapshot_out="s", dest="d")):
        with pytest.raises(OptionError):
            ReconcileSpec(**bad).checked()
    with pytest.raises(OptionError):
        cli.parse_args(["--source", "a", "--dest", "b", "--threads", "4097"])


def test_command_line(spark, trees, tmp_path, capsys):
    differing(*trees)
    out = io.StringIO()
    args = ["--source", str(trees[0]), "--dest", str(trees[1]), "--list-problems", "--limit", "3", "--export", str(tmp_path / "o.csv")]
    assert cli.main(args, spark, out) == 0
    assert "missing files: 1" in out.getvalue() and "EXTRA  c_extra.bin" in out.getvalue()
    assert (tmp_path / "o.csv").read_text("utf-8-sig").count("\n") == 7
    assert cli.main([*args, "--strict-exit"], spark, io.StringIO()) == 2
    assert cli.main(["--bad"], spark, out) == 1


def test_cancelled_runs_have_no_result(spark, trees):
    stopped = control.Control(spark)
    stopped.cancel()
    with pytest.raises(control.Cancelled):
        reconcile.run(spark, ReconcileSpec(str(trees[0]), str(trees[1])), stopped)


def test_counting_on_the_way(spark, trees):
    fixture(trees[0])
    df, seen = control.counted(tree.scan(spark, str(trees[0]))[0], "source")
    df.agg(F.count(F.lit(1))).collect()
    df.collect()
    assert seen.get["files"] == 6
