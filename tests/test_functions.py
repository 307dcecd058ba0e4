"""Functions against independent statements of their rules, on drawn inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallystone.functions import paths, text
from tallystone.spec import ExportFormat, Status


def drawn(parts, n=400, most=7, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]


def values(spark, column, rows, schema="a string, b string"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(column).collect()]


PATHS = drawn(["\\", "\\", "\\\\?\\", "UNC\\", "Q:", "/", "é", "vault", "7"])


def root_of(path):
    for prefix, instead in (("\\\\?\\UNC\\", "\\\\"), ("\\\\?\\", "")):
        if path.startswith(prefix):
            path = instead + path[len(prefix) :]
            break
    while len(path) > 3 and path.endswith("\\"):
        path = path[:-1]
    return "\\" if path == "\\\\" else path


def test_normalize_root(spark):
    assert values(spark, paths.normalize_root(F.col("a")), [(p, "") for p in PATHS]) == [root_of(p) for p in PATHS]
    assert [paths.normalize_root_value(p) for p in PATHS] == [root_of(p) for p in PATHS]
    assert sum(root_of(p) != p for p in PATHS) > 50


def test_join_prefix_and_base_name(spark):
    pairs = list(zip(PATHS, PATHS[::-1], strict=True)) + [("", "q"), ("q", "")]
    assert values(spark, paths.join_rel(F.col("a"), F.col("b")), pairs) == [b if not a else a + "\\" + b for a, b in pairs]
    assert values(spark, paths.make_absolute(F.col("a"), F.col("b")), pairs) == [a if not b else a + "\\" + b for a, b in pairs]
    long = lambda p: p if p[:4] == "\\\\?\\" else "\\\\?\\UNC" + p[1:] if p[:2] == "\\\\" else "\\\\?\\" + p
    assert values(spark, paths.add_long_path_prefix(F.col("a")), pairs) == [long(a) for a, _ in pairs]
    assert values(spark, paths.base_name(F.col("a")), pairs) == [a.replace("/", "\\").rpartition("\\")[2] for a, _ in pairs]
    assert values(spark, paths.is_unc(F.col("a")), pairs) == [a[:1] in ("\\", "/") and a != "" for a, _ in pairs]


def test_fold_is_one_to_one(spark):
    names = drawn(["m", "Q", "ß", "ﬂ", "ö", "я", "Ж", "ı", "9", "日", "\\", "ǆ"])
    want = ["".join(c.upper() if len(c.upper()) == 1 else c for c in n) for n in names]
    got = values(spark, paths.fold(F.col("a")), [(n, "") for n in names])
    assert got == want and all(len(a) == len(b) for a, b in zip(got, names, strict=True))


@pytest.mark.parametrize("separator", ["\\", "/"])
def test_ancestors(spark, separator):
    names = drawn([separator, "u", "vw", " "], seed=2)
    want = [[separator.join(n.split(separator)[:k]) for k in range(1, len(n.split(separator)))] for n in names]
    assert values(spark, paths.ancestors(F.col("a"), separator), [(n, "") for n in names]) == want


def csv_of(cell):
    if cell and cell[0] in "=+-@\t\r\f":
        return "\"'" + cell.replace('"', '""') + '"'
    return '"' + cell.replace('"', '""') + '"' if any(c in cell for c in ',"\r\n') else cell


def test_csv_and_json_cells(spark):
    cells = drawn(["=", "+", "-", "@", "\t", "\r", "\n", "\f", "\b", "\x02", '"', "\\", ",", "'", "ø", "k", "/"])
    assert values(spark, text.csv_cell(F.col("a")), [(c, "") for c in cells]) == [csv_of(c) for c in cells]
    assert values(spark, text.json_cell(F.col("a")), [(c, "") for c in cells]) == [json.dumps(c, ensure_ascii=False)[1:-1] for c in cells]


def test_tokens_digests_and_predicates(spark):
    tokens = values(spark, text.status_token(F.col("a")), [(s.value, "") for s in Status])
    assert tokens == [text.STATUS_TOKENS[s] for s in Status] and len(set(tokens)) == len(Status)
    blobs = [bytes(range(k, k + 9)) for k in range(0, 240, 40)]
    assert values(spark, text.hex_digest(F.col("a")), [(bytearray(b),) for b in blobs] + [(None,)], "a binary") == [b.hex() for b in blobs] + [""]
    codes = list(range(1300))
    assert [c for c, lost in zip(codes, values(spark, text.is_disconnect(F.col("a")), [(c,) for c in codes], "a int"), strict=True) if lost] == list(text.DISCONNECT_CODES)
    pairs = list(zip(PATHS, PATHS[::-1], strict=True))
    kinds = ("LocalLocal", "LocalNetwork", "NetworkNetwork")
    assert values(spark, text.io_class(F.col("a"), F.col("b")), pairs) == [kinds[sum(p[:1] in ("\\", "/") and p != "" for p in pair)] for pair in pairs]
    numbers = [random.Random(3).randrange(10**k) for k in range(1, 18)]
    grouped = [f"{n:_}".replace("_", ".") for n in numbers]
    assert values(spark, text.group_thousands_col(F.col("a")), [(n,) for n in numbers], "a long") == grouped == [text.group_thousands(n) for n in numbers]


@pytest.mark.parametrize("bad", ["", "-7", "+7", "7b", "\t7", "7\n", "0x7", "7.0", str(2**64), "٧", "1_0"])
def test_strict_numbers_reject(bad):
    assert text.parse_uint64(bad) is None


def test_strict_numbers_and_report_formats():
    assert [text.parse_uint64(str(x)) for x in (0, 7, 2**64 - 1)] == [0, 7, 2**64 - 1] and text.parse_uint64("007") == 7
    assert (text.parse_thread_count(str(text.MOST_THREADS)), text.parse_thread_count(str(text.MOST_THREADS + 1))) == (text.MOST_THREADS, None)
    assert [text.human_bytes(x) for x in (7, 1023, 3 << 10, 7 << 19, 5 << 50, 1 << 62)] == ["7 B", "1023 B", "3.00 KB", "3.50 MB", "5.00 PB", "4096.00 PB"]
    assert [text.format_time(x) for x in (0.2, 119.6, 7322, 400_000)] == ["00:00:00", "00:02:00", "02:02:02", "111:06:40"]
    assert [text.format_rate(3 << 20, x) for x in (0, -1, 2)] == ["n/d", "n/d", "1.50 MB/s"]
    assert [text.default_threads(n, c) for n, c in ((False, 12), (True, 12), (False, 3), (True, 0))] == [8, 4, 3, 4]
    assert [text.infer_format(x) for x in ("x/out.Json", "out.json.txt", "json", "a.json\\b")] == [ExportFormat.JSON, ExportFormat.CSV, ExportFormat.CSV, ExportFormat.CSV]
