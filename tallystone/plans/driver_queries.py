"""Queries over the driver's tables and their DuckDB counterparts.

The tables stand for two states: a destination is a deterministic change of the source.
"""

from __future__ import annotations

import os
import re
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions import paths, text
from tallystone.operators import classify, content, keying, leafdirs, records, stats
from tallystone.plans import reconcile
from tallystone.sources import adapter, cache, export, file_records, snapshot, tree
from tallystone.spec import ExportFormat, Mode, Status


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- documents against a changed copy ------------------------------------------------------------


def doc_sides(spark: SparkSession, sf_dir: str, digests: bool = True) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(body).cast("long")
    number = F.col("doc_id").cast("string")
    payload = [body] if digests else None
    source = adapter.table_entries(docs.where(F.col("doc_id") % 11 != 0), ["source", "lang", F.concat(F.lit("D"), number)], size, payload, seq="doc_id")
    changed = F.when(F.col("doc_id") % 5 == 0, F.lit("x")).otherwise(body)
    dest = adapter.table_entries(docs.where((F.col("doc_id") % 13 != 0) | (F.col("doc_id") % 11 == 0)), [F.lower("source"), "lang", F.concat(F.lit("d"), number)], size + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0), [changed] if digests else None, seq="doc_id")
    return source, dest


_DOC_SIDES = r"""
s AS (SELECT doc_id, upper(concat_ws('\', source, lang, 'D' || doc_id)) AS key, concat_ws('\', source, lang, 'D' || doc_id) AS path,
             CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 11 <> 0),
d AS (SELECT doc_id, upper(concat_ws('\', lower(source), lang, 'd' || doc_id)) AS key, concat_ws('\', lower(source), lang, 'd' || doc_id) AS path,
             CAST(strlen(coalesce(text, '')) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size,
             sha256(CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE coalesce(text, '') END) AS digest FROM documents WHERE doc_id % 13 <> 0 OR doc_id % 11 = 0)
"""


def _doc_status(mode: Mode) -> str:
    size = "" if mode == Mode.PRESENCE else "WHEN s.size <> d.size THEN 'SizeMismatch'"
    digest = "WHEN s.digest <> d.digest THEN 'ContentMismatch'" if mode == Mode.CONTENT else ""
    return f"""
WITH {_DOC_SIDES}, c AS (
  SELECT coalesce(s.key, d.key) AS key, coalesce(d.path, s.path) AS relative_path,
         coalesce(s.size, 0) AS size_source, coalesce(d.size, 0) AS size_dest, s.digest AS hs, d.digest AS hd,
         CASE WHEN d.key IS NULL THEN 'Missing' WHEN s.key IS NULL THEN 'Extra' {size} {digest} ELSE 'Identical' END AS status
  FROM s FULL JOIN d ON s.key = d.key)
"""


def _diff(mode: Mode):
    def query(spark, sf_dir):
        results, _ = reconcile.reconcile(*doc_sides(spark, sf_dir, mode == Mode.CONTENT), mode)
        return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("size_source").alias("bytes_source"), F.sum("size_dest").alias("bytes_dest"))

    return query, _doc_status(mode) + "SELECT status, count(*) AS n, CAST(sum(size_source) AS BIGINT) AS bytes_source, CAST(sum(size_dest) AS BIGINT) AS bytes_dest FROM c GROUP BY status"


def problem_rows(spark, sf_dir):
    results, _ = reconcile.reconcile(*doc_sides(spark, sf_dir), Mode.CONTENT)
    return reconcile.problems(results).select("status", "relative_path", "size_source", "size_dest", text.hex_digest(F.col("hash_source")).alias("hash_source"), text.hex_digest(F.col("hash_dest")).alias("hash_dest"))


_PROBLEM_ROWS = _doc_status(Mode.CONTENT) + """SELECT status, relative_path, size_source, size_dest,
  CASE WHEN status = 'ContentMismatch' THEN hs ELSE '' END AS hash_source, CASE WHEN status = 'ContentMismatch' THEN hd ELSE '' END AS hash_dest FROM c WHERE status <> 'Identical'"""


def stats_counters(spark, sf_dir):
    return reconcile.reconcile(*doc_sides(spark, sf_dir), Mode.CONTENT)[1]


_STATS = _doc_status(Mode.CONTENT) + """, z AS (SELECT CAST(0 AS BIGINT) AS zero)
SELECT (SELECT count(*) FROM s) AS source_files, zero AS source_dirs, (SELECT count(*) FROM d) AS dest_files, zero AS dest_dirs,
  count(*) FILTER (status = 'Identical') AS identical_files, zero AS identical_dirs, count(*) FILTER (status = 'Missing') AS missing_files, zero AS missing_dirs,
  count(*) FILTER (status = 'Extra') AS extra_files, zero AS extra_dirs, count(*) FILTER (status = 'SizeMismatch') AS size_mismatch,
  count(*) FILTER (status = 'ContentMismatch') AS content_mismatch, zero AS read_errors, zero AS access_denied, zero AS changed_during_scan,
  (SELECT CAST(sum(size) AS BIGINT) FROM s) AS bytes_source, (SELECT CAST(sum(size) AS BIGINT) FROM d) AS bytes_dest
FROM c, z GROUP BY zero"""


def _order_counters(spark, sf_dir):
    """Orders with directories, changes and unreadable files, of which a tenth is on either side alone."""
    orders = table(spark, sf_dir, "orders")
    number = F.col("o_orderkey")
    rows = adapter.table_entries(orders, [number], number % 100, [F.col("o_orderpriority")], seq="o_orderkey", is_directory=number % 6 == 0)
    rows = rows.withColumn("changed", F.col("seq") % 23 == 0).withColumn("content_state", F.when(F.col("seq") % 31 == 0, "no_access").when(F.col("seq") % 37 == 0, "read_error").otherwise("ok"))
    side = lambda left: rows.where(F.col("seq") % 10 != left).withColumn("size", F.col("size") + F.when((F.col("seq") % 7 == 0) & F.lit(left == 1), 1).otherwise(0))
    return reconcile.reconcile(side(0), side(1), Mode.CONTENT)[1]


_ORDER_COUNTERS = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 = 0 AS dir, o_orderkey % 100 AS size, o_orderkey % 10 <> 0 AS s, o_orderkey % 10 <> 1 AS d FROM orders),
c AS (SELECT *, CASE WHEN NOT d THEN 'missing' WHEN NOT s THEN 'extra' WHEN dir THEN 'same' WHEN k % 7 = 0 THEN 'size' WHEN k % 23 = 0 THEN 'changed' WHEN k % 31 = 0 THEN 'access' WHEN k % 37 = 0 THEN 'read' ELSE 'same' END AS status FROM o),
n AS (SELECT count(*) FILTER (s AND NOT dir) AS source_files, count(*) FILTER (s AND dir) AS source_dirs, count(*) FILTER (d AND NOT dir) AS dest_files, count(*) FILTER (d AND dir) AS dest_dirs,
  count(*) FILTER (status = 'same' AND NOT dir) AS identical_files, count(*) FILTER (status = 'same' AND dir) AS identical_dirs, count(*) FILTER (status = 'missing' AND NOT dir) AS missing_files, count(*) FILTER (status = 'missing' AND dir) AS missing_dirs,
  count(*) FILTER (status = 'extra' AND NOT dir) AS extra_files, count(*) FILTER (status = 'extra' AND dir) AS extra_dirs, count(*) FILTER (status = 'size') AS size_mismatch, CAST(0 AS BIGINT) AS content_mismatch,
  count(*) FILTER (status = 'read') AS read_errors, count(*) FILTER (status = 'access') AS access_denied, count(*) FILTER (status = 'changed') AS changed_during_scan,
  CAST(sum(size) FILTER (s AND NOT dir) AS BIGINT) AS bytes_source, CAST(sum(size + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) FILTER (d AND NOT dir) AS BIGINT) AS bytes_dest FROM c)
"""


def errors_total(spark, sf_dir):
    return stats.errors_total(_order_counters(spark, sf_dir))


# --- missing and extra rows of a table -----------------------------------------------------------


def order_results(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = adapter.table_entries(orders, [F.col("o_orderkey")], seq="o_orderkey")
    number = F.col("relative_path").cast("long")
    return reconcile.reconcile(rows.where(number % 17 != 0), rows.where((number % 19 != 0) | (number % 17 == 0)), Mode.PRESENCE)[0]


def _order_rows(status: Status):
    return lambda spark, sf_dir: order_results(spark, sf_dir).where(F.col("status") == status.value).select(F.col("relative_path").cast("long").alias("o_orderkey"))


# --- repeated keys, case, types ------------------------------------------------------------------


def _text_entries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return adapter.table_entries(docs.where("text is not null"), F.concat(F.when(F.col("doc_id") % 2 == 0, "T").otherwise("t"), F.md5(F.col("text").cast("binary"))), F.octet_length("text"), seq="doc_id")


def dedupe_last_wins(spark, sf_dir):
    return keying.last_wins(keying.keyed(_text_entries(spark, sf_dir))).select("key", "size", F.col("seq").alias("doc_id"))


def dest_duplicates_extra(spark, sf_dir):
    rows = _text_entries(spark, sf_dir)
    results, _ = reconcile.reconcile(rows.where(F.col("seq") % 2 == 0), rows, Mode.PRESENCE)
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("size_dest").alias("bytes_dest"))


def tied_rows(spark, sf_dir):
    """Rows of one key and order: one matches, every other is extra."""
    rows = adapter.table_entries(table(spark, sf_dir, "lineitem"), F.concat(F.lit("p"), F.col("l_partkey")), F.col("l_quantity").cast("long"))
    results, _ = reconcile.reconcile(rows, rows, Mode.PRESENCE, True)
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_TEXT_KEYS = "t AS (SELECT doc_id, strlen(text) AS size, upper('T' || md5(text)) AS key FROM documents WHERE text IS NOT NULL)"


def case_sensitive_vs_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    source = adapter.table_entries(rows, [F.col("c_name")], seq="c_custkey")
    dest = adapter.table_entries(rows, F.when(F.col("c_custkey") % 3 == 0, F.lower("c_name")).otherwise(F.col("c_name")), seq="c_custkey")
    parts = [reconcile.reconcile(source, dest, Mode.PRESENCE, exact)[0].groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("case_sensitive", F.lit(exact)) for exact in (False, True)]
    return parts[0].unionByName(parts[1])


def type_conflict(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    entries = lambda is_dir: adapter.table_entries(docs, [F.col("source"), F.col("doc_id")], "n_chars", seq="doc_id", is_directory=is_dir)
    results, _ = reconcile.reconcile(entries(F.col("doc_id") % 6 == 0), entries(F.col("doc_id") % 4 == 0), Mode.PRESENCE)
    return results.groupBy("status", "is_directory").agg(F.count(F.lit(1)).alias("n"))


# --- directories of page addresses ---------------------------------------------------------------


def _page_entries(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where("url is not null")
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "/+$", "")
    files = pages.select(path.alias("path"), "page_id")
    dirs = files.select(F.explode(paths.ancestors(F.col("path"), "/")).alias("path"), "page_id").groupBy("path").agg(F.min("page_id").alias("page_id")).withColumn("is_dir", F.lit(True))
    files = files.groupBy("path").agg(F.min("page_id").alias("page_id")).join(dirs.select("path"), "path", "left_anti").withColumn("is_dir", F.lit(False))
    return adapter.table_entries(files.unionByName(dirs), F.col("path"), seq="page_id", is_directory=F.col("is_dir"))


def _leaf_dirs(status: Status):
    def query(spark, sf_dir):
        rows = fixed_pages = _page_entries(spark, sf_dir)
        part = rows.where(F.col("seq") % 3 != 0)
        sides = (fixed_pages, part) if status == Status.MISSING else (part, fixed_pages)
        results, _ = reconcile.reconcile(*sides, Mode.PRESENCE, True)
        return leafdirs.without_descendants(results.where(F.col("status") == status.value), "/").select("relative_path", "is_directory")

    return query


_LEAF_DIRS = """
WITH f AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/+$', '') AS path, page_id FROM pages WHERE url IS NOT NULL),
p AS (SELECT path, page_id, string_split(path, '/') AS parts FROM f),
dirs AS (SELECT array_to_string(parts[1:i], '/') AS path, min(page_id) AS page_id FROM p, unnest(range(1, len(parts))) AS r(i) GROUP BY 1),
rows_ AS (SELECT path, page_id, true AS is_directory FROM dirs
          UNION ALL SELECT path, min(page_id), false FROM f WHERE path NOT IN (SELECT path FROM dirs) GROUP BY path),
gone AS (SELECT * FROM rows_ WHERE page_id % 3 = 0)
SELECT path AS relative_path, is_directory FROM gone g
WHERE NOT is_directory OR NOT EXISTS (SELECT 1 FROM gone h WHERE starts_with(h.path, g.path || '/'))
"""


# --- digests, snapshots, changes -----------------------------------------------------------------


def cache_hit_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    files = docs.select(F.concat(F.lit("/c/"), F.col("doc_id")).alias("abs_path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 10).alias("last_write_time"))
    kept = files.where("last_write_time % 30 <> 0").select("abs_path", F.when(F.col("last_write_time") % 70 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "last_write_time").withColumn("digest", F.unhex(F.sha2(F.col("abs_path").cast("binary"), 256)))
    hit = files.join(kept, list(cache.KEYS), "left")
    return hit.agg(F.count_if(F.col("digest").isNotNull()).alias("hits"), F.count_if(F.col("digest").isNull()).alias("misses"))


def offline_digest_compare(spark, sf_dir):
    source, dest = doc_sides(spark, sf_dir)
    # Every third file of the snapshot could not be hashed.
    source = source.withColumn("digest", F.when(F.col("seq") % 3 == 0, None).otherwise(F.col("digest")))
    results, _ = reconcile.reconcile(source, dest, Mode.CONTENT)
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def degrade_to_size(spark, sf_dir):
    source, dest = doc_sides(spark, sf_dir, digests=False)
    mode = Mode.CONTENT if not source.where(F.col("digest").isNotNull()).isEmpty() else Mode.SIZE
    results, _ = reconcile.reconcile(source, dest, mode)
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def changed_during_scan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    entries = adapter.table_entries(orders, [F.col("o_orderkey")], F.lit(8), [F.col("o_orderpriority")], seq="o_orderkey")
    source = entries.withColumn("changed", F.col("seq") % 23 == 0)
    dest = entries.withColumn("changed", F.col("seq") % 29 == 0).withColumn("content_state", F.when(F.col("seq") % 31 == 0, "no_access").when(F.col("seq") % 37 == 0, "read_error").otherwise("ok"))
    results, _ = reconcile.reconcile(source, dest, Mode.CONTENT)
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def problem_filter_errors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    errors = docs.where(F.col("doc_id") % 9 == 0).select(F.concat(F.lit("e"), F.col("doc_id")).alias("path"), F.lit("denied").alias("message"), F.when(F.col("doc_id") % 2 == 0, 5).otherwise(32).alias("code"), F.lit(False).alias("lost_device"))
    results = reconcile.reconcile(*doc_sides(spark, sf_dir), Mode.CONTENT)[0].unionByName(classify.errors_as_rows(errors))
    return reconcile.filtered(reconcile.problems(results), "errors").select("status", "relative_path", "error_message", "is_directory")


def view_counts(spark, sf_dir):
    """Rows of each view of the problems."""
    rows = reconcile.fixed(reconcile.problems(reconcile.reconcile(*doc_sides(spark, sf_dir), Mode.CONTENT)[0]), "problems")
    counts = [reconcile.filtered(rows, view).agg(F.count(F.lit(1)).alias("n")).withColumn("view", F.lit(view)) for view in ("all", "missing", "extra", "size", "content", "errors", "identical")]
    return reduce(DataFrame.unionByName, counts)


_VIEW_COUNTS = _doc_status(Mode.CONTENT) + ", v AS (SELECT * FROM (VALUES ('all', NULL), ('missing', 'Missing'), ('extra', 'Extra'), ('size', 'SizeMismatch'), ('content', 'ContentMismatch'), ('errors', 'ReadError'), ('identical', 'none')) AS t(view, status)) SELECT view, (SELECT count(*) FROM c WHERE c.status <> 'Identical' AND (v.status IS NULL OR c.status = v.status)) AS n FROM v"


def listed_examples(spark, sf_dir):
    """The first 15 rows of each kind, as a report lists them."""
    found = reconcile.examples(reconcile.reconcile(*doc_sides(spark, sf_dir), Mode.CONTENT)[0], 15)
    return found.select("kind", "key", "relative_path", "status")


_EXAMPLES = _doc_status(Mode.CONTENT) + ", k AS (SELECT *, CASE status WHEN 'Missing' THEN 'only_source' WHEN 'Extra' THEN 'only_dest' ELSE 'differs' END AS kind FROM c WHERE status <> 'Identical') SELECT kind, key, relative_path, status FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY key, relative_path) <= 15"


def limit_problems(spark, sf_dir):
    results, _ = reconcile.reconcile(*doc_sides(spark, sf_dir), Mode.CONTENT)
    return reconcile.problems(results).orderBy("ord", "key").limit(25).select("status", "relative_path")


# --- scalar functions ----------------------------------------------------------------------------


def csv_cell_escape(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cell = F.concat(F.element_at(F.array(*map(F.lit, ("", "=", "+", "-", "@", "\t"))), (F.col("doc_id") % 6 + 1).cast("int")), "text")
    return docs.select("doc_id", text.csv_cell(cell).alias("cell"))


def json_cell_escape(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cell = F.concat("text", F.lit('"\\\b\f\r\t'), F.lit("\x01"))
    return docs.select("doc_id", text.json_cell(cell).alias("cell"))


def hex_digest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.hex_digest(F.when(F.col("doc_id") % 2 == 0, F.unhex(F.sha2("text", 256)))).alias("digest"))


def status_token(spark, sf_dir):
    return reconcile.reconcile(*doc_sides(spark, sf_dir), Mode.CONTENT)[0].groupBy(text.status_token(F.col("status")).alias("token")).agg(F.count(F.lit(1)).alias("n"))


def _pages_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.element_at(F.array(*map(F.lit, ("C:\\", "\\\\?\\C:\\", "\\\\?\\UNC\\", "\\\\"))), (F.col("page_id") % 4 + 1).cast("int")), F.replace("url", F.lit("/"), F.lit("\\"))).alias("path"))


_PAGES_PATH = r"""p AS (SELECT page_id, (['C:\', '\\?\C:\', '\\?\UNC\', '\\'])[CAST(page_id % 4 + 1 AS INTEGER)] || replace(url, '/', '\') AS path FROM pages)"""
_NORMAL = r"""CASE WHEN starts_with(path, '\\?\UNC\') THEN '\\' || substr(path, 9) WHEN starts_with(path, '\\?\') THEN substr(path, 5) ELSE path END"""


def norm_root(spark, sf_dir):
    return _pages_path(spark, sf_dir).select("page_id", paths.normalize_root(F.col("path")).alias("root"))


def join_rel(spark, sf_dir):
    rows = _pages_path(spark, sf_dir)
    parent = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("path"))
    return rows.select("page_id", paths.join_rel(parent, F.lit("x")).alias("joined"), paths.make_absolute(F.col("path"), F.when(F.col("page_id") % 5 == 0, "").otherwise(F.lit("y"))).alias("absolute"))


def long_prefix(spark, sf_dir):
    return _pages_path(spark, sf_dir).select("page_id", paths.add_long_path_prefix(F.col("path")).alias("prefixed"))


def base_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.base_name(F.col("url")).alias("name"))


def fold_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", paths.fold(F.lower("c_name")).alias("folded"))


def disconnect_predicate(spark, sf_dir):
    codes = table(spark, sf_dir, "part").select((F.col("p_partkey") % 1300).alias("code")).distinct()
    return codes.select("code", text.is_disconnect(F.col("code")).alias("lost"))


def io_class(spark, sf_dir):
    rows = _pages_path(spark, sf_dir)
    return rows.select("page_id", text.io_class(F.col("path"), F.when(F.col("page_id") % 3 == 0, "/mnt/x").otherwise("D:\\x")).alias("io_class"), paths.is_unc(F.col("path")).alias("unc"))


def group_numbers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.group_thousands_col(F.col("o_orderkey") * 1003).alias("grouped"))


# --- merges and record graphs --------------------------------------------------------------------


def merge_compare(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    side = lambda keep, extra: adapter.table_entries(lines.where(keep).groupBy(key.alias("k")).agg(F.max("l_quantity").alias("q")), F.col("k"), F.col("q").cast("long") + extra)
    results, _ = reconcile.reconcile(side(F.col("l_partkey") % 10 != 0, 0), side(F.col("l_suppkey") % 7 != 0, F.when(F.col("q") == 13, 1).otherwise(0)), Mode.SIZE, True)
    only = lambda s: F.count_if(F.col("status") == s.value)
    return results.agg(only(Status.MISSING).alias("only_left"), only(Status.EXTRA).alias("only_right"), only(Status.SIZE_MISMATCH).alias("mismatched"))


_MERGE = """
WITH l AS (SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, max(l_quantity)::BIGINT AS q FROM lineitem WHERE l_partkey % 10 <> 0 GROUP BY 1),
r AS (SELECT k, q + CASE WHEN q = 13 THEN 1 ELSE 0 END AS q FROM (SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, max(l_quantity)::BIGINT AS q FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1))
SELECT count(*) FILTER (r.k IS NULL) AS only_left, count(*) FILTER (l.k IS NULL) AS only_right, count(*) FILTER (l.k = r.k AND l.q <> r.q) AS mismatched FROM l FULL JOIN r ON l.k = r.k
"""


def _records(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("record"), F.col("n_regionkey").cast("long").alias("parent"), F.col("n_name").alias("name"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("record"), F.lit(-1).cast("long").alias("parent"), F.col("r_name").alias("name"))
    return nations.unionByName(regions)


_RECORDS = "rec AS (SELECT n_nationkey + 100 AS record, n_regionkey AS parent, n_name AS name FROM nation UNION ALL SELECT r_regionkey, -1, r_name FROM region)"


def reverse_index(spark, sf_dir):
    return records.reverse_index(_records(spark, sf_dir)).select("parent", F.array_join("children", ",").alias("children"))


def tree_walk(spark, sf_dir):
    return records.walk(_records(spark, sf_dir), -1)


def parent_chain(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("sequence", F.col("record") % 3).withColumn("parent_sequence", F.when(F.col("record") % 4 == 0, F.lit(9)).otherwise(F.col("parent") % 3))
    return records.parent_chain(rows, rows.where("record >= 100"), -1)


def split_ref(spark, sf_dir):
    ref = F.shiftleft((F.col("o_custkey") % 30000).cast("long"), 48).bitwiseOR(F.col("o_orderkey"))
    record, sequence = records.split_ref(ref)
    return table(spark, sf_dir, "orders").select("o_orderkey", record.alias("record"), sequence.cast("long").alias("sequence"))


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("i")).agg(F.max(F.col("l_quantity").cast("long")).alias("length"), F.max(F.col("l_partkey") - F.col("l_suppkey")).alias("delta"))


def data_runs(spark, sf_dir):
    return records.extents(_runs(spark, sf_dir))


_RUNS = """r AS (SELECT l_orderkey AS file, l_linenumber AS i, max(l_quantity::BIGINT) AS length, max(l_partkey - l_suppkey) AS delta FROM lineitem GROUP BY 1, 2),
e AS (SELECT file, i, coalesce(sum(length) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS vcn, (sum(delta) OVER (PARTITION BY file ORDER BY i))::BIGINT AS lcn, length FROM r)"""


def extent_containment(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 60).alias("cluster"))
    return records.containing_extent(points, data_runs(spark, sf_dir), 16).select("file", "cluster", "i", "absolute")


def children_union(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("sequence", F.col("record") % 3)
    index = rows.where("record % 5 <> 0").select("parent", "record", F.when(F.col("record") % 7 == 0, F.lit(9)).otherwise(F.col("sequence")).alias("sequence"))
    said = rows.select((F.col("parent") + 1000).alias("parent"), "record", "sequence")
    return records.children(index, said, rows.withColumn("in_use", F.col("record") % 11 != 0))[0]


_CHILDREN = f"""WITH {_RECORDS}, x AS (SELECT *, record % 3 AS sequence FROM rec), live AS (SELECT * FROM x WHERE record % 11 <> 0),
i AS (SELECT parent, record FROM live WHERE record % 5 <> 0 AND record % 7 <> 0)
SELECT record, parent, 0 AS origin FROM i UNION ALL SELECT record, parent + 1000, 1 FROM live WHERE record NOT IN (SELECT record FROM i)"""


def index_violations(spark, sf_dir):
    """What an index names that isn't a live record of that sequence: the sign of an incomplete scan."""
    rows = _records(spark, sf_dir).withColumn("sequence", F.col("record") % 3)
    index = rows.where("record % 5 <> 0").select("parent", "record", F.when(F.col("record") % 7 == 0, F.lit(9)).otherwise(F.col("sequence")).alias("sequence"))
    return records.children(index, rows.select("parent", "record", "sequence"), rows.withColumn("in_use", F.col("record") % 11 != 0))[1].select("parent", "record", F.col("sequence").cast("int").alias("sequence"))


def picked_names(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_suppkey").alias("parent"), (F.col("l_linenumber") % 4).alias("space"), F.concat(F.lit("n"), F.col("l_partkey")).alias("name")).groupBy("record", "space", "name").agg(F.min("parent").alias("parent"))
    return records.picked_names(names.select("record", "parent", "space", "name")).select("record", F.col("space").cast("int").alias("space"), "name")


def diagnostic_names(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("i"), F.col("l_suppkey").alias("parent"), ((F.col("l_orderkey") + F.col("l_linenumber") * 3) % 4).cast("int").alias("space"), F.concat(F.lit("n"), F.col("l_partkey")).alias("name"))
    return records.diagnostic_names(lines)


_DIAGNOSTIC_NAMES = """WITH n AS (SELECT l_orderkey AS record, l_linenumber AS i, l_suppkey AS parent, CAST((l_orderkey + l_linenumber * 3) % 4 AS INTEGER) AS space, 'n' || l_partkey AS name FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY i DESC, parent DESC, space DESC, name DESC) AS k FROM n WHERE space IN (1, 3)),
f AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY i, parent, space, name) AS k FROM n WHERE record NOT IN (SELECT record FROM r))
SELECT record, parent, space, name FROM r WHERE k = 1 UNION ALL SELECT record, parent, space, name FROM f WHERE k = 1"""


# --- dumps of file records -----------------------------------------------------------------------


def decoded_runs(spark, sf_dir):
    """Runs as bytes, decoded, as extents."""
    lists = _runs(spark, sf_dir).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("i", "length", "delta"))).alias("runs"))

    def encoded(batches):
        for batch in batches:
            packed = [file_records.encoded_runs([(r["length"], r["delta"]) for r in runs]) for runs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["file", "data"])

    def decoded(batches):
        for batch in batches:
            rows = [(file, i, *run) for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, run in enumerate(file_records.run_list(data))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["file", "i", "length", "delta"])

    return records.extents(lists.mapInArrow(encoded, "file long, data binary").mapInArrow(decoded, "file long, i long, length long, delta long"))


def _dump(spark, sf_dir) -> DataFrame:
    """A dump whose root, 5, holds regions, which hold nations; every fourth record isn't in use."""
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 200).cast("long").alias("record"), (F.col("n_regionkey") + 100).cast("long").alias("parent"), F.col("n_name").alias("name"))
    regions = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("long").alias("record"), F.lit(5).cast("long").alias("parent"), F.col("r_name").alias("name"))
    rows = nations.withColumn("dir", F.lit(False)).unionByName(regions.withColumn("dir", F.lit(True)))
    kids = nations.groupBy(F.col("parent").alias("record")).agg(F.sort_array(F.collect_list(F.struct(F.col("record").alias("r"), F.col("name").alias("n")))).alias("kids"))

    def run(batches):
        for batch in batches:
            out = []
            for number, parent, name, is_dir, kids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                used = is_dir or number % 4 > 0
                children = [(k["r"], k["r"] % 5 + 1, k["n"]) for k in kids or []] if is_dir else None
                out.append(file_records.written_record(number % 5 + 1, used + 2 * is_dir, [(parent, 1, 2, name[:6]), (parent, 1, 1, name)], None if is_dir else number * 1000, children, [(2, 40), (1, -7)] if is_dir else None, number, 4096))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["record", "data"])

    return rows.join(kids, "record", "left").select("record", "parent", "name", "dir", "kids").mapInArrow(run, "record long, data binary")


_DUMP = "r AS (SELECT n_nationkey + 200 AS record, n_regionkey + 100 AS parent, n_name AS name, false AS dir, (n_nationkey + 200) % 4 > 0 AS used FROM nation UNION ALL SELECT r_regionkey + 100, 5, r_name, true, true FROM region)"


def record_dump(spark, sf_dir):
    found = file_records.parsed(_dump(spark, sf_dir))
    return found.select("record", "sequence", "in_use", "is_directory", "size", F.array_join(F.transform("names", lambda n: F.concat_ws(":", n["parent"], n["space"], n["name"])), ",").alias("names"), F.array_join(F.transform("index", lambda c: F.concat_ws(":", c["record"], c["sequence"], c["name"])), ",").alias("children"), F.size("index_runs").alias("runs"), "error")


def _dump_tree(spark, sf_dir):
    blocks = spark.createDataFrame([(5, bytearray(file_records.written_block([(999, 1, "gone")])))], "parent long, data binary")
    return file_records.tree_of(file_records.parsed(_dump(spark, sf_dir)), file_records.block_children(blocks), 5)


def dump_tree(spark, sf_dir):
    return _dump_tree(spark, sf_dir)[0].select("record", "relative_path", "size", "is_directory")


def dump_violations(spark, sf_dir):
    return _dump_tree(spark, sf_dir)[1]


def index_blocks(spark, sf_dir):
    """Index blocks of a customer's orders, every fifth torn and every seventh free.

    A reference of 0 stands for no file, so sequences are written from 1, as volumes do, and order 0
    is a child like the others."""
    kids = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 500).alias("parent"), F.expr("o_orderkey div 500").alias("part")).agg(F.sort_array(F.collect_set("o_orderkey")).alias("kids"))
    # A block has room for some 30 names, so each run of 20 is a block of its own.
    kids = kids.select("parent", "kids", F.explode(F.sequence(F.lit(0), F.expr("(size(kids) - 1) div 20"))).alias("block")).select("parent", F.slice("kids", F.expr("cast(20 * block + 1 as int)"), 20).alias("kids"))

    def run(batches):
        for batch in batches:
            out = []
            for parent, kids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = bytearray(file_records.written_block([(k, k % 100 + 1, f"o{k}") for k in kids], parent))
                if parent % 7 == 0:
                    block = bytearray(len(block))
                elif parent % 5 == 0:
                    block[-1] ^= 1
                out.append(bytes(block))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["parent", "data"])

    found = file_records.block_children(kids.mapInArrow(run, "parent long, data binary"))
    return found.select("parent", F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["record"], c["sequence"] - 1, c["name"])), ",").alias("children"), F.col("error").isNotNull().alias("damaged"))


# --- real files ----------------------------------------------------------------------------------


def _shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which all executors see as one of their own."""
    folder = reconcile.shared_folder(spark)
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError(f"files can't be made in {folder}: trees need a mounted folder")
    return f"{re.sub('^file:/+', '/', folder)}/tallystone/{name}-{uuid.uuid4().hex}"


def _page_tree(spark: SparkSession, sf_dir: str) -> str:
    """A file for each page, in directories by number; executors write them."""
    root = _shared_path(spark, "tree")
    number = F.col("page_id").cast("string")
    files = table(spark, sf_dir, "pages").where("page_id is not null").select(F.concat(F.lit("d"), (F.col("page_id") % 7).cast("string"), F.lit("/.x/"), number, F.lit(".html")).alias("path"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("data"))

    def run(batches):
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
                with open(os.path.join(root, path), "wb") as f:
                    f.write(data)
            yield batch.select(["path"])

    files.mapInArrow(run, "path string").agg(F.count(F.lit(1))).first()
    os.makedirs(os.path.join(root, "empty"), exist_ok=True)
    return root


_PAGE_FILES = "f AS (SELECT page_id, 'd' || page_id % 7 || '/.x/' || page_id || '.html' AS path, coalesce(html, '') AS data FROM pages WHERE page_id IS NOT NULL)"


def tree_scan(spark, sf_dir):
    return tree.scan(spark, _page_tree(spark, sf_dir))[0].select("relative_path", "size", "is_directory")


def _page_files(spark, sf_dir) -> DataFrame:
    root = _page_tree(spark, sf_dir)
    entries, _ = tree.scan(spark, root)
    return entries.where("not is_directory").select(F.concat(F.lit(root + "/"), "relative_path").alias("abs_path"), "size", "last_write_time")


def tree_digests(spark, sf_dir):
    return content.digests(_page_files(spark, sf_dir)).select(paths.base_name(F.col("abs_path")).alias("name"), text.hex_digest(F.col("digest")).alias("digest"), "content_state", "changed")


def digests_from_cache(spark, sf_dir):
    """Digests of every second file come from a saved cache, where they are marked, so that reading
    the file would give another one."""
    files = _page_files(spark, sf_dir)
    known = files.where(F.regexp_extract("abs_path", r"(\d+)\.html$", 1).cast("long") % 2 == 0).withColumn("digest", F.unhex(F.sha2(paths.base_name(F.col("abs_path")).cast("binary"), 256)))
    at = _shared_path(spark, "cache")
    cache.save(known, f"file://{at}")
    found, _ = cache.read(spark, f"file://{at}")
    return content.digests(files, found).select(paths.base_name(F.col("abs_path")).alias("name"), text.hex_digest(F.col("digest")).alias("digest"), "from_cache")


def snapshot_round_trip(spark, sf_dir):
    entries = doc_sides(spark, sf_dir)[0]
    at = f"file://{_shared_path(spark, 'snapshot')}"
    snapshot.write(entries, at, "D:\\docs", False)
    saved = snapshot.read(spark, at)
    return saved.entries.select("relative_path", "size", "is_directory", F.col("seq").alias("doc_id"), text.hex_digest(F.col("digest")).alias("digest"), F.lit(saved.root).alias("root"), F.lit(saved.case_sensitive).alias("case_sensitive"))


def binary_snapshot_round_trip(spark, sf_dir):
    entries = adapter.table_entries(table(spark, sf_dir, "customer"), [F.col("c_mktsegment"), F.col("c_name")], F.col("c_custkey") * 10, [F.col("c_name")], seq="c_custkey")
    at = _shared_path(spark, "binary-snapshot")
    os.makedirs(os.path.dirname(at), exist_ok=True)
    snapshot.write_binary(entries, at, "E:", True)
    saved = snapshot.read_binary(spark, at)
    return saved.entries.select("relative_path", "size", text.hex_digest(F.col("digest")).alias("digest"), F.lit(saved.root).alias("root"), F.lit(saved.case_sensitive).alias("case_sensitive"))


def _whole_export(kind: ExportFormat):
    def query(spark, sf_dir):
        at = _shared_path(spark, "export")
        os.makedirs(os.path.dirname(at), exist_ok=True)
        export.write(reconcile.problems(reconcile.reconcile(*doc_sides(spark, sf_dir), Mode.CONTENT)[0]), at, kind)
        whole = spark.read.format("binaryFile").load(f"file://{at}").select("content")
        return whole.select(F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))

    return query


def _export_lines(line):
    return lambda spark, sf_dir: reconcile.problems(reconcile.reconcile(*doc_sides(spark, sf_dir), Mode.CONTENT)[0]).select(line().alias("line"))


_STATUS_COUNTS = "SELECT status, count(*) AS n FROM c GROUP BY status"
_TOKENS = " ".join(f"WHEN '{s.value}' THEN '{t}'" for s, t in text.STATUS_TOKENS.items())
_CSV_PATH = """CASE WHEN regexp_matches(relative_path, '[,"]') THEN '"' || replace(relative_path, '"', '""') || '"' ELSE relative_path END"""


_CSV_LINES = _doc_status(Mode.CONTENT) + f"SELECT concat_ws(',', CASE status {_TOKENS} END, {_CSV_PATH}, size_source, size_dest, CASE WHEN status = 'ContentMismatch' THEN hs ELSE '' END, CASE WHEN status = 'ContentMismatch' THEN hd ELSE '' END) AS line FROM c WHERE status <> 'Identical'"
_JSON_LINES = _doc_status(Mode.CONTENT) + rf"""SELECT '{{"status":"' || CASE status {_TOKENS} END || '","path":"' || replace(relative_path, '\', '\\') || '","size_source":' || size_source || ',"size_destination":' || size_dest || ',"hash_source":"' || CASE WHEN status = 'ContentMismatch' THEN hs ELSE '' END || '","hash_destination":"' || CASE WHEN status = 'ContentMismatch' THEN hd ELSE '' END || '"}}' AS line FROM c WHERE status <> 'Identical'"""


def _whole_sql(lines: str, whole: str) -> str:
    """One file of all lines in the order of groups, then keys."""
    ordered = lines.replace("AS line FROM c", "AS line, key, CASE status WHEN 'Extra' THEN 0 WHEN 'SizeMismatch' THEN 1 WHEN 'Missing' THEN 2 ELSE 4 END AS ord FROM c")
    at = ordered.rindex("SELECT concat_ws") if "SELECT concat_ws(',', CASE" in ordered else ordered.rindex("SELECT '{")
    return f"{ordered[:at]}, l AS ({ordered[at:]}), w AS (SELECT {whole} AS file FROM l) SELECT CAST(strlen(file) AS BIGINT) AS n_bytes, sha256(file) AS sha256 FROM w"


def _catalog() -> dict[str, tuple]:
    presence, size, full = (_diff(m) for m in (Mode.PRESENCE, Mode.SIZE, Mode.CONTENT))
    return {
        "diff_presence": presence,
        "diff_size": size,
        "diff_content": full,
        "problem_rows": (problem_rows, _PROBLEM_ROWS),
        "stats_counters": (stats_counters, _STATS),
        "order_counters": (_order_counters, _ORDER_COUNTERS + "SELECT * FROM n"),
        "errors_total": (errors_total, _ORDER_COUNTERS + "SELECT read_errors + access_denied + changed_during_scan AS errors FROM n"),
        "tied_rows": (tied_rows, "SELECT 'Identical' AS status, count(DISTINCT l_partkey) AS n FROM lineitem UNION ALL SELECT 'Extra', count(*) - count(DISTINCT l_partkey) FROM lineitem"),
        "missing_rows": (_order_rows(Status.MISSING), "SELECT o_orderkey FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 = 0"),
        "extra_rows": (_order_rows(Status.EXTRA), "SELECT o_orderkey FROM orders WHERE o_orderkey % 17 = 0"),
        "dedupe_last_wins": (dedupe_last_wins, f"WITH {_TEXT_KEYS} SELECT key, CAST(arg_max(size, doc_id) AS BIGINT) AS size, max(doc_id) AS doc_id FROM t GROUP BY key"),
        "dest_duplicates_extra": (dest_duplicates_extra, f"WITH {_TEXT_KEYS}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM t), r AS (SELECT CASE WHEN rn = 1 AND key IN (SELECT key FROM t WHERE doc_id % 2 = 0) THEN 'Identical' ELSE 'Extra' END AS status, size FROM n) SELECT status, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes_dest FROM r GROUP BY status"),
        "case_sensitive_vs_fold": (case_sensitive_vs_fold, "SELECT 'Identical' AS status, count(*) AS n, false AS case_sensitive FROM customer UNION ALL SELECT 'Identical', count(*), true FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT s, count(*), true FROM customer, (VALUES ('Missing'), ('Extra')) v(s) WHERE c_custkey % 3 = 0 GROUP BY s"),
        "type_conflict": (type_conflict, "SELECT CASE WHEN (doc_id % 6 = 0) <> (doc_id % 4 = 0) THEN 'SizeMismatch' ELSE 'Identical' END AS status, doc_id % 6 = 0 AND doc_id % 4 = 0 AS is_directory, count(*) AS n FROM documents GROUP BY ALL"),
        "leaf_missing_dirs": (_leaf_dirs(Status.MISSING), _LEAF_DIRS),
        "leaf_extra_dirs": (_leaf_dirs(Status.EXTRA), _LEAF_DIRS),
        "cache_hit_join": (cache_hit_join, "SELECT count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 7 <> 0) AS hits, count(*) FILTER (NOT (doc_id % 3 <> 0 AND doc_id % 7 <> 0)) AS misses FROM documents WHERE doc_id IS NOT NULL"),
        "offline_digest_compare": (offline_digest_compare, _doc_status(Mode.CONTENT).replace("WHEN s.digest <> d.digest", "WHEN s.doc_id % 3 = 0 THEN 'ReadError' WHEN s.digest <> d.digest") + _STATUS_COUNTS),
        "degrade_to_size": (degrade_to_size, _doc_status(Mode.SIZE) + _STATUS_COUNTS),
        "changed_during_scan": (changed_during_scan, "SELECT CASE WHEN o_orderkey % 23 = 0 OR o_orderkey % 29 = 0 THEN 'ChangedDuringScan' WHEN o_orderkey % 31 = 0 THEN 'AccessDenied' WHEN o_orderkey % 37 = 0 THEN 'ReadError' ELSE 'Identical' END AS status, count(*) AS n FROM orders GROUP BY 1"),
        "problem_filter_errors": (problem_filter_errors, "SELECT CASE WHEN doc_id % 2 = 0 THEN 'AccessDenied' ELSE 'ReadError' END AS status, 'e' || doc_id AS relative_path, 'denied' AS error_message, true AS is_directory FROM documents WHERE doc_id % 9 = 0"),
        "view_counts": (view_counts, _VIEW_COUNTS),
        "listed_examples": (listed_examples, _EXAMPLES),
        "diagnostic_names": (diagnostic_names, _DIAGNOSTIC_NAMES),
        "limit_problems": (limit_problems, _doc_status(Mode.CONTENT) + "SELECT status, relative_path FROM c WHERE status <> 'Identical' ORDER BY CASE status WHEN 'Extra' THEN 0 WHEN 'SizeMismatch' THEN 1 WHEN 'Missing' THEN 2 ELSE 4 END, key LIMIT 25"),
        "csv_cell_escape": (csv_cell_escape, r"""WITH t AS (SELECT doc_id, (['', '=', '+', '-', '@', chr(9)])[CAST(doc_id % 6 + 1 AS INTEGER)] || text AS c FROM documents)
SELECT doc_id, CASE WHEN left(c, 1) IN ('=', '+', '-', '@', chr(9), chr(13), chr(12)) THEN '"''' || replace(c, '"', '""') || '"' WHEN contains(c, ',') OR contains(c, '"') OR contains(c, chr(10)) OR contains(c, chr(13)) THEN '"' || replace(c, '"', '""') || '"' ELSE c END AS cell FROM t"""),
        "json_cell_escape": (json_cell_escape, r"""WITH t AS (SELECT doc_id, text || '"\' || chr(8) || chr(12) || chr(13) || chr(9) || chr(1) AS c FROM documents)
SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(c, '\', '\\'), '"', '\"'), chr(8), '\b'), chr(12), '\f'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), chr(1), '\u0001') AS cell FROM t"""),
        "hex_digest": (hex_digest, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(sha256(text), '') ELSE '' END AS digest FROM documents"),
        "status_token": (status_token, _doc_status(Mode.CONTENT) + f"SELECT CASE status {_TOKENS} END AS token, count(*) AS n FROM c GROUP BY 1"),
        "norm_root": (norm_root, rf"WITH {_PAGES_PATH}, n AS (SELECT page_id, {_NORMAL} AS r FROM p) SELECT page_id, CASE WHEN length(r) > 3 THEN substr(r, 1, 3) || rtrim(substr(r, 4), '\') WHEN r = '\\' THEN '\' ELSE r END AS root FROM n"),
        "join_rel": (join_rel, rf"WITH {_PAGES_PATH} SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'x' ELSE path || '\x' END AS joined, CASE WHEN page_id % 5 = 0 THEN path ELSE path || '\y' END AS absolute FROM p"),
        "long_prefix": (long_prefix, rf"WITH {_PAGES_PATH} SELECT page_id, CASE WHEN starts_with(path, '\\?\') THEN path WHEN starts_with(path, '\\') THEN '\\?\UNC\' || substr(path, 3) ELSE '\\?\' || path END AS prefixed FROM p"),
        "base_name": (base_name, r"SELECT page_id, regexp_extract(url, '([^\\/]*)$', 1) AS name FROM pages"),
        "fold_names": (fold_names, "SELECT c_custkey, upper(c_name) AS folded FROM customer"),
        "disconnect_predicate": (disconnect_predicate, "SELECT DISTINCT p_partkey % 1300 AS code, p_partkey % 1300 IN (59, 64, 67, 995, 1167, 1222, 1231, 1236) AS lost FROM part"),
        "io_class": (io_class, rf"WITH {_PAGES_PATH}, u AS (SELECT page_id, left(path, 1) IN ('\', '/') AS unc FROM p) SELECT page_id, CASE unc::INT + (page_id % 3 = 0)::INT WHEN 0 THEN 'LocalLocal' WHEN 1 THEN 'LocalNetwork' ELSE 'NetworkNetwork' END AS io_class, unc FROM u"),
        "group_numbers": (group_numbers, "SELECT o_orderkey, replace(format('{:,}', o_orderkey * 1003), ',', '.') AS grouped FROM orders"),
        "merge_compare": (merge_compare, _MERGE),
        "reverse_index": (reverse_index, f"WITH {_RECORDS} SELECT CAST(parent AS BIGINT) AS parent, string_agg(record, ',' ORDER BY record) AS children FROM rec GROUP BY parent"),
        "tree_walk": (tree_walk, rf"WITH {_RECORDS} SELECT CAST(record AS BIGINT) AS record, 1 AS depth, name AS path FROM rec WHERE parent = -1 UNION ALL SELECT CAST(c.record AS BIGINT), 2, p.name || '\' || c.name FROM rec c JOIN rec p ON c.parent = p.record"),
        "parent_chain": (parent_chain, f"WITH {_RECORDS}, c AS (SELECT record, parent, CASE WHEN record % 4 = 0 THEN 9 ELSE parent % 3 END AS ps FROM rec WHERE record >= 100) SELECT CAST(record AS BIGINT) AS start, 1 AS step, CAST(parent AS BIGINT) AS record, CASE WHEN ps = parent % 3 THEN 'LIVE' ELSE 'STALE' END AS state FROM c UNION ALL SELECT CAST(record AS BIGINT), 2, CAST(-1 AS BIGINT), 'STALE' FROM c WHERE ps = parent % 3"),
        "split_ref": (split_ref, "SELECT o_orderkey, o_orderkey AS record, o_custkey % 30000 AS sequence FROM orders"),
        "data_runs": (data_runs, f"WITH {_RUNS} SELECT * FROM e"),
        "extent_containment": (extent_containment, f"WITH {_RUNS}, q AS (SELECT o_orderkey AS file, o_custkey % 60 AS cluster FROM orders) SELECT q.file, q.cluster, e.i, e.lcn + q.cluster - e.vcn AS absolute FROM q JOIN e ON q.file = e.file AND q.cluster >= e.vcn AND q.cluster < e.vcn + e.length"),
        "children_union": (children_union, _CHILDREN),
        "picked_names": (picked_names, "WITH n AS (SELECT DISTINCT l_orderkey AS record, l_linenumber % 4 AS space, 'n' || l_partkey AS name FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY CASE space WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 0 THEN 2 ELSE 3 END, name) AS k FROM n) SELECT record, CAST(space AS INTEGER) AS space, name FROM r WHERE k = 1"),
        "export_csv_lines": (_export_lines(export.csv_line), _CSV_LINES),
        "export_json_lines": (_export_lines(export.json_line), _JSON_LINES),
        "decoded_runs": (decoded_runs, f"WITH {_RUNS} SELECT file, row_number() OVER (PARTITION BY file ORDER BY i) - 1 AS i, vcn, lcn, length FROM e"),
        "record_dump": (record_dump, f"WITH {_DUMP}, k AS (SELECT parent AS record, string_agg(record || ':' || (record % 5 + 1) || ':' || name, ',' ORDER BY record) AS children FROM r WHERE NOT dir GROUP BY parent) SELECT CAST(r.record AS BIGINT) AS record, CAST(r.record % 5 + 1 AS INTEGER) AS sequence, used AS in_use, dir AS is_directory, CAST(CASE WHEN dir THEN 0 ELSE r.record * 1000 END AS BIGINT) AS size, parent || ':2:' || left(name, 6) || ',' || parent || ':1:' || name AS names, coalesce(children, '') AS children, CASE WHEN dir THEN 2 ELSE 0 END AS runs, CAST(NULL AS VARCHAR) AS error FROM r LEFT JOIN k ON r.record = k.record"),
        "dump_tree": (dump_tree, rf"WITH {_DUMP} SELECT CAST(c.record AS BIGINT) AS record, CASE WHEN c.dir THEN c.name ELSE p.name || '\' || c.name END AS relative_path, CAST(CASE WHEN c.dir THEN 0 ELSE c.record * 1000 END AS BIGINT) AS size, c.dir AS is_directory FROM r c LEFT JOIN r p ON c.parent = p.record WHERE c.used"),
        "dump_violations": (dump_violations, f"WITH {_DUMP} SELECT CAST(parent AS BIGINT) AS parent, CAST(record AS BIGINT) AS record, 'no live record' AS error FROM r WHERE NOT used UNION ALL SELECT 5, 999, 'no live record'"),
        "index_blocks": (index_blocks, "WITH k AS (SELECT o_custkey % 500 AS parent, o_orderkey // 500 AS part, list_sort(list(DISTINCT o_orderkey)) AS every FROM orders GROUP BY 1, 2), b AS (SELECT parent, every, unnest(range(0, len(every), 20)) AS first FROM k), r AS (SELECT parent, every[first + 1:first + 20] AS kids FROM b) SELECT parent, CASE WHEN parent % 7 = 0 OR parent % 5 = 0 THEN '' ELSE array_to_string(list_transform(kids, lambda x: x || ':' || (x % 100) || ':o' || x), ',') END AS children, parent % 7 <> 0 AND parent % 5 = 0 AS damaged FROM r"),
        "export_csv_file": (_whole_export(ExportFormat.CSV), _whole_sql(_CSV_LINES, f"chr(65279) || '{export.HEADER.strip()}' || chr(10) || coalesce(string_agg(line || chr(10), '' ORDER BY ord, key), '')")),
        "export_json_file": (_whole_export(ExportFormat.JSON), _whole_sql(_JSON_LINES, "'[' || chr(10) || coalesce(string_agg(line, ',' || chr(10) ORDER BY ord, key), '') || chr(10) || ']' || chr(10)")),
        "snapshot_round_trip": (snapshot_round_trip, f"WITH {_DOC_SIDES} SELECT path AS relative_path, size, false AS is_directory, doc_id, digest, 'D:\\docs' AS root, false AS case_sensitive FROM s"),
        "binary_snapshot_round_trip": (binary_snapshot_round_trip, r"SELECT c_mktsegment || '\' || c_name AS relative_path, c_custkey * 10 AS size, sha256(c_name) AS digest, 'E:' AS root, true AS case_sensitive FROM customer"),
        "tree_scan": (tree_scan, f"WITH {_PAGE_FILES}, d AS (SELECT DISTINCT unnest(['d' || page_id % 7, 'd' || page_id % 7 || '/.x']) AS path FROM f) SELECT path AS relative_path, CAST(strlen(data) AS BIGINT) AS size, false AS is_directory FROM f UNION ALL SELECT path, 0, true FROM d UNION ALL SELECT 'empty', 0, true"),
        "tree_digests": (tree_digests, f"WITH {_PAGE_FILES} SELECT page_id || '.html' AS name, sha256(data) AS digest, 'ok' AS content_state, false AS changed FROM f"),
        "digests_from_cache": (digests_from_cache, f"WITH {_PAGE_FILES} SELECT page_id || '.html' AS name, CASE WHEN page_id % 2 = 0 THEN sha256(page_id || '.html') ELSE sha256(data) END AS digest, page_id % 2 = 0 AS from_cache FROM f"),
        "index_violations": (index_violations, _CHILDREN.split("SELECT record, parent, 0")[0].rstrip() + " SELECT record, CASE WHEN record % 7 = 0 THEN 9 ELSE sequence END AS sequence, CAST(parent AS BIGINT) AS parent FROM x WHERE record % 5 <> 0 AND (record % 7 = 0 AND sequence <> 9 OR record % 11 = 0)"),
    }


def queries() -> dict:
    return {name: query for name, (query, _) in _catalog().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _catalog().items() if sql is not None}
