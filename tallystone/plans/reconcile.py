"""A whole reconciliation: scan or load, key, join, compare contents, count, save, export."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions import paths, text
from tallystone.operators import classify, content, keying, leafdirs, stats
from tallystone.sources import cache as caches
from tallystone.sources import export, listing, snapshot, tree
from tallystone.sources.scratch import fixed, shared_folder
from tallystone.spec import DigestState, Enumeration, ExportFormat, Mode, ReconcileSpec, Status
from tallystone.streaming.control import Control


def reconcile(source: DataFrame, dest: DataFrame, mode: Mode = Mode.CONTENT, case_sensitive: bool = False, content_stage=None) -> tuple[DataFrame, DataFrame]:
    """(results, counters) of two ``entries`` tables.

    Source keys: the last row wins; destination keys: the first row matches and the others are
    extra. ``content_stage`` takes the joined rows without status and adds digests; without it, the
    ``digest`` columns of the entries are compared. Results hold every row, identical ones too.
    """
    src = keying.last_wins(keying.keyed(source, case_sensitive))
    dst_rows = keying.keyed(dest, case_sensitive)
    first, others = keying.first_match(dst_rows)
    rows = classify.classified(src, first, mode)
    if mode == Mode.CONTENT:
        if content_stage is not None:
            rows = content_stage(rows)
        rows = classify.content_status(rows)
    results = classify.shown(rows).unionByName(classify.duplicates_as_extra(others))
    return results, stats.counters(src, dst_rows, results)


def problems(results: DataFrame, separator: str = paths.BACKSLASH) -> DataFrame:
    """What differs: extras, mismatches, missing rows (files first, by key), errors. Missing and extra
    directories are listed only if nothing below them is. ``ord`` gives the order of the groups."""
    status = F.col("status")
    shown = results.where(status != Status.IDENTICAL.value)
    one_sided = status.isin(Status.MISSING.value, Status.EXTRA.value)
    covered = shown.where(one_sided).select("status", F.explode(paths.ancestors(F.col("key"), separator)).alias("key")).distinct().withColumn("__covered", F.lit(True))
    # One pass over the results and one for the ancestors; only directories have something below them.
    rows = shown.join(covered, ["status", "key"], "left").where(F.col("__covered").isNull() | ~F.col("is_directory")).select(*results.columns)
    rank = F.when(status == Status.EXTRA.value, 0).when(status == Status.SIZE_MISMATCH.value, 1).when(status == Status.MISSING.value, F.when(F.col("is_directory"), 3).otherwise(2)).otherwise(4)
    return rows.withColumn("ord", rank)


def filtered(rows: DataFrame, wanted: str) -> DataFrame:
    """Rows of a view: all, missing, extra, size, content or errors. Identical rows are only counted."""
    kinds = {"missing": (Status.MISSING,), "extra": (Status.EXTRA,), "size": (Status.SIZE_MISMATCH,), "content": (Status.CONTENT_MISMATCH,), "errors": (Status.READ_ERROR, Status.ACCESS_DENIED, Status.CHANGED_DURING_SCAN)}
    if wanted == "all":
        return rows
    if wanted == "identical":
        return rows.where(F.lit(False))
    return rows.where(F.col("status").isin(*[s.value for s in kinds[wanted]]))


def examples(results: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows by key of each kind: ``only_source``, ``only_dest`` and ``differs`` (in size,
    type or content). A report's lists: each is a top-k, so no task sorts them all."""
    kinds = {"only_source": (Status.MISSING,), "only_dest": (Status.EXTRA,), "differs": (Status.SIZE_MISMATCH, Status.CONTENT_MISMATCH)}
    lists = [results.where(F.col("status").isin(*[s.value for s in of])).orderBy("key", "relative_path").limit(most).withColumn("kind", F.lit(kind)) for kind, of in kinds.items()]
    return reduce(DataFrame.unionByName, lists)


@dataclass
class Report:
    """What a run did."""

    spec: ReconcileSpec
    source_ok: bool = True
    dest_ok: bool = True
    messages: list[str] = field(default_factory=list)
    degraded: bool = False
    results: DataFrame | None = None
    problems: DataFrame | None = None
    stats: dict[str, int] = field(default_factory=dict)
    cache_hits: int = 0
    hashed: int = 0
    export_format: ExportFormat | None = None
    snapshot_written: bool = False
    seconds: dict[str, float] = field(default_factory=dict)
    listed: dict[str, Enumeration] = field(default_factory=dict)


SEPARATOR = "/"


def _digest_stage(spec: ReconcileSpec, cache: DataFrame | None, offline: bool, kept: list[DataFrame]):
    """Digests of candidates alone: equal size, both files."""

    def stage(rows: DataFrame) -> DataFrame:
        todo = F.col("status").isNull()
        sides = {"dest": spec.dest} | ({} if offline else {"source": spec.source})
        files = [rows.where(todo).select(F.concat(F.lit(root.rstrip("/") + SEPARATOR), F.col(f"path_{side}")).alias("abs_path"), F.col(f"size_{side}").alias("size"), F.col(f"last_write_time_{side}").alias("last_write_time")) for side, root in sides.items()]
        found = fixed(content.digests(reduce(DataFrame.unionByName, files), cache, spec.threads or None), "digests")
        kept.append(found)
        for side, root in sides.items():
            one = found.select(F.col("abs_path").alias("__path"), F.col("size").alias("__size"), F.col("last_write_time").alias("__time"), F.col("digest").alias("__digest"), F.col("content_state").alias(f"content_state_{side}"), F.col("changed").alias(f"changed_{side}"))
            path = F.when(todo, F.concat(F.lit(root.rstrip("/") + SEPARATOR), F.col(f"path_{side}")))
            same = (path == F.col("__path")) & (F.col(f"size_{side}") == F.col("__size")) & (F.col(f"last_write_time_{side}") == F.col("__time"))
            rows = rows.join(one, same, "left").withColumn(f"hash_{side}", F.col("__digest")).drop("__path", "__size", "__time", "__digest")
        return rows

    return stage


def run(spark: SparkSession, spec: ReconcileSpec, control: Control | None = None) -> Report:
    """Run ``spec``. A root that can't be scanned is reported (``source_ok``, ``dest_ok``), never
    raised; a cancelled run raises ``Cancelled`` and has no result."""
    spec = spec.checked()
    control = control or Control(spark)
    report, began = Report(spec), time.monotonic()

    def took(name: str) -> None:
        nonlocal began
        report.seconds[name] = time.monotonic() - began
        began = time.monotonic()

    with control.running():
        exact, mode = spec.case_sensitive, spec.mode
        cache = None
        if spec.hash_cache:
            cache, warning = caches.read(spark, spec.hash_cache)
            if warning:
                report.messages.append(warning)
        kept: list[DataFrame] = []
        source_errors = None
        dumps = {} if spec.compare else {"source": spec.source_records}
        dumps |= {"dest": spec.dest_records} if spec.dest else {}
        use_dumps = spec.enum == Enumeration.RECORDS or spec.enum == Enumeration.AUTO and all(listing.has_dump(spark, d) for d in dumps.values())

        def listed(name: str, root: str) -> tuple[DataFrame, DataFrame]:
            entries, errors, report.listed[name], message = listing.listed(spark, root, dumps[name], use_dumps, name)
            report.messages += [message] if message else []
            return entries, errors

        if spec.compare:
            try:
                saved = snapshot.read(spark, spec.compare)
            except snapshot.SnapshotError as e:
                report.source_ok = False
                report.messages.append(str(e))
                return report
            source, exact = saved.entries, saved.case_sensitive
            if mode == Mode.CONTENT and not saved.has_digests() and not source.isEmpty():
                mode, report.degraded = Mode.SIZE, True
        else:
            try:
                source, source_errors = listed("source", spec.source)
            except tree.RootError as e:
                report.source_ok = False
                report.messages.append(str(e))
                return report
            if not source_errors.where("lost_device").isEmpty():
                report.source_ok = False
                report.messages.append("the source was lost during the scan")
                return report
        took("source")

        if spec.snapshot_out:
            keyed = keying.last_wins(keying.keyed(source, exact)).drop("key")
            if mode == Mode.CONTENT:
                root = spec.source.rstrip("/") + SEPARATOR
                path = F.concat(F.lit(root), F.col("relative_path"))
                found = fixed(content.digests(keyed.where(~F.col("is_directory")).select(path.alias("abs_path"), "size", "last_write_time"), cache, spec.threads or None), "digests")
                kept.append(found)
                # What could not be hashed, or changed, has no digest.
                good = found.where((F.col("content_state") == DigestState.OK.value) & ~F.col("changed")).select(F.substring("abs_path", len(root) + 1, 2**31 - 1).alias("__path"), "digest")
                keyed = keyed.join(good, (F.col("relative_path") == F.col("__path")) & ~F.col("is_directory"), "left").drop("__path")
            snapshot.write(keyed, spec.snapshot_out, spec.source, exact)
            report.snapshot_written = True
            took("snapshot")

        if spec.dest:
            try:
                dest, dest_errors = listed("dest", spec.dest)
            except tree.RootError as e:
                report.dest_ok = False
                report.messages.append(str(e))
                return report
            if not dest_errors.where("lost_device").isEmpty():
                report.dest_ok = False
                report.messages.append("the destination was lost during the scan")
                return report
            took("destination")
            stage = _digest_stage(spec, cache, bool(spec.compare), kept) if mode == Mode.CONTENT else None
            results, _ = reconcile(source, dest, mode, exact, stage)
            errors = [classify.errors_as_rows(e) for e in (source_errors, dest_errors) if e is not None]
            results = fixed(reduce(DataFrame.unionByName, [results, *errors]), "results")
            report.results = results
            took("comparison")
            src = keying.last_wins(keying.keyed(source, exact))
            report.stats = stats.counters(src, dest, results).first().asDict()
            roots = dest_errors.select(paths.comparison_key(F.col("path"), exact).alias("key"))
            report.problems = leafdirs.under(problems(results, SEPARATOR), roots, separator=SEPARATOR)
            took("counters")
        if kept:
            hit = reduce(DataFrame.unionByName, kept).agg(F.count_if("from_cache"), F.count_if(~F.col("from_cache"))).first()
            report.cache_hits, report.hashed = hit
        if spec.hash_cache and kept:
            fresh = reduce(DataFrame.unionByName, kept).where(~F.col("from_cache"))
            caches.save(caches.merged(cache, fresh), spec.hash_cache)
            took("cache")
        if spec.export and report.problems is not None:
            report.export_format = export.write(report.problems, spec.export, spec.export_format)
            took("export")
    return report
