"""Command line: ``python -m tallystone.cli --source A --dest B``.

Exit code 1 means wrong arguments. Problems and unreachable roots give 0, or with
``--strict-exit`` 2 and 3.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tallystone.functions import text
from tallystone.plans import reconcile
from tallystone.spec import Enumeration, ExportFormat, Mode, OptionError, ReconcileSpec
from tallystone.streaming import control


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise OptionError(message)


def _number(parse, what: str):
    def read(value: str) -> int:
        if (found := parse(value)) is None:
            raise OptionError(f"not a valid value for {what}: {value}")
        return found

    return read


def parse_args(argv: list[str]) -> ReconcileSpec:
    p = _Parser(prog="tallystone", allow_abbrev=False)
    for name in ("source", "dest", "compare", "snapshot-out", "hash-cache", "export", "source-records", "dest-records"):
        p.add_argument(f"--{name}")
    p.add_argument("--mode", choices=[m.value for m in Mode], default=Mode.CONTENT.value)
    p.add_argument("--export-format", choices=["csv", "json"])
    p.add_argument("--threads", type=_number(text.parse_thread_count, "--threads"), default=0)
    p.add_argument("--limit", type=_number(text.parse_uint64, "--limit"), default=100)
    p.add_argument("--enum", choices=[e.value for e in Enumeration], default=Enumeration.AUTO.value)
    for name in ("case-sensitive", "list-problems", "progress", "strict-exit"):
        p.add_argument(f"--{name}", action="store_true")
    a = vars(p.parse_args(argv))
    a["mode"], a["export_format"], a["enum"] = Mode(a["mode"]), ExportFormat(a["export_format"] or "auto"), Enumeration(a["enum"])
    return ReconcileSpec(**a).checked()


def summary(report: reconcile.Report) -> str:
    lines = [f"{name.replace('_', ' ')}: {text.group_thousands(value)}" for name, value in report.stats.items()]
    if report.stats:
        lines.append(f"source bytes: {text.human_bytes(report.stats['bytes_source'])}")
        total = sum(report.seconds.values())
        lines.append(f"time: {text.format_time(total)}, {text.format_rate(report.stats['bytes_source'], total)}")
    lines += [f"{stage}: {seconds:.1f} s" for stage, seconds in report.seconds.items()]
    lines += [f"{side} listed by: {way.value}" for side, way in report.listed.items()]
    if report.degraded:
        lines.append("the snapshot has no digests: compared by size")
    if report.spec.hash_cache:
        lines.append(f"cached digests used: {report.cache_hits}, files read: {report.hashed}")
    if report.export_format:
        lines.append(f"exported: {report.spec.export} ({report.export_format.value})")
    return "\n".join(lines + report.messages)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    try:
        spec = parse_args(sys.argv[1:] if argv is None else argv)
    except OptionError as e:
        print(e, file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("tallystone").getOrCreate()
    if spec.progress:
        show = lambda p: print(f"{p.phase}: {p.tasks_done} of {p.tasks} tasks", file=sys.stderr)
        with control.reporting(spark, "reconcile", show):
            report = reconcile.run(spark, spec)
    else:
        report = reconcile.run(spark, spec)
    print(summary(report), file=out)
    if spec.list_problems and report.problems is not None:
        for r in report.problems.orderBy("ord", "key").limit(min(spec.limit, 2**31 - 1)).collect():
            print(f"{text.STATUS_TOKENS[r.status]}  {r.relative_path}", file=out)
    if spec.strict_exit:
        if not (report.source_ok and report.dest_ok):
            return 3
        if report.problems is not None and not report.problems.isEmpty():
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
