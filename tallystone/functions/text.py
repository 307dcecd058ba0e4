"""Cells of exports, numbers for people, and small predicates."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystone.spec import ExportFormat, Status

# The tokens of the export format.
STATUS_TOKENS = {
    Status.IDENTICAL: "IDENTICO",
    Status.MISSING: "MANCANTE",
    Status.EXTRA: "EXTRA",
    Status.SIZE_MISMATCH: "DIM_DIVERSA",
    Status.CONTENT_MISMATCH: "CONTENUTO_DIVERSO",
    Status.READ_ERROR: "ERRORE_LETTURA",
    Status.ACCESS_DENIED: "ACCESSO_NEGATO",
    Status.CHANGED_DURING_SCAN: "MODIFICATO_DURANTE_SCAN",
}

# System error codes that mean that a device or connection is gone.
DISCONNECT_CODES = (59, 64, 67, 995, 1167, 1222, 1231, 1236)
ACCESS_DENIED_CODE = 5

MOST_THREADS = 4096
MOST_UINT64 = 2**64 - 1


def status_token(status: Column) -> Column:
    pairs = [x for s, token in STATUS_TOKENS.items() for x in (F.lit(s.value), F.lit(token))]
    return F.element_at(F.create_map(*pairs), status)


def csv_cell(text: Column) -> Column:
    """Quoted where needed. A first character that a spreadsheet takes for a formula gets quotes
    and an apostrophe before it."""
    doubled = F.regexp_replace(text, '"', '""')
    return F.when(text.rlike(r"^[=+\-@\t\r\f]"), F.concat(F.lit("\"'"), doubled, F.lit('"'))).when(text.rlike(r'[,"\r\n]'), F.concat(F.lit('"'), doubled, F.lit('"'))).otherwise(text)


def json_cell(text: Column) -> Column:
    """The inside of a JSON string; everything from U+0020 but quote and backslash stays raw."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code, short in ((8, "b"), (12, "f"), (10, "n"), (13, "r"), (9, "t")):
        out = F.replace(out, F.lit(chr(code)), F.lit("\\" + short))
    rare = out
    for code in range(32):
        if code not in (8, 9, 10, 12, 13):
            rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.when(out.rlike(r"[\x00-\x1f]"), rare).otherwise(out)


def hex_digest(digest: Column) -> Column:
    return F.coalesce(F.lower(F.hex(digest)), F.lit(""))


def is_disconnect(code: Column) -> Column:
    return code.isin(*DISCONNECT_CODES)


def io_class(source: Column, dest: Column) -> Column:
    remote = lambda p: p.rlike(r"^[\\/]").cast("int")
    return F.element_at(F.array(*map(F.lit, ("LocalLocal", "LocalNetwork", "NetworkNetwork"))), remote(source) + remote(dest) + 1)


def default_threads(network: bool, cores: int | None = None) -> int:
    cores = os.cpu_count() if cores is None else cores
    return min(cores, 4 if network else 8) if cores else 4


def group_thousands(value: int) -> str:
    return f"{value:,}".replace(",", ".")


def group_thousands_col(value: Column) -> Column:
    return F.translate(F.format_number(value, 0), ",", ".")


def human_bytes(value: int) -> str:
    if value < 1024:
        return f"{value} B"
    amount = float(value)
    for unit in ("KB", "MB", "GB", "TB", "PB"):
        amount /= 1024
        if amount < 1024:
            break
    return f"{amount:.2f} {unit}"


def format_time(seconds: float) -> str:
    whole = int(seconds + 0.5)
    return f"{whole // 3600:02d}:{whole // 60 % 60:02d}:{whole % 60:02d}"


def format_rate(n_bytes: int, seconds: float) -> str:
    if seconds <= 0:
        return "n/d"
    amount, units = n_bytes / seconds, ["B/s", "KB/s", "MB/s", "GB/s", "TB/s"]
    while amount >= 1024 and len(units) > 1:
        amount /= 1024
        units.pop(0)
    return f"{amount:.2f} {units[0]}"


def parse_uint64(text: str, most: int = MOST_UINT64) -> int | None:
    """Digits alone, up to ``most``; anything else is None."""
    if not text or not text.isascii() or not text.isdigit():
        return None
    value = int(text)
    return value if value <= most else None


def parse_thread_count(text: str) -> int | None:
    return parse_uint64(text, MOST_THREADS)


def infer_format(path: str) -> ExportFormat:
    name = path.replace("\\", "/").rpartition("/")[2]
    return ExportFormat.JSON if "." in name and name.rpartition(".")[2].lower() == "json" else ExportFormat.CSV
