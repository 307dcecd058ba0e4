"""Exports of problems: one CSV or JSON file, byte by byte as defined.

Lines are rendered by executors; the driver only appends them, one partition at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import text
from tallystone.spec import ExportFormat

BOM = b"\xef\xbb\xbf"
HEADER = "status,path,size_source,size_destination,hash_source,hash_destination\n"


def csv_line() -> Column:
    return F.concat_ws(",", text.status_token(F.col("status")), text.csv_cell(F.col("relative_path")), F.col("size_source").cast("string"), F.col("size_dest").cast("string"), text.hex_digest(F.col("hash_source")), text.hex_digest(F.col("hash_dest")))


def json_line() -> Column:
    part = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    cells = [part("status", quoted(text.status_token(F.col("status")))), part("path", quoted(text.json_cell(F.col("relative_path")))), part("size_source", F.col("size_source").cast("string")), part("size_destination", F.col("size_dest").cast("string")), part("hash_source", quoted(text.hex_digest(F.col("hash_source")))), part("hash_destination", quoted(text.hex_digest(F.col("hash_dest"))))]
    return F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))


def _ordered(problems: DataFrame) -> DataFrame:
    return problems.orderBy(*[c for c in ("ord", "key") if c in problems.columns]) if "ord" in problems.columns else problems


def write_folder(problems: DataFrame, folder: str, kind: ExportFormat = ExportFormat.CSV) -> None:
    """The lines of ``write``, without header or brackets, as a folder of text files that executors
    write; files are in order by their names. For differences that one file or machine can't hold."""
    _ordered(problems).select((csv_line() if kind == ExportFormat.CSV else json_line()).alias("line")).write.text(folder)


def write(problems: DataFrame, file: str, kind: ExportFormat = ExportFormat.AUTO) -> ExportFormat:
    """Write ``problems``, in their order of ``ord`` if they have it."""
    if kind == ExportFormat.AUTO:
        kind = text.infer_format(file)
    lines = _ordered(problems).select((csv_line() if kind == ExportFormat.CSV else json_line()).alias("line"))
    with open(file, "wb") as out:
        if kind == ExportFormat.CSV:
            out.write(BOM + HEADER.encode())
            for r in lines.toLocalIterator():
                out.write(r.line.encode() + b"\n")
        else:
            out.write(b"[\n")
            for i, r in enumerate(lines.toLocalIterator()):
                out.write(b",\n" * (i > 0) + r.line.encode())
            out.write(b"\n]\n")
    return kind
