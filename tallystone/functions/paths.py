"""Path functions as columns, and on single values where a driver needs them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BACKSLASH = "\\"


def normalize_root(path: Column) -> Column:
    r"""Without a long-path prefix (``\\?\`` or ``\\?\UNC\``) and trailing backslashes; roots of up to
    three characters keep theirs."""
    bare = F.when(path.startswith("\\\\?\\UNC\\"), F.concat(F.lit("\\\\"), F.substring(path, 9, 2**31 - 1))).when(path.startswith("\\\\?\\"), F.substring(path, 5, 2**31 - 1)).otherwise(path)
    head, tail = F.substring(bare, 1, 3), F.substring(bare, 4, 2**31 - 1)
    trimmed = F.when(F.length(bare) > 3, F.concat(head, F.regexp_replace(tail, r"\\+$", ""))).otherwise(bare)
    return F.when(trimmed == "\\\\", F.lit("\\")).otherwise(trimmed)


def normalize_root_value(path: str) -> str:
    if path.startswith("\\\\?\\UNC\\"):
        path = "\\\\" + path[8:]
    elif path.startswith("\\\\?\\"):
        path = path[4:]
    path = path[:3] + path[3:].rstrip("\\")
    return "\\" if path == "\\\\" else path


def join_rel(parent: Column, name: Column, separator: str = BACKSLASH) -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit(separator), name))


def make_absolute(root: Column, rel: Column, separator: str = BACKSLASH) -> Column:
    return F.when(rel == "", root).otherwise(F.concat(root, F.lit(separator), rel))


def add_long_path_prefix(path: Column) -> Column:
    return F.when(path.startswith("\\\\?\\"), path).when(path.startswith("\\\\"), F.concat(F.lit("\\\\?\\UNC\\"), F.substring(path, 3, 2**31 - 1))).otherwise(F.concat(F.lit("\\\\?\\"), path))


def fold(path: Column) -> Column:
    """Upper case for comparison, one code point for one: a character whose upper case is longer
    stays, so that folding never makes two different names of different lengths equal."""
    each = F.transform(F.split(path, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c))
    return F.when(path.rlike(r"^[\x00-\x7f]*$"), F.upper(path)).otherwise(F.array_join(each, ""))


def comparison_key(path: Column, case_sensitive: bool) -> Column:
    return path if case_sensitive else fold(path)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def is_unc(path: Column) -> Column:
    return path.rlike(r"^[\\/]")


def ancestors(path: Column, separator: str = BACKSLASH) -> Column:
    """Strict ancestors: ``a\\b\\c`` gives [``a``, ``a\\b``]."""
    parts = F.split(path, "\\\\" if separator == BACKSLASH else f"[{separator}]", -1)
    prefix = lambda n: F.array_join(F.slice(parts, 1, n), separator)
    # sequence(1, 0) would count down.
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), prefix)).otherwise(F.array().cast("array<string>"))
