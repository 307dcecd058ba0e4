"""What a reconciliation is asked to do, and the values that its columns take."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum


class Status(StrEnum):
    IDENTICAL = "Identical"
    MISSING = "Missing"
    EXTRA = "Extra"
    SIZE_MISMATCH = "SizeMismatch"
    CONTENT_MISMATCH = "ContentMismatch"
    READ_ERROR = "ReadError"
    ACCESS_DENIED = "AccessDenied"
    CHANGED_DURING_SCAN = "ChangedDuringScan"


#: What the error filter shows.
ERROR_STATUSES = (Status.READ_ERROR, Status.ACCESS_DENIED, Status.CHANGED_DURING_SCAN)


class Mode(StrEnum):
    PRESENCE = "presence"
    SIZE = "size"
    CONTENT = "content"


class DigestState(StrEnum):
    OK = "ok"
    NO_ACCESS = "no_access"
    READ_ERROR = "read_error"


class Enumeration(StrEnum):
    """How a side is listed. AUTO takes dumps of file records if every side that is listed has one."""

    AUTO = "auto"
    WALK = "walk"
    RECORDS = "records"


class ExportFormat(StrEnum):
    AUTO = "auto"
    CSV = "csv"
    JSON = "json"


class OptionError(ValueError):
    """Options that exclude or lack each other."""


@dataclass(frozen=True)
class ReconcileSpec:
    """Options of one run. ``source`` and ``dest`` are tree roots; ``compare`` is a snapshot that
    stands for the source; ``snapshot_out`` saves the source. ``source_records`` and ``dest_records`` are
    folders with dumps of the sides' file records."""

    source: str | None = None
    dest: str | None = None
    mode: Mode = Mode.CONTENT
    case_sensitive: bool = False
    compare: str | None = None
    snapshot_out: str | None = None
    hash_cache: str | None = None
    export: str | None = None
    export_format: ExportFormat = ExportFormat.AUTO
    threads: int = 0
    limit: int = 100
    list_problems: bool = False
    progress: bool = False
    strict_exit: bool = False
    enum: Enumeration = Enumeration.AUTO
    source_records: str | None = None
    dest_records: str | None = None

    def checked(self) -> ReconcileSpec:
        if self.compare and self.snapshot_out:
            raise OptionError("comparing with a snapshot and saving one exclude each other")
        if self.compare and self.source:
            raise OptionError("a snapshot stands for the source: give one of them")
        if self.compare and not self.dest:
            raise OptionError("comparing with a snapshot needs a destination")
        if self.snapshot_out and not self.source:
            raise OptionError("saving a snapshot needs a source")
        if not self.compare and not self.snapshot_out and not (self.source and self.dest):
            raise OptionError("source and destination are needed")
        return self
