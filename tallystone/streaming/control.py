"""Progress and cancelling of running jobs.

The reference point has no unbounded stream: its "streaming" is one bounded pass. What carries over
is watching a pass and stopping it.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Cancelled(RuntimeError):
    """A cancelled run has no result."""


class Control:
    """Tags the jobs of a run, so that ``cancel`` (from any thread) stops them and nothing else."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self._cancelled = spark, f"tallystone-{uuid.uuid4().hex[:12]}", threading.Event()

    @property
    def cancelled(self) -> bool:
        return self._cancelled.is_set()

    def cancel(self) -> None:
        self._cancelled.set()
        self.spark.interruptTag(self.tag)

    @contextmanager
    def running(self):
        if self.cancelled:
            raise Cancelled
        self.spark.addTag(self.tag)
        try:
            yield self
        except Exception as e:
            if self.cancelled:
                raise Cancelled from e
            raise
        finally:
            self.spark.removeTag(self.tag)


@dataclass(frozen=True)
class Progress:
    phase: str
    active_stages: int
    tasks_done: int
    tasks: int


def progress(spark: SparkSession, phase: str) -> Progress:
    tracker = spark.sparkContext.statusTracker()
    stages = [s for i in tracker.getActiveStageIds() if (s := tracker.getStageInfo(i))]
    return Progress(phase, len(stages), sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages))


@contextmanager
def reporting(spark: SparkSession, phase: str, report: Callable[[Progress], None], every: float = 1.0):
    """Call ``report`` from a thread of its own until the block ends."""
    done = threading.Event()

    def loop():
        while not done.wait(every):
            report(progress(spark, phase))

    thread = threading.Thread(target=loop, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()


def counted(entries: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``entries``, counting files, directories and bytes on the way."""
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    is_dir = F.col("is_directory")
    return entries.observe(seen, F.count_if(~is_dir).alias("files"), F.count_if(is_dir).alias("dirs"), F.coalesce(F.sum(F.when(~is_dir, F.col("size"))), F.lit(0)).alias("bytes")), seen
