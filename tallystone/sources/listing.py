"""How a side is listed: from a dump of its file records, or by walking its tree.

A dump is a folder of two Parquet tables: ``records`` (record long, data binary) and ``blocks`` (parent
long, data binary), which holds the index blocks that lie outside the records.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.sources import file_records, tree
from tallystone.sources.scratch import fixed
from tallystone.spec import Enumeration

#: The record of a volume's root directory, fixed by the format.
ROOT_RECORD = 5


class IncompleteDump(ValueError):
    """Some record or block is damaged, or an index names a record that isn't live."""


def has_dump(spark: SparkSession, folder: str | None) -> bool:
    if not folder:
        return False
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/records")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def from_records(spark: SparkSession, folder: str, separator: str = "/") -> DataFrame:
    """Entries (``tree.ENTRY_COLUMNS``; ``file_id`` and ``seq`` are the record) of a whole dump. What isn't
    whole raises ``IncompleteDump``, before any entry is used."""
    found = fixed(file_records.parsed(spark.read.parquet(f"{folder}/records")), "records")
    blocks = fixed(file_records.block_children(spark.read.parquet(f"{folder}/blocks")), "blocks")
    entries, bad = file_records.tree_of(found, blocks, ROOT_RECORD, separator)
    if (first := bad.first()) is not None:
        raise IncompleteDump(f"the dump isn't complete: {first.error} (record {first.record}, directory {first.parent})")
    rows = entries.select("*", F.col("record").alias("file_id"), F.col("record").alias("seq"))
    return fixed(rows.select(*tree.ENTRY_COLUMNS), "listed")


def listed(spark: SparkSession, root: str, dump: str | None, use_dump: bool, name: str) -> tuple[DataFrame, DataFrame, Enumeration, str | None]:
    """(entries, errors, way, message) of one side. A dump that can't be used is no error: the tree is
    walked afresh, and the message says why. A root that can't be walked raises ``tree.RootError``."""
    message = None
    if use_dump:
        try:
            if not has_dump(spark, dump):
                raise IncompleteDump("there is no dump")
            entries = from_records(spark, dump)
            return entries, spark.createDataFrame([], "path string, message string, code long, lost_device boolean"), Enumeration.RECORDS, None
        except (IncompleteDump, PySparkException) as e:
            message = f"{name}: {str(e).splitlines()[0]}; its tree is walked instead"
    tree.check_root(root)
    spark.dataSource.register(tree.FileTree)
    entries, errors = tree.parts(fixed(spark.read.format("file_tree").load(root), name))
    return entries, errors, Enumeration.WALK, message
