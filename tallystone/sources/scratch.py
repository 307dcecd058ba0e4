"""Tables and folders in the shared folder, which the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallystone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fixed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: every later plan sees this one state."""
    path = f"{shared_folder(df.sparkSession)}/tallystone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
