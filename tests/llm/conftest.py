import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odd_rows import DATA, ODD, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls anywhere, empty and long texts, repeats and ties, and extra columns with names that
    operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    names = ("size", "copies", "target", "shard", "slot", "position", "curve", "sequence_id", "offset", "score", "lang_pred", "key", "node", "base", "hash", "row_id", "extra")
    return df.select("*", *[F.lit(n).alias(n) for n in names])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
