"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again for the next. All but the last return the columns
of ``documents``. The language network and the byte pairs can't be stated in SQL, so ``ORACLE_SQL``
is None and ``tests/llm`` holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import bagminhash, bytecnn, common, mixing, packing, secrets

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike all that is known of their likeliest language, go. All
    labelled documents tell what is known: one in four the levels, the others the language."""
    network = bytecnn.fit_all(docs)
    found = bytecnn.predict(docs, network, keep=docs.columns, likelihood=True)
    clear = F.col("lang_pred") != bytecnn.UNKNOWN
    for language, least in bytecnn.least_likelihoods(docs, network).items():
        clear &= (F.col("lang_pred") != language) | (F.col("likelihood") >= least)
    return found.where(clear).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays."""
    return bagminhash.deduplicated(docs).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are cut out of the texts; all documents stay."""
    marked = docs.withColumn("__before", F.length("text"))
    clean = secrets.redacted(marked, F.col("source"), F.concat_ws("/", "source", "lang"))
    changed = F.col("__before").isNotNull() & (F.col("__before") != F.length("text"))
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, stay once, or go, by their source's target."""
    sized = docs.withColumn("__size", mixing.word_count())
    return mixing.emit(mixing.with_copies(sized, size_col="__size")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences."""
    packed = packing.pack_documents(docs, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
