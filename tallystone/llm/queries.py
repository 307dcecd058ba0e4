"""The driver's queries of this subpackage: one per operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from tallystone.llm import bagminhash, bytecnn, chat, hilbert, mixing, packing, rpforest, secrets, tiff, zframes


def queries() -> dict:
    return {
        "op1_tiff": tiff.query,
        "op2_hilbert": hilbert.query,
        "op3_rp_forest": rpforest.query,
        "op4_secrets": secrets.query,
        "op5_mixing": mixing.query,
        "op6_packing": packing.query,
        "op7_chat": chat.query,
        "op8_bagminhash": bagminhash.query,
        "op9_zframes": zframes.query,
        "op10_bytecnn": bytecnn.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op3_rp_forest": rpforest.ORACLE_SQL, "op4_secrets": secrets.oracle_sql(), "op5_mixing": mixing.ORACLE_SQL, "op8_bagminhash": bagminhash.ORACLE_SQL}
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
