"""Queries of this package and their DuckDB oracles, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import chat, decontamination, html_text, matroska, minhash, mixing, ngram_lm, packing, quality, secrets, toxicity, turn_repair, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_quality": quality.op2_quality,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_secret_scans": secrets.op4_secret_scans,
        "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
        "op6_html_extraction": html_text.op6_html_extraction,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "reply_branches": chat.reply_branches,
        "op8_media_matroska": matroska.op8_media_matroska,
        "op9_lm_scoring": ngram_lm.op9_lm_scoring,
        "op10_decontamination": decontamination.op10_decontamination,
        "op11_turn_repair": turn_repair.op11_turn_repair,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_packing": packing.op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.ORACLE,
        "op4_secret_scans": secrets.ORACLE,
        "op7_chat_formatting": chat.ORACLE,
        "reply_branches": chat.BRANCHES_ORACLE,
        "op10_decontamination": decontamination.ORACLE,
        "op11_turn_repair": turn_repair.ORACLE,
        "op12_vector_codes": vector_codes.ORACLE,
    }
