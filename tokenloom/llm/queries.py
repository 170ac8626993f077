"""Queries of the pipeline operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_text, lines, mixing, quality, simhash, tokens, topk, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": chat.op1_chat_formatting,
        "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
        "op3_exact_top_k": topk.op3_exact_top_k,
        "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
        "op5_line_dedup": lines.op5_line_dedup,
        "op6_url_filters": urls.op6_url_filters,
        "op7_mixing": mixing.op7_mixing,
        "op8_token_counts": tokens.op8_token_counts,
        "op9_html_extraction": html_text.op9_html_extraction,
        "op10_quality_classifier": quality.op10_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat.OP1_SQL, "op3_exact_top_k": topk.OP3_SQL, "op5_line_dedup": lines.OP5_SQL, "op6_url_filters": urls.OP6_SQL}
