"""The queries of the operators in this subpackage, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import linededup, mixing, passages, pieces, quality, simhash, tokens, toolcalls, urlrules, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": linededup.op1_line_dedup,
        "op2_url_filters": urlrules.op2_url_filters,
        "op3_substring_dedup": passages.op3_substring_dedup,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_tool_calls": toolcalls.op5_tool_calls,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
        "op9_pieces": pieces.op9_pieces,
        "op10_embedding_near_dedup": vectors.op10_embedding_near_dedup,
        "op8_token_counts": tokens.op8_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": linededup.OP1_SQL,
        "op2_url_filters": urlrules.OP2_SQL,
        "op5_tool_calls": toolcalls.OP5_SQL,
        "op6_mix_sources": mixing.OP6_SQL,
        "op10_embedding_near_dedup": vectors.OP10_SQL,
    }
