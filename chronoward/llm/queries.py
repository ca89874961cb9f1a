"""Queries and SQL of the training-data operators, added to the entry point while this subpackage exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, decontaminate, exact_dedup, html_text, language, line_dedup, near_dup, quality, secrets, substrings, topk, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.query,
        "op2_bpe": bpe.query,
        "op3_language": language.query,
        "op4_topk": topk.query,
        "op5_near_dup": near_dup.query,
        "op6_substrings": substrings.query,
        "op7_secrets": secrets.query,
        "op8_html": html_text.query,
        "op9_line_dedup": line_dedup.query,
        "op10_quality": quality.query,
        "op11_exact_dedup": exact_dedup.query,
        "op12_collocations": collocations.query,
        "op13_vector_codes": vector_codes.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_topk": topk.ORACLE,
        "op5_near_dup": near_dup.ORACLE,
        "op6_substrings": substrings.ORACLE,
        "op11_exact_dedup": exact_dedup.ORACLE,
        "op12_collocations": collocations.ORACLE,
        "op13_vector_codes": vector_codes.ORACLE,
    }
