"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe, decontaminate, licenses, line_quality, near_dedup, secrets, spelling, substring_dedup, suffix_dedup, toxicity,
    topk, url_filter, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_line_quality": line_quality.op10_line_quality,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_whitening": whitening.op12_whitening,
    "op13_top_k": topk.op13_top_k,
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": url_filter.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op10_line_quality": line_quality.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op13_top_k": topk.ORACLE,
}
