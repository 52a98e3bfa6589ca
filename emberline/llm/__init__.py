"""Operations of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: The module of each query.
MODULES = {
    "op1_secret_scan": "secret_scan",
    "op2_fingerprints": "fingerprints",
    "op3_best_fit_packing": "packing",
    "op4_warc_index": "warc",
    "op5_bpe_codec": "token_codec",
    "op6_ngram_jaccard_join": "ngram_join",
    "op7_toxicity": "toxicity",
    "op8_orc_token_ids": "orc_tokens",
    "op9_substring_dedup": "substring_dedup",
    "op10_quality_rules": "quality",
    "secret_scan_base": "exact",
    "edited_texts": "exact",
    "capture_records": "exact",
    "quality_base": "exact",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES.values():
        found |= getattr(import_module(f"{__name__}.{module}"), "ORACLE_SQL", {})
    return found
