"""The queries of this subpackage by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe_codec, decontamination, exact_dedup, html_text, lm_scoring, near_dedup, quality, sharding, substring_dedup, token_counts

_MODULES = (sharding, lm_scoring, token_counts, bpe_codec, quality, html_text, substring_dedup, near_dedup, exact_dedup, decontamination)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
