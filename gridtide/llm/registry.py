"""Queries of the training-data operators and their SQL oracles. A query has the name of its module."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "op1_tree_bpe",
    "op2_importance_resampling",
    "op3_bm25_decontamination",
    "op4_line_spread",
    "op5_toxic_spans",
    "op6_licence_automaton",
    "op7_language_filters",
    "op8_katz_backoff",
    "op9_closed_syncmers",
    "op10_token_groups",
    "op11_recursive_splitting",
    "op12_multi_index",
    "op13_nra_search",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: importlib.import_module(f"gridtide.llm.{name}").query for name in NAMES}


def oracle_sql() -> dict[str, str]:
    got = {name: getattr(importlib.import_module(f"gridtide.llm.{name}"), "ORACLE_SQL", None) for name in NAMES}
    return {k: v for k, v in got.items() if v is not None}
