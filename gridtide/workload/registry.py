"""Registration of queries and their oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

FAMILIES = (
    "landing",
    "columns",
    "staging",
    "joining",
    "aggregating",
    "windowing",
    "marts",
    "checks",
    "revisions",
    "knowledge",
    "features",
    "studies",
    "positions",
    "selecting",
    "models",
    "live",
    "questions",
)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return register


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"gridtide.workload.{family}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
