"""The registered queries: each operator bound to the given tables, with an independent SQL oracle."""

from gridtide.workload.registry import oracle_sql, queries

__all__ = ["queries", "oracle_sql"]
