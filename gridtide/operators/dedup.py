"""Keeping one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _newest(order: Sequence[Column | str]) -> list[Column]:
    return [(F.col(o) if isinstance(o, str) else o).desc_nulls_last() for o in order]


def latest_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The newest row of every key; ``order`` lists the deciding columns and must end in a tie-break.

    The ``row_number() = 1`` form lets Spark drop all but one row per key in each map task before the
    shuffle (WindowGroupLimit), so a key with very many re-fetches costs one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*_newest(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def newest_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The k newest rows per key with ``k_index`` 0 for the newest."""
    w = Window.partitionBy(*keys).orderBy(*_newest(order))
    return (
        df.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= k)
        .withColumn("k_index", F.col("_rn") - 1)
        .drop("_rn")
    )


def newest_block(df: DataFrame, keys: Sequence[str], issue: str) -> DataFrame:
    """All rows that carry the newest issue of their key (not the newest row of each target).

    The newest issue is an aggregate joined back, so a key with many rows is never gathered in one
    window partition.
    """
    top = df.groupBy(*keys).agg(F.max(issue).alias(issue))
    return df.join(top, [*keys, issue], "left_semi")


def duplicate_report(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct keys and the rows a keep-one rule drops, per series (``by``, part of ``keys``)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(*by).agg(
        F.sum("_n").alias("rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        (F.sum("_n") - F.count(F.lit(1))).alias("dropped"),
        F.count_if(F.col("_n") > 1).alias("repeated_keys"),
    )


def exact_duplicates_dropped(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per distinct combination of ``cols`` (only those columns are kept)."""
    return df.select(*cols).distinct()
