"""Runs of consecutive steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc


def consecutive_episodes(df: DataFrame, keys: Sequence[str], ts: str, step_seconds: int = 3600) -> DataFrame:
    """Islands of consecutive stamps: start, end and length in steps.

    Input is one row per (key, step).  The step number minus the row number is constant inside an
    island.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    n = tc.epoch_seconds(ts) / F.lit(step_seconds)
    return (
        df.withColumn("_g", n.cast("bigint") - F.row_number().over(w))
        .groupBy(*keys, "_g")
        .agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("steps"))
        .drop("_g")
    )


def flag_autumn_change(df: DataFrame, start: str = "start", steps: str = "steps") -> DataFrame:
    """Marks the one-hour episode of the October clock change (00:00 UTC on a Sunday)."""
    s = F.col(start)
    return df.withColumn(
        "clock_change",
        (F.col(steps) == 1) & (F.month(s) == 10) & (F.hour(s) == 0) & (F.weekday(s.cast("date")) == 6),
    )


def gaps_by_lead(df: DataFrame, keys: Sequence[str], ts: str, step_seconds: int = 3600) -> DataFrame:
    """Rows whose next stamp is not exactly one step later."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return (
        df.select(*keys, ts)
        .withColumn("next_ts", F.lead(ts).over(w))
        .where(F.col("next_ts").isNotNull() & (tc.seconds_between("next_ts", ts) != step_seconds))
    )
