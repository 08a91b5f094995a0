"""When did a value become public?  Time-zone resolution and publication stamps.

A publication stamp is a UTC NTZ column; null means "never published", and such a row must not be
used at any decision time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.numbers import later_of


def wall_to_utc(local: Column, zone: str, second_occurrence: Column) -> Column:
    """Local wall clock to UTC where the n-th occurrence of a repeated hour selects the offset."""
    first = tc.to_utc(local, zone)
    later = first + tc.hours(1)
    repeats = tc.to_local(later, zone) == local
    return F.when(second_occurrence & repeats, later).otherwise(first)


def is_missing_wall_time(local: Column, zone: str) -> Column:
    """True for a wall-clock time that the spring change skips."""
    return tc.to_local(tc.to_utc(local, zone), zone) != local


def localize_wall(
    df: DataFrame, local: str, keys: Sequence[str], ordinal: str, zone: str, out: str = "instant_utc"
) -> DataFrame:
    """Row order decides the fall-back twin: first occurrence = daylight time, second = standard.

    Adds ``out`` and ``missing_wall`` (a skipped hour, which the caller must treat as an error).  The
    window partition is one (key, wall time), at most a handful of rows.
    """
    w = Window.partitionBy(*keys, local).orderBy(ordinal)
    return (
        df.withColumn("_occ", F.row_number().over(w))
        .withColumn(out, wall_to_utc(F.col(local), zone, F.col("_occ") > 1))
        .withColumn("missing_wall", is_missing_wall_time(F.col(local), zone))
        .drop("_occ")
    )


def localize_conservative(local: Column, zone: str) -> Column:
    """Repeated wall times become the later instant, skipped ones shift forward."""
    return wall_to_utc(local, zone, F.lit(True))


def publish_day_ahead(event_utc: Column, file_written_utc: Column, zone: str, hour: int = 11) -> Column:
    """Later of ``hour``:00 local on the day before and the file write time; null without a file."""
    bound = tc.to_utc(tc.midnight(F.date_sub(tc.local_date(event_utc, zone), 1)) + tc.hours(hour), zone)
    return F.when(file_written_utc.isNotNull(), later_of(bound, file_written_utc))


def was_rewritten(event_utc: Column, file_written_utc: Column, zone: str) -> Column:
    """The file was written after the end of the local day it describes."""
    day_end = tc.to_utc(tc.midnight(F.date_add(tc.local_date(event_utc, zone), 1)), zone)
    return F.coalesce(file_written_utc > day_end, F.lit(False))


def publish_real_time(event_utc: Column, file_written_utc: Column, zone: str, lag_minutes: int = 15) -> Column:
    """Hour end plus a lag; a rewritten file counts from the later of that and the rewrite."""
    normal = event_utc + tc.hours(1) + tc.seconds(60 * lag_minutes)
    return F.when(
        file_written_utc.isNotNull(),
        F.when(was_rewritten(event_utc, file_written_utc, zone), later_of(normal, file_written_utc)).otherwise(normal),
    )


def publish_forecast(issue_day: Column, file_written_utc: Column, zone: str, hour: int = 6) -> Column:
    """Later of the write time and ``hour``:00 local on the day before the issue date."""
    bound = tc.to_utc(tc.midnight(F.date_sub(issue_day, 1)) + tc.hours(hour), zone)
    return F.when(file_written_utc.isNotNull(), later_of(bound, file_written_utc))


def publish_weather(valid_utc: Column, lead_hours: Column, slack_hours: int = 8) -> Column:
    """Valid time minus the nominal lead plus run choice and processing slack."""
    return valid_utc - tc.hours(lead_hours) + tc.hours(slack_hours)


def pair_series(
    left: DataFrame, right: DataFrame, keys: Sequence[str], measures: Sequence[str], names: tuple[str, str], label: str
) -> DataFrame:
    """Full outer join of two price series on their keys, measures prefixed and the label coalesced."""
    a, b = names

    def prefixed(df: DataFrame, p: str) -> DataFrame:
        return df.select(*keys, F.col(label).alias(f"_{p}_{label}"), *[F.col(m).alias(f"{p}_{m}") for m in measures])

    joined = prefixed(left, a).join(prefixed(right, b), list(keys), "full_outer")
    return joined.withColumn(label, F.coalesce(F.col(f"_{a}_{label}"), F.col(f"_{b}_{label}"))).drop(
        f"_{a}_{label}", f"_{b}_{label}"
    )


def price_components(df: DataFrame, prefix: str) -> DataFrame:
    """congestion = -raw; energy = price - loss - congestion."""
    return df.withColumn(f"{prefix}_congestion", -F.col(f"{prefix}_congestion_raw")).withColumn(
        f"{prefix}_energy", F.col(f"{prefix}_lbmp") - F.col(f"{prefix}_loss") - F.col(f"{prefix}_congestion")
    )
