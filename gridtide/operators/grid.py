"""Regular time grids: stitching, resampling, completing, interpolating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_avg, fixed, mean_of


def stitch(old: DataFrame, new: DataFrame, ts: str, seam: Column) -> DataFrame:
    """Rows of ``old`` strictly before the seam, rows of ``new`` from it on.  Both filters reach the scans."""
    return old.where(F.col(ts) < seam).unionByName(new.where(F.col(ts) >= seam))


def resample(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, out: str, step_minutes: int = 60, label: str | None = None
) -> DataFrame:
    """Mean and interval count per key and slot; with ``label`` also its smallest text."""
    aggs = [exact_avg(value).alias(out), F.count(F.lit(1)).alias("n_intervals")]
    if label:
        aggs.append(F.min(label).alias(label))
    return df.groupBy(*keys, tc.floor_minutes(ts, step_minutes).alias("hour_utc")).agg(*aggs)


def resample_complete_readings(
    df: DataFrame, keys: Sequence[str], ts: str, parts: Sequence[str], out: str, readings: str
) -> DataFrame:
    """Hourly mean of the sum of all parts over readings where none is missing, with their count."""
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    kept = df.where(total.isNotNull()).withColumn("_total", total)
    return kept.groupBy(*keys, tc.hour_floor(ts).alias("hour_utc")).agg(
        exact_avg("_total").alias(out), F.count(F.lit(1)).alias(readings)
    )


def time_weighted_hourly(
    df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], first_span_seconds: int = 300
) -> DataFrame:
    """Hourly means where a row covers (previous stamp, stamp], clipped at the hour start.

    The previous stamp is looked up inside one local day per key, which bounds the window partition.
    Adds ``covered_seconds``; a complete hour has 3600.
    """
    hour = tc.hour_floor(F.col(ts) - tc.seconds(1))
    w = Window.partitionBy(*keys, "_day").orderBy(ts)
    spans = (
        df.withColumn("_day", tc.day_of(F.col(ts) - tc.seconds(1)))
        .withColumn("hour_utc", hour)
        .withColumn("_prev", F.coalesce(F.lag(ts).over(w), F.col(ts) - tc.seconds(first_span_seconds)))
        .withColumn("_start", F.greatest("_prev", "hour_utc"))
        .withColumn("_w", tc.seconds_between(F.col(ts), F.col("_start")))
    )
    aggs = [F.sum("_w").alias("covered_seconds")]
    for v in values:
        weighted = F.sum(fixed(v) * F.col("_w"))
        aggs.append(F.round(mean_of(weighted, F.sum("_w")), 2).alias(v))
    return spans.groupBy(*keys, "hour_utc").agg(*aggs)


def bounds(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))


def series_between(df: DataFrame, lo: str, hi: str, step: str, out: str) -> DataFrame:
    """One row per step of every [lo, hi] row."""
    return df.withColumn(out, F.explode(F.sequence(F.col(lo), F.col(hi), F.expr(f"interval {step}")))).drop(lo, hi)


def expected_grid(df: DataFrame, keys: Sequence[str], ts: str, step: str = "1 hour") -> DataFrame:
    """Every step between the first and last stamp of each key."""
    return series_between(bounds(df, keys, ts), "lo", "hi", step, ts)


def complete_grid(df: DataFrame, keys: Sequence[str], ts: str, step: str = "1 hour") -> DataFrame:
    """``df`` on its full grid; steps without a row appear with nulls."""
    return expected_grid(df, keys, ts, step).join(df, [*keys, ts], "left")


def missing_steps(df: DataFrame, keys: Sequence[str], ts: str, step: str = "1 hour") -> DataFrame:
    """Grid steps with no row (anti join)."""
    return expected_grid(df, keys, ts, step).join(df.select(*keys, ts), [*keys, ts], "left_anti")


def local_day_hours(days: DataFrame, day: str, zone: str) -> DataFrame:
    """All UTC hours of each local day: 23, 24 or 25 of them."""
    lo = tc.to_utc(tc.midnight(F.col(day)), zone)
    hi = tc.to_utc(tc.midnight(F.date_add(F.col(day), 1)), zone) - tc.hours(1)
    return days.withColumn("hour_utc", F.explode(F.sequence(lo, hi, F.expr("interval 1 hour"))))


def interpolate_hourly(df: DataFrame, run_keys: Sequence[str], ts: str, value: str, max_gap_hours: int = 24) -> DataFrame:
    """Linear hourly values between the points of one run; nothing outside the run or across a gap
    wider than ``max_gap_hours``.  A run is a bounded list of lead times."""
    w = Window.partitionBy(*run_keys).orderBy(ts)
    segs = df.withColumn("_t1", F.lead(ts).over(w)).withColumn("_v1", F.lead(value).over(w))
    span = tc.seconds_between(F.col("_t1"), F.col(ts))
    last = F.when(
        F.col("_t1").isNull() | (span > max_gap_hours * 3600), F.col(ts)
    ).otherwise(F.col("_t1") - tc.hours(1))
    steps = segs.withColumn("_t", F.explode(F.sequence(F.col(ts), F.greatest(last, F.col(ts)), F.expr("interval 1 hour"))))
    frac = tc.seconds_between(F.col("_t"), F.col(ts)).cast("double") / span.cast("double")
    val = F.when(F.col("_t") == F.col(ts), F.col(value)).otherwise(
        F.col(value) + (F.col("_v1") - F.col(value)) * frac
    )
    return steps.select(*run_keys, F.col("_t").alias(ts), val.alias(value))


def wall_hour_grid(df: DataFrame, keys: Sequence[str], ts: str, value: str, zone: str) -> DataFrame:
    """Mean per local day and wall hour: fall-back twins are averaged, the skipped hour has no row."""
    return df.groupBy(
        *keys, tc.local_date(ts, zone).alias("local_day"), tc.local_hour(ts, zone).alias("wall_hour")
    ).agg(exact_avg(value).alias(value))


def slot_of_hour(df: DataFrame, keys: Sequence[str], ts: str, zone: str) -> DataFrame:
    """Local hour 0..23, or 24 for the second pass of the repeated hour.

    The twin is recognised from the clock alone, so no window is needed.
    """
    local = tc.to_local(F.col(ts), zone)
    earlier_twin = tc.to_local(F.col(ts) - tc.hours(1), zone) == local
    return df.withColumn("local_day", local.cast("date")).withColumn(
        "slot", F.when(earlier_twin, 24).otherwise(F.hour(local))
    )
