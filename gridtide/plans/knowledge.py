"""What was known at a deadline: bitemporal reads for all decisions in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.operators.dedup import latest_wins, newest_k


def public_by(published: str, decision: str) -> Column:
    return F.col(published).isNotNull() & (F.col(published) <= F.col(decision))


def available_at(
    decisions: DataFrame, source: DataFrame, event_ts: str, published: str, lookback_days: int, ahead_days: int = 4
) -> DataFrame:
    """Every source row public at each decision within the lookback.

    ``decisions`` has one row per day: ``decision_day`` and the instant ``decision``.  The event day is
    the equi key: each decision is spread over the days of its window, so the join stays a hash join.
    The candidate window deliberately reaches past the decision; only the publication filter decides.
    """
    spread = decisions.withColumn(
        "_day",
        F.explode(
            F.sequence(F.date_sub("decision_day", lookback_days), F.date_add("decision_day", ahead_days), F.expr("interval 1 day"))
        ),
    )
    src = source.withColumn("_day", tc.day_of(event_ts))
    return src.join(spread, "_day").where(public_by(published, "decision")).drop("_day")


def available_counts(
    source: DataFrame, keys: Sequence[str], event_day: Column, usable_day: Column, decisions: DataFrame, decision_day: str,
    lookback_days: int, ahead_days: int,
) -> DataFrame:
    """Rows visible and rows held back by the publication filter, per key and decision day.

    Rows are counted per (key, event day, first usable day) before anything is joined, so the join
    grows with the calendar and not with the number of source rows.
    """
    cells = source.groupBy(*keys, event_day.alias("_day"), usable_day.alias("_usable")).agg(F.count(F.lit(1)).alias("_n"))
    spread = decisions.select(
        decision_day,
        F.explode(
            F.sequence(F.date_sub(decision_day, lookback_days), F.date_add(decision_day, ahead_days), F.expr("interval 1 day"))
        ).alias("_day"),
    )
    ok = F.col("_usable").isNotNull() & (F.col("_usable") <= F.col(decision_day))
    return cells.join(spread, "_day").groupBy(*keys, decision_day).agg(
        F.sum(F.when(ok, F.col("_n")).otherwise(0)).alias("visible"), F.sum(F.when(ok, 0).otherwise(F.col("_n"))).alias("held_back")
    )


def newest_vintage(df: DataFrame, keys: Sequence[str], published: str, decision: str, tie_break: Sequence[str]) -> DataFrame:
    """Per target the row published last before its decision."""
    return latest_wins(df.where(public_by(published, decision)), keys, [published, *tie_break])


def vintage_revision(
    df: DataFrame, keys: Sequence[str], published: str, decision: str, value: str, tie_break: Sequence[str]
) -> DataFrame:
    """Newest and previous public value of each target and their difference."""
    two = newest_k(df.where(public_by(published, decision)), keys, [published, *tie_break], 2)
    g = two.groupBy(*keys).agg(
        F.max(F.when(F.col("k_index") == 0, F.col(value))).alias("newest"),
        F.max(F.when(F.col("k_index") == 1, F.col(value))).alias("previous"),
    )
    return g.withColumn("revision", F.col("newest") - F.col("previous"))


def latest_snapshot(snapshots: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per decision day the newest snapshot date that was public, and its age in days.

    ``snapshots``: snapshot_date, published_at; ``decisions``: decision_day, decision.  Both have at
    most a few rows per calendar day after the distinct, so the running maximum is bounded.
    """
    s = snapshots.select("snapshot_date", "published_at").where(F.col("published_at").isNotNull()).groupBy("snapshot_date").agg(
        F.max("published_at").alias("_t")
    )
    line = s.select("_t", "snapshot_date", F.lit(None).cast("date").alias("decision_day")).unionByName(
        decisions.select(F.col("decision").alias("_t"), F.lit(None).cast("date").alias("snapshot_date"), "decision_day")
    )
    w = Window.partitionBy(F.lit(0)).orderBy("_t", F.col("decision_day").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        line.withColumn("_s", F.max("snapshot_date").over(w))
        .where(F.col("decision_day").isNotNull())
        .select("decision_day", F.col("_s").alias("snapshot_date"), F.datediff("decision_day", "_s").alias("snapshot_age_days"))
    )


def priority_source(
    df: DataFrame, keys: Sequence[str], lead: str, local_hour: str, first: int = 48, second: int = 72, last_hour: int = 21
) -> DataFrame:
    """One row per target: the first lead up to ``last_hour`` local, the second lead later or when the
    first is absent.  The input is already filtered on publication and non-null values."""
    ok = ((F.col(lead) == first) & (F.col(local_hour) <= last_hour)) | (F.col(lead) == second)
    w = Window.partitionBy(*keys).orderBy(lead)
    return df.where(ok).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def prefer_source(a: DataFrame, b: DataFrame, group: Sequence[str], keys: Sequence[str], value: str) -> DataFrame:
    """Whole groups from A when A has any value there, else from B; source code 1, 2 or 0 (neither)."""
    u = (
        a.select(*keys, F.lit(1).alias("_s"), value)
        .unionByName(b.select(*keys, F.lit(2).alias("_s"), value))
        .groupBy(*keys)
        .agg(F.max(F.when(F.col("_s") == 1, F.col(value))).alias("_a"), F.max(F.when(F.col("_s") == 2, F.col(value))).alias("_b"))
    )
    flags = u.groupBy(*group).agg((F.count("_a") > 0).alias("_has_a"), (F.count("_b") > 0).alias("_has_b"))
    return (
        u.join(flags, list(group))
        .withColumn("source", F.when(F.col("_has_a"), 1).when(F.col("_has_b"), 2).otherwise(0))
        .withColumn(value, F.when(F.col("_has_a"), F.col("_a")).otherwise(F.col("_b")))
        .select(*keys, value, "source")
    )
