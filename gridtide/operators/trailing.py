"""Trailing statistics on calendar grids.

The functions expect one row per (entity, calendar step); the window of one entity is then bounded by
the length of the calendar.  ``day_index`` turns dates into integers so that RANGE frames count
calendar days and simply skip missing ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions.exact import (
    exact_sum_over, fixed, mean_of, sliding_avg, sliding_count, sliding_share,
)
from gridtide.operators import pools


def day_index(day: Column | str) -> Column:
    return F.datediff(F.col(day) if isinstance(day, str) else day, F.lit("1970-01-01").cast("date"))


def days_window(keys: Sequence[str], day: str, first: int, last: int):
    """RANGE frame of calendar days: first..last relative to the row's day (negative = earlier)."""
    return Window.partitionBy(*keys).orderBy(day_index(day)).rangeBetween(first, last)


def by_day(keys: Sequence[str], day: str):
    """Window of one entity ordered by day number, to be used with the ``sliding_*`` expressions."""
    return Window.partitionBy(*keys).orderBy(day_index(day))


def rows_window(keys: Sequence[str], order: str, first: int, last: int):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(first, last)


def trailing_stats(
    df: DataFrame, keys: Sequence[str], day: str, value: str, days: int, prefix: str, spike: float | None = None
) -> DataFrame:
    """Mean, median, sample deviation, count and two tail rates over D-days .. D-1."""
    w, o = days_window(keys, day, -days, -1), by_day(keys, day)
    v = F.col(value)
    out = (
        df.withColumn(f"{prefix}_mean", sliding_avg(v, o, -days, -1))
        .withColumn(f"{prefix}_median", F.call_function("percentile", v, F.lit(0.5)).over(w))
        .withColumn(f"{prefix}_std", F.stddev_samp(v).over(w))
        .withColumn(f"{prefix}_n", sliding_count(v, o, -days, -1))
    )
    if spike is not None:
        out = out.withColumn(f"{prefix}_up_rate", sliding_share(v > spike, o, -days, -1)).withColumn(
            f"{prefix}_down_rate", sliding_share(v < -spike, o, -days, -1)
        )
    return out


def trailing_mean(df: DataFrame, keys: Sequence[str], day: str, value: str, days: int, out: str) -> DataFrame:
    return df.withColumn(out, sliding_avg(value, by_day(keys, day), -days, -1))


def trailing_rank(
    df: DataFrame, keys: Sequence[str], day: str, value: str, out: str, days: int = 365, min_obs: int = 60
) -> DataFrame:
    """Share of the strictly earlier ``days`` calendar days with a value strictly below today's; null
    with fewer than ``min_obs`` observations.

    The frame holds at most ``days`` numbers; they are compared in place with a higher-order function,
    which avoids a self join that would emit ``days`` rows per row.
    """
    w = days_window(keys, day, -days, -1)
    return (
        df.withColumn("_hist", F.collect_list(value).over(w))
        .withColumn("_less", F.size(F.filter("_hist", lambda x: x < F.col(value))))
        .withColumn(
            out,
            F.when(
                F.col(value).isNotNull() & (F.size("_hist") >= min_obs),
                F.col("_less").cast("double") / F.size("_hist").cast("double"),
            ),
        )
        .drop("_hist", "_less")
    )


def pooled_rolling_cut(scores: DataFrame, day: str, score: str, days: int, k: float, out: str) -> DataFrame:
    """Per day, the (1-k) quantile of every entity's score on the previous ``days`` days: one row per day."""
    return pools.rolling_quantile(pools.Pool(scores, day, score, days), scores, day, 1 - k, out).drop("n")


def masked_trailing(
    values: DataFrame,
    keys: Sequence[str],
    value_day: str,
    usable_day: str,
    value: str,
    decisions: DataFrame,
    decision_day: str,
    days: int,
) -> DataFrame:
    """Trailing mean over D-days .. D-1 of the values whose ``usable_day`` is at or before D.

    Values are summed per (entity, day, usable day) cell, then the plain window sum over the calendar is
    corrected by the cells that were not usable yet.  Only late cells (usable after the next day) reach
    the correction, one row per decision they are late for, so punctual rows are never multiplied by the
    window length.
    """
    cells = values.where(F.col(usable_day).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, value_day, usable_day).agg(
        F.sum(fixed(value)).alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    per_day = cells.groupBy(*keys, F.col(value_day).alias("_day")).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    asked = decisions.select(F.col(decision_day).alias("_day")).distinct()
    span = decisions.agg(F.min(decision_day).alias("_a"), F.max(decision_day).alias("_b"))  # one row
    ask = (
        values.select(*keys).distinct().join(F.broadcast(span))
        .withColumn("_day", F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))))
        .join(asked, "_day", "left_semi")
        .withColumnRenamed("_day", decision_day)
    )
    line = ask.select(*keys, F.col(decision_day).alias("_day"), F.lit(True).alias("_q"), F.lit(0).cast("bigint").alias("_s"), F.lit(0).cast("bigint").alias("_n")).unionByName(
        per_day.select(*keys, "_day", F.lit(False).alias("_q"), "_s", "_n")
    )
    o = by_day(keys, "_day")
    start = Window.unboundedPreceding
    grow = lambda c, last: F.coalesce(F.sum(c).over(o.rangeBetween(start, last)), F.lit(0))
    bulk = (
        line.withColumn("_ws", grow("_s", -1) - grow("_s", -days - 1))
        .withColumn("_wn", grow("_n", -1) - grow("_n", -days - 1))
        .where("_q")
        .select(*keys, F.col("_day").alias(decision_day), "_ws", "_wn")
    )
    late = cells.where(F.datediff(usable_day, value_day) > 1).withColumn(
        decision_day,
        F.explode(
            F.sequence(
                F.date_add(value_day, 1),
                F.least(F.date_sub(usable_day, 1), F.date_add(value_day, days)),
                F.expr("interval 1 day"),
            )
        ),
    )
    fix = late.groupBy(*keys, decision_day).agg(F.sum("_s").alias("_ls"), F.sum("_n").alias("_ln"))
    j = bulk.join(fix, [*keys, decision_day], "left")
    s = F.col("_ws") - F.coalesce("_ls", F.lit(0))
    n = F.col("_wn") - F.coalesce("_ln", F.lit(0))
    return j.select(
        *keys,
        decision_day,
        F.when(n > 0, mean_of(s, n)).alias(f"{value}_{days}d"),
        n.alias("n_usable"),
    )


def forward_fill(df: DataFrame, keys: Sequence[str], order: str, value: str, limit: int, out: str) -> DataFrame:
    """Last non-null value within ``limit`` rows and its age in rows (complete grid expected)."""
    w = rows_window(keys, order, -limit, 0)
    ordered = Window.partitionBy(*keys).orderBy(order)
    return (
        df.withColumn("_pos", F.row_number().over(ordered))
        .withColumn(out, F.last(value, ignorenulls=True).over(w))
        .withColumn(f"{out}_age", F.col("_pos") - F.last(F.when(F.col(value).isNotNull(), F.col("_pos")), ignorenulls=True).over(w))
        .drop("_pos")
    )


def sign_run_length(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Length of the run of the same non-zero sign ending at each row; null and zero give 0."""
    s = F.when(F.col(value) > 0, 1).when(F.col(value) < 0, -1).otherwise(0)
    w = Window.partitionBy(*keys).orderBy(order)
    run = Window.partitionBy(*keys, "_g").orderBy(order)
    return (
        df.withColumn("_s", s)
        .withColumn("_new", (F.col("_s") != F.coalesce(F.lag("_s").over(w), F.lit(0))).cast("int"))
        .withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(out, F.when(F.col("_s") == 0, 0).otherwise(F.row_number().over(run)))
        .drop("_s", "_new", "_g")
    )


def rolling_median(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int, min_obs: int, out: str) -> DataFrame:
    """Median of the current and the previous ``rows - 1`` rows when at least ``min_obs`` are present."""
    w = rows_window(keys, order, -(rows - 1), 0)
    return df.withColumn(
        out,
        F.when(F.count(value).over(w) >= min_obs, F.call_function("percentile", F.col(value), F.lit(0.5)).over(w)),
    )


def equity(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Running total, running peak (starting at zero) and drawdown."""
    w = rows_window(keys, order, Window.unboundedPreceding, 0)
    return (
        df.withColumn("cum", exact_sum_over(value, w))
        .withColumn("peak", F.greatest(F.lit(0.0), F.max("cum").over(w)))
        .withColumn("drawdown", F.col("cum") - F.col("peak"))
    )


def rolling_sharpe(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int, periods: float, out: str) -> DataFrame:
    """mean/std * sqrt(periods) over a full window of ``rows`` rows only; null for a flat window."""
    w = rows_window(keys, order, -(rows - 1), 0)
    sd = F.stddev_samp(value).over(w)
    return df.withColumn(
        out, F.when((F.count(value).over(w) == rows) & (sd > 0), F.avg(value).over(w) / sd * F.sqrt(F.lit(periods)))
    )


def thin_from_end(df: DataFrame, keys: Sequence[str], order: str, step: int) -> DataFrame:
    """Every ``step``-th row counted back from the last one (which is always kept)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_b", F.row_number().over(w)).where((F.col("_b") - 1) % step == 0).drop("_b")


def all_above(levels: Column, flags: Column) -> Column:
    """For each position of a flag array: the flag and every later flag hold."""
    n = F.size(flags)
    return F.transform(levels, lambda _x, i: F.forall(F.slice(flags, i + 1, n - i), lambda b: b))


def all_below(levels: Column, flags: Column) -> Column:
    """For each position of a flag array: the flag and every earlier flag hold."""
    return F.transform(levels, lambda _x, i: F.forall(F.slice(flags, F.lit(1), i + 1), lambda b: b))
