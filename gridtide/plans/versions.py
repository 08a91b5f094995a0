"""Revision tracking and studies of the published versions of an hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_avg, exact_sum
from gridtide.functions.numbers import row_range
from gridtide.operators import ranking
from gridtide.plans.marts import VERSIONS

EPS_MWH = 0.5


def recent_window(long: DataFrame, days: int, hour_in_progress: Column, live: str = "real-time") -> DataFrame:
    """The last ``days`` days by newest hour, without the live version of hours still in progress."""
    hi = long.agg(F.max("hour_utc").alias("_hi"))
    return (
        long.join(F.broadcast(hi))
        .where(F.col("hour_utc") >= F.col("_hi") - F.expr(f"interval {days} day"))
        .where(~((F.col("version") == live) & (F.col("hour_utc") >= hour_in_progress)))
        .drop("_hi")
    )


def compare_snapshots(prev: DataFrame, cur: DataFrame, keys: Sequence[str], value: str, eps: float = EPS_MWH) -> DataFrame:
    """Each key of two snapshots with before, after and what happened to it."""
    j = prev.select(*keys, F.col(value).alias("before")).join(
        cur.select(*keys, F.col(value).alias("after")), list(keys), "full_outer"
    )
    change = F.col("after") - F.col("before")
    return j.withColumn("change", change).withColumn(
        "status",
        F.when(F.col("before").isNull(), "appeared")
        .when(F.col("after").isNull(), "vanished")
        .when(F.abs("change") > eps, "revised")
        .otherwise("unchanged"),
    )


def snapshot_diff(prev: DataFrame, cur: DataFrame, keys: Sequence[str], version: str, value: str, eps: float = EPS_MWH) -> DataFrame:
    """Counts per version plus the largest and mean absolute revision."""
    c = compare_snapshots(prev, cur, keys, value, eps)
    revised = F.col("status") == "revised"
    return c.groupBy(version).agg(
        F.count_if(F.col("status") == "appeared").alias("appeared"),
        F.count_if(F.col("status") == "vanished").alias("vanished"),
        F.count_if(revised).alias("revised"),
        F.count_if(F.col("status") == "unchanged").alias("unchanged"),
        F.round(F.max(F.when(revised, F.abs("change"))), 2).alias("max_abs_mwh"),
        F.round(exact_avg(F.when(revised, F.abs("change"))), 2).alias("mean_abs_mwh"),
    )


def largest_changes(prev: DataFrame, cur: DataFrame, keys: Sequence[str], value: str, top: int = 5, eps: float = EPS_MWH) -> DataFrame:
    """The report of the ``top`` largest revisions (largest first, key order on ties)."""
    c = compare_snapshots(prev, cur, keys, value, eps).where(F.col("status") == "revised")
    return c.orderBy(F.abs("change").desc(), *[F.col(k).desc() for k in keys]).limit(top).select(
        *keys, F.round("before", 1).alias("before_mwh"), F.round("after", 1).alias("after_mwh"), F.round("change", 1).alias("change_mwh")
    )


def version_spans(long: DataFrame) -> DataFrame:
    """Newest hour of three versions and the settlement lag in whole 24-hour spans."""

    def newest(v: str) -> Column:
        return F.max(F.when(F.col("version") == v, F.col("hour_utc")))

    g = long.agg(
        newest("settled").alias("settled_hi"),
        newest("real-time").alias("realtime_hi"),
        newest("day-ahead").alias("day_ahead_hi"),
        F.count(F.lit(1)).alias("rows"),
    )
    return g.withColumn(
        "settlement_lag_days", F.floor(tc.seconds_between("realtime_hi", "settled_hi") / 86400.0).cast("bigint")
    )


def melt_errors(wide: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """One row per hour and unsettled version: absolute, signed and percentage error against settled."""
    arr = F.array(*[F.struct(F.lit(n).alias("version"), F.col(c).alias("value")) for n, c in VERSIONS[:5]])
    x = wide.select(*by, "v_settled", F.explode(arr).alias("_x")).select("*", "_x.*").drop("_x")
    err = F.col("value") - F.col("v_settled")
    return x.withColumn("err", F.round(err, 4)).withColumn("abs_err", F.round(F.abs(err), 4))


def convergence(full: DataFrame, by: Sequence[Column | str], by_names: Sequence[str], min_settled: float) -> DataFrame:
    """Error profile of each version per group; percentage measures only where settled is large enough."""
    e = melt_errors(full, by)
    keys = [*by_names, "version"]
    big = F.col("v_settled") >= min_settled
    pct = F.when(big, F.col("abs_err") / F.col("v_settled") * 100.0)
    # a group is one area's hours of one period, bounded by the calendar
    return e.withColumn("pct", F.round(pct, 6)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hours"),
        exact_avg("abs_err").alias("mae_mwh"),
        exact_avg("err").alias("bias_mwh"),
        F.avg((F.col("pct") <= 5).cast("double")).alias("within_5pct"),
        F.avg((F.col("pct") <= 10).cast("double")).alias("within_10pct"),
        exact_avg("v_settled").alias("mean_settled_mwh"),
        F.percentile("abs_err", 0.5).alias("median_abs_mwh"),
        F.percentile("abs_err", 0.9).alias("p90_abs_mwh"),
    )


def terciles(full: DataFrame, by: str) -> DataFrame:
    """Hours labelled calm / medium / windy by the settled terciles of their area."""
    w = Window.partitionBy(by)  # the hours of one area: bounded by the calendar
    cut = lambda p: F.percentile("v_settled", p).over(w)
    return (
        full.withColumn("_c1", cut(1 / 3))
        .withColumn("_c2", cut(2 / 3))
        .withColumn(
            "level",
            F.when(F.col("v_settled") <= F.col("_c1"), "calm").when(F.col("v_settled") <= F.col("_c2"), "medium").otherwise("windy"),
        )
        .drop("_c1", "_c2")
    )


def disagreement_by_tercile(full: DataFrame, by: str) -> DataFrame:
    """Span of each tercile and the median disagreement of every version in it."""
    return terciles(full, by).groupBy(by, "level").agg(
        F.count(F.lit(1)).alias("hours"),
        F.min("v_settled").alias("settled_from"),
        F.max("v_settled").alias("settled_to"),
        exact_avg("v_settled").alias("mean_settled_mwh"),
        *[F.percentile(F.round(F.abs(F.col(c) - F.col("v_settled")), 4), 0.5).alias(f"median_{c}") for _, c in VERSIONS[:5]],
    )


def fit_tolerance(full: DataFrame, min_settled: float, percentile: float = 0.99) -> DataFrame:
    """One row: percentage tolerance from large hours, absolute tolerance from small ones."""
    e = full.withColumn("_d", F.round(F.abs(F.col("v_realtime") - F.col("v_settled")), 4))
    big = F.col("v_settled") >= min_settled
    e = e.withColumn("_size", F.when(big, "large").otherwise("small")).withColumn(
        "_x", F.when(big, F.round(F.col("_d") / F.col("v_settled") * 100.0, 6)).otherwise(F.col("_d"))
    )
    q = ranking.exact_quantiles(e, ["_size"], "_x", [percentile])
    return q.agg(
        F.round(F.max(F.when(F.col("_size") == "large", F.col("quantile"))), 1).alias("tolerance_pct"),
        F.round(F.coalesce(F.max(F.when(F.col("_size") == "small", F.col("quantile"))), F.lit(0.0)), 1).alias("tolerance_mwh"),
        F.sum("n").alias("fit_hours"),
    )


def breach_curve(full: DataFrame, by: Sequence[str], tolerances: Sequence[float], floor_mwh: float) -> DataFrame:
    """Breach share per group at each tolerance, from one pass: every hour is reduced to the smallest
    percentage at which it no longer breaches, and the (fixed, short) list of tolerances is counted in
    conditional aggregates, so rows are not multiplied by the list."""
    d = F.abs(F.col("v_realtime") - F.col("v_settled"))
    rates = [
        F.struct(
            F.lit(float(t)).alias("tolerance_pct"),
            (
                F.lit(100.0)
                * F.avg((d > F.greatest(F.lit(floor_mwh), F.lit(float(t)) / F.lit(100.0) * F.col("v_settled"))).cast("double"))
            ).alias("breach_pct"),
        )
        for t in tolerances
    ]
    g = full.groupBy(*by).agg(F.count(F.lit(1)).alias("hours"), F.array(*rates).alias("_r"))
    return g.select(*by, "hours", F.explode("_r").alias("_x")).select(*by, "hours", "_x.*")


def preset_hours(full: DataFrame, area: str) -> DataFrame:
    """Per area: the windiest hour, the most divergent hour and the largest live disagreement."""
    cols = [c for _, c in VERSIONS]
    x = full.withColumn("_rng", row_range(*cols)).withColumn("_rt", F.abs(F.col("v_realtime") - F.col("v_settled")))
    row = F.struct("hour_utc", *cols)

    def by(measure: str) -> Column:
        return F.max_by(row, F.struct(F.col(measure), F.col("hour_utc")))

    g = x.groupBy(area).agg(by("v_settled").alias("windiest"), by("_rng").alias("most_divergent"), by("_rt").alias("largest_live_error"))
    return g.select(
        area,
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("why"), F.col(n).alias("r")) for n in ("windiest", "most_divergent", "largest_live_error")])
        ).alias("x"),
    ).select(area, "x.why", "x.r.*")


def median_hour(full: DataFrame, area: str, min_settled: float) -> DataFrame:
    """Per area the hour in the middle of the percentage disagreements (position n div 2 in ascending order)."""
    x = full.where(F.col("v_settled") >= min_settled).withColumn(
        "pct", F.round(F.abs(F.col("v_realtime") - F.col("v_settled")) / F.col("v_settled"), 9)
    )
    w = Window.partitionBy(area)  # the hours of one area: bounded by the calendar
    p = x.withColumn("_p", F.row_number().over(w.orderBy("pct", "hour_utc")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return p.where(F.col("_p") == F.floor(F.col("_n") / 2)).select(area, "hour_utc", "pct")


def cost_of_version(full: DataFrame, by: Sequence[str], share: float) -> DataFrame:
    """Imbalance cost per produced MWh of acting on each tradable version, split in the part due to the
    forecast and the part due to measurement.  Needs ``gap`` = imbalance price minus spot."""
    arr = F.array(*[F.struct(F.lit(n).alias("version"), F.col(c).alias("value")) for n, c in VERSIONS[:4]])
    x = full.select(*by, "v_settled", "v_realtime", "gap", F.explode(arr).alias("_x")).select("*", "_x.*").drop("_x")
    s = F.lit(share)
    produced = s * F.col("v_settled")
    total = -(produced - s * F.col("value")) * F.col("gap")
    fc = -(s * (F.col("v_realtime") - F.col("value"))) * F.col("gap")
    meas = -(s * (F.col("v_settled") - F.col("v_realtime"))) * F.col("gap")
    g = x.groupBy(*by, "version").agg(
        F.count(F.lit(1)).alias("hours"),
        exact_sum(produced).alias("mwh_produced"),
        exact_sum(total).alias("_t"),
        exact_sum(fc).alias("_f"),
        exact_sum(meas).alias("_m"),
        exact_sum(F.abs(produced - s * F.col("value"))).alias("_i"),
    )
    return g.select(
        *by,
        "version",
        "hours",
        "mwh_produced",
        (F.col("_t") / 1000.0).alias("total_keur"),
        F.try_divide("_t", "mwh_produced").alias("eur_per_mwh"),
        F.try_divide("_f", "mwh_produced").alias("forecast_part_eur_per_mwh"),
        F.try_divide("_m", "mwh_produced").alias("measurement_part_eur_per_mwh"),
        F.try_divide("_i", "mwh_produced").alias("imbalance_share"),
    )


def anatomy(realtime: DataFrame, production: DataFrame, full_readings: int) -> DataFrame:
    """Bias of the live feed against settlement by component, area and year, on full hours."""
    r = realtime.groupBy("area", tc.hour_floor("minute_utc").alias("hour_utc")).agg(
        exact_avg("onshore_wind_mw").alias("on_rt"), exact_avg("offshore_wind_mw").alias("off_rt"), F.count(F.lit(1)).alias("n")
    )
    j = production.join(r.where(F.col("n") == full_readings), ["area", "hour_utc"])
    def bias(live: str, settled: str) -> Column:
        return F.round(F.try_divide(F.lit(100.0) * exact_sum(F.col(live) - F.col(settled)), exact_sum(settled)), 1)

    return j.groupBy("area", F.year("hour_utc").alias("year")).agg(
        bias("on_rt", "onshore_wind_mwh").alias("onshore_bias_pct"),
        bias("off_rt", "offshore_wind_mwh").alias("offshore_bias_pct"),
        F.count(F.lit(1)).alias("hours"),
    )


def coverage(wide: DataFrame, full_readings: int) -> DataFrame:
    """One row: spans, share with every version and short live hours."""
    full = (F.col("versions_present") == 6) & (F.col("realtime_readings") == full_readings)
    return wide.agg(
        F.min(F.when(full, F.col("hour_utc"))).cast("date").alias("first_day"),
        F.max(F.when(full, F.col("hour_utc"))).cast("date").alias("last_day"),
        F.count_if(full).alias("hours_all_six"),
        F.count(F.lit(1)).alias("hours_any"),
        F.avg(full.cast("double")).alias("share_all_six"),
        F.count_if(F.col("v_realtime").isNotNull() & (F.col("realtime_readings") < full_readings)).alias("short_hours"),
        F.count_if(F.col("v_realtime").isNotNull()).alias("realtime_hours"),
    )


def newest_complete(wide: DataFrame, full_readings: int) -> DataFrame:
    """The newest row with every version and a full live hour, per area."""
    full = wide.where((F.col("versions_present") == 6) & (F.col("realtime_readings") == full_readings))
    return full.groupBy("area").agg(F.max("hour_utc").alias("hour_utc"))


def recent_board(wide: DataFrame, anchor: Column, days: int = 15) -> DataFrame:
    """versions_present per hour for the ``days`` days before an anchor."""
    return wide.where((F.col("hour_utc") >= anchor - F.expr(f"interval {days} day")) & (F.col("hour_utc") < anchor)).select(
        "area", "hour_utc", "versions_present"
    )
