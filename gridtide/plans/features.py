"""Point-in-time features of a delivery panel (zone, slot of the day, delivery date)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions import numbers
from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_avg, exact_sum, fixed, mean_of, sliding_avg, sliding_count, sliding_share
from gridtide.operators import joins, ranking, trailing
from gridtide.operators.dedup import newest_k
from gridtide.operators.setops import table_differences
from gridtide.plans.knowledge import public_by


def zone_slot_features(panel: DataFrame, zone: str, slot: str, day: str, price: str, gap: str, spike: float) -> DataFrame:
    """Same-slot history before the day: price and gap of D-1, means of 7, 28 and 365 days, tails, counts.

    All frames share one partitioning and one sort, so the five windows cost a single shuffle.
    """
    o = trailing.by_day([zone, slot], day)
    g = F.col(gap)

    def yesterday(c: str) -> Column:
        return F.max(c).over(o.rangeBetween(-1, -1))

    return panel.select(
        day,
        zone,
        slot,
        yesterday(price).alias("price_dm1"),
        sliding_avg(price, o, -7, -1).alias("price_7d"),
        yesterday(gap).alias("gap_dm1"),
        sliding_avg(gap, o, -7, -1).alias("gap_7d"),
        sliding_avg(gap, o, -28, -1).alias("gap_28d"),
        sliding_share(g > spike, o, -28, -1).alias("spike_28d"),
        sliding_share(g < -spike, o, -28, -1).alias("negspike_28d"),
        sliding_avg(gap, o, -365, -1).alias("gap_365d"),
        sliding_count(gap, o, -365, -1).alias("n_365d"),
    )


def zone_day_features(panel: DataFrame, zone: str, slot: str, day: str, price: str, gap: str, early_slot: int) -> DataFrame:
    """Per zone and day: means of earlier days, the day's early gap and price level, the last value seen."""
    daily = panel.groupBy(zone, day).agg(
        F.sum(fixed(gap)).alias("_s"),
        F.count(gap).alias("_n"),
        exact_avg(F.when(F.col(slot) <= early_slot, F.col(gap))).alias("gap_early"),
        exact_avg(price).alias("price_mean"),
        F.max(price).alias("price_max"),
        F.max_by(gap, slot).alias("gap_last"),
        F.max(F.when(F.col(gap).isNotNull(), F.col(slot))).alias("_last_slot"),
    )

    def mean(n: int) -> Column:
        w = trailing.days_window([zone], day, -n, -1)
        return mean_of(F.sum("_s").over(w), F.sum("_n").over(w))

    ordered = Window.partitionBy(zone).orderBy(day)
    return daily.select(
        zone,
        day,
        mean(1).alias("gap_dm1_mean"),
        mean(7).alias("gap_7d_all"),
        mean(28).alias("gap_28d_all"),
        "gap_early",
        "price_mean",
        "price_max",
        F.lag("gap_last").over(ordered).alias("last_gap_before"),
        F.datediff(day, F.lag(day).over(ordered)).alias("days_since_last"),
    )


def forecast_features(newest: DataFrame, zone: str, day: str, slot: str, value: str) -> DataFrame:
    """Value, day peak, value relative to the peak, change on the day before at the same slot, system total."""
    peak = F.max(value).over(Window.partitionBy(zone, day))
    total = newest.groupBy(day, slot).agg(exact_sum(value).alias("system_total"))
    prev = trailing.days_window([zone, slot], day, -1, -1)
    return newest.select(
        zone, day, slot, value, peak.alias("peak"), (F.col(value) / peak).alias("relative"), (F.col(value) - F.max(value).over(prev)).alias("day_change")
    ).join(total, [day, slot])


def point_distribution(points: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Spread of a value over the points of each step: quantiles, deviation and count."""
    q = ranking.quantile_columns(points, keys, value, {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    sd = points.groupBy(*keys).agg(F.stddev_samp(value).alias("std"))
    return q.join(sd, list(keys))


def border_features(panel: DataFrame, zone: str, slot: str, day: str, gap: str, price: str, borders: Sequence[str]) -> DataFrame:
    """For every zone row the same-step price of each border proxy, its trailing gap and the spread to it.

    The proxies are a fixed short list: they are pivoted once into columns and joined by step.
    """
    b = trailing.trailing_mean(panel.where(F.col(zone).isin(list(borders))), [zone, slot], day, gap, 7, "_g7")
    cols = []
    for name in borders:
        hit = F.col(zone) == name
        slug = name.lower().replace(" ", "_")
        cols += [F.max(F.when(hit, F.col(price))).alias(f"price_{slug}"), F.max(F.when(hit, F.col("_g7"))).alias(f"gap7_{slug}")]
    wide = b.groupBy(day, slot).agg(*cols)
    out = panel.where(~F.col(zone).isin(list(borders))).join(wide, [day, slot], "left")
    for name in borders:
        slug = name.lower().replace(" ", "_")
        out = out.withColumn(f"spread_{slug}", F.col(price) - F.col(f"price_{slug}"))
    return out


def specialist_features(panel: DataFrame, zone: str, slot: str, day: str, gap: str, price: str, move: float) -> DataFrame:
    """Rates of large moves up and down over 28 days, 28-day upper decile and the share of large prices."""
    keys = [zone, slot]
    w, o = trailing.days_window(keys, day, -28, -1), trailing.by_day(keys, day)
    g = F.col(gap)
    return panel.select(
        day, zone, slot,
        sliding_share(g > move, o, -28, -1).alias("up_rate"),
        sliding_share(g < -move, o, -28, -1).alias("down_rate"),
        F.call_function("percentile", g, F.lit(0.9)).over(w).alias("gap_q90_28d"),
        sliding_share(F.abs(g) > 0.05 * F.col(price), o, -28, -1).alias("wide_share"),
    )


def weather_features(hourly: DataFrame, point: str, ts: str, temp_c: str, zone: str, min_hours: int = 20) -> DataFrame:
    """Per point and local day: max, min and mean in °F and degree-hours scaled to 24 hours (null when the
    day has too few hours), with the change on the same weekday of the week before."""
    f = numbers.fahrenheit(temp_c)
    daily = hourly.groupBy(point, tc.local_date(ts, zone).alias("day")).agg(
        F.max(f).alias("tmax_f"),
        F.min(f).alias("tmin_f"),
        exact_avg(f).alias("tmean_f"),
        (F.lit(24.0) * exact_avg(numbers.heating_degrees(f))).alias("hdh"),
        (F.lit(24.0) * exact_avg(numbers.cooling_degrees(f))).alias("cdh"),
        F.count(temp_c).alias("n_hours"),
    )
    enough = F.col("n_hours") >= min_hours
    for c in ("tmax_f", "tmin_f", "tmean_f", "hdh", "cdh"):
        daily = daily.withColumn(c, F.when(enough, F.col(c)))
    w = trailing.days_window([point], "day", -7, -7)
    return daily.withColumn("tmean_week_change", F.col("tmean_f") - F.max("tmean_f").over(w))


def contrast(weather: DataFrame, load: DataFrame, keys: Sequence[str], day: str, x: str, y: str) -> DataFrame:
    """Week-on-week change of one series minus the percentage change of another."""
    a = joins.shifted(weather.select(*keys, day, x), keys, day, "7 day", [x], "_w")
    b = joins.shifted(load.select(*keys, day, y), keys, day, "7 day", [y], "_w")
    return a.join(b, [*keys, day]).select(
        *keys, day,
        ((F.col(x) - F.col(f"{x}_w")) - F.lit(100.0) * (F.col(y) - F.col(f"{y}_w")) / F.col(f"{y}_w")).alias("contrast"),
    )


def outage_features(
    outages: DataFrame, start: str, end: str, cls: str, classes: Sequence[str]
) -> DataFrame:
    """Per day: open outages in total and by class, those ending the next day and those starting that day."""
    counts = joins.active_counts(outages, start, end, [cls])
    wide = counts.groupBy("day").agg(
        F.sum("active").alias("n_active"), *[F.sum(F.when(F.col(cls) == c, F.col("active")).otherwise(0)).alias(f"n_{c}") for c in classes]
    )
    starts = outages.groupBy(F.col(start).alias("day")).agg(F.count(F.lit(1)).alias("n_started"))
    ends = outages.where(F.col(end).isNotNull()).groupBy(F.date_sub(end, 1).alias("day")).agg(F.count(F.lit(1)).alias("n_ending_next_day"))
    return (
        wide.join(starts, "day", "left").join(ends, "day", "left").na.fill(0, ["n_started", "n_ending_next_day"])
    )


def site_indicators(outages: DataFrame, start: str, end: str, site: str, sites: Sequence[str]) -> DataFrame:
    """0/1 per day and listed site: any open outage there."""
    span = outages.agg(F.min(start).alias("lo"), F.greatest(F.max(start), F.max(end)).alias("hi"))
    c = joins.active_counts(outages.where(F.col(site).isin(list(sites))), start, end, [site], span)
    return c.groupBy("day").agg(*[F.max(((F.col(site) == s) & (F.col("active") > 0)).cast("int")).alias(f"out_{s}") for s in sites])


def regime_flags(days: DataFrame, day: str, changes: DataFrame, effective: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Per day an indicator for each kind of change in force (effective strictly before the day)."""
    first = changes.groupBy().agg(*[F.min(F.when(F.col(kind) == k, F.col(effective))).alias(f"_{i}") for i, k in enumerate(kinds)])
    j = days.join(F.broadcast(first))  # one row
    return j.select(day, *[F.coalesce(F.col(day) > F.col(f"_{i}"), F.lit(False)).cast("int").alias(f"regime_{k}") for i, k in enumerate(kinds)])


def day_matrix(long: DataFrame, day: str, name: Column, value: str) -> DataFrame:
    """One row per day with a map from feature name to value (wide matrix without thousands of columns)."""
    return long.groupBy(day).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("k"), F.col(value).alias("v"))))).alias("features"))


def labels(panel: DataFrame, zone: str, day: str, gap: str, published: str) -> DataFrame:
    """Per zone and day the realised total, and when the last part of it was public."""
    return panel.groupBy(zone, day).agg(
        exact_sum(gap).alias("label_gap"), F.max(published).alias("label_published_at"), F.count(gap).alias("label_rows")
    )


def standardise(df: DataFrame, train: Column, cols: Sequence[str], bound: float = 8.0) -> DataFrame:
    """(x - mean)/std by the training rows' moments, null -> 0, clipped; the moments are one row."""
    m = df.where(train).agg(*[a for c in cols for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    out = df.join(F.broadcast(m))
    for c in cols:
        z = F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
        out = out.withColumn(c, F.coalesce(F.greatest(F.least(z, F.lit(bound)), F.lit(-bound)), F.lit(0.0)))
    return out.drop(*[f"_{p}_{c}" for c in cols for p in ("m", "s")])


def normalised_recency(df: DataFrame, day: str, anchor: Column, half_life: float, out: str) -> DataFrame:
    """Weights 0.5^(age/half-life) with mean one over the rows."""
    w = df.withColumn("_w", numbers.recency_weight(F.datediff(anchor, F.col(day)).cast("double"), half_life))
    mean = w.agg(F.avg("_w").alias("_mw"))
    return w.join(F.broadcast(mean)).withColumn(out, F.col("_w") / F.col("_mw")).drop("_w", "_mw")


def storm_score(daily: DataFrame, keys: Sequence[str], day: str, highs: Sequence[str], lows: Sequence[str], days: int = 365, min_obs: int = 60) -> DataFrame:
    """Largest of the trailing ranks of several day-level inputs (low inputs negated)."""
    out = daily
    ranks = []
    for c in [*highs, *lows]:
        v = c if c in highs else f"_neg_{c}"
        if c in lows:
            out = out.withColumn(v, -F.col(c))
        out = trailing.trailing_rank(out, keys, day, v, f"rank_{c}", days, min_obs)
        ranks.append(F.col(f"rank_{c}"))
    return out.withColumn("score", F.greatest(*ranks)).drop(*[f"_neg_{c}" for c in lows])


def forecast_surprise(
    vintages: DataFrame, target_keys: Sequence[str], day: str, published: str, decision: str, value: str, comfort: float,
    min_pairs: int, tie_break: Sequence[str], window_days: int = 365, min_obs: int = 60,
) -> DataFrame:
    """Did the newest forecast move further from comfort than the one before it?  Mean per day over the
    targets with both, then the trailing rank of that mean."""
    two = newest_k(vintages.where(public_by(published, decision)), [*target_keys, day], [published, *tie_break], 2)
    d = F.abs(F.col(value) - comfort)
    pairs = two.groupBy(*target_keys, day).agg(
        F.max(F.when(F.col("k_index") == 0, d)).alias("_a"), F.max(F.when(F.col("k_index") == 1, d)).alias("_b")
    ).where(F.col("_b").isNotNull())
    per_day = pairs.groupBy(day).agg(exact_avg(F.col("_a") - F.col("_b")).alias("surprise"), F.count(F.lit(1)).alias("pairs"))
    per_day = per_day.withColumn("surprise", F.when(F.col("pairs") >= min_pairs, F.col("surprise"))).withColumn("_one", F.lit(0))
    return trailing.trailing_rank(per_day, ["_one"], day, "surprise", "rank", window_days, min_obs).drop("_one")


def historical_event_rate(panel: DataFrame, keys: Sequence[str], day: str, gap: str, level: float, public_gap_days: int = 2) -> DataFrame:
    """Per key and year the share of earlier days with gap >= level.

    A year's rate uses delivery days up to ``public_gap_days`` before it starts, so counts are kept per
    (key, year from which they may be used) and summed over the few years.
    """
    usable_from = F.year(F.date_add(F.col(day), public_gap_days - 1)) + 1
    c = panel.where(F.col(gap).isNotNull()).groupBy(*keys, usable_from.alias("_y")).agg(
        F.count_if(F.col(gap) >= level).alias("_h"), F.count(F.lit(1)).alias("_n")
    )
    years = panel.select(*keys, F.year(day).alias("year")).distinct()
    line = years.select(*keys, F.col("year").alias("_y"), F.lit(0).cast("bigint").alias("_h"), F.lit(0).cast("bigint").alias("_n"), F.lit(True).alias("_q")).unionByName(
        c.select(*keys, "_y", "_h", "_n", F.lit(False).alias("_q"))
    )
    w = Window.partitionBy(*keys).orderBy("_y").rangeBetween(Window.unboundedPreceding, 0)
    return (
        line.withColumn("hits", F.sum("_h").over(w)).withColumn("days", F.sum("_n").over(w)).where("_q")
        .select(*keys, F.col("_y").alias("year"), "hits", "days", F.when(F.col("days") > 0, F.col("hits") / F.col("days")).alias("rate"))
    )


def perturbation_differences(build, source: DataFrame, published: str, decision: Column, noise: dict[str, Column]) -> DataFrame:
    """Look-ahead test: ``build`` must give the same table when rows published after the decision are
    overwritten with noise.  Returns the differing row hashes (empty = no look-ahead)."""
    late = F.col(published).isNull() | (F.col(published) > decision)
    changed = source
    for c, n in noise.items():
        changed = changed.withColumn(c, F.when(late, n).otherwise(F.col(c)))
    return table_differences(build(source), build(changed))
