"""Data checks.  Every check returns the failing rows; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.operators import grid


class LookaheadError(ValueError):
    """A table or column would let a decision see the future."""


def not_null(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows with a null in any of ``cols``, with the first such column named."""
    bad = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])
    return df.select(*keep, bad.alias("null_column")).where(F.col("null_column").isNotNull())


def accepted_values(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """Values outside the list with their row counts (null is left to ``not_null``)."""
    return df.where(~F.col(col).isin(list(values))).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def no_gaps(df: DataFrame, keys: Sequence[str], ts: str, step: str = "1 hour") -> DataFrame:
    return grid.missing_steps(df, keys, ts, step)


def interior_days_complete(daily: DataFrame, keys: Sequence[str], day: str, complete: str) -> DataFrame:
    """Incomplete days that are neither the first nor the last of their series."""
    b = daily.groupBy(*keys).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    return (
        daily.where(~F.col(complete))
        .join(b, list(keys))
        .where((F.col(day) > F.col("_first")) & (F.col(day) < F.col("_last")))
        .drop("_first", "_last")
    )


def intervals_per_hour(hourly: DataFrame, source: str, source_value: str, count: str, expected: int) -> DataFrame:
    return hourly.where((F.col(source) == source_value) & (F.col(count) != expected))


def seam_continuous(old: DataFrame, new: DataFrame, keys: Sequence[str], ts: str, step_seconds: int = 3600) -> DataFrame:
    """Keys whose first new stamp is not exactly one step after the last old one."""
    lo = old.groupBy(*keys).agg(F.max(ts).alias("last_old"))
    hi = new.groupBy(*keys).agg(F.min(ts).alias("first_new"))
    return lo.join(hi, list(keys)).where(tc.seconds_between("first_new", "last_old") != step_seconds)


def business_days_only(df: DataFrame, day: str) -> DataFrame:
    return df.where(tc.is_weekend(day))


def outside_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return df.where((F.col(col) < lo) | (F.col(col) > hi))


def _since_last(df: DataFrame, ts: str, anchor: Column, days: int) -> DataFrame:
    """Rows within ``days`` days of the newest row where ``anchor`` holds; the anchor is one row."""
    hi = df.where(anchor).agg(F.max(ts).alias("_hi"))
    return df.join(F.broadcast(hi)).where(F.col(ts) >= F.col("_hi") - F.expr(f"interval {days} day"))


def breach_rate(
    versions: DataFrame, key: str, ts: str, live: str, settled: str, readings: str,
    full: int, abs_floor: float, pct: float, max_breach_pct: float, days: int = 60,
) -> DataFrame:
    """Keys whose live value breaches max(floor, pct of settled) in more than the allowed share of hours."""
    recent = _since_last(versions, ts, F.col(settled).isNotNull(), days).where(
        F.col(settled).isNotNull() & F.col(live).isNotNull() & (F.col(readings) == full)
    )
    tol = F.greatest(F.lit(abs_floor), F.lit(pct) / F.lit(100.0) * F.col(settled))
    breach = F.abs(F.col(live) - F.col(settled)) > tol
    rate = recent.groupBy(key).agg(F.count_if(breach).alias("breaches"), F.count(F.lit(1)).alias("hours"))
    share = F.lit(100.0) * F.col("breaches") / F.col("hours")
    return rate.where(share > max_breach_pct).withColumn("breach_pct", F.round(share, 2))


def short_hours(versions: DataFrame, key: str, ts: str, live: str, readings: str, full: int, max_share: float, days: int = 30) -> DataFrame:
    """Keys where too many of the feed's last hours (newest one excluded) lack readings."""
    recent = _since_last(versions, ts, F.col(live).isNotNull(), days).where(F.col(ts) < F.col("_hi"))
    rate = recent.groupBy(key).agg(F.count_if(F.col(readings) < full).alias("short_hours"), F.count(F.lit(1)).alias("hours"))
    return rate.where(F.col("short_hours") > F.lit(max_share) * F.col("hours"))


def settlement_lag(versions: DataFrame, key: str, ts: str, live: str, settled: str, max_days: int) -> DataFrame:
    x = versions.groupBy(key).agg(
        F.max(F.when(F.col(settled).isNotNull(), F.col(ts))).alias("settled_hi"),
        F.max(F.when(F.col(live).isNotNull(), F.col(ts))).alias("realtime_hi"),
    )
    lag = F.datediff("realtime_hi", "settled_hi")
    return x.where(lag > max_days).withColumn("lag_days", lag)


def bias_band(
    versions: DataFrame, key: str, ts: str, live: str, settled: str, readings: str, full: int, band_pct: float, days: int = 30
) -> DataFrame:
    """Keys whose summed bias over the last settled days leaves the band."""
    from gridtide.functions.exact import exact_sum

    recent = _since_last(versions, ts, F.col(settled).isNotNull(), days).where(
        F.col(settled).isNotNull() & F.col(live).isNotNull() & (F.col(readings) == full)
    )
    b = recent.groupBy(key).agg(
        F.count(F.lit(1)).alias("hours"),
        (F.lit(100.0) * exact_sum(F.col(live) - F.col(settled)) / exact_sum(settled)).alias("_b"),
    )
    return b.where(F.abs("_b") > band_pct).select(key, "hours", F.round("_b", 2).alias("bias_pct"))


def no_lookahead(frames: dict[str, DataFrame], published: str, decision: str) -> DataFrame:
    """Per source: rows that were unpublished or published after their decision.

    A frame without the publication column is an error at plan time.
    """
    parts = []
    for name, df in frames.items():
        if published not in df.columns:
            raise LookaheadError(f"{name}: no column {published}")
        bad = F.col(published).isNull() | (F.col(published) > F.col(decision))
        parts.append(df.where(bad).groupBy(F.lit(name).alias("source")).agg(F.count(F.lit(1)).alias("rows_too_late")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule (a rule is a condition that marks a bad row), in one pass; only rules with hits."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations").where(F.col("violations") > 0)


def excluded_by_publication(rows: DataFrame, source: str, published: str, decision: str) -> DataFrame:
    """Per source: candidate rows kept and rows the publication filter removes (a row without a stamp is removed)."""
    ok = F.coalesce(F.col(published) <= F.col(decision), F.lit(False))
    return rows.groupBy(F.col(source).alias("source")).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("excluded"))


def identity_share(df: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Across the entities of one key: is the value the same within a tolerance?  Share of keys."""
    g = df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("_r"))
    return g.agg(
        F.count(F.lit(1)).alias("keys"),
        F.avg((F.col("_r") <= tolerance).cast("double")).alias("share_equal"),
        F.max("_r").alias("largest_range"),
    )


def component_identity(df: DataFrame, total: str, parts: Sequence[str], tolerance: float, max_share: float) -> DataFrame:
    """Fails (one row) when the parts miss the total in more than the allowed share of rows."""
    s = F.col(parts[0])
    for p in parts[1:]:
        s = s + F.col(p)
    bad = F.abs(F.col(total) - s) > tolerance
    g = df.where(F.col(total).isNotNull()).agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad_rows"))
    return g.where(F.col("bad_rows") > F.lit(max_share) * F.col("rows"))


def coverage_inventory(expected: DataFrame, present: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Expected, present and missing keys per group."""
    p = present.select(*keys).distinct().withColumn("_p", F.lit(1))
    return (
        expected.join(p, list(keys), "left")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("expected"), F.count("_p").alias("present"), F.count_if(F.col("_p").isNull()).alias("missing"))
    )


def fill_below(df: DataFrame, blocks: dict[str, Sequence[str]], threshold: float = 0.9) -> DataFrame:
    """Feature blocks whose share of non-null cells is under the threshold."""
    exprs = []
    for name, cols in blocks.items():
        filled = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
        exprs.append((F.sum(filled).cast("double") / (F.count(F.lit(1)) * F.lit(len(cols))).cast("double")).alias(name))
    return df.agg(*exprs).unpivot([], list(blocks), "block", "fill").where(F.col("fill") < threshold)


def refuse_labels(features: Sequence[str], label_prefixes: Sequence[str] = ("y_", "label_", "gap_label")) -> None:
    """Plan-time guard: label columns may not be used as features."""
    bad = [c for c in features if c == "gap" or c.startswith(tuple(label_prefixes))]
    if bad:
        raise LookaheadError(f"label columns used as features: {bad}")


def rebuilt_matches(rebuilt: DataFrame, official: DataFrame, keys: Sequence[str], measures: Sequence[str], tolerance: float) -> DataFrame:
    """Keys on one side only, or with a difference above the tolerance."""
    a = rebuilt.select(*keys, F.lit(1).alias("_a"), *[F.col(m).alias(f"rebuilt_{m}") for m in measures])
    b = official.select(*keys, F.lit(1).alias("_b"), *[F.col(m).alias(f"official_{m}") for m in measures])
    j = a.join(b, list(keys), "full_outer")
    diffs = [F.coalesce(F.abs(F.col(f"rebuilt_{m}") - F.col(f"official_{m}")), F.lit(0.0)) for m in measures]
    diff = F.greatest(*diffs, F.lit(0.0))
    return (
        j.withColumn("max_abs_diff", diff)
        .withColumn("side", F.when(F.col("_a").isNull(), "official only").when(F.col("_b").isNull(), "rebuilt only").otherwise("both"))
        .where((F.col("side") != "both") | (F.col("max_abs_diff") > tolerance))
        .drop("_a", "_b")
    )


def choice_guard(choices: DataFrame, last_used: str, published: str, cutoff: str, known_by: str) -> DataFrame:
    """Choices made on days after the cutoff or on outcomes that were not public yet."""
    return choices.where((F.col(last_used) > F.col(cutoff)) | (F.col(published) > F.col(known_by)))


def fault_matrix(
    tables: dict[str, DataFrame],
    faults: dict[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]],
    checks: dict[str, Callable[[dict[str, DataFrame]], DataFrame]],
) -> DataFrame:
    """Every check on every faulted copy of the tables: (fault, check, failing rows)."""
    parts = []
    for fault, change in faults.items():
        faulted = {**tables, **change(tables)}
        for check, run in checks.items():
            parts.append(
                run(faulted).agg(F.count(F.lit(1)).alias("failing_rows")).select(
                    F.lit(fault).alias("fault"), F.lit(check).alias("check"), "failing_rows"
                )
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def agreement_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], measures: Sequence[str], tolerance: float) -> DataFrame:
    """Independent rebuild against stored inputs: equal, different and one-sided keys per measure."""
    ja = a.select(*keys, F.lit(1).alias("_a"), *[F.col(m).alias(f"_a_{m}") for m in measures])
    jb = b.select(*keys, F.lit(1).alias("_b"), *[F.col(m).alias(f"_b_{m}") for m in measures])
    j = ja.join(jb, list(keys), "full_outer")
    rows = []
    for m in measures:
        same = F.col(f"_a_{m}").eqNullSafe(F.col(f"_b_{m}")) | (F.abs(F.col(f"_a_{m}") - F.col(f"_b_{m}")) <= tolerance)
        both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
        rows.append(
            F.struct(
                F.lit(m).alias("measure"),
                F.count_if(both & F.coalesce(same, F.lit(False))).alias("equal"),
                F.count_if(both & ~F.coalesce(same, F.lit(False))).alias("different"),
                F.count_if(~both).alias("one_sided"),
            )
        )
    g = j.agg(F.array(*rows).alias("_r"))
    return g.select(F.explode("_r").alias("_x")).select("_x.*")
