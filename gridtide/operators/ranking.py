"""Exact ranks, deciles and quantiles of groups of any size.

``percentile`` and ``rank() over (partition by k)`` gather a whole group in one task.  Here a group is
first reduced to its distinct values with counts (map-side combined), the values are cut into ranges,
and the cumulative count is built from bounded steps: counts per range, a running sum over the ranges of
a group, and a running sum inside one range.  Ranges are logarithmic in the value and are then
subdivided evenly between their exact minimum and maximum, into as many pieces as their distinct values ask for, so neither outliers nor a cluster far from
zero ends up in one range.  They depend only on the data, never on partitioning or sampling, which keeps
task retries harmless.

On grid tables, whose groups are bounded by the calendar, plain windows and ``percentile`` are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_sum
from gridtide.operators.joins import null_safe

PER_OCTAVE = 16
PER_RANGE = 1_000  # distinct values for which a range gets one more piece


def _as_number(df: DataFrame, c: str) -> Column:
    """A number that grows with the column (equal for close values is fine: it only selects a range)."""
    t = df.schema[c].dataType
    if isinstance(t, (T.TimestampNTZType, T.TimestampType)):
        return tc.epoch_seconds(c).cast("double")
    if isinstance(t, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    return F.col(c).cast("double")


def ranked_values(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per (keys, distinct value): ``ties`` rows with it, ``below`` rows under it, ``n`` in the
    group.  ``extra`` adds aggregates (name -> aggregate Column) computed per distinct value."""
    by = list(keys) or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    vc = src.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("ties"), *[c.alias(n) for n, c in (extra or {}).items()]
    )
    x = _as_number(df, value)
    octave = (F.signum(x) * (F.floor(F.log2(F.abs(x)) * F.lit(float(PER_OCTAVE))) + F.lit(40000))).cast("int")
    one = vc.withColumn("_rv_x", x).withColumn("_rv_b1", F.when(x == 0, F.lit(0)).otherwise(octave))
    w1 = Window.partitionBy(*by).orderBy("_rv_b1").rowsBetween(Window.unboundedPreceding, -1)
    o1 = (
        one.groupBy(*by, "_rv_b1").agg(F.sum("ties").alias("_rv_c"), F.min("_rv_x").alias("_rv_lo"), F.max("_rv_x").alias("_rv_hi"), F.count(F.lit(1)).alias("_rv_d"))
        .withColumn("_rv_o1", F.coalesce(F.sum("_rv_c").over(w1), F.lit(0)))
        .withColumn("n", F.sum("_rv_c").over(Window.partitionBy(*by)))
        .drop("_rv_c")
    )
    width = F.col("_rv_hi") - F.col("_rv_lo")
    pieces = F.ceil(F.col("_rv_d") / PER_RANGE)
    part = F.least(F.floor((F.col("_rv_x") - F.col("_rv_lo")) / width * pieces), pieces - 1)
    two = null_safe(one, o1, [*by, "_rv_b1"]).withColumn("_rv_b2", F.when(width > 0, part).otherwise(F.lit(0)).cast("bigint"))
    w2 = Window.partitionBy(*by, "_rv_b1").orderBy("_rv_b2").rowsBetween(Window.unboundedPreceding, -1)
    o2 = (
        two.groupBy(*by, "_rv_b1", "_rv_b2").agg(F.sum("ties").alias("_rv_c"))
        .withColumn("_rv_o2", F.coalesce(F.sum("_rv_c").over(w2), F.lit(0)))
        .drop("_rv_c")
    )
    w3 = Window.partitionBy(*by, "_rv_b1", "_rv_b2").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        null_safe(two, o2, [*by, "_rv_b1", "_rv_b2"])
        .withColumn("below", F.col("_rv_o1") + F.col("_rv_o2") + F.coalesce(F.sum("ties").over(w3), F.lit(0)))
        .drop("_rv_x", "_rv_lo", "_rv_hi", "_rv_d", "_rv_b1", "_rv_b2", "_rv_o1", "_rv_o2", "_all")
    )


def average_rank() -> Column:
    """1-based rank with ties sharing their mean, over ``ranked_values`` columns."""
    return F.col("below") + (F.col("ties") + 1) / F.lit(2.0)


def percent_rank_pooled() -> Column:
    """Average-tie rank divided by n (not SQL ``percent_rank``)."""
    return average_rank() / F.col("n")


def decile_of_rank(bins: int = 10) -> Column:
    """min(bins - 1, floor(pct * bins))."""
    return F.least(F.lit(bins - 1), F.floor(percent_rank_pooled() * F.lit(float(bins)))).cast("int")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles: one row per group and probability (``prob``, ``quantile``)."""
    keys = list(keys)
    rv = ranked_values(df, keys, value)
    p = rv.withColumn("prob", F.explode(F.array(*[F.lit(float(x)) for x in probs])))
    pos = (F.col("n") - 1).cast("double") * F.col("prob")
    lo, hi = F.floor(pos), F.ceil(pos)
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("ties"))
    hit = p.withColumn("_pos", pos).where(holds(lo) | holds(hi))
    g = hit.groupBy(*keys, "prob").agg(
        F.max("_pos").alias("_pos"),
        F.min(F.when(holds(lo), F.col(value))).alias("_vlo"),
        F.max(F.when(holds(hi), F.col(value))).alias("_vhi"),
        F.max("n").alias("n"),
    )
    frac = F.col("_pos") - F.floor("_pos")
    return g.select(
        *keys, "prob", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac).alias("quantile"), "n"
    )


def quantile_columns(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Quantiles as columns, one row per group."""
    q = exact_quantiles(df, keys, value, list(probs.values()))
    return q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(x)), F.col("quantile"))).alias(n) for n, x in probs.items()],
        F.max("n").alias("n"),
    )


def positions(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """0-based position of every row in its group by (value, tie) and the group size.

    Works on two nested rankings, so neither a hot group nor a hot value is sorted in one task.
    """
    keys = list(keys)
    by_value = ranked_values(df, keys, value).select(*keys, value, F.col("below").alias("_bv"), "n")
    by_tie = ranked_values(df, [*keys, value], tie).select(*keys, value, tie, F.col("below").alias("_bt"))
    return (
        df.join(by_tie, [*keys, value, tie])
        .join(by_value, [*keys, value])
        .withColumn("position", F.col("_bv") + F.col("_bt"))
        .drop("_bv", "_bt")
    )


def ntile_of_position(tiles: int) -> Column:
    """SQL ntile from a 0-based position: the first n % tiles tiles hold one row more."""
    n, i = F.col("n"), F.col("position")
    base, extra = F.floor(n / F.lit(tiles)), n % tiles
    cut = extra * (base + 1)
    return (
        F.when(i < cut, F.floor(i / (base + 1)) + 1).otherwise(extra + F.floor((i - cut) / F.greatest(base, F.lit(1))) + 1)
    ).cast("int")


def qcut_first(bins: int, position: str | Column = "position", n: str = "n") -> Column:
    """0-based equal-count bin of a 1-based ``rank first``: right-closed linear quantile edges."""
    n, i = F.col(n), F.col(position) if isinstance(position, str) else position
    # rank r = i + 1 lies in bin b when 1 + (n-1) b/bins < r <= 1 + (n-1)(b+1)/bins
    return F.greatest(F.ceil(i * F.lit(float(bins)) / F.greatest(n - 1, F.lit(1))) - 1, F.lit(0)).cast("int")


def bin_parts(df: DataFrame, keys: Sequence[str], value: str, tie: str, bins: int, extra: dict[str, Column]) -> DataFrame:
    """Parts of the equal-count bins of every group by (value, tie): ``bin``, ``ties`` rows and the ``extra`` aggregates.

    A value whose rows all lie in one bin is one part. Only the rows of values that an edge of the bins splits, at most
    ``bins - 1`` values a group, are ranked by ``tie`` (a number; nulls come last).
    """
    keys = list(keys)
    rv = ranked_values(df, keys, value, {**extra, "_no_tie": F.count_if(F.col(tie).isNull())})
    rv = rv.withColumn("bin", qcut_first(bins, "below")).withColumn("_last", qcut_first(bins, F.col("below") + F.col("ties") - 1))
    split = rv.where("bin <> _last").select(*keys, value, F.col("below").alias("_from"), F.col("n").alias("_of"), (F.col("ties") - F.col("_no_tie")).alias("_tied"))
    start = F.col("_from") + F.when(F.col(tie).isNull(), F.col("_tied")).otherwise(F.lit(0))
    rows = null_safe(df, split, [*keys, value]).withColumn("_from", start).withColumn("_tie", F.coalesce(tie, F.lit(0).cast(df.schema[tie].dataType)))
    ranked = ranked_values(rows, [*keys, value, "_from", "_of"], "_tie", extra)
    parts = ranked.withColumn("bin", qcut_first(bins, F.col("_from") + F.col("below"), "_of"))
    cols = [*keys, "bin", "ties", *extra]
    return rv.where("bin = _last").select(*cols).unionByName(parts.select(*cols))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation (ties averaged) of the complete pairs per group."""
    keys = list(keys)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_w"))
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = ranked_values(base, keys, x).select(*keys, x, average_rank().alias("_rx"))
    ry = ranked_values(base, keys, y).select(*keys, y, average_rank().alias("_ry"))
    j = pairs.join(rx, [*keys, x]).join(ry, [*keys, y])
    w = F.col("_w").cast("double")
    n, sx, sy = F.sum(w), F.sum(w * F.col("_rx")), F.sum(w * F.col("_ry"))
    sxx, syy = F.sum(w * F.col("_rx") ** 2), F.sum(w * F.col("_ry") ** 2)
    sxy = F.sum(w * F.col("_rx") * F.col("_ry"))
    g = j.groupBy(*keys).agg(n.alias("_n"), sx.alias("_sx"), sy.alias("_sy"), sxx.alias("_sxx"), syy.alias("_syy"), sxy.alias("_sxy"))
    cov = F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy")
    var = (F.col("_n") * F.col("_sxx") - F.col("_sx") ** 2) * (F.col("_n") * F.col("_syy") - F.col("_sy") ** 2)
    return g.select(*keys, F.when(var > 0, cov / F.sqrt(var)).alias("spearman"), F.col("_n").cast("bigint").alias("n"))


def trimmed_sums(df: DataFrame, keys: Sequence[str], value: str, ks: Sequence[int], out: str = "without_best_") -> DataFrame:
    """Total and total without the best k rows, for small k.

    Only the k largest rows per task survive to the shuffle (WindowGroupLimit); the total is a plain
    aggregate.
    """
    total = df.groupBy(*keys).agg(exact_sum(value).alias("total"))
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last())
    top = df.select(*keys, value).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(ks))
    best = top.groupBy(*keys).agg(*[exact_sum(F.when(F.col("_r") <= k, F.col(value))).alias(f"_b{k}") for k in ks])
    j = total.join(best, list(keys), "left")
    return j.select(*keys, "total", *[(F.col("total") - F.coalesce(f"_b{k}", F.lit(0.0))).alias(f"{out}{k}") for k in ks])


def best_decile_share(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Share of the total earned by the best max(1, n div 10) rows; null unless the total is positive.

    The boundary value may be shared by rows inside and outside the decile; it is counted for exactly
    the rows that fit.
    """
    rv = ranked_values(df, keys, value)
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    above = F.col("n") - F.col("below") - F.col("ties")
    taken = F.greatest(F.lit(0), F.least(F.col("ties"), k - above))
    g = rv.groupBy(*keys).agg(
        F.sum(taken * F.col(value)).alias("_top"), F.sum(F.col("ties") * F.col(value)).alias("_all_sum"), F.max("n").alias("n")
    )
    return g.select(*keys, "n", F.when(F.col("_all_sum") > 0, F.col("_top") / F.col("_all_sum")).alias("best_decile_share"))
