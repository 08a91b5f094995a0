"""Statistics of the studies: regressions, error profiles, rules, calibration, resampling, verdicts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_avg, exact_sum, fixed, mean_of, mean_of_parts, mean_parts
from gridtide.operators import joins, ranking

# ---------------------------------------------------------------- regression

_MOMENTS = ("n", "sy", "syy", "sx", "sxx", "sx3", "sx4", "sxy", "sxxy")


def fixed_effects_ols(
    df: DataFrame, group: Sequence[str], hour: str, month: str, y: str, x: str, train: Column, min_rows: int
) -> DataFrame:
    """Out-of-sample R² with hour and month effects, without and with x and x², per group.

    Rows are reduced to moment sums per (group, hour, month, train/test) cell, at most 576 cells per
    group; only those reach the small dense solve.  The data itself never leaves the aggregation.
    """
    import numpy as np
    import pandas as pd

    xv, yv = F.col(x).cast("double"), F.col(y).cast("double")
    cells = df.withColumn("_train", train.cast("int")).groupBy(*group, "_train", F.col(hour).alias("_h"), F.col(month).alias("_m")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(yv).alias("sy"), F.sum(yv * yv).alias("syy"), F.sum(xv).alias("sx"),
        F.sum(xv * xv).alias("sxx"), F.sum(xv**3).alias("sx3"), F.sum(xv**4).alias("sx4"), F.sum(xv * yv).alias("sxy"), F.sum(xv * xv * yv).alias("sxxy"),
    )
    names = list(group)
    types = dict(df.dtypes)
    schema = ", ".join(f"`{g}` {types[g]}" for g in names) + ", r2_without double, r2_with double, x_adds double, n_train bigint, n_test bigint"

    def normal(c: pd.DataFrame, with_x: bool):
        d = np.zeros((len(c), 36))
        d[:, 0] = 1.0
        h, m = c["_h"].to_numpy(int), c["_m"].to_numpy(int)
        rows = np.arange(len(c))
        d[rows[h > 0], h[h > 0]] = 1.0
        d[rows[m > 1], 22 + m[m > 1]] = 1.0
        a = d.T @ (d * c["n"].to_numpy()[:, None])
        b = d.T @ c["sy"].to_numpy()
        if with_x:
            u, v = d.T @ c["sx"].to_numpy(), d.T @ c["sxx"].to_numpy()
            q = c[["sxx", "sx3", "sx4"]].sum()
            a = np.block([[a, u[:, None], v[:, None]], [u[None, :], q["sxx"], q["sx3"]], [v[None, :], q["sx3"], q["sx4"]]])
            b = np.concatenate([b, [c["sxy"].sum(), c["sxxy"].sum()]])
        return a, b

    def r2(tr: pd.DataFrame, te: pd.DataFrame, with_x: bool) -> float:
        a, b = normal(tr, with_x)
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        ta, tb = normal(te, with_x)
        sse = te["syy"].sum() - 2 * beta @ tb + beta @ ta @ beta
        n, s = te["n"].sum(), te["sy"].sum()
        return float(1 - sse / (te["syy"].sum() - s * s / n))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, te = pdf[pdf["_train"] == 1], pdf[pdf["_train"] == 0]
        n_tr, n_te = int(tr["n"].sum()), int(te["n"].sum())
        row = {g: pdf[g].iloc[0] for g in names}
        if min(n_tr, n_te) < min_rows:
            return pd.DataFrame([], columns=[*names, "r2_without", "r2_with", "x_adds", "n_train", "n_test"])
        base, full = r2(tr, te, False), r2(tr, te, True)
        return pd.DataFrame([{**row, "r2_without": base, "r2_with": full, "x_adds": full - base, "n_train": n_tr, "n_test": n_te}])

    return cells.groupBy(*names).applyInPandas(solve, schema)


# ---------------------------------------------------------------- error profiles

def error_profile(df: DataFrame, by: Sequence[Column | str], err: str) -> DataFrame:
    return df.groupBy(*by).agg(exact_avg(F.abs(err)).alias("mae"), exact_avg(err).alias("bias"), F.count(err).alias("n"))


def naive_baselines(grid: DataFrame, keys: Sequence[str], ts: str, value: str, train: Column) -> DataFrame:
    """Mean absolute error of three naive forecasts: same hour yesterday, long-run mean, training mean."""
    y = joins.shifted(grid.select(*keys, ts, value), keys, ts, "24 hour", [value], "_y")
    means = grid.groupBy(*keys).agg(exact_avg(value).alias("_all"), exact_avg(F.when(train, F.col(value))).alias("_train"))
    j = y.join(means, list(keys))
    v = F.col(value)
    return j.groupBy(*keys).agg(
        exact_avg(F.abs(v - F.col(f"{value}_y"))).alias("mae_yesterday"),
        exact_avg(F.abs(v - F.col("_all"))).alias("mae_long_run"),
        exact_avg(F.abs(v - F.col("_train"))).alias("mae_training_mean"),
        F.count(v).alias("n"),
    )


def bias_of_means(df: DataFrame, by: Sequence[str], period: Column, longer: Column, value: str, level: str) -> DataFrame:
    """Means per period, then the mean of the period means and the correlation of bias and level."""
    m = df.groupBy(*by, period.alias("_p"), longer.alias("year")).agg(exact_avg(value).alias("_b"), exact_avg(level).alias("_l"))
    return m.groupBy(*by, "year").agg(
        exact_avg("_b").alias("mean_of_means"), F.count(F.lit(1)).alias("periods"), F.round(F.corr("_b", "_l"), 7).alias("corr_bias_level")
    )


def sign_agreement(df: DataFrame, by: Sequence[str], err: str, gap: str) -> DataFrame:
    """How often the error has the opposite sign of the gap, and the mean gap on either side."""
    e = F.col(err)
    return df.groupBy(*by).agg(
        F.avg((F.signum(err) == -F.signum(gap)).cast("double")).alias("sign_agreement"),
        exact_avg(F.when(e > 0, F.col(gap))).alias("gap_when_over"),
        exact_avg(F.when(e < 0, F.col(gap))).alias("gap_when_under"),
        F.avg((F.col(gap) == 0).cast("double")).alias("zero_share"),
        F.count(F.lit(1)).alias("n"),
    )


def decile_means(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Mean of y by decile of the pooled rank of x.  Rows are reduced to one per distinct x first."""
    rv = ranking.ranked_values(df.where(F.col(y).isNotNull()), by, x, extra={"_u": F.sum(fixed(y))})
    return rv.groupBy(*by, ranking.decile_of_rank().alias("decile")).agg(
        F.sum("ties").alias("n"), mean_of(F.sum("_u"), F.sum("ties")).alias(f"mean_{y}")
    )


# ---------------------------------------------------------------- rules

def rule_summary(taken: DataFrame, by: Sequence[str], pnl: str) -> DataFrame:
    """Mean, standard error, best-decile share and a verdict for the P&L of taken trades."""
    g = taken.groupBy(*by).agg(
        F.count(pnl).alias("trades"), exact_avg(pnl).alias("mean"), F.round(F.stddev_samp(pnl) / F.sqrt(F.count(pnl).cast("double")), 6).alias("se"),
        F.avg((F.col(pnl) > 0).cast("double")).alias("hit_rate"),
    )
    word = F.when(F.abs("mean") <= F.col("se"), "null").when(F.col("mean") > 0, "positive").otherwise("negative")
    return g.withColumn("verdict", word).join(ranking.best_decile_share(taken, by, pnl).drop("n"), list(by), "left")


def revision_rule(df: DataFrame, by: str, revision: str, gap: str, train: Column, cost: float, q: float = 0.75) -> DataFrame:
    """Trade against the revision when it is larger than the training quantile of its size."""
    cut = ranking.exact_quantiles(df.where(train).withColumn("_a", F.abs(revision)), [by], "_a", [q]).select(by, F.col("quantile").alias("threshold"))
    t = df.join(cut, by).where(F.abs(revision) > F.col("threshold"))
    t = t.withColumn("pnl", F.round(-F.signum(revision) * F.col(gap) - F.lit(cost), 6))
    return rule_summary(t, [by], "pnl")


def daily_spread_rule(
    hours: DataFrame, area: str, ts: str, price: str, share: str, pair: tuple[str, str], cost: float = 0.6, q: float = 0.75
) -> DataFrame:
    """One row: short the daily price spread of two areas on days when their forecast shares differ by more than the ``q``
    quantile of all days, and against that difference.

    Hours count where both areas have a price and a share.  The quantile is over one row per calendar day.
    """
    sides = {name: F.col(area) == a for name, a in zip("ab", pair, strict=True)}
    known = hours.where(F.col(area).isin(*pair) & F.col(price).isNotNull() & F.col(share).isNotNull())
    both = known.groupBy(ts).agg(*[F.max(F.when(on, F.col(c))).alias(f"_{n}_{k}") for k, on in sides.items() for n, c in (("price", price), ("share", share))])
    both = both.where(F.col("_price_a").isNotNull() & F.col("_price_b").isNotNull())
    days = both.groupBy(F.col(ts).cast("date").alias("_day")).agg(
        (exact_avg("_share_a") - exact_avg("_share_b")).alias("_share"), (exact_avg("_price_a") - exact_avg("_price_b")).alias("_spread")
    )
    cut = days.agg(F.percentile(F.abs("_share"), q).alias("threshold"))  # one row
    traded = days.join(F.broadcast(cut)).withColumn(
        "_pnl", F.when(F.abs("_share") > F.col("threshold"), -F.signum("_share") * F.col("_spread") - F.lit(cost))
    )
    n = F.count("_pnl")
    mean, se = exact_avg("_pnl"), F.stddev_samp("_pnl") / F.sqrt(n.cast("double"))
    word = F.when(n == 0, "no trades").when(F.abs(mean) <= se, "null").when(mean > 0, "positive").otherwise("negative")
    return traded.agg(
        F.max("threshold").alias("threshold"), n.alias("days_traded"), F.count(F.lit(1)).alias("days_total"), mean.alias("mean_pnl"), se.alias("standard_error"),
        word.alias("verdict"),
    )


def cost_by_horizon(df: DataFrame, by: Sequence[str], actual: str, gap: str, horizons: dict[str, str], share: float) -> DataFrame:
    """-(A-N)·gap per produced unit for each forecast horizon."""
    a = F.lit(share) * F.col(actual)
    arr = F.array(*[F.struct(F.lit(n).alias("horizon"), F.col(c).alias("fc")) for n, c in horizons.items()])
    x = df.withColumn("_x", F.explode(arr)).select(*by, actual, gap, "_x.horizon", "_x.fc").where(F.col("fc").isNotNull())
    cost = -(a - F.lit(share) * F.col("fc")) * F.col(gap)
    return x.groupBy(*by, "horizon").agg(
        F.count(F.lit(1)).alias("hours"), exact_sum(cost).alias("total"), F.try_divide(exact_sum(cost), exact_sum(a)).alias("per_unit"),
        F.try_divide(exact_sum(F.abs(a - F.lit(share) * F.col("fc"))), exact_sum(a)).alias("imbalance_share"),
    )


def persistence(df: DataFrame, keys: Sequence[str], ts: str, gap: str, lags: Sequence[int]) -> DataFrame:
    """How often the sign of the gap equals the sign k true hours earlier, against the majority share."""
    s = df.select(*keys, ts, F.signum(gap).alias("_s"))
    # the lagged copies come from one union and one aggregate instead of a self join per lag
    lag_rows = s.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col("_s").alias("_l"), (F.col(ts) + tc.hours(k)).alias("_t")) for k in lags])).alias("x")
    ).select(*keys, F.col("x.lag").alias("lag"), F.col("x._l").alias("_l"), F.col("x._t").alias(ts))
    j = s.join(lag_rows, [*keys, ts])
    ok = (F.col("_s") != 0) & (F.col("_l") != 0)
    major = s.where(F.col("_s") != 0).groupBy(*keys).agg(
        F.greatest(F.avg((F.col("_s") > 0).cast("double")), F.avg((F.col("_s") < 0).cast("double"))).alias("majority")
    )
    return (
        j.where(ok).groupBy(*keys, "lag").agg(F.avg((F.col("_s") == F.col("_l")).cast("double")).alias("persistence"), F.count(F.lit(1)).alias("n"))
        .join(major, list(keys))
    )


def freshness_value(df: DataFrame, keys: Sequence[str], ts: str, gap: str, delays: Sequence[int], cost: float) -> DataFrame:
    """Mean value of trading the sign seen ``delay`` hours ago, per delay, and whether half the value is kept."""
    s = df.select(*keys, ts, gap)
    moved = s.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(k).alias("delay"), F.signum(gap).alias("_l"), (F.col(ts) + tc.hours(k)).alias("_t")) for k in delays])).alias("x")
    ).select(*keys, F.col("x.delay").alias("delay"), F.col("x._l").alias("_l"), F.col("x._t").alias(ts))
    j = s.join(moved, [*keys, ts]).where(F.col("_l") != 0)
    g = j.groupBy(*keys, "delay").agg(exact_avg(F.col("_l") * F.col(gap) - F.lit(cost)).alias("value"), F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("delay") == min(delays), F.col("value"))).over(Window.partitionBy(*keys))
    return g.withColumn("keeps_half", F.col("value") >= best / 2)


def negative_profile(df: DataFrame, by: Sequence[str], price: str, local_hour: Column) -> DataFrame:
    """Where in the day the low prices fall."""
    h = local_hour
    g = df.where(F.col(price) <= 0).withColumn("_h", h).groupBy(*by)
    return g.agg(
        F.count(F.lit(1)).alias("hours"), F.avg(F.col("_h").between(10, 16).cast("double")).alias("midday_share"),
        F.avg(((F.col("_h") >= 22) | (F.col("_h") <= 5)).cast("double")).alias("night_share"),
        F.array(*[F.count_if(F.col("_h") == i) for i in range(24)]).alias("by_hour"),
    )


def refusal_waterfall(df: DataFrame, reasons: Sequence[tuple[str, Column]], pnl: str) -> DataFrame:
    """First matching reason wins; rows, share and counterfactual mean per reason (``kept`` when none)."""
    r = F
    expr = None
    for name, cond in reasons:
        expr = r.when(cond, name) if expr is None else expr.when(cond, name)
    return df.withColumn("reason", expr.otherwise("kept")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("rows"), exact_avg(pnl).alias("mean_if_traded"), exact_sum(pnl).alias("total_if_traded")
    )


def threshold_curve(df: DataFrame, score: str, pnl: str, grid: Sequence[float]) -> DataFrame:
    """Kept and removed rows and money at each threshold, in one pass of conditional aggregates."""
    p = F.col(pnl)
    cells = [
        F.struct(
            F.lit(float(q)).alias("q"), F.count_if(F.col(score) >= q).alias("kept"), F.count_if(F.col(score) < q).alias("removed"),
            F.coalesce(exact_sum(F.when(F.col(score) >= q, p)), F.lit(0.0)).alias("kept_total"), exact_avg(F.when(F.col(score) >= q, p)).alias("kept_mean"),
        )
        for q in grid
    ]
    g = df.where(F.col(score).isNotNull()).agg(F.array(*cells).alias("_c"), F.coalesce(exact_sum(p), F.lit(0.0)).alias("all_total"))
    return g.select(F.explode("_c").alias("c"), "all_total").select("c.*", (F.col("c.kept_total") >= F.col("all_total")).alias("does_not_lose"))


# ---------------------------------------------------------------- probability quality

def brier_and_auc(df: DataFrame, by: Sequence[str], p: str, y: str) -> DataFrame:
    """Mean squared probability error and area under the ROC curve (ties averaged).

    The rank sum uses one row per distinct probability.
    """
    b = df.where(F.col(p).isNotNull()).groupBy(*by).agg(exact_avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))
    rv = ranking.ranked_values(df, by, p, extra={"_pos": F.sum(F.col(y).cast("bigint"))})
    g = rv.groupBy(*by).agg(
        F.sum(F.col("_pos") * ranking.average_rank()).alias("_r"), F.sum("_pos").alias("positives"), F.max("n").alias("n")
    )
    neg = F.col("n") - F.col("positives")
    auc = (F.col("_r") - F.col("positives") * (F.col("positives") + 1) / 2.0) / (F.col("positives") * neg)
    g = g.select(*by, "n", "positives", F.when((F.col("positives") > 0) & (neg > 0), auc).alias("auc"))
    return g.join(b, list(by)) if by else g.join(b)


def reliability(df: DataFrame, p: str, y: str, tie: str, bins: int) -> DataFrame:
    """Mean probability and event rate by equal-count bins."""
    pos = ranking.positions(df.where(F.col(p).isNotNull()), [], p, tie)
    return pos.groupBy(ranking.qcut_first(bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), exact_avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate")
    )


def reweighted(p: Column, weight: float) -> Column:
    """Probability after removing a class weight from the odds."""
    return p / (p + F.lit(weight) * (1 - p))


def calibration_deciles(df: DataFrame, by: Sequence[str], pred: str, real: str, tie: str, bins: int = 10) -> DataFrame:
    """Equal-count bins of the prediction: mean prediction, mean and count of the outcome."""
    known = df.where(F.col(pred).isNotNull() & F.col(real).isNotNull())
    parts = ranking.bin_parts(known, by, pred, tie, bins, mean_parts(pred, "_pred") | mean_parts(real, "_real"))
    return parts.groupBy(*by, "bin").agg(
        mean_of_parts("_pred").alias("pred_mean"), mean_of_parts("_real").alias("real_mean"), F.sum("ties").alias("n")
    )


# ---------------------------------------------------------------- resampling

def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on its labels, so results do not depend on partitioning."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


GRID = float(2**24)
CHUNK = 1_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 32-bit numbers."""
    x = (x ^ (x >> 16)) * 2246822507 & 0xFFFFFFFF
    x = (x ^ (x >> 13)) * 3266489909 & 0xFFFFFFFF
    return x ^ (x >> 16)


def _drawn(seed: int, tag: int, draw: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend only on seed, tag, draw and block."""
    mask = np.uint64(0xFFFFFFFF)
    first = _mixed(np.uint64(8 * seed + tag) & mask ^ draw.astype(np.uint64))
    return _mixed((first[:, None] + k.astype(np.uint64)[None, :]) & mask) / 4294967296.0


def resampled_means(position: np.ndarray, value: np.ndarray, n: int, draws: np.ndarray, mean_block: float, seed: int) -> np.ndarray:
    """Means of one series under the given draws (nan where a draw meets none of its days)."""
    total, days = np.zeros(n), np.zeros(n)
    np.add.at(total, position, value)
    np.add.at(days, position, 1.0)
    twice = [np.concatenate(([0.0], np.cumsum(np.concatenate((x, x))))) for x in (total, days)]  # running sums, once around and again
    many = math.ceil(n * (2.0 / mean_block)) + 64
    k = np.arange(many)
    length = np.ones((len(draws), many), np.int64)
    if mean_block > 1:
        length = np.floor(np.log(1 - _drawn(seed, 1, draws, k)) / math.log(1 - 1 / mean_block)).astype(np.int64) + 1
    begin = np.minimum(np.cumsum(length, axis=1) - length, n)
    size = np.minimum(length, n - begin)
    size[:, -1] = n - begin[:, -1]
    start = np.floor(_drawn(seed, 2, draws, k) * n).astype(np.int64)
    sums = [(x[start + size] - x[start]).sum(axis=1) for x in twice]
    with np.errstate(invalid="ignore", divide="ignore"):
        return sums[0] / sums[1]


def bootstrap_means(
    daily: DataFrame, keys: Sequence[str], position: str, value: str, draws: int, mean_block: float, seed: int
) -> DataFrame:
    """Stationary bootstrap: the mean of every resampled series, one row per (keys, draw).

    ``position`` numbers the days 0..n-1.  Blocks start at a hashed day, continue circularly and have geometric lengths of mean
    ``mean_block`` (1 is the plain day bootstrap); the same draws serve every series.  A block is the difference of two running
    sums of the series, so a draw costs one look-up per block end and not one row per day.  Twice the expected number of blocks
    and 64 more are drawn; should they not fill the n days, the last one does.

    A task has one series, whose length the calendar bounds, and ``CHUNK`` draws.  Values are rounded to 2^-24, so that running
    sums are exact, in any order, up to 5 * 10^8.
    """
    keys = list(keys)
    n = daily.agg((F.max(position) + 1).cast("bigint").alias("_n"))  # one row
    chunks = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // CHUNK)))
    rounded_value = F.floor(F.col(value) * F.lit(GRID) + F.lit(0.5)) / F.lit(GRID)
    rows = daily.where(F.col(value).isNotNull()).select(*keys, F.col(position).cast("bigint").alias("_i"), rounded_value.alias("_v"))
    rows = rows.join(F.broadcast(n)).withColumn("_chunk", chunks)
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema.fields)

    def resample(group: pa.Table) -> pa.Table:
        first = group.column("_chunk")[0].as_py() * CHUNK
        draw = np.arange(first, min(first + CHUNK, draws))
        means = resampled_means(group.column("_i").to_numpy(), group.column("_v").to_numpy(), group.column("_n")[0].as_py(), draw, mean_block, seed)
        same = {k: pa.repeat(group.column(k)[0], len(draw)) for k in keys}
        return pa.table(same | {"draw": pa.array(draw), "boot_mean": pa.array(means, mask=np.isnan(means))})

    return rows.groupBy(*keys, "_chunk").applyInArrow(resample, own + "draw long, boot_mean double")


def bootstrap_summary(means: DataFrame, keys: Sequence[str], level: float = 0.95) -> DataFrame:
    """Percentile interval, two-sided p-value and standard error of the bootstrap means (one value per draw)."""
    a = (1 - level) / 2
    n = F.count(F.lit(1)).cast("double")
    low = (F.count_if(F.col("boot_mean") <= 0) + 1) / (n + 1)
    high = (F.count_if(F.col("boot_mean") >= 0) + 1) / (n + 1)
    return means.groupBy(*keys).agg(
        F.percentile("boot_mean", a).alias("lo"), F.percentile("boot_mean", 1 - a).alias("hi"),
        F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p_two_sided"), F.stddev_samp("boot_mean").alias("se"),
    )


# ---------------------------------------------------------------- verdicts

def holm(tests: DataFrame, name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down levels: test r of m is compared with alpha/(m-r+1) while every earlier one was rejected."""
    w = Window.partitionBy(F.lit(0)).orderBy(p, name)  # one row per registered test
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    x = tests.withColumn("rank", F.row_number().over(w)).withColumn("alpha", F.lit(alpha) / (m - F.col("rank") + 1))
    x = x.withColumn("_ok", F.col(p) < F.col("alpha")).withColumn(
        "reached", F.coalesce(F.min("_ok").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    )
    return x.withColumn("rejected", F.col("reached") & F.col("_ok")).withColumn("level", 1 - F.col("alpha")).drop("_ok")


def verdict(lo: Column, hi: Column, reached: Column | None = None) -> Column:
    v = F.when(lo > 0, "pays").when(hi < 0, "doesn't pay").otherwise("inconclusive")
    return v if reached is None else F.when(~reached, "inconclusive").otherwise(v)


def equivalence(lo: Column, hi: Column, margin: Column) -> Column:
    return (
        F.when(lo > 0, "better").when(hi < 0, "worse")
        .when((lo >= -margin) & (lo <= 0) & (hi >= 0) & (hi <= margin), "equivalent").otherwise("inconclusive")
    )


def minimum_detectable(se: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    from statistics import NormalDist

    z = NormalDist()
    return se * F.lit(z.inv_cdf(1 - alpha / 2) + z.inv_cdf(power))


# ---------------------------------------------------------------- tables about positions and runs

def supply_sanity(panel: DataFrame, zone: str, gap: str) -> DataFrame:
    """Per zone: mean of -gap, share of negative outcomes, mean without the top 1 percent of gaps, worst row."""
    q = ranking.quantile_columns(panel, [zone], gap, {"_q": 0.99}).drop("n")
    return panel.join(q, zone).groupBy(zone).agg(
        exact_avg(-F.col(gap)).alias("mean_supply"), F.avg((-F.col(gap) < 0).cast("double")).alias("share_negative"),
        exact_avg(F.when(F.col(gap) <= F.col("_q"), -F.col(gap))).alias("mean_without_top_1pct"), F.min(-F.col(gap)).alias("worst"), F.count(gap).alias("n"),
    )


def correlation_matrix(daily: DataFrame, day: str, name: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every pair of series on their common days (the series list is short)."""
    p = joins.unordered_pairs(daily, [day, *by], name, [value])
    return p.groupBy(*by, f"{name}_i", f"{name}_j").agg(F.corr(f"{value}_i", f"{value}_j").alias("pearson"), F.count(F.lit(1)).alias("days"))


def tail_comovement(daily: DataFrame, day: str, name: str, value: str, k: int) -> DataFrame:
    """Share of a series' k worst days on which each other series also lost."""
    w = Window.partitionBy(name).orderBy(value, day)
    worst = daily.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(day, F.col(name).alias("worst_of"))
    return worst.join(daily, day).where(F.col(name) != F.col("worst_of")).groupBy("worst_of", name).agg(
        F.avg((F.col(value) < 0).cast("double")).alias("share_losing"), F.count(F.lit(1)).alias("days")
    )


def overlap_categories(a: DataFrame, b: DataFrame, keys: Sequence[str], pos: str, net: str) -> DataFrame:
    """Rows of two books by how their positions relate, with the net difference."""
    j = a.select(*keys, F.col(pos).alias("_pa"), F.col(net).alias("_na")).join(
        b.select(*keys, F.col(pos).alias("_pb"), F.col(net).alias("_nb")), list(keys), "full_outer"
    )
    pa, pb = F.coalesce("_pa", F.lit(0.0)), F.coalesce("_pb", F.lit(0.0))
    cat = (
        F.when((pa == 0) & (pb == 0), "both flat").when(pa == pb, "same").when(pb == 0, "only first").when(pa == 0, "only second")
        .when(F.signum(pa) == -F.signum(pb), "opposite").otherwise("different size")
    )
    return j.groupBy(cat.alias("category")).agg(
        F.count(F.lit(1)).alias("rows"), exact_sum(F.coalesce("_na", F.lit(0.0)) - F.coalesce("_nb", F.lit(0.0))).alias("net_difference")
    )


def event_windows(daily: DataFrame, day: str, value: str, events: dict[str, tuple[str, str]]) -> DataFrame:
    """Net, worst day and days inside each named date window, and outside all of them."""
    d = F.col(day)
    inside = [
        (n, (d >= F.lit(lo).cast("date")) & (d <= F.lit(hi).cast("date"))) for n, (lo, hi) in events.items()
    ]
    outside = ~inside[0][1]
    for _, c in inside[1:]:
        outside = outside & ~c
    cells = [
        F.struct(
            F.lit(n).alias("event"), exact_sum(F.when(c, F.col(value))).alias("net"), F.min(F.when(c, F.col(value))).alias("worst_day"),
            F.count_if(c).alias("days"),
        )
        for n, c in [*inside, ("none", outside)]
    ]
    return daily.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("c")).select("c.*")


def cell_correction(rows: DataFrame, cell: Sequence[str], residual: str, shrink: float = 200.0, min_t: float = 2.0) -> DataFrame:
    """Mean residual per cell, shrunk by n/(n+shrink), kept where its t-value is large enough."""
    g = rows.groupBy(*cell).agg(F.count(residual).alias("n"), exact_avg(residual).alias("_m"), F.stddev_samp(residual).alias("_s"))
    t = F.col("_m") / (F.col("_s") / F.sqrt(F.col("n").cast("double")))
    return g.select(
        *cell, "n", t.alias("t"), F.when(F.abs(t) >= min_t, F.col("_m") * F.col("n") / (F.col("n") + shrink)).otherwise(0.0).alias("correction")
    )


def run_spread(runs: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Smallest, middle and largest result over repeated runs and how many were negative."""
    return runs.groupBy(*by).agg(
        F.min(value).alias("low"), F.percentile(value, 0.5).alias("middle"), F.max(value).alias("high"), F.count_if(F.col(value) < 0).alias("negative_runs"),
        F.count(F.lit(1)).alias("runs"),
    )


def market_baseline(daily: DataFrame, day: str, level: str, bills: DataFrame, rate: str, days_per_year: float = 365.0) -> DataFrame:
    """Annualised return and worst drawdown of a market level, and the mean bill rate carried forward over its days."""
    w = Window.partitionBy(F.lit(0)).orderBy(day)  # one row per calendar day
    j = daily.join(bills.select(day, rate), day, "full_outer").withColumn("_r", F.last(rate, ignorenulls=True).over(w))
    j = j.where(F.col(level).isNotNull()).withColumn("_peak", F.max(level).over(w))
    return j.agg(
        F.min_by(level, day).alias("first_level"), F.max_by(level, day).alias("last_level"), F.datediff(F.max(day), F.min(day)).alias("span_days"),
        F.min(F.col(level) / F.col("_peak") - 1).alias("worst_drawdown"), exact_avg("_r").alias("mean_rate"),
    ).withColumn("annual_return", F.pow(F.col("last_level") / F.col("first_level"), F.lit(days_per_year) / F.col("span_days")) - 1)
