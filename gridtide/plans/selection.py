"""Walk-forward masks and choices, neighbour settings and placebos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_sum, fixed, value_of
from gridtide.plans.studies import _uniform


# ---------------------------------------------------------------- calendars and masks

def month_calendar(bounds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First days of every month touched by [lo, hi]."""
    return bounds.select(*keys, F.explode(F.sequence(F.trunc("lo", "MM"), F.trunc("hi", "MM"), F.expr("interval 1 month"))).alias("period"))


def quarter_calendar(bounds: DataFrame) -> DataFrame:
    q = bounds.select(F.explode(F.sequence(F.trunc("lo", "quarter"), F.trunc("hi", "quarter"), F.expr("interval 3 month"))).alias("period"))
    return q.select("period", F.add_months("period", 3).alias("period_end"), tc.quarter_label("period").alias("label"))


def first_month_from(d: Column) -> Column:
    """First month start at or after a date."""
    m = F.trunc(d, "MM")
    return F.when(m == d, m).otherwise(F.add_months(m, 1))


def first_training_month(day: Column, published: Column, zone: str, gap_days: int = 2) -> Column:
    """First month start whose refit may learn from a row: the day ends ``gap_days`` before it and the
    label was public by the deadline on the day before it.  Null when the label is never public."""
    usable = tc.first_usable_day(published, zone)
    start = F.greatest(F.date_add(day, gap_days), F.date_add(usable, 1))
    return F.when(published.isNotNull(), first_month_from(start))


def training_rows(rows: DataFrame, keys: Sequence[str], day: str, published: str, value: str, zone: str) -> DataFrame:
    """Per refit month the number and the latest day of the rows it may learn from.

    Each row enters at one month and stays, so one aggregate and a running sum over the months replace
    a join of every period with all earlier rows.
    """
    r = rows.where(F.col(value).isNotNull()).withColumn("_p", first_training_month(F.col(day), F.col(published), zone))
    entry = r.where(F.col("_p").isNotNull()).groupBy(*keys, F.col("_p").alias("period")).agg(F.count(F.lit(1)).alias("_n"), F.max(day).alias("_d"))
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return entry.select(*keys, "period", F.sum("_n").over(w).alias("train_rows"), F.max("_d").over(w).alias("train_last"))


def trailing_quarters(df: DataFrame, keys: Sequence[str], day: str, value: str, quarters: int) -> DataFrame:
    """Per key and quarter the sum over the ``quarters`` before it, without the last day before it.

    A choice for a quarter uses delivery days up to two days before its start.  Sums are kept per
    calendar quarter with the last day apart, so windows run over a handful of quarters and no row is
    repeated per period it serves.
    """
    q = (F.year(day) * 4 + F.quarter(day)).cast("int")
    is_last = F.date_add(F.col(day), 1) == F.trunc(F.date_add(F.col(day), 1), "quarter")
    v = fixed(value)
    per = df.groupBy(*keys, q.alias("_q")).agg(
        F.coalesce(F.sum(v), F.lit(0)).alias("_s"), F.coalesce(F.sum(F.when(is_last, v)), F.lit(0)).alias("_l"),
        F.count(value).alias("_n"), F.count(F.when(is_last, F.col(value))).alias("_ln"),
    )
    span = df.agg(F.min(q).alias("_a"), (F.max(q) + 1).alias("_b"))  # one row
    every = per.select(*keys).distinct().join(F.broadcast(span)).select(*keys, F.explode(F.sequence("_a", "_b")).alias("_q"))
    line = every.join(per, [*keys, "_q"], "left").na.fill(0, ["_s", "_l", "_n", "_ln"])
    w = Window.partitionBy(*keys).orderBy("_q")
    all_q, last_q = w.rangeBetween(-quarters, -1), w.rangeBetween(-1, -1)
    year = F.floor((F.col("_q") - 1) / 4).cast("int")
    period = F.make_date(year, (F.col("_q") - year * 4 - 1) * 3 + 1, F.lit(1))
    tot = F.coalesce(F.sum("_s").over(all_q), F.lit(0)) - F.coalesce(F.sum("_l").over(last_q), F.lit(0))
    cnt = F.coalesce(F.sum("_n").over(all_q), F.lit(0)) - F.coalesce(F.sum("_ln").over(last_q), F.lit(0))
    return line.select(*keys, period.alias("period"), value_of(tot).alias("trailing_net"), cnt.alias("trailing_rows"))


# ---------------------------------------------------------------- choices

def setting_nets(df: DataFrame, by: Sequence[Column | str], settings: Sequence[tuple[str, Column]]) -> DataFrame:
    """Net of every setting per group in one pass: (by..., setting_index, setting, net)."""
    cells = [F.struct(F.lit(i).alias("setting_index"), F.lit(n).alias("setting"), F.coalesce(exact_sum(c), F.lit(0.0)).alias("net")) for i, (n, c) in enumerate(settings)]
    g = df.groupBy(*by).agg(F.array(*cells).alias("_c"))
    names = [c for c in g.columns if c != "_c"]
    return g.select(*names, F.explode("_c").alias("c")).select(*names, "c.*")


def choose_setting(nets: DataFrame, day: str, keys: Sequence[str] = (), quarters: int = 4, default_index: int = 0) -> DataFrame:
    """Per quarter (and key) the setting with the best trailing net; ties go to the first of the grid;
    the declared default when nothing earlier exists."""
    t = trailing_quarters(nets, [*keys, "setting_index", "setting"], day, "net", quarters)
    best = F.max_by(F.struct("setting_index", "setting"), F.struct(F.col("trailing_net"), -F.col("setting_index")))
    dflt = F.max(F.when(F.col("setting_index") == default_index, F.struct("setting_index", "setting")))
    g = t.groupBy(*keys, "period").agg(best.alias("_b"), dflt.alias("_d"), F.max("trailing_rows").alias("_n"), F.max("trailing_net").alias("best_net"))
    pick = F.when(F.col("_n") > 0, F.col("_b")).otherwise(F.col("_d"))
    return g.select(*keys, "period", pick["setting_index"].alias("setting_index"), pick["setting"].alias("setting"), "best_net", (F.col("_n") > 0).alias("from_data"))


def apply_choice(nets: DataFrame, choice: DataFrame, day: str, size: int, shifts: Sequence[int] = (0,)) -> DataFrame:
    """Daily net of the chosen setting and of its neighbours ``shifts`` places along a grid of ``size`` settings (kept inside
    it), all from one join: (period, shift, day, setting_index, net)."""
    moved = F.greatest(F.lit(0), F.least(F.col("setting_index") + F.col("shift"), F.lit(size - 1)))
    c = choice.select("period", "setting_index", F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift")).withColumn("setting_index", moved)
    placed = nets.withColumn("period", F.trunc(day, "quarter"))
    return placed.join(c, ["period", "setting_index"]).select("period", "shift", day, "setting_index", "net")


def choose_pairs(pairs_daily: DataFrame, day: str, pair: str, k: int = 5, quarters: int = 4) -> DataFrame:
    """Per quarter the best k pairs by positive trailing net."""
    t = trailing_quarters(pairs_daily, [pair], day, "net", quarters).where(F.col("trailing_net") > 0)
    w = Window.partitionBy("period").orderBy(F.desc("trailing_net"), pair)
    return t.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("period", pair, "place", "trailing_net")


def usual_sides(spreads: DataFrame, day: str, keys: Sequence[str], spread: str, quarters: int = 12) -> DataFrame:
    """Sign of the mean spread over the trailing quarters per key and period; no row without history."""
    t = trailing_quarters(spreads, keys, day, spread, quarters)
    return t.where(F.col("trailing_rows") > 0).select(*keys, "period", F.signum("trailing_net").alias("side"))


def static_pairs(spreads: DataFrame, day: str, pair: str, slot: str, spread: str, cost: str, k: int = 5) -> DataFrame:
    """No-model pairs: today's side per pair and slot from three years, the pairs by the trailing four
    quarters of the same rule with the sides known a year earlier."""
    sides = usual_sides(spreads.where(F.col(spread).isNotNull()), day, [pair, slot], spread)
    year_ago = sides.select(pair, slot, F.add_months("period", 12).alias("_q"), F.col("side").alias("_old"))
    s = spreads.where(F.col(spread).isNotNull())
    # a day's net under the sides of the quarter it helps to choose: one row per quarter it serves (at most five)
    served = s.withColumn(
        "_q", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.add_months(F.trunc(day, "quarter"), i * 3)))
    ).where((F.col(day) >= F.add_months("_q", -12)) & (F.col(day) <= F.date_sub("_q", 2)))
    net = served.join(year_ago, [pair, slot, "_q"]).groupBy(pair, F.col("_q").alias("period")).agg(
        exact_sum(F.col("_old") * F.col(spread) - F.abs("_old") * F.col(cost)).alias("trailing_net")
    )
    w = Window.partitionBy("period").orderBy(F.desc("trailing_net"), pair)
    chosen = net.where(F.col("trailing_net") > 0).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return chosen.join(sides, [pair, "period"]).select("period", pair, slot, "place", "trailing_net", "side")


def best_setting_pairs(nets: DataFrame, day: str, pair: str, k: int = 5, quarters: int = 4) -> DataFrame:
    """Per quarter the setting with the largest sum of its k best positive pair nets."""
    t = trailing_quarters(nets, [pair, "setting_index", "setting"], day, "net", quarters)
    w = Window.partitionBy("period", "setting_index").orderBy(F.desc("trailing_net"), pair)
    top = t.where(F.col("trailing_net") > 0).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    g = top.groupBy("period", "setting_index", "setting").agg(exact_sum("trailing_net").alias("top_net"), F.count(F.lit(1)).alias("pairs"))
    best = g.groupBy("period").agg(F.max_by(F.struct("setting_index", "setting", "top_net", "pairs"), F.struct(F.col("top_net"), -F.col("setting_index"))).alias("b"))
    return best.select("period", "b.*")


# ---------------------------------------------------------------- placebos

def one_day_late(scores: DataFrame, keys: Sequence[str], day: str, score: str) -> DataFrame:
    """Each day carries the score of the previous row's day."""
    w = Window.partitionBy(*keys).orderBy(day)
    return scores.withColumn(score, F.lag(score).over(w))


def dealt_days(days: DataFrame, day: str, block: Column, draws: int, seed: int) -> DataFrame:
    """For every draw a permutation of the days inside each block: (draw, target day, source day).

    Days are ordered by a hash of (seed, draw, day), so a draw does not depend on partitioning.  The
    table has draws x calendar days rows.
    """
    d = days.select(F.col(day).alias("_d"), block.alias("_b")).distinct()
    t = d.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_d")))
    s = d.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy("_b", "draw").orderBy(_uniform(F.lit(seed), F.col("draw"), F.col("_d")), "_d")
    s = s.withColumn("_r", F.row_number().over(w))
    return s.select("draw", "_b", "_r", F.col("_d").alias("source_day")).join(
        t.select("_b", "_r", F.col("_d").alias("target_day")), ["_b", "_r"]
    ).select("draw", "target_day", "source_day")


def permuted_nets(day_scores: DataFrame, day_nets: DataFrame, day: str, score: str, net: str, cut: float, draws: int, seed: int) -> DataFrame:
    """Total of a day filter (sit out above the cut) under score permutations within each year."""
    deal = dealt_days(day_scores, day, F.year(day), draws, seed)
    s = day_scores.select(F.col(day).alias("source_day"), F.col(score).alias("_s"))
    n = day_nets.select(F.col(day).alias("target_day"), F.col(net).alias("_n"))
    taken = F.when(F.col("_s") > cut, 0.0).otherwise(F.col("_n"))
    return deal.join(s, "source_day").join(n, "target_day").groupBy("draw").agg(exact_sum(taken).alias("total"))


def month_matrix(rows: DataFrame, day: str, keys: Sequence[str], pos: str, gap: str) -> DataFrame:
    """P&L of each day's position vector on every other day of its month (source, target, value).

    Rows meet only inside one (month, zone, slot), at most 31 by 31, and are summed to day pairs by a
    map-side aggregate.
    """
    m = F.trunc(day, "MM")
    src = rows.select(m.alias("_m"), *keys, F.col(day).alias("source_day"), F.col(pos).alias("_p"))
    dst = rows.select(
        m.alias("_m"), *keys, F.col(day).alias("target_day"), F.coalesce(gap, F.lit(0.0)).alias("_g"), "supply_cost", "load_cost"
    )
    cost = F.when(F.col("_p") < 0, F.col("supply_cost")).otherwise(F.col("load_cost"))
    return src.join(dst, ["_m", *keys]).groupBy("source_day", "target_day").agg(
        exact_sum(F.col("_p") * F.col("_g") - F.abs("_p") * cost).alias("value")
    )


def random_days_placebo(rows: DataFrame, day: str, keys: Sequence[str], pos: str, gap: str, draws: int, seed: int) -> DataFrame:
    """Totals of whole-day position blocks dealt to random days of the same month, per draw."""
    deal = dealt_days(rows, day, F.trunc(day, "MM"), draws, seed)
    m = month_matrix(rows, day, keys, pos, gap)
    return deal.join(m, ["source_day", "target_day"], "left").groupBy("draw").agg(
        F.coalesce(exact_sum("value"), F.lit(0.0)).alias("total")
    )


def placebo_summary(draws: DataFrame, real: DataFrame) -> DataFrame:
    """Where the real total lies among the draws (``real``: one row, column real_total)."""
    return draws.join(F.broadcast(real)).groupBy("real_total").agg(
        F.count(F.lit(1)).alias("draws"), F.avg((F.col("total") < F.col("real_total")).cast("double")).alias("share_below_rule"),
        F.avg((F.col("total") > F.col("real_total")).cast("double")).alias("share_beats_rule"), F.percentile("total", 0.5).alias("median_total"),
    )


def fragility(total: Column, neighbours: Sequence[Column], without_best: Sequence[Column], share_beats: Column) -> Column:
    """Reasons why a result is fragile (empty = not fragile)."""
    flip = F.lit(False)
    for n in neighbours:
        flip = flip | (F.signum(n) != F.signum(total))
    thin = F.lit(False)
    for n in without_best:
        thin = thin | (n < 0)
    return F.filter(
        F.array(
            F.when(flip, "sign changes at a neighbouring setting"), F.when(thin, "negative without one year's best days"),
            F.when(share_beats > 0.2, "random days win too often"),
        ),
        lambda r: r.isNotNull(),
    )
