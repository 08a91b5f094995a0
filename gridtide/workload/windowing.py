"""Window functions on calendar grids (G1-G22) on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_avg, exact_avg_over, exact_sum
from gridtide.operators import grid, pools, ranking, trailing
from gridtide.workload.bindings import FEED, PANEL, feed, load, panel, with_, xavg, xavg_over, xmean, xsum, xsum_over, xunits
from gridtide.workload.registry import query

_HOURS = FEED + f", h as (select area, date_trunc('hour', ts) as hour_utc, {xavg('value')} as v, count(*) as n from feed group by 1, 2)"
_GRID = _HOURS + """, g as (select e.area, e.hour_utc, h.v, h.n from (select area, unnest(generate_series(min(hour_utc), max(hour_utc), interval 1 hour)) as hour_utc from h group by 1) e
   left join h using (area, hour_utc))"""
_DAYS = f"days as (select l_returnflag as series, l_shipdate::date as day, {xsum('l_extendedprice*(l_tax-l_discount)/1000.0e0')} as v, count(*) as n from lineitem group by 1, 2)"


def hours_(spark, sf):
    return feed(spark, sf).groupBy("area", tc.hour_floor("ts").alias("hour_utc")).agg(exact_avg("value").alias("v"), F.count(F.lit(1)).alias("n"))


def grid_(spark, sf):
    return grid.complete_grid(hours_(spark, sf), ["area"], "hour_utc")


def days_(spark, sf):
    v = F.col("l_extendedprice") * (F.col("l_tax") - F.col("l_discount")) / 1000.0
    return load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("series"), F.col("l_shipdate").cast("date").alias("day")).agg(
        exact_sum(v).alias("v"), F.count(F.lit(1)).alias("n")
    )


@query(
    "yesterday_and_jump",
    oracle=with_(_GRID) + f"""
      select area, hour_utc, v, lag(v, 24) over w as same_hour_yesterday, v - lag(v) over w as jump, {xavg_over('v', 'partition by area')} as long_run from g window w as (partition by area order by hour_utc)""",
)
def yesterday(spark, sf):
    w = Window.partitionBy("area").orderBy("hour_utc")
    return grid_(spark, sf).select(
        "area", "hour_utc", "v", F.lag("v", 24).over(w).alias("same_hour_yesterday"), (F.col("v") - F.lag("v").over(w)).alias("jump"),
        exact_avg_over("v", Window.partitionBy("area")).alias("long_run"),
    )


@query(
    "ntile_buckets",
    oracle=with_(_HOURS) + f"""
      select area, bucket, count(*) as hours, min(v) as lo, max(v) as hi, {xavg('v')} as mean_v from (
        select *, ntile(10) over (partition by area order by v, hour_utc)::int as bucket from h) group by 1, 2""",
)
def ntile_buckets(spark, sf):
    placed = ranking.positions(hours_(spark, sf).where("v is not null").drop("n"), ["area"], "v", "hour_utc")
    return placed.withColumn("bucket", ranking.ntile_of_position(10)).groupBy("area", "bucket").agg(
        F.count(F.lit(1)).alias("hours"), F.min("v").alias("lo"), F.max("v").alias("hi"), exact_avg("v").alias("mean_v")
    )


@query(
    "deciles_by_pooled_rank",
    oracle=f"""with r as (select l_returnflag, l_quantity as q, l_extendedprice as p, (rank() over w + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0e0) / count(*) over (partition by l_returnflag) as pct
        from lineitem window w as (partition by l_returnflag order by l_quantity))
      select l_returnflag, least(9, floor(pct * 10.0e0))::int as decile, count(*) as n, min(q) as lo, max(q) as hi, {xavg('p')} as mean_price from r group by 1, 2""",
)
def deciles_by_rank(spark, sf):
    # decile of a value depends on its rank only, so rows are pre-aggregated per distinct value and never ranked one by one
    li = load(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    cents = F.sum(F.floor(F.col("l_extendedprice") * 100.0 + 0.5).cast("bigint"))
    rv = ranking.ranked_values(li, ["l_returnflag"], "l_quantity", extra={"cents": cents})
    return rv.groupBy("l_returnflag", ranking.decile_of_rank().alias("decile")).agg(
        F.sum("ties").alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"),
        (F.sum("cents").cast("double") / (F.sum("ties").cast("double") * 100.0)).alias("mean_price"),
    )


@query(
    "equal_count_bins",
    oracle="""with r as (select o_orderstatus, o_totalprice, row_number() over (partition by o_orderstatus order by o_totalprice, o_orderkey) - 1 as i, count(*) over (partition by o_orderstatus) as n from orders)
      select o_orderstatus, greatest(ceil(i * 10.0e0 / greatest(n - 1, 1)) - 1, 0)::int as bin, count(*) as rows, min(o_totalprice) as lo, max(o_totalprice) as hi from r group by 1, 2""",
)
def equal_count_bins(spark, sf):
    o = load(spark, sf, "orders").select("o_orderstatus", "o_totalprice", "o_orderkey")
    ends = {"lo": F.min("o_totalprice"), "hi": F.max("o_totalprice")}
    p = ranking.bin_parts(o, ["o_orderstatus"], "o_totalprice", "o_orderkey", 10, ends)
    return p.groupBy("o_orderstatus", "bin").agg(F.sum("ties").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query(
    "trailing_rank",
    oracle=with_(_DAYS) + """, x as (select a.series, a.day, a.v, count(b.v) as obs, count(*) filter (where b.v < a.v) as less from days a left join days b
        on a.series = b.series and b.day >= a.day - 365 and b.day <= a.day - 1 group by 1, 2, 3)
      select series, day, v, case when obs >= 60 then less::double / obs::double end as rank_365 from x""",
)
def trailing_rank(spark, sf):
    return trailing.trailing_rank(days_(spark, sf), ["series"], "day", "v", "rank_365").drop("n")


@query(
    "pooled_rolling_cut",
    oracle=with_(_DAYS) + """
      select d.day, round(quantile_cont(p.v, 0.9), 9) as cut from (select distinct day from days) d left join days p on p.day >= d.day - 30 and p.day <= d.day - 1 group by 1""",
)
def pooled_cut(spark, sf):
    return trailing.pooled_rolling_cut(days_(spark, sf), "day", "v", 30, 0.1, "cut").withColumn("cut", F.round("cut", 9))


@query(
    "rolling_pool_rank_size",
    oracle=with_(_DAYS) + """, x as (select a.series, a.day, a.v, count(b.v) as obs, count(*) filter (where b.v < a.v) as less from days a left join days b on b.day >= a.day - 30 and b.day <= a.day - 1 group by 1, 2, 3)
      select series, day, case when obs > 0 then 1.0e0 - less::double / obs::double end as size from x""",
)
def pool_rank_size(spark, sf):
    d = days_(spark, sf)
    ranked = pools.rolling_rank(pools.Pool(d, "day", "v", 30), d.drop("n"), "day", "v")
    return ranked.select("series", "day", F.when(F.col("n") > 0, 1.0 - F.col("less").cast("double") / F.col("n").cast("double")).alias("size"))


_W28 = "partition by zone, slot order by delivery_date range between interval 28 day preceding and interval 1 day preceding"


@query(
    "trailing_stats_28_days",
    oracle=with_(PANEL) + f"""
      select delivery_date, zone, slot, gap, {xavg_over('gap', _W28)} as gap_28d_mean, round(quantile_cont(gap, 0.5) over w, 11) as gap_28d_median, round(stddev_samp(gap) over w, 6) as gap_28d_std, count(gap) over w as gap_28d_n,
        avg(case when gap > 1 then 1.0e0 else 0.0e0 end) over w as gap_28d_up_rate, avg(case when gap < -1 then 1.0e0 else 0.0e0 end) over w as gap_28d_down_rate
      from panel window w as ({_W28})""",
)
def trailing_stats(spark, sf):
    p = panel(spark, sf).select("delivery_date", "zone", "slot", "gap")
    t = trailing.trailing_stats(p, ["zone", "slot"], "delivery_date", "gap", 28, "gap_28d", spike=1.0)
    return t.withColumn("gap_28d_median", F.round("gap_28d_median", 11)).withColumn("gap_28d_std", F.round("gap_28d_std", 6))


_V = f"""v as (select l_linestatus as series, l_shipdate::date as day, l_shipdate::date + 1 + (l_suppkey % 5)::int as usable, l_extendedprice*(l_tax-l_discount)/1000.0e0 as x from lineitem)"""


def public_values(spark, sf):
    day = F.col("l_shipdate").cast("date")
    return load(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("series"), day.alias("day"), F.date_add(day, (F.col("l_suppkey") % 5 + 1).cast("int")).alias("usable"),
        (F.col("l_extendedprice") * (F.col("l_tax") - F.col("l_discount")) / 1000.0).alias("x"),
    )


@query(
    "trailing_mean_of_public_rows",
    oracle=with_(_V) + f""", d as (select distinct day as d from v), s as (select distinct series from v)
      , j as (select s.series, d.d, sum({xunits('v.x')}) as sx, count(v.x) as n from s cross join d left join v on v.series = s.series and v.day >= d.d - 60 and v.day <= d.d - 1 and v.usable <= d.d group by 1, 2)
      select series, d as decision_day, case when n > 0 then {xmean('sx', 'n')} end as x_60d, n as n_usable from j""",
)
def public_rows(spark, sf):
    v = public_values(spark, sf)
    decisions = v.select(F.col("day").alias("decision_day")).distinct()
    return trailing.masked_trailing(v, ["series"], "day", "usable", "x", decisions, "decision_day", 60)


@query(
    "quantiles_of_public_rows",
    oracle=with_(_V) + """, d as (select distinct series, day as d from v)
      , j as (select d.series, d.d, round(quantile_cont(v.x, 0.9), 9) as q90_60d, count(v.x) as n from d left join v on v.series = d.series and v.day >= d.d - 60 and v.day <= d.d - 1 and v.usable <= d.d group by 1, 2)
      select series, d as decision_day, q90_60d, n as n_usable from j""",
)
def public_quantiles(spark, sf):
    v = public_values(spark, sf)
    pool = pools.Pool(v, "day", "x", 60, ["series"], "usable")
    q = pools.rolling_quantile(pool, v.select("series", F.col("day").alias("decision_day")), "decision_day", 0.9, "q90_60d")
    return q.select("series", "decision_day", F.round("q90_60d", 9).alias("q90_60d"), F.col("n").alias("n_usable"))


@query(
    "shift_by_true_hours",
    oracle=with_(_HOURS) + " select a.area, a.hour_utc, a.v, b.v as v_2h_ago from h a left join h b on a.area = b.area and b.hour_utc = a.hour_utc - interval 2 hour",
)
def true_hours(spark, sf):
    from gridtide.operators.joins import shifted

    return shifted(hours_(spark, sf).select("area", "hour_utc", "v"), ["area"], "hour_utc", "2 hour", ["v"], "_2h_ago")


@query(
    "bounded_forward_fill",
    oracle=with_(_GRID) + """, p as (select *, row_number() over (partition by area order by hour_utc) as pos from g)
      select area, hour_utc, v, last_value(v ignore nulls) over w as filled, pos - last_value(case when v is not null then pos end ignore nulls) over w as filled_age from p
      window w as (partition by area order by hour_utc rows between 12 preceding and current row)""",
)
def forward_fill(spark, sf):
    x = trailing.forward_fill(grid_(spark, sf).drop("n"), ["area"], "hour_utc", "v", 12, "filled")
    return x.withColumn("filled_age", F.col("filled_age").cast("bigint"))


_SIGN = _GRID + ", s as (select area, hour_utc, v - 20.0e0 as d from g)"


@query(
    "sign_run_length",
    oracle=with_(_SIGN) + """, a as (select *, case when d > 0 then 1 when d < 0 then -1 else 0 end as s from s),
      b as (select *, case when s <> coalesce(lag(s) over (partition by area order by hour_utc), 0) then 1 else 0 end as nw from a),
      c as (select *, sum(nw) over (partition by area order by hour_utc rows unbounded preceding) as g from b)
      select area, hour_utc, d, case when s = 0 then 0 else row_number() over (partition by area, g order by hour_utc) end as run from c""",
)
def sign_run(spark, sf):
    g = grid_(spark, sf).select("area", "hour_utc", (F.col("v") - 20.0).alias("d"))
    return trailing.sign_run_length(g, ["area"], "hour_utc", "d", "run").withColumn("run", F.col("run").cast("bigint"))


@query(
    "rolling_median_min_obs",
    oracle=with_(_GRID) + """
      select area, hour_utc, case when count(v) over w >= 3 then round(quantile_cont(v, 0.5) over w, 9) end as med6 from g window w as (partition by area order by hour_utc rows between 5 preceding and current row)""",
)
def rolling_median(spark, sf):
    x = trailing.rolling_median(grid_(spark, sf), ["area"], "hour_utc", "v", 6, 3, "med6")
    return x.select("area", "hour_utc", F.round("med6", 9).alias("med6"))


@query(
    "equity_and_drawdown",
    oracle=with_(_DAYS) + f""", c as (select series, day, v, {xsum_over('v', 'partition by series order by day rows unbounded preceding')} as cum from days),
      p as (select *, greatest(0.0e0, max(cum) over (partition by series order by day rows unbounded preceding)) as peak from c)
      select *, cum - peak as drawdown from p""",
)
def equity(spark, sf):
    return trailing.equity(days_(spark, sf).drop("n"), ["series"], "day", "v")


@query(
    "rolling_sharpe_year",
    oracle=with_(_DAYS) + """
      select series, day, case when count(v) over w = 365 and stddev_samp(v) over w > 0 then round(avg(v) over w / stddev_samp(v) over w * sqrt(365.0e0), 6) end as sharpe from days
      window w as (partition by series order by day rows between 364 preceding and current row)""",
)
def rolling_sharpe(spark, sf):
    x = trailing.rolling_sharpe(days_(spark, sf), ["series"], "day", "v", 365, 365.0, "sharpe")
    return x.select("series", "day", F.round("sharpe", 6).alias("sharpe"))


@query(
    "thinned_from_the_end",
    oracle=with_(_DAYS) + " select series, day, v from (select *, row_number() over (partition by series order by day desc) - 1 as b from days) where b % 7 = 0",
)
def thinned(spark, sf):
    return trailing.thin_from_end(days_(spark, sf), ["series"], "day", 7).select("series", "day", "v")


@query(
    "profitable_at_every_higher_level",
    oracle="""with l as (select p_partkey, p_size, p_retailprice, unnest([0.5e0, 0.7e0, 1.0e0, 1.3e0, 1.6e0]) as m from part),
      x as (select p_partkey, m, p_retailprice * m - 800.0e0 - p_size * 10 > 0 as ok from l),
      y as (select *, bool_and(ok) over (partition by p_partkey order by m desc rows unbounded preceding) as up, bool_and(ok) over (partition by p_partkey order by m rows unbounded preceding) as dn from x)
      select p_partkey, min(m) filter (where up) as lowest_level, max(m) filter (where dn) as highest_level from y group by 1""",
)
def higher_level(spark, sf):
    levels = F.array(*[F.lit(x) for x in (0.5, 0.7, 1.0, 1.3, 1.6)])
    p = load(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice").withColumn("lv", levels)
    p = p.withColumn("ok", F.transform("lv", lambda m: F.col("p_retailprice") * m - 800.0 - F.col("p_size") * 10 > 0))
    up, dn = trailing.all_above(F.col("lv"), F.col("ok")), trailing.all_below(F.col("lv"), F.col("ok"))
    pick = lambda flags: F.filter(F.zip_with("lv", flags, lambda a, b: F.when(b, a)), lambda v: v.isNotNull())
    return p.select("p_partkey", F.array_min(pick(up)).alias("lowest_level"), F.array_max(pick(dn)).alias("highest_level"))
