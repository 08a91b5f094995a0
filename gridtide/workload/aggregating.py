"""Aggregations (F1-F23) and top-k reports (H1-H7) on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_avg, exact_sum
from gridtide.operators import ranking
from gridtide.workload.bindings import AREAS, FEED, PANEL, ZONE, Warehouse, feed, load, panel, warehouse_sql, with_, xavg, xsum
from gridtide.workload.registry import query


@query(
    "daily_bars",
    oracle=with_(FEED) + f"""
      select area, cast((ts at time zone 'UTC') at time zone '{ZONE}' as date) as day_dk, {xavg('value')} as avg_v, min(value) as low_v, max(value) as high_v,
        arg_min(value, ts) as open_v, arg_max(value, ts) as close_v, count(*) as n, count(*) filter (where value < 5) as n_low, {xsum('value')} as total from feed group by 1, 2""",
)
def daily_bars(spark, sf):
    return feed(spark, sf).groupBy("area", tc.local_date("ts", ZONE).alias("day_dk")).agg(
        exact_avg("value").alias("avg_v"), F.min("value").alias("low_v"), F.max("value").alias("high_v"), F.min_by("value", "ts").alias("open_v"),
        F.max_by("value", "ts").alias("close_v"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 5).alias("n_low"), exact_sum("value").alias("total"),
    )


@query(
    "pivot_by_type",
    oracle=with_(FEED) + " select date_trunc('hour', ts) as hour_utc, " + ", ".join(f"{xavg(f'case when area = {chr(39)}{a}{chr(39)} then value end')} as {a}" for a in AREAS) + " from feed group by 1",
)
def pivot_by_type(spark, sf):
    f = feed(spark, sf).withColumn("hour_utc", tc.hour_floor("ts"))
    # the value list is fixed, so no extra pass looks for it
    return f.groupBy("hour_utc").pivot("area", list(AREAS)).agg(exact_avg("value"))


@query(
    "unpivot_wide",
    oracle="""select o_orderkey, measure, v from (select o_orderkey, o_totalprice as price, case when o_custkey % 3 = 0 then o_custkey::double end as customer from orders)
      unpivot include nulls (v for measure in (price, customer))""",
)
def unpivot_wide(spark, sf):
    o = load(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey").cast("double")).alias("customer")
    )
    return o.unpivot(["o_orderkey"], ["price", "customer"], "measure", "v")


@query(
    "exact_quantiles",
    oracle="""select l_returnflag, year(l_shipdate) as year, round(quantile_cont(l_extendedprice, 0.05), 6) as p05, round(quantile_cont(l_extendedprice, 0.5), 6) as p50, round(quantile_cont(l_extendedprice, 0.95), 6) as p95,
      round(quantile_cont(l_extendedprice, 0.99), 6) as p99, count(*) as n from lineitem group by 1, 2""",
)
def exact_quantiles(spark, sf):
    li = load(spark, sf, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("year"), "l_extendedprice")
    q = ranking.quantile_columns(li, ["l_returnflag", "year"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99})
    return q.select("l_returnflag", "year", "n", *[F.round(c, 6).alias(c) for c in ("p05", "p50", "p95", "p99")])


@query(
    "grid_quantiles",
    oracle=with_(PANEL) + "select zone, slot, round(median(gap), 9) as p50, round(quantile_cont(gap, 0.9), 9) as p90 from panel group by 1, 2",
)
def grid_quantiles(spark, sf):
    # one row per day in each group
    return panel(spark, sf).groupBy("zone", "slot").agg(
        F.round(F.percentile("gap", 0.5), 9).alias("p50"), F.round(F.percentile("gap", 0.9), 9).alias("p90")
    )


@query(
    "deviation_and_error",
    oracle="""select o_orderpriority, round(stddev_samp(o_totalprice), 4) as sd, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) as se, count(*) as n from orders group by 1""",
)
def deviation(spark, sf):
    sd = F.stddev_samp("o_totalprice")
    return load(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.round(sd, 4).alias("sd"), F.round(sd / F.sqrt(F.count(F.lit(1))), 4).alias("se"), F.count(F.lit(1)).alias("n")
    )


@query(
    "correlation_and_slope",
    oracle="""select l_returnflag, round(corr(l_extendedprice, l_quantity), 8) as r, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_r2(l_extendedprice, l_quantity), 8) as r2 from lineitem group by 1""",
)
def correlation(spark, sf):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.corr(y, x), 8).alias("r"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_r2(y, x), 8).alias("r2")
    )


@query(
    "spearman_correlation",
    oracle="""with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0e0 as a,
        rank() over (partition by l_returnflag order by l_discount) + (count(*) over (partition by l_returnflag, l_discount) - 1) / 2.0e0 as b from lineitem)
      select l_returnflag, round(corr(a, b), 7) as spearman, count(*) as n from r group by 1""",
)
def spearman(spark, sf):
    li = load(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    return ranking.spearman(li, ["l_returnflag"], "l_quantity", "l_discount").withColumn("spearman", F.round("spearman", 7))


@query(
    "entities_and_first_seen",
    oracle="""with s as (select l_suppkey, min(year(l_shipdate)) as first_year from lineitem group by 1), y as (select distinct year(l_shipdate) as year, l_suppkey from lineitem)
      select year, count(*) as entities, count(*) filter (where first_year = year) as new_entities from y join s using (l_suppkey) group by 1""",
)
def entities(spark, sf):
    y = load(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), "l_suppkey").distinct()
    first = y.groupBy("l_suppkey").agg(F.min("year").alias("first_year"))
    return y.join(first, "l_suppkey").groupBy("year").agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(F.col("first_year") == F.col("year")).alias("new_entities")
    )


@query("duplicate_groups", oracle="select o_custkey, o_orderdate, count(*) as n from orders group by 1, 2 having count(*) > 1")
def duplicate_groups(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "most_common_values",
    oracle="select hour(ts) * 100 + minute(ts) as hhmm, count(*) as n from events group by 1 order by n desc, hhmm limit 3",
)
def most_common(spark, sf):
    e = load(spark, sf, "events").groupBy((F.hour("ts") * 100 + F.minute("ts")).cast("bigint").alias("hhmm")).agg(F.count(F.lit(1)).alias("n"))
    return e.orderBy(F.desc("n"), "hhmm").limit(3)


@query(
    "bias_and_shares",
    oracle=with_(FEED) + f""", x as (select area, value, k from feed)
      select area, 100.0e0 * {xsum('k - value')} / {xsum('value')} as bias_pct, avg(case when abs(k - value) <= 0.05e0 * value then 1.0e0 else 0.0e0 end) as within_5,
        avg(case when abs(k - value) <= 0.1e0 * value then 1.0e0 else 0.0e0 end) as within_10, avg(case when k = 0 then 1.0e0 else 0.0e0 end) as zero_share from x group by 1""",
)
def bias_shares(spark, sf):
    k, v = F.col("k"), F.col("value")
    share = lambda c: F.avg(c.cast("double"))
    return feed(spark, sf).groupBy("area").agg(
        (F.lit(100.0) * exact_sum(k - v) / exact_sum("value")).alias("bias_pct"), share(F.abs(k - v) <= 0.05 * v).alias("within_5"),
        share(F.abs(k - v) <= 0.1 * v).alias("within_10"), share(k == 0).alias("zero_share"),
    )


@query(
    "grouped_argmax_row",
    oracle="""select l_suppkey, l_orderkey, l_linenumber, l_extendedprice from (select l_suppkey, l_orderkey, l_linenumber, l_extendedprice,
      row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey desc, l_linenumber desc) as rn from lineitem) where rn = 1""",
)
def grouped_argmax(spark, sf):
    r = F.struct("l_extendedprice", "l_orderkey", "l_linenumber")
    return load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max(r).alias("r")).select("l_suppkey", "r.l_orderkey", "r.l_linenumber", "r.l_extendedprice")


@query("ordered_text_aggregate", oracle="select n_regionkey, string_agg(n_name, ', ' order by n_name) as nations from nation group by 1")
def ordered_text(spark, sf):
    load(spark, sf, "nation").createOrReplaceTempView("_nation_list")
    return spark.sql("select n_regionkey, listagg(n_name, ', ') within group (order by n_name) as nations from _nation_list group by 1")


_DAY_NET = PANEL + f", day_net as (select zone, delivery_date, {xsum('gap')} as net, year(delivery_date) as year from panel group by all)"


def day_net(spark, sf):
    return panel(spark, sf).groupBy("zone", "delivery_date").agg(exact_sum("gap").alias("net")).withColumn("year", F.year("delivery_date"))


@query(
    "net_without_best_days",
    oracle=with_(_DAY_NET) + f""", r as (select *, row_number() over (partition by zone, year order by net desc) as rn from day_net)
      select zone, year, {xsum('net')} as total, {xsum('net')} - {xsum('case when rn <= 3 then net end')} as without_best_3, {xsum('net')} - {xsum('case when rn <= 5 then net end')} as without_best_5 from r group by 1, 2""",
)
def without_best(spark, sf):
    return ranking.trimmed_sums(day_net(spark, sf), ["zone", "year"], "net", [3, 5])


@query(
    "best_decile_share",
    oracle="""with r as (select l_returnflag, l_tax * 100 - l_discount * 60 + l_quantity / 10 as v, l_orderkey from lineitem),
      s as (select l_returnflag, round(v, 6) as v, row_number() over (partition by l_returnflag order by v desc) as rn, count(*) over (partition by l_returnflag) as n from r)
      select l_returnflag, max(n) as n, round(sum(v) filter (where rn <= greatest(1, n // 10)) / sum(v), 9) as best_decile_share from s group by 1 having sum(v) > 0""",
)
def best_decile(spark, sf):
    v = F.round(F.col("l_tax") * 100 - F.col("l_discount") * 60 + F.col("l_quantity") / 10, 6)
    li = load(spark, sf, "lineitem").select("l_returnflag", v.alias("v"))
    return ranking.best_decile_share(li, ["l_returnflag"], "v").withColumn("best_decile_share", F.round("best_decile_share", 9))


@query(
    "season_and_half_year_rollup",
    oracle=with_(PANEL) + f"""
      select zone, year(delivery_date)::varchar || case when month(delivery_date) <= 6 then 'H1' else 'H2' end as half,
        case when month(delivery_date) in (12, 1, 2) then 'winter' when month(delivery_date) <= 5 then 'spring' when month(delivery_date) <= 8 then 'summer' else 'autumn' end as season,
        case when slot <= 2 then 'early' when slot <= 5 then 'middle' else 'late' end as block, {xsum('gap')} as net, count(*) as n from panel group by 1, 2, 3, 4""",
)
def season_rollup(spark, sf):
    block = F.when(F.col("slot") <= 2, "early").when(F.col("slot") <= 5, "middle").otherwise("late")
    return panel(spark, sf).groupBy(
        "zone", tc.half_year("delivery_date").alias("half"), tc.season("delivery_date").alias("season"), block.alias("block")
    ).agg(exact_sum("gap").alias("net"), F.count(F.lit(1)).alias("n"))


@query(
    "zones_by_smallest_worst_day",
    oracle=with_(_DAY_NET) + """, w as (select zone, arg_min(delivery_date, net) as worst_day, min(net) as worst from day_net group by 1)
      select zone, worst_day, worst, row_number() over (order by worst desc, zone) as place from w""",
)
def smallest_worst_day(spark, sf):
    w = day_net(spark, sf).groupBy("zone").agg(F.min_by("delivery_date", "net").alias("worst_day"), F.min("net").alias("worst"))
    # one row per zone
    return w.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("worst"), "zone")))


@query(
    "group_maximum_on_rows",
    oracle=with_(PANEL) + "select delivery_date, zone, slot, y_da, max(y_da) over (partition by zone, delivery_date) as peak, y_da / max(y_da) over (partition by zone, delivery_date) as rel from panel",
)
def group_maximum(spark, sf):
    w = Window.partitionBy("zone", "delivery_date")
    return panel(spark, sf).select("delivery_date", "zone", "slot", "y_da", F.max("y_da").over(w).alias("peak"), (F.col("y_da") / F.max("y_da").over(w)).alias("rel"))


# ---------------------------------------------------------------- sorts and top-k

@query("dearest_hours", oracle=warehouse_sql("select area, hour_utc, price_eur from power_hourly order by price_eur desc, area, hour_utc limit 5"))
def dearest_hours(spark, sf):
    h = Warehouse(spark, sf).power_hourly.select("area", "hour_utc", "price_eur")
    return h.orderBy(F.desc("price_eur"), "area", "hour_utc").limit(5)


@query(
    "mean_of_newest_rows",
    oracle=warehouse_sql(f"select {xavg('rate')} as mean_rate, count(*) as n from (select rate from stg_fx where currency = 'F' and rate is not null order by rate_date desc limit 30)"),
)
def newest_rows(spark, sf):
    fx = Warehouse(spark, sf).stg_fx.where((F.col("currency") == "F") & F.col("rate").isNotNull())
    return fx.orderBy(F.desc("rate_date")).limit(30).agg(exact_avg("rate").alias("mean_rate"), F.count(F.lit(1)).alias("n"))


@query(
    "worst_and_best_days",
    oracle=with_(_DAY_NET) + """, r as (select *, row_number() over (partition by zone, year order by net, delivery_date) as lo, row_number() over (partition by zone, year order by net desc, delivery_date) as hi from day_net)
      select zone, year, delivery_date, net, lo <= 3 as is_worst from r where lo <= 3 or hi <= 3""",
)
def worst_best(spark, sf):
    w = Window.partitionBy("zone", "year")
    d = day_net(spark, sf).withColumn("lo", F.row_number().over(w.orderBy("net", "delivery_date"))).withColumn(
        "hi", F.row_number().over(w.orderBy(F.desc("net"), "delivery_date"))
    )
    return d.where("lo <= 3 or hi <= 3").select("zone", "year", "delivery_date", "net", (F.col("lo") <= 3).alias("is_worst"))


@query(
    "most_frequent_sites",
    oracle="""select split_part(p_name, ' ', 1) as site, count(distinct (p_brand, p_size)) as starts from part group by 1 order by starts desc, site limit 20""",
)
def frequent_sites(spark, sf):
    p = load(spark, sf, "part").select(F.split("p_name", " ")[0].alias("site"), "p_brand", "p_size").distinct()
    return p.groupBy("site").agg(F.count(F.lit(1)).alias("starts")).orderBy(F.desc("starts"), "site").limit(20)
