"""Joins and set operations (E1-E18, I1-I5) on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_avg
from gridtide.operators import joins, setops
from gridtide.workload.bindings import FEED, PANEL, Warehouse, feed, load, panel, warehouse_sql, with_, xavg, xsum
from gridtide.workload.registry import query


@query(
    "inner_join_on_keys",
    oracle=f"""select n_name, o_orderpriority, count(*) as n, {xsum('o_totalprice')} as total from orders join customer on o_custkey = c_custkey
      join nation on c_nationkey = n_nationkey group by 1, 2""",
)
def inner_join(spark, sf):
    # per customer first: the join then moves one row per customer and priority, not one per order
    per = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("o_totalprice") * 100.0 + 0.5).cast("bigint")).alias("cents")
    )
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return per.join(c, "c_custkey").join(n, "c_nationkey").groupBy("n_name", "o_orderpriority").agg(
        F.sum("n").alias("n"), (F.sum("cents").cast("double") / 100.0).alias("total")
    )


@query(
    "left_join_with_calendar_gap",
    oracle=warehouse_sql("""select h.area, h.d, h.n, f.rate from (select area, hour_utc::date as d, count(*) as n from power_hourly group by 1, 2) h
      left join (select * from stg_fx where currency = 'P' and dayofweek(rate_date) not in (0, 6)) f on f.rate_date = h.d"""),
)
def left_join_calendar(spark, sf):
    w = Warehouse(spark, sf)
    h = w.power_hourly.groupBy("area", F.col("hour_utc").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    fx = w.stg_fx.where((F.col("currency") == "P") & ~tc.is_weekend("rate_date")).select(F.col("rate_date").alias("d"), "rate")
    return h.join(fx, "d", "left").select("area", "d", "n", "rate")


@query(
    "area_spread_per_day",
    oracle=with_(FEED) + f""", d as (select area, ts::date as day, {xavg('value')} as v from feed group by 1, 2)
      select a.day, a.v - b.v as spread from d a join d b on a.day = b.day and a.area = 'click' and b.area = 'view'""",
)
def area_spread(spark, sf):
    d = feed(spark, sf).where(F.col("area").isin("click", "view")).groupBy(F.col("ts").cast("date").alias("day")).agg(
        exact_avg(F.when(F.col("area") == "click", F.col("value"))).alias("a"), exact_avg(F.when(F.col("area") == "view", F.col("value"))).alias("b")
    )
    return d.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("day", (F.col("a") - F.col("b")).alias("spread"))


@query("missing_rows_anti_join", oracle="select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def anti_join(spark, sf):
    return load(spark, sf, "customer").select("c_custkey").join(
        load(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey")),
        "c_custkey", "left_anti",
    )


@query(
    "key_membership_semi_join",
    oracle="""select o_orderpriority, count(*) as n from orders where o_orderkey in (select l_orderkey from lineitem where l_discount >= 0.1) group by 1""",
)
def semi_join(spark, sf):
    li = load(spark, sf, "lineitem").where(F.col("l_discount") >= 0.1).select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf, "orders").join(li, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "one_row_cross_join",
    oracle="""with span as (select max(o_orderdate) as hi from orders)
      select o_orderstatus, count(*) as n from orders, span where o_orderdate >= hi - interval 90 day group by 1""",
)
def one_row_cross(spark, sf):
    o = load(spark, sf, "orders").select("o_orderstatus", "o_orderdate")
    span = o.agg(F.max("o_orderdate").alias("hi"))  # one row
    return o.join(F.broadcast(span)).where(F.col("o_orderdate") >= F.col("hi") - F.expr("interval 90 day")).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "asof_backward",
    oracle=with_(FEED) + """, l as (select event_id, user_id, ts from feed where k >= 50), r as (select event_id, user_id, ts as run_ts, value from feed where k < 50)
      select l.event_id, l.user_id, l.ts, r.run_ts as asof_run_ts, r.value as asof_value from l asof left join r on l.user_id = r.user_id and l.ts >= r.run_ts""",
)
def asof_backward(spark, sf):
    f = feed(spark, sf)
    left = f.where("k >= 50").select("event_id", "user_id", "ts")
    right = f.where("k < 50").select("event_id", "user_id", F.col("ts").alias("run_ts"), "value")
    return joins.asof_backward(left, right, ["user_id"], "ts", "run_ts", ["value"], "event_id")


@query(
    "asof_backward_with_tolerance",
    oracle=with_(FEED) + """, l as (select event_id, area, ts from feed where k >= 50), r as (select area, ts as run_ts, value from feed where k < 10)
      select l.event_id, l.area, l.ts, case when epoch(date_trunc('second', l.ts)) - epoch(date_trunc('second', r.run_ts)) <= 7200 then r.run_ts end as asof_run_ts,
        case when epoch(date_trunc('second', l.ts)) - epoch(date_trunc('second', r.run_ts)) <= 7200 then r.value end as asof_value
      from l asof left join r on l.area = r.area and l.ts >= r.run_ts""",
)
def asof_tolerance(spark, sf):
    f = feed(spark, sf)
    left = f.where("k >= 50").select("event_id", "area", "ts")
    right = f.where("k < 10").select("event_id", "area", F.col("ts").alias("run_ts"), "value")
    return joins.asof_backward(left, right, ["area"], "ts", "run_ts", ["value"], "event_id", tolerance_seconds=7200)


_INTERVALS = """i as (select o_orderkey, o_orderpriority, o_orderdate::date as s,
  case when o_orderstatus <> 'P' then o_orderdate::date + (1 + o_custkey % 40)::int end as e from orders)"""


def intervals(spark, sf):
    o = load(spark, sf, "orders")
    s = F.col("o_orderdate").cast("date")
    return o.select(
        "o_orderkey", "o_orderpriority", s.alias("s"),
        F.when(F.col("o_orderstatus") != "P", F.date_add(s, (F.col("o_custkey") % 40 + 1).cast("int"))).alias("e"),
    )


@query(
    "interval_overlap_join",
    oracle=f"""with {_INTERVALS}, d as (select distinct o_orderdate::date as day from orders)
      select day, o_orderpriority, count(*) as active, min(o_orderkey) as first_key from d join i on s <= day and (e is null or e > day) group by 1, 2""",
)
def interval_overlap(spark, sf):
    days = load(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    aggregates = {"active": (F.count(F.lit(1)), "sum"), "first_key": (F.min("o_orderkey"), "min")}
    return joins.interval_summary(days, intervals(spark, sf), "s", "e", "day", ["o_orderpriority"], aggregates)


@query(
    "closed_intervals_at_month_starts",
    oracle=f"""with {_INTERVALS}, d as (select distinct date_trunc('month', o_orderdate)::date as day from orders)
      select day, o_orderkey, o_orderpriority, e - day as days_left from d join i on s <= day and e > day""",
)
def intervals_at_months(spark, sf):
    days = load(spark, sf, "orders").select(F.trunc("o_orderdate", "MM").alias("day")).distinct()
    x = joins.interval_overlap(days, intervals(spark, sf).where("e is not null"), "s", "e", "day")
    return x.select("day", "o_orderkey", "o_orderpriority", F.datediff("e", "day").cast("bigint").alias("days_left"))


@query(
    "active_interval_counts",
    oracle=f"""with {_INTERVALS}, p as (select distinct o_orderpriority from orders), d as (select unnest(generate_series(min(s), greatest(max(s), max(e)), interval 1 day))::date as day from i),
      st as (select o_orderpriority, s as day, count(*) as c from i group by 1, 2), en as (select o_orderpriority, e as day, count(*) as c from i where e is not null group by 1, 2)
      select o_orderpriority, day, (sum(coalesce(st.c, 0)) over w - sum(coalesce(en.c, 0)) over w)::bigint as active from p cross join d
      left join st using (o_orderpriority, day) left join en using (o_orderpriority, day) window w as (partition by o_orderpriority order by day rows unbounded preceding)""",
)
def active_counts(spark, sf):
    return joins.active_counts(intervals(spark, sf), "s", "e", ["o_orderpriority"])


@query(
    "effective_date_flags",
    oracle="""with d as (select distinct o_orderdate::date as day from orders), c as (select o_orderdate::date as eff from orders where o_orderpriority = '1-URGENT' and o_totalprice > 400000)
      , cd as (select eff, count(*) as c from c group by 1)
      select day, coalesce((select sum(c) from cd where eff < day), 0)::bigint as changes_in_force, least(day - (select max(eff) from cd where eff < day), 1500) as days_since_change from d""",
)
def effective_flags(spark, sf):
    o = load(spark, sf, "orders")
    days = o.select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    changes = o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000)).select(F.col("o_orderdate").cast("date").alias("eff"))
    x = joins.effective_flags(days, "day", changes, "eff")
    return x.withColumn("days_since_change", F.col("days_since_change").cast("bigint"))


@query(
    "shifted_key_join",
    oracle=with_(FEED) + f""", d as (select area, ts::date as day, {xavg('value')} as v, count(*) as n from feed group by 1, 2)
      select a.area, a.day, a.v, a.n, b.v as v_week_ago, a.v - b.v as change from d a left join d b on a.area = b.area and b.day = a.day - 7""",
)
def shifted_key(spark, sf):
    d = feed(spark, sf).groupBy("area", F.col("ts").cast("date").alias("day")).agg(exact_avg("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return joins.shifted(d, ["area"], "day", "7 day", ["v"], "_week_ago").withColumn("change", F.col("v") - F.col("v_week_ago"))


@query("join_key_violations", oracle="select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def join_key_violations(spark, sf):
    return joins.cardinality_violations(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "many_to_one_join",
    oracle="select o_orderkey, o_custkey, c_mktsegment, c_nationkey from orders left join (select c_custkey as o_custkey, c_mktsegment, c_nationkey from customer) using (o_custkey)",
)
def many_to_one(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return joins.many_to_one(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"])


@query(
    "predictions_side_by_side",
    oracle=with_(FEED) + f""", b as (select distinct area, ts::date as day from feed), m1 as (select area, ts::date as day, {xavg('value')} as p from feed where k < 30 group by 1, 2),
      m2 as (select area, ts::date as day, max(value) as p from feed where k >= 95 group by 1, 2), m3 as (select area, ts::date as day, min(value) as p from feed group by 1, 2)
      select area, day, m1.p as p_mean, m2.p as p_high, m3.p as p_low from b left join m1 using (area, day) left join m2 using (area, day) left join m3 using (area, day)""",
)
def side_by_side(spark, sf):
    f = feed(spark, sf).withColumn("day", F.col("ts").cast("date"))
    k = ["area", "day"]
    return joins.side_by_side(
        f.select(*k).distinct(),
        {
            "mean": f.where("k < 30").groupBy(*k).agg(exact_avg("value").alias("p")),
            "high": f.where("k >= 95").groupBy(*k).agg(F.max("value").alias("p")),
            "low": f.groupBy(*k).agg(F.min("value").alias("p")),
        },
        k,
        "p",
    )


@query(
    "unordered_zone_pairs",
    oracle=with_(PANEL) + """
      select a.delivery_date, a.slot, a.zone as zone_i, b.zone as zone_j, a.gap as gap_i, b.gap as gap_j from panel a join panel b
      on a.delivery_date = b.delivery_date and a.slot = b.slot and a.zone < b.zone""",
)
def unordered_pairs(spark, sf):
    return joins.unordered_pairs(panel(spark, sf), ["delivery_date", "slot"], "zone", ["gap"])


@query("scalar_subquery", oracle="select o_orderstatus, count(*) as n from orders where o_orderdate = (select max(o_orderdate) from orders) group by 1")
def scalar_subquery(spark, sf):
    load(spark, sf, "orders").createOrReplaceTempView("_orders_sq")
    return spark.sql("select o_orderstatus, count(*) as n from _orders_sq where o_orderdate = (select max(o_orderdate) from _orders_sq) group by 1")


# ---------------------------------------------------------------- set operations

@query(
    "union_all_of_feeds",
    oracle="""select series, count(*) as n, max(t) as newest from (select o_orderpriority as series, o_orderdate as t from orders
      union all select l_returnflag, l_shipdate from lineitem) group by 1""",
)
def union_all(spark, sf):
    a = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("t"))
    b = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series"), F.col("l_shipdate").alias("t"))
    return a.unionByName(b).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("newest"))


@query("distinct_key_union", oracle="select o_orderdate::date as d from orders union select l_shipdate::date from lineitem")
def key_union(spark, sf):
    a = load(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    b = load(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    return setops.key_union(["d"], a, b)


@query(
    "expected_minus_present",
    oracle="""with o as (select o_orderdate::date as d from orders where o_totalprice > 400000)
      select unnest(generate_series(min(d), max(d), interval 1 day))::date as d from o except select d from o""",
)
def expected_minus_present(spark, sf):
    present = load(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_orderdate").cast("date").alias("d"))
    expected = present.agg(F.explode(F.sequence(F.min("d"), F.max("d"), F.expr("interval 1 day"))).alias("d"))
    return setops.missing_keys(expected, present, ["d"])


@query("shared_days", oracle="select o_orderdate::date as d from orders where o_totalprice > 450000 intersect select l_shipdate::date from lineitem where l_quantity > 49")
def shared_days(spark, sf):
    a = load(spark, sf, "orders").where("o_totalprice > 450000").select(F.col("o_orderdate").cast("date").alias("d"))
    b = load(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_shipdate").cast("date").alias("d"))
    return setops.shared_keys(a, b, ["d"])


@query(
    "table_equality",
    oracle="""with a as (select * from orders), b as (select o_orderkey, o_custkey, case when o_totalprice > 499000 then 'X' else o_orderstatus end as o_orderstatus,
        o_totalprice, o_orderdate, o_orderpriority from orders)
      select (select count(*) from a) as rows_left, (select count(*) from b) as rows_right,
        (select count(*) from ((select * from a except all select * from b) union all (select * from b except all select * from a))) as different_hashes,
        (select count(*) from (select * from a except all select * from b)) = 0 as equal""",
)
def table_equality(spark, sf):
    o = load(spark, sf, "orders")
    changed = o.withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 499000, "X").otherwise(F.col("o_orderstatus")))
    return setops.table_summary(o, changed)
