"""Data-quality checks (K1-K27): the failing rows of each check on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.operators import grid, quality
from gridtide.workload.bindings import (
    PANEL, SEAM, ZONE, Warehouse, feed, FEED, load, panel, warehouse_sql, with_, xavg, xsum,
)
from gridtide.workload.registry import query


@query(
    "check_not_null",
    oracle=warehouse_sql("""select area, hour_utc, case when v_day_ahead is null then 'v_day_ahead' when v_realtime is null then 'v_realtime'
      when v_settled is null then 'v_settled' end as null_column from wind_versions
      where v_day_ahead is null or v_realtime is null or v_settled is null"""),
)
def check_not_null(spark, sf):
    return quality.not_null(Warehouse(spark, sf).wind_versions, ["v_day_ahead", "v_realtime", "v_settled"], ["area", "hour_utc"])


@query(
    "check_accepted_values",
    oracle="""select o_orderpriority as value, count(*) as rows from orders
      where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM') group by 1""",
)
def check_accepted_values(spark, sf):
    return quality.accepted_values(load(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query(
    "check_unique_key",
    oracle="select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
)
def check_unique_key(spark, sf):
    return quality.unique_key(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "check_no_gaps",
    oracle=warehouse_sql("""select e.area, e.hour_utc from (
      select area, unnest(generate_series(min(hour_utc), max(hour_utc), interval 1 hour)) as hour_utc from power_hourly group by 1) e
      left join power_hourly p using (area, hour_utc) where p.hour_utc is null"""),
)
def check_no_gaps(spark, sf):
    return quality.no_gaps(Warehouse(spark, sf).power_hourly, ["area"], "hour_utc")


@query(
    "check_no_gaps_by_lead",
    oracle=warehouse_sql("""select * from (select area, hour_utc, lead(hour_utc) over (partition by area order by hour_utc) as next_ts
      from power_hourly) where next_ts - hour_utc <> interval 1 hour"""),
)
def check_no_gaps_by_lead(spark, sf):
    from gridtide.operators.episodes import gaps_by_lead

    return gaps_by_lead(Warehouse(spark, sf).power_hourly, ["area"], "hour_utc")


@query(
    "check_interior_days_complete",
    oracle=warehouse_sql("""select d.area, d.day_dk, d.hours from desk_daily d join (
      select area, min(day_dk) as lo, max(day_dk) as hi from desk_daily group by 1) b using (area)
      where d.day_dk > b.lo and d.day_dk < b.hi and not d.is_complete"""),
)
def check_interior_days_complete(spark, sf):
    d = Warehouse(spark, sf).desk_daily
    return quality.interior_days_complete(d, ["area"], "day_dk", "is_complete").select("area", "day_dk", "hours")


@query(
    "check_quarters_come_in_fours",
    oracle=warehouse_sql("select area, hour_utc, n_intervals from power_hourly where source = 'DayAheadPrices' and n_intervals <> 4"),
)
def check_quarters(spark, sf):
    h = Warehouse(spark, sf).power_hourly
    return quality.intervals_per_hour(h, "source", "DayAheadPrices", "n_intervals", 4).select("area", "hour_utc", "n_intervals")


@query(
    "check_seam_is_continuous",
    oracle=warehouse_sql(f"""select o.area, o.t as last_old, n.t as first_new from
      (select area, max(interval_start_utc) as t from stg_elspot where interval_start_utc < timestamp '{SEAM}' group by 1) o join
      (select area, min(interval_start_utc) as t from stg_dayahead where interval_start_utc >= timestamp '{SEAM}' group by 1) n using (area)
      where n.t - o.t <> interval 1 hour"""),
)
def check_seam(spark, sf):
    w = Warehouse(spark, sf)
    ts = F.col("interval_start_utc")
    return quality.seam_continuous(
        w.stg_elspot.where(ts < tc.ntz(SEAM)), w.stg_dayahead.where(ts >= tc.ntz(SEAM)), ["area"], "interval_start_utc"
    )


@query(
    "check_business_days_only",
    oracle=warehouse_sql("select rate_date, currency from stg_fx where dayofweek(rate_date) in (0, 6)"),
)
def check_business_days(spark, sf):
    return quality.business_days_only(Warehouse(spark, sf).stg_fx, "rate_date").select("rate_date", "currency")


@query(
    "check_row_provenance",
    oracle=warehouse_sql("select area, hour_utc from stg_forecasts where published_utc is null and fc_day_ahead_mwh is not null"),
)
def check_provenance(spark, sf):
    f = Warehouse(spark, sf).stg_forecasts
    return f.where(F.col("published_utc").isNull() & F.col("fc_day_ahead_mwh").isNotNull()).select("area", "hour_utc")


@query(
    "check_plausible_range",
    oracle=warehouse_sql("select area, hour_utc, wind_share from power_context where wind_share < 0 or wind_share > 3"),
)
def check_range(spark, sf):
    return quality.outside_range(Warehouse(spark, sf).power_context, "wind_share", 0, 3).select("area", "hour_utc", "wind_share")


@query(
    "check_fitted_tolerance",
    oracle=warehouse_sql("""
select area, count_if(far) as breaches, count(*) as hours, round(100.0e0 * count_if(far) / count(*), 2) as breach_pct
from (select area, abs(v_realtime - v_settled) > greatest(20.0e0, 24.1e0 / 100.0e0 * v_settled) as far, realtime_readings = 2 and v_realtime is not null as whole
  from wind_versions where v_settled is not null qualify hour_utc >= max(hour_utc) over () - interval 60 day)
where whole group by area having 100.0e0 * count_if(far) / count(*) > 5.0"""),
)
def check_tolerance(spark, sf):
    return quality.breach_rate(
        Warehouse(spark, sf).wind_versions, "area", "hour_utc", "v_realtime", "v_settled", "realtime_readings", 2, 20.0, 24.1, 5.0
    )


@query(
    "check_feed_completeness",
    oracle=warehouse_sql("""
select area, count_if(realtime_readings < 2) as short_hours, count(*) as hours
from (select *, max(hour_utc) filter (v_realtime is not null) over () as newest from wind_versions)
where hour_utc < newest and hour_utc >= newest - interval 30 day group by area having count_if(realtime_readings < 2) > 0.05 * count(*)"""),
)
def check_feed(spark, sf):
    return quality.short_hours(Warehouse(spark, sf).wind_versions, "area", "hour_utc", "v_realtime", "realtime_readings", 2, 0.05)


@query(
    "check_settlement_lag",
    oracle="""with x as (select l_suppkey as area, max(l_shipdate) filter (where l_linestatus = 'F') as settled_hi,
        max(l_shipdate) filter (where l_linestatus = 'O') as realtime_hi from lineitem group by 1)
      select *, date_diff('day', settled_hi, realtime_hi) as lag_days from x where date_diff('day', settled_hi, realtime_hi) > 16""",
)
def check_lag(spark, sf):
    li = load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("area"), F.col("l_shipdate").alias("hour_utc"),
        F.when(F.col("l_linestatus") == "F", 1.0).alias("s"), F.when(F.col("l_linestatus") == "O", 1.0).alias("r"),
    )
    return quality.settlement_lag(li, "area", "hour_utc", "r", "s", 16).withColumn("lag_days", F.col("lag_days").cast("bigint"))


@query(
    "check_bias_band",
    oracle=warehouse_sql(f"""
select area, hours, round(percent, 2) as bias_pct from (
  select area, count(*) as hours, 100.0e0 * {xsum('v_realtime - v_settled')} / {xsum('v_settled')} as percent
  from (from wind_versions where v_settled is not null qualify hour_utc >= max(hour_utc) over () - interval 30 day)
  where realtime_readings = 2 and v_realtime is not null group by area)
where percent not between -5.0 and 5.0"""),
)
def check_bias(spark, sf):
    return quality.bias_band(Warehouse(spark, sf).wind_versions, "area", "hour_utc", "v_realtime", "v_settled", "realtime_readings", 2, 5.0)


# bitemporal rows: published some hours after the event, sometimes never, against the deadline of the next day
def stamped(spark, sf):
    f = feed(spark, sf)
    return f.withColumn("published_at", F.when(F.col("k") != 13, F.col("ts") + tc.hours(F.col("k")))).withColumn(
        "decision", tc.decision_time(F.date_add(F.col("ts").cast("date"), 1), ZONE)
    )


STAMPED = FEED + f""", stamped as (
  select *, case when k <> 13 then ts + k * interval 1 hour end as published_at,
    ((cast(cast(ts as date) + 1 as timestamp) + interval 5 hour) at time zone '{ZONE}') at time zone 'UTC' as decision from feed)"""


@query(
    "check_no_lookahead",
    oracle=with_(STAMPED) + """
      select 'small' as source, count(*) as rows_too_late from stamped where k < 50 and (published_at is null or published_at > decision) having count(*) > 0
      union all select 'large', count(*) from stamped where k >= 50 and (published_at is null or published_at > decision) having count(*) > 0""",
)
def check_no_lookahead(spark, sf):
    s = stamped(spark, sf)
    return quality.no_lookahead({"small": s.where("k < 50"), "large": s.where("k >= 50")}, "published_at", "decision")


@query(
    "rows_excluded_by_publication",
    oracle=with_(STAMPED) + """
      select area as source, count(*) filter (where published_at <= decision) as kept,
        count(*) - count(*) filter (where published_at <= decision) as excluded from stamped group by 1""",
)
def excluded(spark, sf):
    return quality.excluded_by_publication(stamped(spark, sf), "area", "published_at", "decision")


@query(
    "check_publication_rules",
    oracle=with_(STAMPED) + """
      select * from (
        select 'before_event' as rule, count(*) filter (where published_at < ts) as violations from stamped
        union all select 'missing', count(*) filter (where published_at is null) from stamped
        union all select 'more_than_three_days', count(*) filter (where published_at > ts + interval 72 hour) from stamped)
      where violations > 0""",
)
def check_rules(spark, sf):
    s = stamped(spark, sf)
    return quality.rule_violations(
        s,
        {
            "before_event": F.col("published_at") < F.col("ts"),
            "missing": F.col("published_at").isNull(),
            "more_than_three_days": F.col("published_at") > F.col("ts") + tc.hours(72),
        },
    )


@query(
    "check_identity_across_zones",
    oracle=with_(PANEL) + """
      , g as (select delivery_date, slot, max(y_da) - min(y_da) as r from panel group by 1, 2)
      select count(*) as keys, avg(case when r <= 20.0 then 1.0e0 else 0.0e0 end) as share_equal, max(r) as largest_range from g""",
)
def check_identity(spark, sf):
    return quality.identity_share(panel(spark, sf), ["delivery_date", "slot"], "y_da", 20.0)


@query(
    "check_component_identity",
    oracle="""with c as (select l_extendedprice as total, l_extendedprice*(1-l_discount) as energy, l_extendedprice*l_discount as congestion,
        case when l_tax > 0.07 then 1.0e0 else 0.0e0 end as loss from lineitem),
      g as (select count(*) as rows, count(*) filter (where abs(total - (energy + congestion + loss)) > 0.05) as bad_rows from c where total is not null)
      select * from g where bad_rows > 0.001 * rows""",
)
def check_components(spark, sf):
    p = F.col("l_extendedprice")
    li = load(spark, sf, "lineitem").select(
        p.alias("total"), (p * (1 - F.col("l_discount"))).alias("energy"), (p * F.col("l_discount")).alias("congestion"),
        F.when(F.col("l_tax") > 0.07, 1.0).otherwise(0.0).alias("loss"),
    )
    return quality.component_identity(li, "total", ["energy", "congestion", "loss"], 0.05, 0.001)


@query(
    "coverage_inventory",
    oracle=with_(PANEL) + """
      , z as (select r_name as zone from region), s as (select distinct slot from panel),
      d as (select unnest(generate_series(min(delivery_date), max(delivery_date), interval 1 day))::date as delivery_date from panel)
      select z.zone, year(d.delivery_date) as year, count(*) as expected, count(p.zone) as present, count(*) - count(p.zone) as missing
      from z cross join s cross join d left join panel p on p.zone = z.zone and p.slot = s.slot and p.delivery_date = d.delivery_date
      group by 1, 2""",
)
def coverage_inventory(spark, sf):
    p = panel(spark, sf)
    # every zone with every slot that occurs: both lists are dimensions (zones x slots of a day)
    slots = load(spark, sf, "region").select(F.col("r_name").alias("zone")).join(F.broadcast(p.agg(F.collect_set("slot").alias("s")))).select("zone", F.explode("s").alias("slot"))
    span = grid.bounds(p, [], "delivery_date")  # one row
    expected = grid.series_between(slots.join(F.broadcast(span)), "lo", "hi", "1 day", "delivery_date").withColumn("year", F.year("delivery_date"))
    return quality.coverage_inventory(expected, p, ["delivery_date", "zone", "slot"], ["zone", "year"])


@query(
    "write_time_profile",
    oracle=with_(FEED) + """
      , q as (select area, cast(strftime(ts, '%H%M') as int) as hhmm from feed)
      select area, count(distinct hhmm) as clock_times, quantile_cont(hhmm, 0.0) as q0, quantile_cont(hhmm, 0.5) as q50,
        quantile_cont(hhmm, 0.99) as q99 from q group by 1""",
)
def write_time_profile(spark, sf):
    # minutes of a day: 1440 distinct values per area at most, so the exact aggregate stays small
    q = feed(spark, sf).select("area", (F.hour("ts") * 100 + F.minute("ts")).alias("hhmm"))
    p = lambda x: F.call_function("percentile", F.col("hhmm"), F.lit(x))
    return q.groupBy("area").agg(F.countDistinct("hhmm").alias("clock_times"), p(0.0).alias("q0"), p(0.5).alias("q50"), p(0.99).alias("q99"))


@query(
    "check_fill_threshold",
    oracle=warehouse_sql("""
      select * from (
        select 'forecast' as block, (sum((v_day_ahead is not null)::int + (v_intraday is not null)::int + (v_5h is not null)::int + (v_1h is not null)::int))::double / (count(*) * 4)::double as fill from wind_versions
        union all select 'measured', (sum((v_realtime is not null)::int + (v_settled is not null)::int))::double / (count(*) * 2)::double from wind_versions)
      where fill < 0.99"""),
)
def check_fill(spark, sf):
    return quality.fill_below(
        Warehouse(spark, sf).wind_versions,
        {"forecast": ["v_day_ahead", "v_intraday", "v_5h", "v_1h"], "measured": ["v_realtime", "v_settled"]},
        0.99,
    )


@query(
    "check_rebuilt_against_official",
    oracle=with_(FEED) + f"""
      , r as (select area, date_trunc('hour', ts) as h, {xavg('value')} as x from feed group by 1, 2),
      o as (select area, date_trunc('hour', ts) as h, max(value) as x from feed where k < 80 group by 1, 2)
      select area, h, r.x as rebuilt_x, o.x as official_x, coalesce(abs(r.x - o.x), 0) as max_abs_diff,
        case when r.x is null then 'official only' when o.x is null then 'rebuilt only' else 'both' end as side
      from r full join o using (area, h) where r.x is null or o.x is null or abs(r.x - o.x) > 5.0""",
)
def check_rebuilt(spark, sf):
    from gridtide.functions.exact import exact_avg

    f = feed(spark, sf).withColumn("h", tc.hour_floor("ts"))
    return quality.rebuilt_matches(
        f.groupBy("area", "h").agg(exact_avg("value").alias("x")), f.where("k < 80").groupBy("area", "h").agg(F.max("value").alias("x")),
        ["area", "h"], ["x"], 5.0,
    )


@query(
    "check_choice_guard",
    oracle=with_(PANEL) + """
      , c as (select zone, date_trunc('quarter', delivery_date)::date + interval 3 month as period, max(delivery_date) as last_used,
          max(label_published_at) as published from panel group by 1, 2)
      select zone, period::date as period, last_used, published, (period - interval 2 day)::date as cutoff,
        period - interval 1 day + interval 5 hour as known_by from c
      where last_used > (period - interval 2 day)::date or published > period - interval 1 day + interval 5 hour""",
)
def check_choice_guard(spark, sf):
    period = F.add_months(tc.quarter_start("delivery_date"), 3)
    c = (
        panel(spark, sf).groupBy("zone", period.alias("period"))
        .agg(F.max("delivery_date").alias("last_used"), F.max("label_published_at").alias("published"))
        .withColumn("cutoff", F.date_sub("period", 2))
        .withColumn("known_by", tc.midnight(F.date_sub("period", 1)) + tc.hours(5))
    )
    return quality.choice_guard(c, "last_used", "published", "cutoff", "known_by")


@query(
    "fault_matrix",
    oracle=warehouse_sql(f"""
, base as (select area, hour_utc, price_eur from power_hourly),
faults as (
  select 'none' as fault, * from base
  union all select 'lost midday hours', * from base where not (hour(hour_utc) = 12)
  union all select 'doubled purchase rows', * from base union all select 'doubled purchase rows', * from base where area = 'purchase'
  union all select 'blanked prices', area, hour_utc, case when price_eur < 30 then null else price_eur end from base),
b as (select fault, area, unnest(generate_series(min(hour_utc), max(hour_utc), interval 1 hour)) as hour_utc from faults group by 1, 2),
f as (select unnest(['none', 'lost midday hours', 'doubled purchase rows', 'blanked prices']) as fault),
gaps as (select b.fault, count(*) as n from b anti join faults using (fault, area, hour_utc) group by 1),
dups as (select fault, count(*) as n from (select fault from faults group by fault, area, hour_utc having count(*) > 1) group by 1),
nulls as (select fault, count(*) as n from faults where price_eur is null group by 1)
select f.fault, 'no gaps' as "check", coalesce(n, 0) as failing_rows from f left join gaps using (fault)
union all select f.fault, 'unique', coalesce(n, 0) from f left join dups using (fault)
union all select f.fault, 'not null', coalesce(n, 0) from f left join nulls using (fault)"""),
)
def fault_matrix(spark, sf):
    h = Warehouse(spark, sf).power_hourly.select("area", "hour_utc", "price_eur")
    return quality.fault_matrix(
        {"power_hourly": h},
        {
            "none": lambda t: {},
            "lost midday hours": lambda t: {"power_hourly": t["power_hourly"].where(F.hour("hour_utc") != 12)},
            "doubled purchase rows": lambda t: {
                "power_hourly": t["power_hourly"].unionByName(t["power_hourly"].where(F.col("area") == "purchase"))
            },
            "blanked prices": lambda t: {
                "power_hourly": t["power_hourly"].withColumn("price_eur", F.when(F.col("price_eur") >= 30, F.col("price_eur")))
            },
        },
        {
            "no gaps": lambda t: quality.no_gaps(t["power_hourly"], ["area"], "hour_utc"),
            "unique": lambda t: quality.unique_key(t["power_hourly"], ["area", "hour_utc"]),
            "not null": lambda t: quality.not_null(t["power_hourly"], ["price_eur"], ["area"]),
        },
    )


@query(
    "input_rebuild_agreement",
    oracle=with_(STAMPED) + f"""
      , a as (select area, cast(ts as date) as d, {xsum('value')} as s, count(*) as n from stamped where published_at <= decision group by 1, 2),
      b as (select area, cast(ts as date) as d, {xsum('value')} as s, count(*) as n from stamped where published_at is not null group by 1, 2),
      j as (select a.s as sa, b.s as sb, a.n as na, b.n as nb, a.area is not null and b.area is not null as both_sides
            from a full join b using (area, d))
      select 's' as measure, count(*) filter (where both_sides and abs(sa - sb) <= 0.5) as equal, count(*) filter (where both_sides and abs(sa - sb) > 0.5) as different,
        count(*) filter (where not both_sides) as one_sided from j
      union all select 'n', count(*) filter (where both_sides and abs(na - nb) <= 0.5), count(*) filter (where both_sides and abs(na - nb) > 0.5), count(*) filter (where not both_sides) from j""",
)
def input_rebuild(spark, sf):
    from gridtide.functions.exact import exact_sum

    s = stamped(spark, sf)

    def build(cond):
        return s.where(cond).groupBy("area", F.col("ts").cast("date").alias("d")).agg(exact_sum("value").alias("s"), F.count(F.lit(1)).alias("n"))

    return quality.agreement_counts(
        build(F.col("published_at") <= F.col("decision")), build(F.col("published_at").isNotNull()), ["area", "d"], ["s", "n"], 0.5
    )
