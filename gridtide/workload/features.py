"""Features (M8-M25) on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_avg, exact_sum
from gridtide.plans import features, knowledge
from gridtide.workload.bindings import FEED, PANEL, ZONE, feed, load, panel, with_, xavg, xavg_over, xmean, xsum, xunits
from gridtide.workload.joining import _INTERVALS, intervals
from gridtide.workload.knowledge import VINTAGES, vintages
from gridtide.workload.registry import query


def _over(n: int, lo: int = 1) -> str:
    return f"partition by zone, slot order by delivery_date range between interval {n} day preceding and interval {lo} day preceding"


@query(
    "zone_slot_features",
    oracle=with_(PANEL) + f"""
      select delivery_date, zone, slot, max(y_da) over w1 as price_dm1, {xavg_over('y_da', _over(7))} as price_7d, max(gap) over w1 as gap_dm1,
        {xavg_over('gap', _over(7))} as gap_7d, {xavg_over('gap', _over(28))} as gap_28d, avg(case when gap > 1 then 1.0e0 else 0.0e0 end) over w28 as spike_28d,
        avg(case when gap < -1 then 1.0e0 else 0.0e0 end) over w28 as negspike_28d, {xavg_over('gap', _over(365))} as gap_365d, count(gap) over w365 as n_365d
      from panel window w1 as ({_over(1)}), w28 as ({_over(28)}), w365 as ({_over(365)})""",
)
def zone_slot(spark, sf):
    return features.zone_slot_features(panel(spark, sf), "zone", "slot", "delivery_date", "y_da", "gap", 1.0)


def _zmean(n: int) -> str:
    o = f"partition by zone order by delivery_date range between interval {n} day preceding and interval 1 day preceding"
    return xmean(f"sum(s) over ({o})", f"sum(n) over ({o})")


@query(
    "zone_day_features",
    oracle=with_(PANEL) + f""", d as (select zone, delivery_date, sum({xunits('gap')}) as s, count(gap) as n, {xavg('case when slot <= 2 then gap end')} as gap_early,
        {xavg('y_da')} as price_mean, max(y_da) as price_max, arg_max(gap, slot) as gap_last from panel group by 1, 2)
      select zone, delivery_date, {_zmean(1)} as gap_dm1_mean, {_zmean(7)} as gap_7d_all, {_zmean(28)} as gap_28d_all, gap_early, price_mean, price_max,
        lag(gap_last) over w as last_gap_before, (delivery_date - lag(delivery_date) over w)::int as days_since_last from d window w as (partition by zone order by delivery_date)""",
)
def zone_day(spark, sf):
    return features.zone_day_features(panel(spark, sf), "zone", "slot", "delivery_date", "y_da", "gap", 2)


@query(
    "forecast_features",
    oracle=with_(VINTAGES) + f""", nv as (select area, target, hour(ts)::int as h, value, published_at, event_id from vintages where published_at <= decision
        qualify row_number() over (partition by area, target, hour(ts) order by published_at desc, event_id desc) = 1),
      t as (select target, h, {xsum('value')} as system_total from nv group by 1, 2)
      select area, target, h, value, max(value) over (partition by area, target) as peak, value / max(value) over (partition by area, target) as relative,
        value - max(value) over (partition by area, h order by target range between interval 1 day preceding and interval 1 day preceding) as day_change, system_total from nv join t using (target, h)""",
)
def forecast_features(spark, sf):
    v = vintages(spark, sf).withColumn("h", F.hour("ts"))
    n = knowledge.newest_vintage(v, ["area", "target", "h"], "published_at", "decision", ["event_id"])
    return features.forecast_features(n.select("area", "target", "h", "value"), "area", "target", "h", "value")


@query(
    "point_distribution",
    oracle=f"""with p as (select l_suppkey, date_trunc('month', l_shipdate)::date as month, {xavg('l_extendedprice')} as v from lineitem group by 1, 2)
      select month, round(quantile_cont(v, 0.05), 7) as p05, round(quantile_cont(v, 0.5), 7) as p50, round(quantile_cont(v, 0.95), 7) as p95, count(*) as n, round(stddev_samp(v), 4) as std from p group by 1""",
)
def point_distribution(spark, sf):
    p = load(spark, sf, "lineitem").groupBy("l_suppkey", tc.month_start("l_shipdate").alias("month")).agg(exact_avg("l_extendedprice").alias("v"))
    d = features.point_distribution(p, ["month"], "v")
    return d.select("month", *[F.round(c, 7).alias(c) for c in ("p05", "p50", "p95")], "n", F.round("std", 4).alias("std"))


@query(
    "border_features",
    oracle=with_(PANEL) + f""", b as (select delivery_date, slot, zone, y_da, {xavg_over('gap', _over(7))} as g7 from panel where zone in ('ASIA', 'MIDDLE EAST')),
      w as (select delivery_date, slot, max(y_da) filter (where zone = 'ASIA') as price_asia, max(g7) filter (where zone = 'ASIA') as gap7_asia,
        max(y_da) filter (where zone = 'MIDDLE EAST') as price_middle_east, max(g7) filter (where zone = 'MIDDLE EAST') as gap7_middle_east from b group by 1, 2)
      select p.delivery_date, p.zone, p.slot, p.gap, w.price_asia, w.gap7_asia, w.price_middle_east, w.gap7_middle_east, p.y_da - w.price_asia as spread_asia, p.y_da - w.price_middle_east as spread_middle_east
      from panel p left join w using (delivery_date, slot) where p.zone not in ('ASIA', 'MIDDLE EAST')""",
)
def border(spark, sf):
    x = features.border_features(panel(spark, sf), "zone", "slot", "delivery_date", "gap", "y_da", ["ASIA", "MIDDLE EAST"])
    return x.drop("y_da", "n_trades", "label_published_at")


@query(
    "specialist_features",
    oracle=with_(PANEL) + f"""
      select delivery_date, zone, slot, avg(case when gap > 2 then 1.0e0 else 0.0e0 end) over w as up_rate, avg(case when gap < -2 then 1.0e0 else 0.0e0 end) over w as down_rate,
        round(quantile_cont(gap, 0.9) over w, 11) as gap_q90_28d, avg(case when abs(gap) > 0.05e0 * y_da then 1.0e0 else 0.0e0 end) over w as wide_share from panel window w as ({_over(28)})""",
)
def specialist(spark, sf):
    x = features.specialist_features(panel(spark, sf), "zone", "slot", "delivery_date", "gap", "y_da", 2.0)
    return x.withColumn("gap_q90_28d", F.round("gap_q90_28d", 11))


_WX = FEED + f""", wx as (select area as point, date_trunc('hour', ts) as t, max(k) * 0.5e0 - 5.0e0 as c from feed group by 1, 2),
  wl as (select point, cast((t at time zone 'UTC') at time zone '{ZONE}' as date) as day, c * 9.0e0 / 5.0e0 + 32.0e0 as f from wx),
  wd as (select point, day, max(f) as tmax_f, min(f) as tmin_f, {xavg('f')} as tmean_f, 24.0e0 * {xavg('greatest(65.0e0 - f, 0.0e0)')} as hdh, 24.0e0 * {xavg('greatest(f - 65.0e0, 0.0e0)')} as cdh, count(*) as n_hours from wl group by 1, 2),
  weather as (select point, day, n_hours, case when n_hours >= 20 then tmax_f end as tmax_f, case when n_hours >= 20 then tmin_f end as tmin_f, case when n_hours >= 20 then tmean_f end as tmean_f,
    case when n_hours >= 20 then hdh end as hdh, case when n_hours >= 20 then cdh end as cdh from wd)"""


def weather(spark, sf):
    wx = feed(spark, sf).groupBy(F.col("area").alias("point"), tc.hour_floor("ts").alias("t")).agg((F.max("k") * 0.5 - 5.0).alias("c"))
    return features.weather_features(wx, "point", "t", "c", ZONE)


@query(
    "weather_features",
    oracle=with_(_WX) + " select a.*, a.tmean_f - b.tmean_f as tmean_week_change from weather a left join weather b on a.point = b.point and b.day = a.day - 7",
)
def weather_features(spark, sf):
    return weather(spark, sf)


@query(
    "operator_and_weather_contrast",
    oracle=with_(_WX) + f""", ld as (select area as point, ts::date as day, {xsum('value')} as load from feed group by 1, 2)
      select w.point, w.day, (w.tmean_f - w7.tmean_f) - 100.0e0 * (l.load - l7.load) / l7.load as contrast from weather w join ld l using (point, day)
      left join weather w7 on w7.point = w.point and w7.day = w.day - 7 left join ld l7 on l7.point = w.point and l7.day = w.day - 7""",
)
def contrast(spark, sf):
    ld = feed(spark, sf).groupBy(F.col("area").alias("point"), F.col("ts").cast("date").alias("day")).agg(exact_sum("value").alias("load"))
    return features.contrast(weather(spark, sf), ld, ["point"], "day", "tmean_f", "load")


# All days from the first start to the last start or end.
_ALL_DAYS = "d as (select unnest(generate_series(min(s), greatest(max(s), max(e)), interval 1 day))::date as day from i)"


@query(
    "outage_features",
    oracle=f"""with {_INTERVALS}, {_ALL_DAYS},
      st as (select s as day, count(*) as n, count(*) filter (where o_orderpriority = '1-URGENT') as u, count(*) filter (where o_orderpriority = '5-LOW') as l from i group by 1),
      en as (select e as day, count(*) as n, count(*) filter (where o_orderpriority = '1-URGENT') as u, count(*) filter (where o_orderpriority = '5-LOW') as l from i where e is not null group by 1)
      select day, (sum(coalesce(st.n, 0)) over w - sum(coalesce(en.n, 0)) over w)::bigint as n_active, (sum(coalesce(st.u, 0)) over w - sum(coalesce(en.u, 0)) over w)::bigint as "n_1-URGENT",
        (sum(coalesce(st.l, 0)) over w - sum(coalesce(en.l, 0)) over w)::bigint as "n_5-LOW", coalesce(st.n, 0) as n_started, coalesce(e2.n, 0) as n_ending_next_day
      from d left join st using (day) left join en using (day) left join en e2 on e2.day = d.day + 1 window w as (order by d.day rows unbounded preceding)""",
)
def outage_features(spark, sf):
    return features.outage_features(intervals(spark, sf), "s", "e", "o_orderpriority", ["1-URGENT", "5-LOW"])


@query(
    "site_indicators",
    oracle=f"""with i as (select o_orderdate::date as s, o_orderdate::date + (1 + o_custkey % 3)::int as e, o_orderstatus || '_' || left(o_orderpriority, 1) as site from orders),
      {_ALL_DAYS},
      a as (select distinct site, day from d join i on s <= day and e > day)
      select d.day, (exists (select 1 from a where a.site = 'F_1' and a.day = d.day))::int as "out_F_1", (exists (select 1 from a where a.site = 'P_5' and a.day = d.day))::int as "out_P_5" from d""",
)
def site_indicators(spark, sf):
    o = load(spark, sf, "orders")
    s = F.col("o_orderdate").cast("date")
    i = o.select(
        s.alias("s"), F.date_add(s, (F.col("o_custkey") % 3 + 1).cast("int")).alias("e"),
        F.concat("o_orderstatus", F.lit("_"), F.substring("o_orderpriority", 1, 1)).alias("site"),
    )
    return features.site_indicators(i, "s", "e", "site", ["F_1", "P_5"])


@query(
    "regime_flags",
    oracle="""with d as (select distinct o_orderdate::date as day from orders), c as (select o_orderpriority as kind, min(o_orderdate::date) as eff from orders where o_totalprice > 499000 group by 1)
      select day, coalesce(day > (select eff from c where kind = '1-URGENT'), false)::int as "regime_1-URGENT", coalesce(day > (select eff from c where kind = '2-HIGH'), false)::int as "regime_2-HIGH" from d""",
)
def regime_flags(spark, sf):
    o = load(spark, sf, "orders")
    days = o.select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    changes = o.where("o_totalprice > 499000").select(F.col("o_orderdate").cast("date").alias("eff"), F.col("o_orderpriority").alias("kind"))
    return features.regime_flags(days, "day", changes, "eff", "kind", ["1-URGENT", "2-HIGH"])


@query(
    "wide_day_matrix",
    oracle=with_(PANEL) + """
      select delivery_date, count(*) as n_features, min(zone || '__s' || slot) as first_feature, max(zone || '__s' || slot) as last_feature, arg_min(gap, zone || '__s' || slot) as first_value from panel group by 1""",
)
def wide_day_matrix(spark, sf):
    name = F.concat("zone", F.lit("__s"), F.col("slot").cast("string"))
    m = features.day_matrix(panel(spark, sf), "delivery_date", name, "gap")
    keys = F.map_keys("features")
    return m.select(
        "delivery_date", F.size("features").cast("bigint").alias("n_features"), F.array_min(keys).alias("first_feature"),
        F.array_max(keys).alias("last_feature"), F.element_at("features", F.array_min(keys)).alias("first_value"),
    )


@query(
    "labels_per_zone_day",
    oracle=with_(PANEL) + f" select zone, delivery_date, {xsum('gap')} as label_gap, max(label_published_at) as label_published_at, count(gap) as label_rows from panel group by 1, 2",
)
def labels(spark, sf):
    return features.labels(panel(spark, sf), "zone", "delivery_date", "gap", "label_published_at")


@query(
    "standardised_features",
    oracle=with_(PANEL) + """, m as (select avg(gap) as mg, stddev_pop(gap) as sg, avg(y_da) as mp, stddev_pop(y_da) as sp from panel where delivery_date < date '1999-01-01')
      select delivery_date, zone, slot, round(greatest(least((gap - mg) / sg, 8.0e0), -8.0e0), 7) as gap, round(greatest(least((y_da - mp) / sp, 8.0e0), -8.0e0), 7) as y_da from panel, m""",
)
def standardised(spark, sf):
    p = panel(spark, sf).select("delivery_date", "zone", "slot", "gap", "y_da")
    s = features.standardise(p, F.col("delivery_date") < F.lit("1999-01-01").cast("date"), ["gap", "y_da"])
    return s.withColumn("gap", F.round("gap", 7)).withColumn("y_da", F.round("y_da", 7))


@query(
    "recency_weights",
    oracle="""with d as (select distinct o_orderdate::date as day from orders), w as (select day, pow(0.5e0, (date '2001-12-31' - day) / 365.0e0) as w from d)
      select day, round(w / (select avg(w) from w), 8) as weight from w""",
)
def recency(spark, sf):
    d = load(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    x = features.normalised_recency(d, "day", F.lit("2001-12-31").cast("date"), 365.0, "weight")
    return x.withColumn("weight", F.round("weight", 8))


@query(
    "storm_score",
    oracle=with_(PANEL) + f""", dd as (select zone, delivery_date, max(y_da) as peak, -min(y_da) as cold, {xavg('case when slot <= 3 then gap end')} as early from panel group by 1, 2),
      j as (select a.zone, a.delivery_date, any_value(a.early) as early, count(b.delivery_date) as n, count(b.early) as ne, count(*) filter (where b.peak < a.peak) as lp, count(*) filter (where b.cold < a.cold) as lc, count(*) filter (where b.early < a.early) as le
        from dd a left join dd b on a.zone = b.zone and b.delivery_date >= a.delivery_date - 365 and b.delivery_date <= a.delivery_date - 1 group by 1, 2)
      select zone, delivery_date, greatest(case when n >= 60 then lp::double / n::double end, case when n >= 60 then lc::double / n::double end, case when ne >= 60 and early is not null then le::double / ne::double end) as score from j""",
)
def storm_score(spark, sf):
    d = panel(spark, sf).groupBy("zone", "delivery_date").agg(
        F.max("y_da").alias("peak"), F.min("y_da").alias("low"), exact_avg(F.when(F.col("slot") <= 3, F.col("gap"))).alias("early")
    )
    return features.storm_score(d, ["zone"], "delivery_date", ["peak", "early"], ["low"]).select("zone", "delivery_date", "score")


@query(
    "forecast_surprise",
    oracle=with_(VINTAGES) + f""", r as (select *, row_number() over (partition by area, user_id, target order by published_at desc, event_id desc) as rn from vintages where published_at <= decision),
      p as (select area, user_id, target, max(abs(value - 18.3e0)) filter (where rn = 1) as a, max(abs(value - 18.3e0)) filter (where rn = 2) as b from r where rn <= 2 group by 1, 2, 3),
      s as (select target, {xavg('a - b')} as s, count(*) as pairs from p where b is not null group by 1),
      d as (select target, case when pairs >= 10 then s end as surprise, pairs from s)
      select x.target, x.surprise, x.pairs, case when x.surprise is not null and count(y.surprise) >= 5 then count(*) filter (where y.surprise < x.surprise)::double / count(y.surprise)::double end as rank
      from d x left join d y on y.target >= x.target - 365 and y.target <= x.target - 1 group by 1, 2, 3""",
)
def forecast_surprise(spark, sf):
    return features.forecast_surprise(
        vintages(spark, sf), ["area", "user_id"], "target", "published_at", "decision", "value", 18.3, 10, ["event_id"], 365, 5
    )


@query(
    "historical_event_rate",
    oracle=with_(PANEL) + """, y as (select distinct zone, slot, year(delivery_date)::int as year from panel)
      select y.zone, y.slot, y.year, count(*) filter (where p.gap >= 2) as hits, count(p.gap) as days, case when count(p.gap) > 0 then count(*) filter (where p.gap >= 2)::double / count(p.gap)::double end as rate
      from y left join panel p on p.zone = y.zone and p.slot = y.slot and p.delivery_date <= make_date(y.year - 1, 12, 30) group by 1, 2, 3""",
)
def event_rate(spark, sf):
    return features.historical_event_rate(panel(spark, sf), ["zone", "slot"], "delivery_date", "gap", 2.0)


@query(
    "lookahead_perturbation",
    oracle=with_(VINTAGES) + """, v as (select *, published_at is null or published_at > decision as late from vintages),
      f as (select count(distinct (area, target)) as n from v where late)
      select 'filtered' as build, 0::bigint as different_groups union all select 'opened', n from f""",
)
def perturbation(spark, sf):
    # the filtered build must not move; the same build without its filter must move in every group that has a late row

    v = vintages(spark, sf)

    def build(filtered):
        def run(df):
            x = df.where(knowledge.public_by("published_at", "decision")) if filtered else df
            return x.groupBy("area", "target").agg(exact_sum("value").alias("s"), F.count(F.lit(1)).alias("n"))

        return run

    parts = []
    for name, filtered in (("filtered", True), ("opened", False)):
        d = features.perturbation_differences(
            build(filtered), v, "published_at", F.col("decision"), {"value": F.lit(1e6) + F.col("event_id") / 8.0}
        )
        parts.append(d.agg(F.sum(F.when(F.col("n_left") > 0, F.col("n_left")).otherwise(0)).alias("g")).select(
            F.lit(name).alias("build"), F.coalesce("g", F.lit(0)).cast("bigint").alias("different_groups")
        ))
    return parts[0].unionByName(parts[1])
