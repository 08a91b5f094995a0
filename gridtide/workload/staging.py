"""De-duplication, vintages and publication stamping (C1-C13) and grids (D1-D10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_avg
from gridtide.operators import dedup, grid, publication
from gridtide.workload.bindings import FEED, ZONE, Warehouse, feed, load, warehouse_sql, with_, xavg, xmean, xunits
from gridtide.workload.registry import query

NY = "America/New_York"
_REST = "l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc, l_discount desc, l_tax desc, l_returnflag desc, l_linestatus desc"
_ORDER = [c.split()[0] for c in _REST.split(", ")]


@query(
    "latest_fetch_wins",
    oracle=f"select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {_REST}) = 1",
)
def latest_fetch_wins(spark, sf):
    return dedup.latest_wins(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], _ORDER)


@query(
    "duplicates_dropped_per_series",
    oracle="""with k as (select l_returnflag, l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2, 3)
      select l_returnflag, sum(n)::bigint as rows, count(*) as distinct_keys, (sum(n) - count(*))::bigint as dropped, count(*) filter (where n > 1) as repeated_keys from k group by 1""",
)
def duplicates_dropped(spark, sf):
    return dedup.duplicate_report(load(spark, sf, "lineitem"), ["l_returnflag", "l_orderkey", "l_linenumber"], ["l_returnflag"])


@query("exact_duplicates_dropped", oracle="select distinct l_orderkey, l_suppkey, l_shipdate from lineitem")
def exact_duplicates(spark, sf):
    return dedup.exact_duplicates_dropped(load(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey", "l_shipdate"])


@query(
    "newest_two_vintages",
    oracle=f"""select l_orderkey, l_linenumber, l_shipdate, l_quantity, (rn - 1)::int as k_index from (
      select *, row_number() over (partition by l_orderkey, l_linenumber order by {_REST}) as rn from lineitem) where rn <= 2""",
)
def newest_two(spark, sf):
    x = dedup.newest_k(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], _ORDER, 2)
    return x.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "k_index")


@query(
    "newest_issue_block",
    oracle="""select l_orderkey, l_linenumber, l_shipdate, l_quantity from lineitem
      where (l_orderkey, l_shipdate) in (select l_orderkey, max(l_shipdate) from lineitem group by 1)""",
)
def newest_issue_block(spark, sf):
    x = dedup.newest_block(load(spark, sf, "lineitem"), ["l_orderkey"], "l_shipdate")
    return x.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")


# wall clock: order dates at two o'clock windows around every clock change, from the order key
_WALL = f"""w as (select o_orderkey, o_orderdate::date + (o_orderkey % 4) * interval 1 hour as wall, o_orderkey as ord, o_orderpriority from orders),
  f as (select *, (wall at time zone '{NY}') at time zone 'UTC' as std from w)"""


def _wall(spark, sf):
    return load(spark, sf, "orders").select(
        "o_orderkey", (tc.midnight(F.col("o_orderdate").cast("date")) + tc.hours(F.col("o_orderkey") % 4)).alias("wall"), "o_orderpriority"
    )


def _dst_sql(inner: str) -> str:
    """Independent clock rule: US daylight time ran from the first Sunday of April 02:00 to the last Sunday of
    October 02:00 in these years."""
    return f"""with w as (select o_orderkey, o_orderdate::date + (o_orderkey % 4) * interval 1 hour as wall, o_orderpriority from orders),
      r as (select *, make_date(year(wall), 4, 1 + (7 - isodow(make_date(year(wall), 4, 1)))::int % 7) + interval 2 hour as s,
        make_date(year(wall), 10, 31 - isodow(make_date(year(wall), 10, 31))::int % 7) + interval 2 hour as e from w),
      o as (select *, row_number() over (partition by o_orderpriority, wall order by o_orderkey) as occ,
        wall >= s and wall < s + interval 1 hour as missing, wall >= e - interval 1 hour and wall < e as twice,
        wall >= s and wall < e as dst from r) {inner}"""


@query(
    "localize_wall_clock",
    oracle=_dst_sql("""select o_orderkey, wall, missing as missing_wall,
      wall + case when dst and not (twice and occ > 1) then interval 4 hour else interval 5 hour end + case when missing then interval 1 hour else interval 0 hour end as instant_utc from o"""),
)
def localize_wall(spark, sf):
    x = publication.localize_wall(_wall(spark, sf), "wall", ["o_orderpriority"], "o_orderkey", NY)
    return x.select("o_orderkey", "wall", "missing_wall", "instant_utc")


@query(
    "localize_conservative",
    oracle=_dst_sql("""select o_orderkey, wall + case when dst and not twice then interval 4 hour else interval 5 hour end
      + case when missing then interval 1 hour else interval 0 hour end as instant_utc from o"""),
)
def localize_conservative(spark, sf):
    return _wall(spark, sf).select("o_orderkey", publication.localize_conservative(F.col("wall"), NY).alias("instant_utc"))


def _stamps(spark, sf):
    f = feed(spark, sf)
    written = F.when(F.col("k") != 5, F.col("ts") + tc.hours(F.col("k") - 30))
    return f.withColumn("written", written)


_STAMPS = FEED + f""", s as (select *, case when k <> 5 then ts + (k - 30) * interval 1 hour end as written,
  cast((ts at time zone 'UTC') at time zone '{NY}' as date) as ld from feed)"""


def _utc(expr: str) -> str:
    return f"(({expr}) at time zone '{NY}') at time zone 'UTC'"


@query(
    "publication_stamps",
    oracle=with_(_STAMPS) + f"""
      select event_id, case when written is not null then greatest({_utc("(ld - 1)::timestamp + interval 11 hour")}, written) end as da_published_at,
        coalesce(written > {_utc("(ld + 1)::timestamp")}, false) as rt_revised,
        case when written is null then null when written > {_utc("(ld + 1)::timestamp")} then greatest(ts + interval 75 minute, written) else ts + interval 75 minute end as rt_published_at,
        case when written is not null then greatest({_utc("(ld - 1)::timestamp + interval 6 hour")}, written) end as fc_published_at,
        ts - k * interval 1 hour + interval 8 hour as wx_published_at, datediff('day', ts::date, ld) as lead_days from s""",
)
def publication_stamps(spark, sf):
    s = _stamps(spark, sf)
    ts, w = F.col("ts"), F.col("written")
    ld = tc.local_date("ts", NY)
    return s.select(
        "event_id", publication.publish_day_ahead(ts, w, NY).alias("da_published_at"), publication.was_rewritten(ts, w, NY).alias("rt_revised"),
        publication.publish_real_time(ts, w, NY).alias("rt_published_at"), publication.publish_forecast(ld, w, NY).alias("fc_published_at"),
        publication.publish_weather(ts, F.col("k")).alias("wx_published_at"), tc.lead_days(ld, ts.cast("date")).cast("bigint").alias("lead_days"),
    )


@query(
    "first_usable_day",
    oracle=with_(_STAMPS) + f""", l as (select event_id, (written at time zone 'UTC') at time zone '{NY}' as lw from s)
      select event_id, case when lw <= lw::date + interval 5 hour then lw::date else lw::date + 1 end as first_usable from l""",
)
def first_usable_day(spark, sf):
    return _stamps(spark, sf).select("event_id", tc.first_usable_day(F.col("written"), NY).alias("first_usable"))


@query(
    "paired_price_series",
    oracle=f"""with a as (select l_suppkey as ptid, l_shipdate as t, max(l_returnflag) as name, {xavg('l_extendedprice')} as lbmp, {xavg('l_tax')} as loss, {xavg('l_discount')} as congestion_raw
        from lineitem where l_linestatus = 'O' group by 1, 2),
      b as (select l_suppkey as ptid, l_shipdate as t, max(l_returnflag) as name, {xavg('l_extendedprice')} as lbmp, {xavg('l_tax')} as loss, {xavg('l_discount')} as congestion_raw
        from lineitem where l_linestatus = 'F' group by 1, 2)
      select ptid, t, coalesce(a.name, b.name) as name, a.lbmp as da_lbmp, a.loss as da_loss, a.congestion_raw as da_congestion_raw, b.lbmp as rt_lbmp, b.loss as rt_loss,
        b.congestion_raw as rt_congestion_raw, -a.congestion_raw as da_congestion, a.lbmp - a.loss - (-a.congestion_raw) as da_energy,
        -b.congestion_raw as rt_congestion, b.lbmp - b.loss - (-b.congestion_raw) as rt_energy from a full join b using (ptid, t)""",
)
def paired_price_series(spark, sf):
    li = load(spark, sf, "lineitem").withColumnsRenamed({"l_suppkey": "ptid", "l_shipdate": "t"})

    def side(flag):
        return li.where(F.col("l_linestatus") == flag).groupBy("ptid", "t").agg(
            F.max("l_returnflag").alias("name"), exact_avg("l_extendedprice").alias("lbmp"), exact_avg("l_tax").alias("loss"),
            exact_avg("l_discount").alias("congestion_raw"),
        )

    p = publication.pair_series(side("O"), side("F"), ["ptid", "t"], ["lbmp", "loss", "congestion_raw"], ("da", "rt"), "name")
    return publication.price_components(publication.price_components(p, "da"), "rt")


# ---------------------------------------------------------------- grids

@query(
    "stitch_at_seam",
    oracle=f"""select o_orderstatus as series, o_orderdate as t, {xavg('o_totalprice')} as v, 'daily' as source from orders where o_orderdate < timestamp '1998-07-01' group by 1, 2
      union all select o_orderstatus, o_orderdate, o_totalprice, 'raw' from orders where o_orderdate >= timestamp '1998-07-01'""",
)
def stitch_at_seam(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderstatus").alias("series"), F.col("o_orderdate").alias("t"), F.col("o_totalprice").alias("v"))
    daily = o.groupBy("series", "t").agg(exact_avg("v").alias("v")).withColumn("source", F.lit("daily"))
    return grid.stitch(daily, o.withColumn("source", F.lit("raw")), "t", tc.ntz("1998-07-01 00:00:00"))


@query(
    "resample_hourly",
    oracle=f"select event_type, date_trunc('hour', ts) as hour_utc, {xavg('value')} as mean_value, count(*) as n_intervals from events group by 1, 2",
)
def resample_hourly(spark, sf):
    return grid.resample(load(spark, sf, "events"), ["event_type"], "ts", "value", "mean_value")


@query(
    "resample_complete_readings",
    oracle=with_(FEED) + f"""select area, date_trunc('hour', ts) as hour_utc, {xavg('value + kk')} as mean_total, count(*) as readings
      from (select *, case when k < 90 then k * 1.0e0 end as kk from feed) where value is not null and kk is not null group by 1, 2""",
)
def resample_readings(spark, sf):
    f = feed(spark, sf).withColumn("kk", F.when(F.col("k") < 90, F.col("k") * 1.0))
    return grid.resample_complete_readings(f, ["area"], "ts", ["value", "kk"], "mean_total", "readings")


@query(
    "time_weighted_hourly",
    oracle=with_(FEED) + f""", s as (select area, date_trunc('second', ts) as t, max(value) as value from feed group by 1, 2),
      x as (select *, cast(t - interval 1 second as date) as d, date_trunc('hour', t - interval 1 second) as hour_utc from s),
      y as (select *, greatest(coalesce(lag(t) over (partition by area, d order by t), t - interval 300 second), hour_utc) as st from x),
      z as (select *, cast(epoch(t) - epoch(st) as bigint) as w from y)
      select area, hour_utc, sum(w)::bigint as covered_seconds, round({xmean('sum(' + xunits('value') + ' * w)', 'sum(w)')}, 2) as value
      from z group by 1, 2""",
)
def time_weighted(spark, sf):
    s = feed(spark, sf).groupBy("area", tc.floor_second("ts").alias("t")).agg(F.max("value").alias("value"))
    return grid.time_weighted_hourly(s, ["area"], "t", ["value"])


@query(
    "complete_hourly_grid",
    oracle=with_(FEED) + f""", h as (select area, date_trunc('hour', ts) as hour_utc, {xavg('value')} as v from feed group by 1, 2),
      g as (select area, unnest(generate_series(min(hour_utc), max(hour_utc), interval 1 hour)) as hour_utc from h group by 1)
      select area, hour_utc, v from g left join h using (area, hour_utc)""",
)
def complete_hourly(spark, sf):
    h = feed(spark, sf).groupBy("area", tc.hour_floor("ts").alias("hour_utc")).agg(exact_avg("value").alias("v"))
    return grid.complete_grid(h, ["area"], "hour_utc")


@query(
    "local_day_hours",
    oracle=f"""with d as (select distinct o_orderdate::date as d from orders),
      h as (select d, unnest(generate_series(((d::timestamp) at time zone '{ZONE}') at time zone 'UTC', (((d + 1)::timestamp) at time zone '{ZONE}') at time zone 'UTC' - interval 1 hour, interval 1 hour)) as h from d)
      select d, count(*) as hours, min(h) as first_hour, max(h) as last_hour from h group by 1""",
)
def local_day_hours(spark, sf):
    d = load(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return grid.local_day_hours(d, "d", ZONE).groupBy("d").agg(
        F.count(F.lit(1)).alias("hours"), F.min("hour_utc").alias("first_hour"), F.max("hour_utc").alias("last_hour")
    )


@query(
    "interpolate_hourly",
    oracle=with_(FEED) + f""", p as (select area, user_id, date_trunc('hour', ts) as t, max(value) as v from feed group by 1, 2, 3),
      s as (select *, lead(t) over w as t1, lead(v) over w as v1 from p window w as (partition by area, user_id order by t)),
      g as (select *, unnest(generate_series(t, case when t1 is null or t1 - t > interval 24 hour then t else t1 - interval 1 hour end, interval 1 hour)) as h from s)
      select area, user_id, h as t, round(case when h = t then v else v + (v1 - v) * ((epoch(h) - epoch(t))::double / (epoch(t1) - epoch(t))::double) end, 9) as v from g""",
)
def interpolate(spark, sf):
    p = feed(spark, sf).groupBy("area", "user_id", tc.hour_floor("ts").alias("t")).agg(F.max("value").alias("v"))
    return grid.interpolate_hourly(p, ["area", "user_id"], "t", "v").withColumn("v", F.round("v", 9))


@query(
    "wall_hour_grid",
    oracle=f"""with x as (select o_orderstatus, o_orderdate + (o_orderkey % 24) * interval 1 hour as t, o_totalprice as v from orders),
      y as (select *, (t at time zone 'UTC') at time zone '{ZONE}' as l from x)
      select o_orderstatus, l::date as local_day, hour(l)::int as wall_hour, {xavg('v')} as v from y group by 1, 2, 3""",
)
def wall_hour_grid(spark, sf):
    x = load(spark, sf, "orders").select(
        "o_orderstatus", (F.col("o_orderdate") + tc.hours(F.col("o_orderkey") % 24)).alias("t"), F.col("o_totalprice").alias("v")
    )
    return grid.wall_hour_grid(x, ["o_orderstatus"], "t", "v", ZONE)


@query(
    "slot_of_hour",
    oracle=f"""with d as (select distinct o_orderdate::date as d from orders),
      h as (select d, unnest(generate_series(d::timestamp, d + interval 23 hour, interval 1 hour)) as t from d),
      l as (select t, (t at time zone 'UTC') at time zone '{ZONE}' as l, ((t - interval 1 hour) at time zone 'UTC') at time zone '{ZONE}' as lp from h)
      select t, l::date as local_day, (case when lp = l then 24 else hour(l) end)::int as slot from l""",
)
def slot_of_hour(spark, sf):
    d = load(spark, sf, "orders").select(tc.midnight(F.col("o_orderdate").cast("date")).alias("a")).distinct()
    h = d.select(F.explode(F.sequence("a", F.col("a") + tc.hours(23), F.expr("interval 1 hour"))).alias("t"))
    return grid.slot_of_hour(h, [], "t", ZONE)


@query(
    "mixed_grain_union",
    oracle=warehouse_sql("select instrument, interval_minutes, count(*) as n, min(interval_start_utc) as first_start, max(value) as high from prices group by 1, 2"),
)
def mixed_grain(spark, sf):
    return Warehouse(spark, sf).prices.groupBy("instrument", "interval_minutes").agg(
        F.count(F.lit(1)).alias("n"), F.min("interval_start_utc").alias("first_start"), F.max("value").alias("high")
    )
