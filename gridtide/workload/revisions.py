"""Revision tracking and version studies (L1-L13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_sum
from gridtide.plans import versions
from gridtide.workload.bindings import FEED, Warehouse, feed, warehouse_sql, with_, xavg, xsum
from gridtide.workload.registry import query

FULL = "versions_present >= 5 and v_realtime is not null and v_settled is not null"
FULL_SQL = f", full_hours as (select * from wind_versions where {FULL})"


def full_hours(spark, sf):
    return Warehouse(spark, sf).wind_versions.where(FULL)


@query(
    "recent_window",
    oracle=warehouse_sql("""select * from wind_versions_long
      where hour_utc >= (select max(hour_utc) from wind_versions_long) - interval 20 day
        and not (version = 'real-time' and hour_utc >= timestamp '2024-01-30 12:00:00')"""),
)
def recent_window(spark, sf):
    return versions.recent_window(Warehouse(spark, sf).wind_versions_long, 20, tc.ntz("2024-01-30 12:00:00"))


# two nightly snapshots: totals per user and day, without and with what was published overnight
def snapshots(spark, sf):
    f = feed(spark, sf)
    keys = ["user_id", "area", F.col("ts").cast("date").alias("day")]
    prev = f.where(F.col("ts") < tc.ntz("2024-01-29 00:00:00")).where("k < 80").groupBy(*keys).agg(exact_sum("value").alias("x"))
    cur = f.where(F.col("ts") >= tc.ntz("2024-01-02 00:00:00")).groupBy(*keys).agg(exact_sum("value").alias("x"))
    return prev, cur


SNAP = FEED + f""", prev as (select user_id, area, cast(ts as date) as day, {xsum('value')} as x from feed
    where ts < timestamp '2024-01-29' and k < 80 group by all),
  cur as (select user_id, area, cast(ts as date) as day, {xsum('value')} as x from feed where ts >= timestamp '2024-01-02' group by all),
  cmp as (select user_id, area, day, prev.x as before, cur.x as after, cur.x - prev.x as change,
    case when prev.x is null then 'appeared' when cur.x is null then 'vanished' when abs(cur.x - prev.x) > 0.5 then 'revised' else 'unchanged' end as status
    from prev full join cur using (user_id, area, day))"""


@query(
    "snapshot_diff",
    oracle=with_(SNAP) + f"""
      select area, count(*) filter (where status = 'appeared') as appeared, count(*) filter (where status = 'vanished') as vanished,
        count(*) filter (where status = 'revised') as revised, count(*) filter (where status = 'unchanged') as unchanged,
        round(max(case when status = 'revised' then abs(change) end), 2) as max_abs_mwh,
        round({xavg("case when status = 'revised' then abs(change) end")}, 2) as mean_abs_mwh from cmp group by 1""",
)
def snapshot_diff(spark, sf):
    prev, cur = snapshots(spark, sf)
    return versions.snapshot_diff(prev, cur, ["user_id", "area", "day"], "area", "x")


@query(
    "largest_changes",
    oracle=with_(SNAP) + """
      select user_id, area, day, round(before, 1) as before_mwh, round(after, 1) as after_mwh, round(change, 1) as change_mwh
      from cmp where status = 'revised' order by abs(change) desc, user_id desc, area desc, day desc limit 5""",
)
def largest_changes(spark, sf):
    prev, cur = snapshots(spark, sf)
    return versions.largest_changes(prev, cur, ["user_id", "area", "day"], "x")


@query(
    "version_spans",
    oracle=warehouse_sql("""
      , s as (select max(hour_utc) filter (where version = 'settled') as settled_hi, max(hour_utc) filter (where version = 'real-time') as realtime_hi,
        max(hour_utc) filter (where version = 'day-ahead') as day_ahead_hi, count(*) as rows from wind_versions_long)
      select *, cast(floor(epoch(realtime_hi - settled_hi) / 86400.0) as bigint) as settlement_lag_days from s"""),
)
def version_spans(spark, sf):
    return versions.version_spans(Warehouse(spark, sf).wind_versions_long)


MELT = ", e as (select area, v_settled, version, round(value - v_settled, 4) as err, round(abs(value - v_settled), 4) as abs_err from full_hours unpivot (value for version in (v_day_ahead as 'day-ahead', v_intraday as 'intraday', v_5h as 'five-hour', v_1h as 'one-hour', v_realtime as 'real-time')))"


@query(
    "version_convergence",
    oracle=warehouse_sql(FULL_SQL + f"""
, e as (select area, year(hour_utc) as year, v_settled, version, round(value - v_settled, 4) as err, round(abs(value - v_settled), 4) as abs_err
   from (select *, unnest([{{'version': 'day-ahead', 'value': v_day_ahead}}, {{'version': 'intraday', 'value': v_intraday}},
     {{'version': 'five-hour', 'value': v_5h}}, {{'version': 'one-hour', 'value': v_1h}}, {{'version': 'real-time', 'value': v_realtime}}], recursive := true) from full_hours)),
f as (select *, case when v_settled >= 20 then round(abs_err / v_settled * 100.0e0, 6) end as pct from e)
select area, year, version, count(*) as hours, {xavg('abs_err')} as mae_mwh, {xavg('err')} as bias_mwh,
  avg(case when pct is null then null when pct <= 5 then 1.0e0 else 0.0e0 end) as within_5pct,
  avg(case when pct is null then null when pct <= 10 then 1.0e0 else 0.0e0 end) as within_10pct,
  {xavg('v_settled')} as mean_settled_mwh, round(quantile_cont(abs_err, 0.5), 6) as median_abs_mwh, round(quantile_cont(abs_err, 0.9), 6) as p90_abs_mwh
from f group by 1, 2, 3"""),
)
def version_convergence(spark, sf):
    c = versions.convergence(full_hours(spark, sf), ["area", F.year("hour_utc").alias("year")], ["area", "year"], 20.0)
    return c.withColumn("median_abs_mwh", F.round("median_abs_mwh", 6)).withColumn("p90_abs_mwh", F.round("p90_abs_mwh", 6))


@query(
    "disagreement_by_tercile",
    oracle=warehouse_sql(FULL_SQL + f"""
, cuts as (select area, quantile_cont(v_settled, 1.0e0/3) as c1, quantile_cont(v_settled, 2.0e0/3) as c2 from full_hours group by 1),
lab as (select f.*, case when v_settled <= c1 then 'calm' when v_settled <= c2 then 'medium' else 'windy' end as level from full_hours f join cuts using (area))
select area, level, count(*) as hours, min(v_settled) as settled_from, max(v_settled) as settled_to, {xavg('v_settled')} as mean_settled_mwh,
  """ + ", ".join(f"round(quantile_cont(round(abs({c} - v_settled), 4), 0.5), 6) as median_{c}" for c in ("v_day_ahead", "v_intraday", "v_5h", "v_1h", "v_realtime"))
    + " from lab group by 1, 2"),
)
def disagreement(spark, sf):
    d = versions.disagreement_by_tercile(full_hours(spark, sf), "area")
    for c in d.columns:
        if c.startswith("median_"):
            d = d.withColumn(c, F.round(c, 6))
    return d


@query(
    "fit_tolerance",
    oracle=warehouse_sql(FULL_SQL + """
, e as (select v_settled, round(abs(v_realtime - v_settled), 4) as d from full_hours)
select round((select quantile_cont(round(d / v_settled * 100.0e0, 6), 0.99) from e where v_settled >= 20), 1) as tolerance_pct,
  round(coalesce((select quantile_cont(d, 0.99) from e where v_settled < 20), 0), 1) as tolerance_mwh,
  (select count(*) from e) as fit_hours"""),
)
def fit_tolerance(spark, sf):
    return versions.fit_tolerance(full_hours(spark, sf), 20.0)


@query(
    "breach_curve",
    oracle=warehouse_sql(FULL_SQL + """
select area, count(*) as hours, t::double as tolerance_pct,
  100.0e0 * avg(case when abs(v_realtime - v_settled) > greatest(15.0e0, t::double / 100.0e0 * v_settled) then 1.0e0 else 0.0e0 end) as breach_pct
from full_hours cross join range(1, 31) r(t) group by area, t"""),
)
def breach_curve(spark, sf):
    return versions.breach_curve(full_hours(spark, sf), ["area"], list(range(1, 31)), 15.0)


@query(
    "breach_monthly",
    oracle=warehouse_sql(FULL_SQL + """
select area, strftime(hour_utc, '%Y-%m') as month, count(*) as hours, 24.1e0 as tolerance_pct,
  100.0e0 * avg(case when abs(v_realtime - v_settled) > greatest(15.0e0, 24.1e0 / 100.0e0 * v_settled) then 1.0e0 else 0.0e0 end) as breach_pct
from full_hours group by 1, 2"""),
)
def breach_monthly(spark, sf):
    f = full_hours(spark, sf).withColumn("month", F.date_format("hour_utc", "yyyy-MM"))
    return versions.breach_curve(f, ["area", "month"], [24.1], 15.0)


_V = "v_day_ahead, v_intraday, v_5h, v_1h, v_realtime, v_settled"


@query(
    "preset_hours",
    oracle=warehouse_sql(FULL_SQL + f"""
, x as (select *, greatest({_V}) - least({_V}) as rng, abs(v_realtime - v_settled) as rt from full_hours)
select area, 'windiest' as why, hour_utc, {_V} from x qualify row_number() over (partition by area order by v_settled desc, hour_utc desc) = 1
union all select area, 'most_divergent', hour_utc, {_V} from x qualify row_number() over (partition by area order by rng desc, hour_utc desc) = 1
union all select area, 'largest_live_error', hour_utc, {_V} from x qualify row_number() over (partition by area order by rt desc, hour_utc desc) = 1"""),
)
def preset_hours(spark, sf):
    return versions.preset_hours(full_hours(spark, sf), "area")


@query(
    "median_disagreement_hour",
    oracle=warehouse_sql(FULL_SQL + """
, x as (select area, hour_utc, round(abs(v_realtime - v_settled) / v_settled, 9) as pct from full_hours where v_settled >= 20)
select area, hour_utc, pct from (select *, row_number() over (partition by area order by pct, hour_utc) - 1 as p, count(*) over (partition by area) as n from x)
where p = n // 2"""),
)
def median_hour(spark, sf):
    return versions.median_hour(full_hours(spark, sf), "area", 20.0)


@query(
    "cost_of_version",
    oracle=warehouse_sql(FULL_SQL + f"""
, priced as (select area, hour_utc, 0.1e0 * v_settled as made, 0.1e0 * v_realtime as seen, v_settled, v_realtime, imbalance_price_eur - price_eur as gap
  from full_hours join power_hourly using (area, hour_utc) join stg_imbalance using (area, hour_utc) where imbalance_price_eur is not null),
said as (from full_hours unpivot include nulls (value_mwh for version in (v_day_ahead as 'day-ahead', v_intraday as 'intraday', v_5h as 'five-hour', v_1h as 'one-hour')) select area, hour_utc, version, value_mwh),
added as (select area, year(hour_utc) as year, version, count(*) as hours, {xsum('made')} as mwh_produced, {xsum('-(made - 0.1e0 * value_mwh) * gap')} as eur,
  {xsum('-(0.1e0 * (v_realtime - value_mwh)) * gap')} as by_forecast, {xsum('-(0.1e0 * (v_settled - v_realtime)) * gap')} as by_measurement, {xsum('abs(made - 0.1e0 * value_mwh)')} as off
  from priced join said using (area, hour_utc) group by all)
select area, year, version, hours, mwh_produced, eur / 1000.0e0 as total_keur, eur / nullif(mwh_produced, 0) as eur_per_mwh, by_forecast / nullif(mwh_produced, 0) as forecast_part_eur_per_mwh,
  by_measurement / nullif(mwh_produced, 0) as measurement_part_eur_per_mwh, off / nullif(mwh_produced, 0) as imbalance_share from added"""),
)
def cost_of_version(spark, sf):
    w = Warehouse(spark, sf)
    keys = ["area", "hour_utc"]
    f = (
        w.wind_versions.where(FULL).join(w.power_hourly.select(*keys, "price_eur"), keys)
        .join(w.stg_imbalance.where(F.col("imbalance_price_eur").isNotNull()).select(*keys, "imbalance_price_eur"), keys)
        .withColumn("gap", F.col("imbalance_price_eur") - F.col("price_eur")).withColumn("year", F.year("hour_utc"))
    )
    return versions.cost_of_version(f, ["area", "year"], 0.1)


@query(
    "feed_anatomy",
    oracle=warehouse_sql(f"""
, kinds as (select area, hour_utc, kind, settled from stg_production unpivot (settled for kind in (onshore_wind_mwh as 'onshore', offshore_wind_mwh as 'offshore'))),
seen as (select area, date_trunc('hour', minute_utc) as hour_utc, count(*) as readings, map(['onshore', 'offshore'], [{xavg('onshore_wind_mw')}, {xavg('offshore_wind_mw')}]) as mw from stg_realtime group by all having count(*) = 3),
reports as (select area, year(hour_utc) as year, kind, settled, mw[kind] as reported from kinds join seen using (area, hour_utc)),
hours as (select area, year(hour_utc) as year, count(*) as hours from stg_production join seen using (area, hour_utc) group by all)
select area, year, any_value(hours) as hours, round(100.0e0 * {xsum("case when kind = 'onshore' then reported - settled end")} / nullif({xsum("case when kind = 'onshore' then settled end")}, 0), 1) as onshore_bias_pct,
  round(100.0e0 * {xsum("case when kind = 'offshore' then reported - settled end")} / nullif({xsum("case when kind = 'offshore' then settled end")}, 0), 1) as offshore_bias_pct
from hours left join reports using (area, year) group by area, year"""),
)
def feed_anatomy(spark, sf):
    w = Warehouse(spark, sf)
    return versions.anatomy(w.stg_realtime, w.stg_production, 3)


@query(
    "version_coverage",
    oracle=warehouse_sql("""
, x as (select *, versions_present = 6 and realtime_readings = 2 as f from wind_versions)
select min(hour_utc) filter (where f)::date as first_day, max(hour_utc) filter (where f)::date as last_day, count(*) filter (where f) as hours_all_six,
  count(*) as hours_any, avg(case when f then 1.0e0 else 0.0e0 end) as share_all_six,
  count(*) filter (where v_realtime is not null and realtime_readings < 2) as short_hours, count(v_realtime) as realtime_hours from x"""),
)
def version_coverage(spark, sf):
    return versions.coverage(Warehouse(spark, sf).wind_versions, 2)


@query("versions_present_counts", oracle=warehouse_sql("select versions_present, count(*) as hours from wind_versions group by 1"))
def versions_present_counts(spark, sf):
    return Warehouse(spark, sf).wind_versions.groupBy("versions_present").agg(F.count(F.lit(1)).alias("hours"))


@query(
    "newest_complete_hour",
    oracle=warehouse_sql("select area, max(hour_utc) as hour_utc from wind_versions where versions_present = 6 and realtime_readings = 2 group by 1"),
)
def newest_complete(spark, sf):
    return versions.newest_complete(Warehouse(spark, sf).wind_versions, 2)


@query(
    "recent_board",
    oracle=warehouse_sql("""select area, hour_utc, versions_present from wind_versions
      where hour_utc >= timestamp '2024-01-25 06:00:00' - interval 15 day and hour_utc < timestamp '2024-01-25 06:00:00'"""),
)
def recent_board(spark, sf):
    return versions.recent_board(Warehouse(spark, sf).wind_versions, tc.ntz("2024-01-25 06:00:00"))


@query(
    "gap_episodes",
    oracle=warehouse_sql("""
, g as (select area, hour_utc, hour_utc - row_number() over (partition by area order by hour_utc) * interval 1 hour as grp
   from wind_versions where v_settled is not null and v_realtime is null),
e as (select area, min(hour_utc) as start, max(hour_utc) as "end", count(*) as steps from g group by area, grp)
select *, steps = 1 and month(start) = 10 and hour(start) = 0 and dayofweek(start) = 0 as clock_change from e"""),
)
def gap_episodes(spark, sf):
    from gridtide.operators.episodes import consecutive_episodes, flag_autumn_change

    w = Warehouse(spark, sf).wind_versions
    missing = w.where(F.col("v_settled").isNotNull() & F.col("v_realtime").isNull()).select("area", "hour_utc")
    return flag_autumn_change(consecutive_episodes(missing, ["area"], "hour_utc"))
