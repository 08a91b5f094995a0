"""Staging models and marts (J1-J11) on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.plans import marts
from gridtide.workload.bindings import SEPARATE, SINGLE, Warehouse, warehouse_sql
from gridtide.workload.registry import query

for _name in (
    "stg_elspot", "stg_dayahead", "stg_production", "stg_forecasts", "stg_imbalance", "stg_realtime", "stg_fx", "prices",
    "power_hourly", "desk_daily", "power_context", "forecast_hourly", "forecast_vs_imbalance", "wind_versions",
    "wind_versions_long",
):

    @query(_name, oracle=warehouse_sql(f"select * from {_name}"))
    def _mart(spark, sf, _name=_name):
        return getattr(Warehouse(spark, sf), _name)


@query(
    "activation_hours",
    oracle=warehouse_sql(f"""
, raw as (
  select r.area, r.hour_utc, r.balancing_up_eur as up_eur, r.balancing_down_eur as down_eur, r.imbalance_price_eur as imbalance_eur,
    r.imbalance_mwh, r.mfrr_up_mwh, r.mfrr_down_mwh, p.price_eur as spot_eur
  from stg_imbalance r join power_hourly p using (area, hour_utc)),
grid as (select area, unnest(generate_series(min(hour_utc), max(hour_utc), interval 1 hour)) as hour_utc from raw group by 1),
g as (select grid.area, grid.hour_utc, raw.* exclude (area, hour_utc) from grid left join raw using (area, hour_utc)),
h as (select *, coalesce(up_eur > spot_eur + 1e-9 and coalesce(mfrr_up_mwh, 0) > 0, false) as up_activated,
  coalesce(down_eur < spot_eur - 1e-9 and abs(coalesce(mfrr_down_mwh, 0)) > 0, false) as down_activated from g)
select *, least(1.0e0, coalesce(mfrr_up_mwh, 0.0e0)/60.0e0) as up_frac, least(1.0e0, abs(coalesce(mfrr_down_mwh, 0.0e0))/60.0e0) as down_frac,
  case when imbalance_eur is null then null when imbalance_eur > spot_eur + 1e-9 then 1.0e0 when imbalance_eur < spot_eur - 1e-9 then -1.0e0 else 0.0e0 end as dir,
  case when up_activated then up_eur - spot_eur else 0.0e0 end as up_premium,
  case when down_activated then spot_eur - down_eur else 0.0e0 end as down_discount,
  hour_utc >= timestamp '{SINGLE}' as single_pricing,
  case when hour_utc < timestamp '{SEPARATE}' then 'training' else 'separate' end as period
from h"""),
)
def activation_hours(spark, sf):
    w = Warehouse(spark, sf)
    return marts.activation_hours(w.stg_imbalance, w.power_hourly, tc.ntz(SINGLE), tc.ntz(SEPARATE))


DECISION_SQL = f"""
, base as (
  select v.area, v.hour_utc, v.price_eur, v.imbalance_price_eur, v.imbalance_minus_spot_eur as gap, f.wind_fc_da_mwh, f.wind_fc_id_mwh,
    f.wind_fc_5h_mwh, f.wind_fc_1h_mwh, f.wind_actual_mwh, f.consumption_mwh, f.solar_fc_da_mwh, i.mfrr_up_mwh, i.mfrr_down_mwh, i.imbalance_mwh
  from forecast_vs_imbalance v join forecast_hourly f using (area, hour_utc) left join stg_imbalance i using (area, hour_utc)
  where v.imbalance_minus_spot_eur is not null),
grid as (select area, unnest(generate_series(min(hour_utc), max(hour_utc), interval 1 hour)) as hour_utc from base group by 1),
g as (select grid.area, grid.hour_utc, base.* exclude (area, hour_utc) from grid left join base using (area, hour_utc)),
a as (select *, lag(gap, 2) over w as gap2, lag(cast(sign(gap) as double), 2) over w as sgn2,
    lag(coalesce(mfrr_up_mwh, 0.0e0) - coalesce(mfrr_down_mwh, 0.0e0), 2) over w as net_act2, lag(imbalance_mwh, 2) over w as imb2,
    row_number() over w as pos from g window w as (partition by area order by hour_utc)),
b as (select *, case when sgn2 <> 0 then sgn2 end as nz, case when sgn2 <> 0 then pos end as nzpos,
    coalesce(sgn2, 0) as s0 from a),
c as (select *, last_value(nz ignore nulls) over w12 as dir, pos - last_value(nzpos ignore nulls) over w12 + 2 as dir_age,
    case when s0 <> coalesce(lag(s0) over (partition by area order by hour_utc), 0) then 1 else 0 end as isnew,
    case when count(gap2) over w6 >= 3 then quantile_cont(abs(gap2), 0.5) over w6 end as med_abs_gap6
  from b window w12 as (partition by area order by hour_utc rows between 12 preceding and current row),
    w6 as (partition by area order by hour_utc rows between 5 preceding and current row)),
d as (select *, sum(isnew) over (partition by area order by hour_utc rows unbounded preceding) as grp from c)
select area, hour_utc, price_eur, imbalance_price_eur, gap, wind_fc_da_mwh, wind_fc_id_mwh, wind_fc_5h_mwh, wind_fc_1h_mwh, wind_actual_mwh,
  consumption_mwh, solar_fc_da_mwh, gap2, gap2 is not null as settled2, abs(gap2) as abs_gap2, net_act2, imb2, dir, dir_age,
  case when s0 = 0 then 0 else row_number() over (partition by area, grp order by hour_utc) end as run2, med_abs_gap6,
  wind_fc_5h_mwh - wind_fc_da_mwh as rev5, wind_fc_da_mwh / nullif(consumption_mwh, 0) as fc_share,
  {{hod}}
  cast(sign(gap) as double) as y, hour_utc >= timestamp '{SINGLE}' as single_pricing,
  case when hour_utc < timestamp '{SEPARATE}' then 'training' else 'separate' end as period
from d"""


@query(
    "decision_hours",
    oracle=warehouse_sql(
        DECISION_SQL.replace(
            "{hod}",
            "round(sin(2.0e0*pi()*hour(hour_utc)/24.0e0), 9) as hod_sin, round(cos(2.0e0*pi()*hour(hour_utc)/24.0e0), 9) as hod_cos,",
        )
    ),
)
def decision_hours(spark, sf):
    w = Warehouse(spark, sf)
    d = marts.decision_hours(w.forecast_hourly, w.stg_imbalance, tc.ntz(SINGLE), tc.ntz(SEPARATE))
    return d.withColumn("hod_sin", F.round("hod_sin", 9)).withColumn("hod_cos", F.round("hod_cos", 9))
