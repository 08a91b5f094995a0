"""Analogues of the warehouse feeds on the given tables, in Spark and as SQL for the oracles.

``events`` plays the high-frequency feed (event type = area, JSON ``k`` = a second measure),
``lineitem`` the re-fetched records and the traded panel (supplier region = zone, line number = slot of
the day), ``orders`` the daily and the interval tables.  All of them are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_avg
from gridtide.plans import marts

ZONE = "Europe/Copenhagen"
SEAM = "2024-01-16 22:00:00"
SINGLE = "2024-01-10 00:00:00"
SEPARATE = "2024-01-21 00:00:00"
AREAS = ("click", "error", "purchase", "signup", "view")
ZONES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- SQL helpers (oracle side)

UNIT = "1125899906842624"


def xunits(c: str) -> str:
    """A value as a whole number of units of 2^-50."""
    x = f"(({c})*1.0e0)"
    return f"(cast(trunc({x}) as hugeint)*{UNIT} + cast(trunc(({x}-trunc({x}))*{UNIT}.0e0) as hugeint))"


def xmean(units: str, n: str) -> str:
    return f"(cast(cast({units} as varchar) as double)/(cast({n} as double)*{UNIT}.0e0))"


def xsum(c: str) -> str:
    return f"(cast(cast(sum({xunits(c)}) as varchar) as double)/{UNIT}.0e0)"


def xavg(c: str) -> str:
    return xmean(f"sum({xunits(c)})", f"count({c})")


def xavg_over(c: str, over: str) -> str:
    return xmean(f"sum({xunits(c)}) over ({over})", f"count({c}) over ({over})")


def xsum_over(c: str, over: str) -> str:
    return f"(cast(cast(sum({xunits(c)}) over ({over}) as varchar) as double)/{UNIT}.0e0)"


def with_(*ctes: str) -> str:
    """A WITH clause from CTE texts, repeated ones once, in order."""
    seen: list[str] = []
    for c in ctes:
        if c not in seen:
            seen.append(c)
    return "with " + ",\n".join(seen)


# ---------------------------------------------------------------- events as raw feeds

def feed(spark: SparkSession, sf: str) -> DataFrame:
    """events with the JSON measure parsed once."""
    return load(spark, sf, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("area"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


FEED = """feed as (
  select event_id, ts, user_id, event_type as area, value, cast(json_extract_string(props, '$.k') as int) as k
  from events)"""


def raw_feeds(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Raw landing tables in the shape of the warehouse's sources, every row carrying fetch order columns."""
    f = feed(spark, sf).withColumnRenamed("area", "PriceArea").withColumn("_fetched_at", F.col("ts"))
    hour = tc.hour_floor("ts")
    k = F.col("k")
    v = F.col("value")

    def band(lo: int, hi: int):
        return F.when((k >= lo) & (k < hi), v)

    keep = ["PriceArea", "_fetched_at", "event_id"]
    orders = load(spark, sf, "orders")
    return {
        "elspot": f.select(*keep, hour.alias("HourUTC"), v.alias("SpotPriceEUR"), (v * 7.5).alias("SpotPriceDKK")),
        "dayahead": f.select(
            *keep, tc.floor_minutes("ts", 15).alias("TimeUTC"), (v - 20.0).alias("DayAheadPriceEUR"),
            ((v - 20.0) * 7.5).alias("DayAheadPriceDKK"),
        ),
        "production": f.select(
            *keep, hour.alias("HourUTC"),
            band(0, 10).alias("OffshoreWindLt100MW_MWh"), band(10, 30).alias("OffshoreWindGe100MW_MWh"),
            band(30, 40).alias("OnshoreWindLt50kW_MWh"), band(40, 60).alias("OnshoreWindGe50kW_MWh"),
            band(60, 65).alias("SolarPowerLt10kW_MWh"), band(65, 70).alias("SolarPowerGe10Lt40kW_MWh"),
            band(70, 75).alias("SolarPowerGe40kW_MWh"), band(75, 80).alias("SolarPowerSelfConMWh"),
            band(80, 85).alias("CentralPowerMWh"), band(85, 90).alias("LocalPowerMWh"), band(90, 100).alias("CommercialPowerMWh"),
            (v + k - 5.0).alias("GrossConsumptionMWh"),
        ),
        "forecasts": f.select(
            *keep, hour.alias("HourUTC"),
            F.when(k < 40, "Offshore Wind").when(k < 80, "Onshore Wind").otherwise("Solar").alias("ForecastType"),
            F.when(k != 7, v + 4.0).alias("ForecastDayAhead"), F.when(k != 8, v + 3.0).alias("ForecastIntraday"),
            F.when(k != 9, v - 2.0).alias("Forecast5Hour"), F.when(k < 90, v + k / 100.0).alias("Forecast1Hour"),
            v.alias("ForecastCurrent"), F.when(k != 50, F.col("ts")).alias("TimestampUTC"),
        ),
        "imbalance": f.select(
            *keep, hour.alias("HourUTC"), (k - 50.0).alias("ImbalanceMWh"), (v + k / 10.0 - 5.0).alias("ImbalancePriceEUR"),
            (v + F.greatest(k - 50.0, F.lit(0.0))).alias("BalancingPowerPriceUpEUR"),
            (v - F.greatest(50.0 - k, F.lit(0.0))).alias("BalancingPowerPriceDownEUR"),
            F.when(k > 30, k * 1.0).alias("mFRRUpActBal"), F.when(k < 70, 0.0 - k).alias("mFRRDownActBal"),
        ),
        "realtime": f.select(
            *keep, tc.floor_minutes("ts", 5).alias("Minutes5UTC"), v.alias("OnshoreWindPower"),
            F.when(k < 90, k * 1.0).alias("OffshoreWindPower"), (v / 2.0).alias("SolarPower"),
        ),
        # the order book moved 27 years on stands for the daily reference rates
        "fx": orders.select(
            F.add_months(F.col("o_orderdate").cast("date"), 324).alias("date"), F.col("o_orderstatus").alias("currency"),
            F.lit("EUR").alias("denominator"), (F.col("o_totalprice") / 10000.0).alias("rate"),
            F.col("o_orderdate").alias("_fetched_at"), F.col("o_orderkey").alias("event_id"),
        ),
    }


ORDER = ("_fetched_at", "event_id")
#: What the price mart keeps the stamp of the fetch of.
FETCHED = ("stg_elspot", "stg_dayahead", "stg_fx", "prices")

_LATEST = "row_number() over (partition by {keys} order by ts desc, event_id desc) = 1"
_HOUR = "date_trunc('hour', ts)"


def _stage(name: str, keys: str, cols: str) -> str:
    return (
        f"{name} as (select {cols} from (select *, {_HOUR} as hour_utc, "
        f"time_bucket(interval 15 minute, ts, timestamp '2000-01-01') as q_utc, "
        f"time_bucket(interval 5 minute, ts, timestamp '2000-01-01') as minute_utc, "
        f"case when k < 40 then 'Offshore Wind' when k < 80 then 'Onshore Wind' else 'Solar' end as forecast_type "
        f"from feed) qualify {_LATEST.format(keys=keys)})"
    )


STG_ELSPOT = _stage(
    "stg_elspot", "area, hour_utc",
    "area, hour_utc as interval_start_utc, 60 as interval_minutes, value as price_eur, value*7.5e0 as price_dkk, ts as _fetched_at",
)
STG_DAYAHEAD = _stage(
    "stg_dayahead", "area, q_utc",
    "area, q_utc as interval_start_utc, 15 as interval_minutes, value-20.0e0 as price_eur, (value-20.0e0)*7.5e0 as price_dkk, ts as _fetched_at",
)
STG_PRODUCTION = _stage(
    "stg_production", "area, hour_utc",
    "area, hour_utc, case when k<30 then value else 0.0e0 end as offshore_wind_mwh, "
    "case when k>=30 and k<60 then value else 0.0e0 end as onshore_wind_mwh, "
    "case when k>=60 and k<80 then value else 0.0e0 end as solar_mwh, "
    "case when k>=80 then value else 0.0e0 end as thermal_mwh, value+k-5.0e0 as consumption_mwh",
)
STG_FORECASTS = _stage(
    "stg_forecasts", "area, hour_utc, forecast_type",
    "area, hour_utc, forecast_type, case when k<>7 then value+4.0e0 end as fc_day_ahead_mwh, "
    "case when k<>8 then value+3.0e0 end as fc_intraday_mwh, case when k<>9 then value-2.0e0 end as fc_5h_mwh, "
    "case when k<90 then value+k/100.0e0 end as fc_1h_mwh, value as fc_current_mwh, "
    "case when k<>50 then ts end as published_utc",
)
STG_IMBALANCE = _stage(
    "stg_imbalance", "area, hour_utc",
    "area, hour_utc, k-50.0e0 as imbalance_mwh, value+k/10.0e0-5.0e0 as imbalance_price_eur, "
    "value+greatest(k-50.0e0,0.0e0) as balancing_up_eur, value-greatest(50.0e0-k,0.0e0) as balancing_down_eur, "
    "case when k>30 then k*1.0e0 end as mfrr_up_mwh, case when k<70 then 0.0e0-k end as mfrr_down_mwh",
)
STG_REALTIME = _stage(
    "stg_realtime", "area, minute_utc",
    "area, minute_utc, value as onshore_wind_mw, case when k<90 then k*1.0e0 end as offshore_wind_mw, value/2.0e0 as solar_mw",
)
STG_FX = """stg_fx as (
  select cast(o_orderdate + interval 27 year as date) as rate_date, o_orderstatus as currency, 'EUR' as denominator,
         o_totalprice/10000.0e0 as rate, o_orderdate as _fetched_at
  from orders
  qualify row_number() over (partition by cast(o_orderdate + interval 27 year as date), o_orderstatus
                             order by o_orderdate desc, o_orderkey desc) = 1)"""
# Both energy feeds with their names; the seam decides which of them counts at an instant.
PRICES = f"""prices as (
  with feeds as (from stg_elspot select *, '_DA' as suffix, 'Elspotprices' as source union all by name from stg_dayahead select *, '_DA' as suffix, 'DayAheadPrices' as source)
  select area || suffix as instrument, area, interval_start_utc, interval_minutes, price_eur as value, 'EUR/MWh' as unit, source, _fetched_at from feeds
    where source = case when interval_start_utc < timestamp '{SEAM}' then 'Elspotprices' else 'DayAheadPrices' end
  union all by name
  select denominator || currency as instrument, null as area, rate_date::timestamp as interval_start_utc, 1440 as interval_minutes, rate as value,
    currency || ' per ' || denominator as unit, 'ECB' as source, _fetched_at from stg_fx)"""
HOURLY = f"""power_hourly as (
  select area, date_trunc('hour', interval_start_utc) as hour_utc, {xavg('value')} as price_eur,
         count(*) as n_intervals, min(source) as source
  from prices where unit = 'EUR/MWh' group by 1, 2)"""
# Local days; the two areas of the spread are picked out of all days by conditional aggregation.
DESK = f"""bars as (
  select area, (timezone('{ZONE}', timezone('UTC', hour_utc)))::date as day_dk, {xavg('price_eur')} as avg_eur, count(*) as hours,
    first(price_eur order by hour_utc) as open_eur, last(price_eur order by hour_utc) as close_eur, min(price_eur) as low_eur, max(price_eur) as high_eur,
    count_if(price_eur < 0) as negative_hours from power_hourly group by all),
desk_daily as (
  select bars.*, hours between 23 and 25 as is_complete, spread_eur, rate as fx_rate, avg_eur * rate as avg_local from bars
  left join (select day_dk, max(avg_eur) filter (area = 'click') - max(avg_eur) filter (area = 'view') as spread_eur from bars group by day_dk) using (day_dk)
  left join (select rate_date as day_dk, rate from stg_fx where currency = 'F') using (day_dk))"""
CONTEXT = """power_context as (
  select area, hour_utc, price_eur, wind_mwh, solar_mwh, thermal_mwh, consumption_mwh, wind_mwh / nullif(greatest(consumption_mwh, 0), 0) as wind_share
  from power_hourly join (select *, offshore_wind_mwh + onshore_wind_mwh as wind_mwh from stg_production) using (area, hour_utc))"""
# Every forecast as one row per vintage; all wide tables are conditional aggregates of this.
VINTAGES = """vintages as (
  select area, hour_utc, forecast_type like '%Wind%' as is_wind, forecast_type like '%Solar%' as is_solar, vintage, mwh
  from stg_forecasts unpivot include nulls (mwh for vintage in (fc_day_ahead_mwh as 'day-ahead', fc_intraday_mwh as 'intraday', fc_5h_mwh as 'five-hour', fc_1h_mwh as 'one-hour')))"""


def _vintage(kind: str, vintage: str) -> str:
    return xsum(f"case when {kind} and vintage = '{vintage}' then mwh end")


FORECAST = f"""forecast_hourly as (
  select *, wind_actual_mwh - wind_fc_da_mwh as wind_err_da_mwh, wind_actual_mwh - wind_fc_1h_mwh as wind_err_1h_mwh,
    wind_fc_da_mwh / nullif(greatest(consumption_mwh, 0), 0) as wind_fc_share
  from (select area, hour_utc, {_vintage('is_solar', 'day-ahead')} as solar_fc_da_mwh, {_vintage('is_wind', 'day-ahead')} as wind_fc_da_mwh,
      {_vintage('is_wind', 'intraday')} as wind_fc_id_mwh, {_vintage('is_wind', 'five-hour')} as wind_fc_5h_mwh, {_vintage('is_wind', 'one-hour')} as wind_fc_1h_mwh
    from vintages group by area, hour_utc)
  join (select area, hour_utc, price_eur, consumption_mwh, wind_mwh as wind_actual_mwh, solar_mwh as solar_actual_mwh from power_context) using (area, hour_utc))"""
VERSUS = """forecast_vs_imbalance as (
  select area, hour_utc, price_eur, wind_err_da_mwh, wind_err_1h_mwh, wind_fc_da_mwh, wind_actual_mwh, imbalance_price_eur, imbalance_mwh,
    imbalance_price_eur - price_eur as imbalance_minus_spot_eur
  from stg_imbalance join forecast_hourly using (area, hour_utc))"""
# All versions of an hour as rows; the wide table is made of them.
VERSIONS = f"""hour_versions as (
  select area, hour_utc, vintage as version, {xsum('mwh')} as value, null::bigint as readings from vintages where is_wind group by all
  union all
  select area, date_trunc('hour', minute_utc), 'real-time', {xavg('onshore_wind_mw + offshore_wind_mw')}, count(*) from stg_realtime
    where onshore_wind_mw + offshore_wind_mw is not null group by all
  union all
  select area, hour_utc, 'settled', offshore_wind_mwh + onshore_wind_mwh, null from stg_production)"""
_NAMES = {"v_day_ahead": "day-ahead", "v_intraday": "intraday", "v_5h": "five-hour", "v_1h": "one-hour", "v_realtime": "real-time", "v_settled": "settled"}
WIDE = (
    "wind_versions as (select area, hour_utc, "
    + ", ".join(f"any_value(value) filter (version = '{v}') as {c}" for c, v in _NAMES.items())
    + ", coalesce(max(readings), 0) as realtime_readings, count(value)::int as versions_present from hour_versions group by all having count(value) > 0)"
)
LONG = f"""wind_versions_long as (
  select area, hour_utc, version, list_position({list(_NAMES.values())}, version)::int as rank, version not in ('real-time', 'settled') as tradable,
    value as value_mwh, any_value(value) filter (version = 'settled') over (partition by area, hour_utc) as settled_mwh, value - settled_mwh as diff_vs_settled_mwh
  from hour_versions qualify value is not null)"""

WAREHOUSE = (
    FEED, STG_ELSPOT, STG_DAYAHEAD, STG_PRODUCTION, STG_FORECASTS, STG_IMBALANCE, STG_REALTIME, STG_FX, PRICES, HOURLY,
    DESK, CONTEXT, VINTAGES, FORECAST, VERSUS, VERSIONS, WIDE, LONG,
)


def warehouse_sql(body: str) -> str:
    return with_(*WAREHOUSE) + "\n" + body


class Warehouse:
    """All staging models and marts on the given tables; every attribute is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf: str):
        self.raw = raw_feeds(spark, sf)

    def __getattr__(self, name: str) -> DataFrame:
        r = self.__dict__["raw"]
        make = {
            "stg_elspot": lambda: marts.stg_elspot(r["elspot"], ORDER),
            "stg_dayahead": lambda: marts.stg_dayahead(r["dayahead"], ORDER),
            "stg_production": lambda: marts.stg_production(r["production"], ORDER),
            "stg_forecasts": lambda: marts.stg_forecasts(r["forecasts"], ORDER),
            "stg_imbalance": lambda: marts.stg_imbalance(r["imbalance"], ORDER),
            "stg_realtime": lambda: marts.stg_realtime(r["realtime"], ORDER),
            "stg_fx": lambda: marts.stg_fx(r["fx"], ORDER),
            "prices": lambda: marts.prices(self.stg_elspot, self.stg_dayahead, self.stg_fx, tc.ntz(SEAM)),
            "power_hourly": lambda: marts.power_hourly(self.prices),
            "desk_daily": lambda: marts.desk_daily(self.power_hourly, self.stg_fx, ZONE, ("click", "view"), "F"),
            "power_context": lambda: marts.power_context(self.power_hourly, self.stg_production),
            "forecast_hourly": lambda: marts.forecast_hourly(self.stg_forecasts, self.power_context),
            "forecast_vs_imbalance": lambda: marts.forecast_vs_imbalance(self.forecast_hourly, self.stg_imbalance),
            "wind_versions": lambda: marts.wind_versions(self.stg_forecasts, self.stg_realtime, self.stg_production),
            "wind_versions_long": lambda: marts.wind_versions_long(self.wind_versions),
        }
        if name not in make:
            raise AttributeError(name)
        df = make[name]().drop("event_id", *([] if name in FETCHED else ["_fetched_at"]))
        self.__dict__[name] = df
        return df


# ---------------------------------------------------------------- the traded panel

def panel(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (delivery_date, zone, slot): two prices, their gap, and when the outcome was public."""
    li = load(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_discount", "l_tax")
    zones = (
        load(spark, sf, "supplier")
        .join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("zone"))
    )
    da = F.col("l_extendedprice") / 1000.0
    gap = F.col("l_extendedprice") * (F.col("l_tax") - F.col("l_discount")) / 1000.0
    return (
        li.join(zones, "l_suppkey")
        .groupBy(F.col("l_shipdate").cast("date").alias("delivery_date"), "zone", F.col("l_linenumber").alias("slot"))
        .agg(exact_avg(da).alias("y_da"), exact_avg(gap).alias("gap"), F.count(F.lit(1)).alias("n_trades"))
        .withColumn("label_published_at", tc.midnight("delivery_date") + tc.hours(F.lit(24) + F.col("slot")))
    )


PANEL = f"""panel as (
  select cast(l_shipdate as date) as delivery_date, r_name as zone, l_linenumber as slot,
    {xavg('l_extendedprice/1000.0e0')} as y_da,
    {xavg('l_extendedprice*(l_tax-l_discount)/1000.0e0')} as gap, count(*) as n_trades,
    cast(cast(l_shipdate as date) as timestamp) + (24+l_linenumber)*interval 1 hour as label_published_at
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey
  group by all)"""
