"""Desk questions (R1-R2) on the given tables: each is SQL on the marts, checked by its own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.plans import questions
from gridtide.workload.bindings import ZONE, Warehouse, warehouse_sql, xavg, xsum
from gridtide.workload.registry import query

VIEWS = ("power_hourly", "desk_daily", "power_context", "forecast_hourly", "stg_fx", "prices")

_SUM = questions.EXACT_SUM
_AVG = questions.EXACT_AVG


def _x(c: str) -> tuple[str, str]:
    return _AVG.format(c=c), xavg(c)


LOCAL = "convert_timezone('UTC', '{z}', hour_utc)".format(z=ZONE)
LOCAL_D = f"(hour_utc at time zone 'UTC') at time zone '{ZONE}'"
_P, _PD = _x("price_eur")
_W, _WD = _x("wind_mwh")
_R, _RD = _x("rate")
_A, _AD = _x("avg_eur")
_S, _SD = _x("wind_share")

# name: (Spark SQL, DuckDB SQL)
QUESTIONS: dict[str, tuple[str, str]] = {
    "average_price_in_month": (
        f"select area, {_P} as mean_eur from power_hourly where hour_utc >= timestamp_ntz '2024-01-01' and hour_utc < timestamp_ntz '2024-02-01' group by area",
        f"select area, {_PD} as mean_eur from power_hourly where hour_utc >= timestamp '2024-01-01' and hour_utc < timestamp '2024-02-01' group by area",
    ),
    "hours_below_zero": (
        "select area, count(*) as n from power_hourly where price_eur < 0 group by area",
        "select area, count(*) as n from power_hourly where price_eur < 0 group by area",
    ),
    "cheapest_hour": (
        "select area, hour_utc, price_eur from power_hourly order by price_eur, area, hour_utc limit 1",
        "select area, hour_utc, price_eur from power_hourly order by price_eur, area, hour_utc limit 1",
    ),
    "five_dearest_days": (
        "select area, day_dk, avg_eur from desk_daily order by avg_eur desc, area, day_dk limit 5",
        "select area, day_dk, avg_eur from desk_daily order by avg_eur desc, area, day_dk limit 5",
    ),
    "last_thirty_rates": (
        f"select {_R} as mean_rate from (select rate from stg_fx where currency = 'O' and rate is not null order by rate_date desc limit 30)",
        f"select {_RD} as mean_rate from (select rate from stg_fx where currency = 'O' and rate is not null order by rate_date desc limit 30)",
    ),
    "newest_rate": (
        "select rate_date, currency, rate from stg_fx where rate_date = (select max(rate_date) from stg_fx)",
        "select rate_date, currency, rate from stg_fx where rate_date = (select max(rate_date) from stg_fx)",
    ),
    "rate_deviation": (
        "select currency, round(stddev_samp(rate), 6) as sd from stg_fx group by currency",
        "select currency, round(stddev_samp(rate), 6) as sd from stg_fx group by currency",
    ),
    "largest_daily_jump": (
        "select area, max(abs(j)) as jump from (select area, avg_eur - lag(avg_eur) over (partition by area order by day_dk) as j from desk_daily) group by area",
        "select area, max(abs(j)) as jump from (select area, avg_eur - lag(avg_eur) over (partition by area order by day_dk) as j from desk_daily) group by area",
    ),
    "weekday_and_weekend": (
        f"select area, (dayofweek(day_dk) - 1) in (0, 6) as weekend, {_A} as mean_eur from desk_daily group by 1, 2",
        f"select area, dayofweek(day_dk) in (0, 6) as weekend, {_AD} as mean_eur from desk_daily group by 1, 2",
    ),
    "median_price": (
        "select area, round(median(price_eur), 6) as med from power_hourly group by area",
        "select area, round(median(price_eur), 6) as med from power_hourly group by area",
    ),
    "profile_by_local_hour": (
        f"select area, hour({LOCAL}) as h, {_P} as mean_eur, count(*) as n from power_hourly group by 1, 2",
        f"select area, hour({LOCAL_D})::int as h, {_PD} as mean_eur, count(*) as n from power_hourly group by 1, 2",
    ),
    "windy_hours": (
        f"select area, count(*) as n, {_P} as mean_eur from power_context where wind_share > 0.8 group by area",
        f"select area, count(*) as n, {_PD} as mean_eur from power_context where wind_share > 0.8 group by area",
    ),
    "wind_share_bands": (
        f"select area, floor(wind_share*10+0.5)/10 as band, count(*) as n, {_P} as mean_eur from power_context where wind_share is not null group by 1, 2",
        f"select area, floor(wind_share*10+0.5)/10 as band, count(*) as n, {_PD} as mean_eur from power_context where wind_share is not null group by 1, 2",
    ),
    "incomplete_days": (
        "select area, count(*) as n from desk_daily where not is_complete group by area",
        "select area, count(*) as n from desk_daily where not is_complete group by area",
    ),
    "widest_spread_day": (
        "select distinct day_dk, spread_eur from desk_daily where spread_eur is not null order by abs(spread_eur) desc, day_dk limit 1",
        "select day_dk, spread_eur from (select distinct day_dk, spread_eur from desk_daily where spread_eur is not null) order by abs(spread_eur) desc, day_dk limit 1",
    ),
    "wind_by_month": (
        f"select area, date_format(hour_utc, 'yyyy-MM') as month, {_W} as mean_wind from power_context group by 1, 2",
        f"select area, strftime(hour_utc, '%Y-%m') as month, {_WD} as mean_wind from power_context group by 1, 2",
    ),
    "forecast_error": (
        f"select area, {_AVG.format(c='abs(wind_err_da_mwh)')} as mae, {_AVG.format(c='wind_err_da_mwh')} as bias from forecast_hourly group by area",
        f"select area, {xavg('abs(wind_err_da_mwh)')} as mae, {xavg('wind_err_da_mwh')} as bias from forecast_hourly group by area",
    ),
    "price_when_wind_share_low": (
        f"select area, {_P} as mean_eur, {_S} as mean_share from power_context where wind_share < 0.2 group by area",
        f"select area, {_PD} as mean_eur, {_SD} as mean_share from power_context where wind_share < 0.2 group by area",
    ),
    "newest_interval": (
        "select instrument, max(interval_start_utc) as newest from prices group by instrument",
        "select instrument, max(interval_start_utc) as newest from prices group by instrument",
    ),
    "hours_per_source": (
        "select area, source, count(*) as n, sum(n_intervals) as intervals from power_hourly group by 1, 2",
        "select area, source, count(*) as n, sum(n_intervals)::bigint as intervals from power_hourly group by 1, 2",
    ),
    "days_above_average": (
        "select area, count(*) as n from desk_daily d where avg_eur > (select avg(avg_eur) from desk_daily) group by area",
        "select area, count(*) as n from desk_daily d where avg_eur > (select avg(avg_eur) from desk_daily) group by area",
    ),
    "best_day_per_area": (
        "select area, max_by(day_dk, avg_eur) as day_dk, max(avg_eur) as avg_eur from desk_daily group by area",
        "select area, arg_max(day_dk, avg_eur) as day_dk, max(avg_eur) as avg_eur from desk_daily group by area",
    ),
    "average_in_second_currency": (
        f"select area, {_AVG.format(c='avg_local')} as mean_local from desk_daily where avg_local is not null group by area",
        f"select area, {xavg('avg_local')} as mean_local from desk_daily where avg_local is not null group by area",
    ),
    "price_range_per_day": (
        "select area, day_dk, high_eur - low_eur as rng from desk_daily where hours >= 20 order by rng desc, area, day_dk limit 10",
        "select area, day_dk, high_eur - low_eur as rng from desk_daily where hours >= 20 order by rng desc, area, day_dk limit 10",
    ),
    "two_year_hours": (
        "select area, year(hour_utc) as y, count(*) as n from power_hourly group by 1, 2",
        "select area, year(hour_utc)::int as y, count(*) as n from power_hourly group by 1, 2",
    ),
    "evening_peak": (
        f"select area, {_P} as mean_eur from power_hourly where hour({LOCAL}) between 17 and 20 group by area",
        f"select area, {_PD} as mean_eur from power_hourly where hour({LOCAL_D}) between 17 and 20 group by area",
    ),
    "days_opening_above_close": (
        "select area, count(*) as n from desk_daily where open_eur > close_eur group by area",
        "select area, count(*) as n from desk_daily where open_eur > close_eur group by area",
    ),
    "correlation_of_wind_and_price": (
        "select area, round(corr(price_eur, wind_share), 8) as r from power_context group by area",
        "select area, round(corr(price_eur, wind_share), 8) as r from power_context group by area",
    ),
    "solar_hours": (
        "select area, count(*) as n, max(solar_mwh) as high from power_context where solar_mwh > 0 group by area",
        "select area, count(*) as n, max(solar_mwh) as high from power_context where solar_mwh > 0 group by area",
    ),
    "consumption_total": (
        f"select area, {_SUM.format(c='consumption_mwh')} as total from power_context group by area",
        f"select area, {xsum('consumption_mwh')} as total from power_context group by area",
    ),
    "first_and_last_hour": (
        "select area, min(hour_utc) as first_hour, max(hour_utc) as last_hour from power_hourly group by area",
        "select area, min(hour_utc) as first_hour, max(hour_utc) as last_hour from power_hourly group by area",
    ),
}


def register_views(spark, sf):
    w = Warehouse(spark, sf)
    for v in VIEWS:
        getattr(w, v).createOrReplaceTempView(v)


for _name, (_spark_sql, _duck_sql) in QUESTIONS.items():

    @query(f"ask_{_name}", oracle=warehouse_sql(_duck_sql))
    def _ask(spark, sf, _sql=_spark_sql):
        register_views(spark, sf)
        return spark.sql(_sql)


@query(
    "row_cap_with_flag",
    oracle=warehouse_sql(
        """select area, hour_utc, price_eur, true as truncated from power_hourly order by price_eur desc, area, hour_utc limit 200
        """
    ),
)
def row_cap(spark, sf):
    # the cap is this query's feature: the 200 dearest hours, and word of there being more
    h = Warehouse(spark, sf).power_hourly.select("area", "hour_utc", "price_eur")
    return questions.capped(h, 200, [F.desc("price_eur"), F.asc("area"), F.asc("hour_utc")])


PERIODS = (("2024-01-01", "2024-02-01"), ("2024-01-01", "2024-01-08"), ("2024-01-15", "2024-01-22"), ("2024-01-20", "2024-01-31"), ("2024-01-30", "2024-01-31"))
CATALOGUE_AREAS = ("click", "view")


def _catalogue_sql() -> str:
    parts = []
    for m, sql in questions.METRICS.items():
        for a in CATALOGUE_AREAS:
            for lo, hi in PERIODS:
                body = sql.format(
                    avg=xavg("price_eur"), hourly="power_hourly", where=f"area = '{a}' and hour_utc >= timestamp '{lo}' and hour_utc < timestamp '{hi}'"
                ).replace("count_if(price_eur < 0)", "count(*) filter (where price_eur < 0)")
                body = body.replace("avg(cast(price_eur < 0 as double))", "avg(case when price_eur < 0 then 1.0e0 else 0.0e0 end)")
                parts.append(f"select '{m}' as metric, '{a}' as area, '{lo}' as lo, '{hi}' as hi, answer, n from ({body})")
    return warehouse_sql(" union all ".join(parts))


@query("question_catalogue", oracle=_catalogue_sql())
def question_catalogue(spark, sf):
    # 6 metrics x 2 areas x 5 periods in one pass: every cell is a conditional aggregate over the same hours
    from pyspark.sql import Window

    h = Warehouse(spark, sf).power_hourly
    w = Window.partitionBy("area").orderBy("hour_utc")
    h = h.withColumn("jump", F.abs(F.col("price_eur") - F.lag("price_eur").over(w))).where(F.col("area").isin(*CATALOGUE_AREAS))
    periods = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in PERIODS])
    x = h.withColumn("p", F.explode(periods)).where(
        (F.col("hour_utc") >= F.col("p.lo").cast("timestamp_ntz")) & (F.col("hour_utc") < F.col("p.hi").cast("timestamp_ntz"))
    )
    from gridtide.functions.exact import exact_avg

    p = F.col("price_eur")
    g = x.groupBy("area", "p.lo", "p.hi").agg(
        F.count(F.lit(1)).alias("n"), exact_avg("price_eur").alias("average price"), F.min(p).alias("lowest hour"), F.max(p).alias("highest hour"),
        F.count_if(p < 0).cast("double").alias("hours below the floor"), F.avg((p < 0).cast("double")).alias("share of hours below the floor"),
        F.max("jump").alias("largest hour-to-hour jump"),
    )
    return g.unpivot(["area", "lo", "hi", "n"], list(questions.METRICS), "metric", "answer").select("metric", "area", "lo", "hi", "answer", "n")
