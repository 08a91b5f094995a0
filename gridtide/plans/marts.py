"""Staging models and marts of the warehouse: raw feeds in, typed and joined tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_avg, exact_sum
from gridtide.functions.numbers import null_safe_sum, presence_count, safe_ratio
from gridtide.operators import grid, trailing
from gridtide.operators.dedup import latest_wins
from gridtide.operators.setops import key_union

FETCH = "_fetched_at"

# The six published versions of an hour, in order of publication, with the wide column.
VERSIONS = (
    ("day-ahead", "v_day_ahead"),
    ("intraday", "v_intraday"),
    ("five-hour", "v_5h"),
    ("one-hour", "v_1h"),
    ("real-time", "v_realtime"),
    ("settled", "v_settled"),
)
TRADABLE = ("day-ahead", "intraday", "five-hour", "one-hour")


def typed_latest(
    raw: DataFrame, keys: dict[str, Column], columns: dict[str, Column], order: Sequence[str] = (FETCH,)
) -> DataFrame:
    """A staging model: name and cast, then keep the latest fetch of each key.

    The projection comes first so that only the needed columns reach the shuffle.
    """
    carry = [c for c in order if c not in keys and c not in columns]
    typed = raw.select(
        *[c.alias(n) for n, c in keys.items()], *[c.alias(n) for n, c in columns.items()], *[F.col(c) for c in carry]
    )
    return latest_wins(typed, list(keys), list(order))


def stg_elspot(raw: DataFrame, order: Sequence[str] = (FETCH,)) -> DataFrame:
    return _stg_price(raw, "HourUTC", "SpotPriceEUR", "SpotPriceDKK", 60, order)


def stg_dayahead(raw: DataFrame, order: Sequence[str] = (FETCH,)) -> DataFrame:
    return _stg_price(raw, "TimeUTC", "DayAheadPriceEUR", "DayAheadPriceDKK", 15, order)


def _stg_price(raw: DataFrame, ts: str, eur: str, dkk: str, minutes: int, order: Sequence[str]) -> DataFrame:
    return typed_latest(
        raw,
        {"area": F.col("PriceArea"), "interval_start_utc": F.col(ts).cast("timestamp_ntz")},
        {
            "interval_minutes": F.lit(minutes),
            "price_eur": F.col(eur).cast("double"),
            "price_dkk": F.col(dkk).cast("double"),
        },
        order,
    )


def stg_fx(raw: DataFrame, order: Sequence[str] = (FETCH,)) -> DataFrame:
    return typed_latest(
        raw,
        {"rate_date": F.col("date").cast("date"), "currency": F.col("currency")},
        {"denominator": F.col("denominator"), "rate": F.col("rate").cast("double")},
        order,
    )


def stg_production(raw: DataFrame, order: Sequence[str] = (FETCH,)) -> DataFrame:
    return typed_latest(
        raw,
        {"area": F.col("PriceArea"), "hour_utc": F.col("HourUTC").cast("timestamp_ntz")},
        {
            "offshore_wind_mwh": null_safe_sum("OffshoreWindLt100MW_MWh", "OffshoreWindGe100MW_MWh"),
            "onshore_wind_mwh": null_safe_sum("OnshoreWindLt50kW_MWh", "OnshoreWindGe50kW_MWh"),
            "solar_mwh": null_safe_sum(
                "SolarPowerLt10kW_MWh", "SolarPowerGe10Lt40kW_MWh", "SolarPowerGe40kW_MWh", "SolarPowerSelfConMWh"
            ),
            "thermal_mwh": null_safe_sum("CentralPowerMWh", "LocalPowerMWh", "CommercialPowerMWh"),
            "consumption_mwh": F.col("GrossConsumptionMWh").cast("double"),
        },
        order,
    )


def stg_forecasts(raw: DataFrame, order: Sequence[str] = (FETCH,)) -> DataFrame:
    return typed_latest(
        raw,
        {
            "area": F.col("PriceArea"),
            "hour_utc": F.col("HourUTC").cast("timestamp_ntz"),
            "forecast_type": F.col("ForecastType"),
        },
        {
            "fc_day_ahead_mwh": F.col("ForecastDayAhead").cast("double"),
            "fc_intraday_mwh": F.col("ForecastIntraday").cast("double"),
            "fc_5h_mwh": F.col("Forecast5Hour").cast("double"),
            "fc_1h_mwh": F.col("Forecast1Hour").cast("double"),
            "fc_current_mwh": F.col("ForecastCurrent").cast("double"),
            "published_utc": F.col("TimestampUTC").cast("timestamp_ntz"),
        },
        order,
    )


def stg_imbalance(raw: DataFrame, order: Sequence[str] = (FETCH,)) -> DataFrame:
    return typed_latest(
        raw,
        {"area": F.col("PriceArea"), "hour_utc": F.col("HourUTC").cast("timestamp_ntz")},
        {
            "imbalance_mwh": F.col("ImbalanceMWh").cast("double"),
            "imbalance_price_eur": F.col("ImbalancePriceEUR").cast("double"),
            "balancing_up_eur": F.col("BalancingPowerPriceUpEUR").cast("double"),
            "balancing_down_eur": F.col("BalancingPowerPriceDownEUR").cast("double"),
            "mfrr_up_mwh": F.col("mFRRUpActBal").cast("double"),
            "mfrr_down_mwh": F.col("mFRRDownActBal").cast("double"),
        },
        order,
    )


def stg_realtime(raw: DataFrame, order: Sequence[str] = (FETCH,)) -> DataFrame:
    return typed_latest(
        raw,
        {"area": F.col("PriceArea"), "minute_utc": F.col("Minutes5UTC").cast("timestamp_ntz")},
        {
            "onshore_wind_mw": F.col("OnshoreWindPower").cast("double"),
            "offshore_wind_mw": F.col("OffshoreWindPower").cast("double"),
            "solar_mw": F.col("SolarPower").cast("double"),
        },
        order,
    )


def prices(elspot: DataFrame, dayahead: DataFrame, fx: DataFrame, seam: Column) -> DataFrame:
    """All instruments in one schema at native resolution with the stamp of their fetch, power stitched at the seam."""

    def power(df: DataFrame, source: str) -> DataFrame:
        return df.select(
            F.concat("area", F.lit("_DA")).alias("instrument"),
            "area",
            "interval_start_utc",
            "interval_minutes",
            F.col("price_eur").alias("value"),
            F.lit("EUR/MWh").alias("unit"),
            F.lit(source).alias("source"),
            FETCH,
        )

    stitched = grid.stitch(power(elspot, "Elspotprices"), power(dayahead, "DayAheadPrices"), "interval_start_utc", seam)
    rates = fx.select(
        F.concat("denominator", "currency").alias("instrument"),
        F.lit(None).cast("string").alias("area"),
        tc.midnight("rate_date").alias("interval_start_utc"),
        F.lit(1440).alias("interval_minutes"),
        F.col("rate").alias("value"),
        F.concat("currency", F.lit(" per "), "denominator").alias("unit"),
        F.lit("ECB").alias("source"),
        FETCH,
    )
    return stitched.unionByName(rates)


def power_hourly(prices_df: DataFrame) -> DataFrame:
    p = prices_df.where(F.col("unit") == "EUR/MWh")
    return grid.resample(p, ["area"], "interval_start_utc", "value", "price_eur", 60, label="source")


def desk_daily(
    hourly: DataFrame, fx: DataFrame, zone: str, spread: tuple[str, str], currency: str
) -> DataFrame:
    """Daily bars per area on local days, with completeness, the spread of two areas and a second currency.

    The spread needs the two areas' means of one day: a conditional aggregate over the daily table,
    joined back by day, replaces the self join.
    """
    daily = (
        hourly.withColumn("day_dk", tc.local_date("hour_utc", zone))
        .groupBy("area", "day_dk")
        .agg(
            exact_avg("price_eur").alias("avg_eur"),
            F.min("price_eur").alias("low_eur"),
            F.max("price_eur").alias("high_eur"),
            F.min_by("price_eur", "hour_utc").alias("open_eur"),
            F.max_by("price_eur", "hour_utc").alias("close_eur"),
            F.count(F.lit(1)).alias("hours"),
            F.count_if(F.col("price_eur") < 0).alias("negative_hours"),
        )
    )
    a, b = spread
    spreads = daily.groupBy("day_dk").agg(
        (F.max(F.when(F.col("area") == a, F.col("avg_eur"))) - F.max(F.when(F.col("area") == b, F.col("avg_eur")))).alias(
            "spread_eur"
        )
    )
    rate = fx.where(F.col("currency") == currency).select(F.col("rate_date").alias("day_dk"), F.col("rate").alias("fx_rate"))
    return (
        daily.withColumn("is_complete", F.col("hours").isin(23, 24, 25))
        .join(spreads, "day_dk", "left")
        .join(rate, "day_dk", "left")
        .withColumn("avg_local", F.col("avg_eur") * F.col("fx_rate"))
    )


def power_context(hourly: DataFrame, production: DataFrame) -> DataFrame:
    wind = F.col("offshore_wind_mwh") + F.col("onshore_wind_mwh")
    return hourly.join(production, ["area", "hour_utc"]).select(
        "area",
        "hour_utc",
        "price_eur",
        wind.alias("wind_mwh"),
        "solar_mwh",
        "thermal_mwh",
        "consumption_mwh",
        safe_ratio(wind, "consumption_mwh").alias("wind_share"),
    )


def _sum_type(col: str, word: str) -> Column:
    return exact_sum(F.when(F.col("forecast_type").like(f"%{word}%"), F.col(col)))


def forecast_hourly(forecasts: DataFrame, context: DataFrame) -> DataFrame:
    f = forecasts.groupBy("area", "hour_utc").agg(
        _sum_type("fc_day_ahead_mwh", "Wind").alias("wind_fc_da_mwh"),
        _sum_type("fc_intraday_mwh", "Wind").alias("wind_fc_id_mwh"),
        _sum_type("fc_5h_mwh", "Wind").alias("wind_fc_5h_mwh"),
        _sum_type("fc_1h_mwh", "Wind").alias("wind_fc_1h_mwh"),
        _sum_type("fc_day_ahead_mwh", "Solar").alias("solar_fc_da_mwh"),
    )
    return context.join(f, ["area", "hour_utc"]).select(
        "area",
        "hour_utc",
        "price_eur",
        "wind_fc_da_mwh",
        "wind_fc_id_mwh",
        "wind_fc_5h_mwh",
        "wind_fc_1h_mwh",
        "solar_fc_da_mwh",
        F.col("wind_mwh").alias("wind_actual_mwh"),
        F.col("solar_mwh").alias("solar_actual_mwh"),
        "consumption_mwh",
        (F.col("wind_mwh") - F.col("wind_fc_da_mwh")).alias("wind_err_da_mwh"),
        (F.col("wind_mwh") - F.col("wind_fc_1h_mwh")).alias("wind_err_1h_mwh"),
        safe_ratio("wind_fc_da_mwh", "consumption_mwh").alias("wind_fc_share"),
    )


def forecast_vs_imbalance(forecast: DataFrame, imbalance: DataFrame) -> DataFrame:
    i = imbalance.select("area", "hour_utc", "imbalance_price_eur", "imbalance_mwh")
    return forecast.join(i, ["area", "hour_utc"]).select(
        "area",
        "hour_utc",
        "price_eur",
        "wind_err_da_mwh",
        "wind_err_1h_mwh",
        "wind_fc_da_mwh",
        "wind_actual_mwh",
        "imbalance_price_eur",
        "imbalance_mwh",
        (F.col("imbalance_price_eur") - F.col("price_eur")).alias("imbalance_minus_spot_eur"),
    )


def wind_versions(forecasts: DataFrame, realtime: DataFrame, production: DataFrame) -> DataFrame:
    """Six versions of each hour side by side on the union of their hours."""
    f = (
        forecasts.where(F.col("forecast_type").like("%Wind%"))
        .groupBy("area", "hour_utc")
        .agg(
            exact_sum("fc_day_ahead_mwh").alias("v_day_ahead"),
            exact_sum("fc_intraday_mwh").alias("v_intraday"),
            exact_sum("fc_5h_mwh").alias("v_5h"),
            exact_sum("fc_1h_mwh").alias("v_1h"),
        )
    )
    r = grid.resample_complete_readings(
        realtime, ["area"], "minute_utc", ["onshore_wind_mw", "offshore_wind_mw"], "v_realtime", "realtime_readings"
    )
    s = production.select("area", "hour_utc", (F.col("offshore_wind_mwh") + F.col("onshore_wind_mwh")).alias("v_settled"))
    keys = ["area", "hour_utc"]
    joined = key_union(keys, f, r, s).join(f, keys, "left").join(r, keys, "left").join(s, keys, "left")
    cols = [c for _, c in VERSIONS]
    return (
        joined.select(
            *keys,
            *cols[:5],
            F.coalesce("realtime_readings", F.lit(0)).alias("realtime_readings"),
            "v_settled",
            presence_count(*cols).alias("versions_present"),
        )
        .where(F.col("versions_present") > 0)
    )


def wind_versions_long(wide: DataFrame) -> DataFrame:
    """One row per present version; the settled value rides along in the row, so no self join."""
    labels = F.array(
        *[
            F.struct(
                F.lit(name).alias("version"),
                F.lit(i + 1).alias("rank"),
                F.lit(name in TRADABLE).alias("tradable"),
                F.col(col).alias("value_mwh"),
            )
            for i, (name, col) in enumerate(VERSIONS)
        ]
    )
    return (
        wide.select("area", "hour_utc", F.col("v_settled").alias("settled_mwh"), F.explode(labels).alias("x"))
        .select("area", "hour_utc", "x.*", "settled_mwh")
        .where(F.col("value_mwh").isNotNull())
        .withColumn("diff_vs_settled_mwh", F.col("value_mwh") - F.col("settled_mwh"))
    )


def activation_hours(imbalance: DataFrame, hourly: DataFrame, single_from: Column, separate_from: Column) -> DataFrame:
    """Per area and hour on a full grid: which side was activated, at what premium, for what part of the hour."""
    keys = ["area", "hour_utc"]
    raw = imbalance.select(
        *keys,
        F.col("balancing_up_eur").alias("up_eur"),
        F.col("balancing_down_eur").alias("down_eur"),
        F.col("imbalance_price_eur").alias("imbalance_eur"),
        "imbalance_mwh",
        "mfrr_up_mwh",
        "mfrr_down_mwh",
    ).join(hourly.select(*keys, F.col("price_eur").alias("spot_eur")), keys)
    g = grid.complete_grid(
        raw.where(F.col("up_eur").isNotNull() & F.col("down_eur").isNotNull() & F.col("spot_eur").isNotNull()),
        ["area"],
        "hour_utc",
    )
    up_v = F.coalesce("mfrr_up_mwh", F.lit(0.0))
    down_v = F.abs(F.coalesce("mfrr_down_mwh", F.lit(0.0)))
    eps = F.lit(1e-9)
    up = F.coalesce((F.col("up_eur") > F.col("spot_eur") + eps) & (up_v > 0), F.lit(False))
    down = F.coalesce((F.col("down_eur") < F.col("spot_eur") - eps) & (down_v > 0), F.lit(False))
    return (
        g.withColumn("up_frac", F.least(F.lit(1.0), up_v / 60.0))
        .withColumn("down_frac", F.least(F.lit(1.0), down_v / 60.0))
        .withColumn(
            "dir",
            F.when(F.col("imbalance_eur").isNull(), F.lit(None).cast("double"))
            .when(F.col("imbalance_eur") > F.col("spot_eur") + eps, 1.0)
            .when(F.col("imbalance_eur") < F.col("spot_eur") - eps, -1.0)
            .otherwise(0.0),
        )
        .withColumn("up_activated", up)
        .withColumn("down_activated", down)
        .withColumn("up_premium", F.when(up, F.col("up_eur") - F.col("spot_eur")).otherwise(0.0))
        .withColumn("down_discount", F.when(down, F.col("spot_eur") - F.col("down_eur")).otherwise(0.0))
        .withColumn("single_pricing", F.col("hour_utc") >= single_from)
        .withColumn("period", F.when(F.col("hour_utc") < separate_from, "training").otherwise("separate"))
    )


def decision_hours(
    forecast: DataFrame, imbalance: DataFrame, single_from: Column, separate_from: Column
) -> DataFrame:
    """What a desk knew at the gate (settled hours up to t-2) beside the outcome of hour t, on a full grid."""
    keys = ["area", "hour_utc"]
    base = (
        forecast.select(
            *keys, "price_eur", "wind_fc_da_mwh", "wind_fc_id_mwh", "wind_fc_5h_mwh", "wind_fc_1h_mwh", "wind_actual_mwh",
            "consumption_mwh", "solar_fc_da_mwh",
        )
        .join(imbalance.select(*keys, "imbalance_price_eur", "mfrr_up_mwh", "mfrr_down_mwh", "imbalance_mwh"), keys)
        .withColumn("gap", F.col("imbalance_price_eur") - F.col("price_eur"))
        .where(F.col("gap").isNotNull())
    )
    g = grid.complete_grid(base, ["area"], "hour_utc")
    w = Window.partitionBy("area").orderBy("hour_utc")
    sgn = F.signum("gap")
    act = F.coalesce("mfrr_up_mwh", F.lit(0.0)) - F.coalesce("mfrr_down_mwh", F.lit(0.0))
    x = (
        g.withColumn("gap2", F.lag("gap", 2).over(w))
        .withColumn("sgn2", F.lag(sgn, 2).over(w))
        .withColumn("settled2", F.col("gap2").isNotNull())
        .withColumn("abs_gap2", F.abs("gap2"))
        .withColumn("net_act2", F.lag(act, 2).over(w))
        .withColumn("imb2", F.lag("imbalance_mwh", 2).over(w))
        .withColumn("_nz2", F.when(F.col("sgn2") != 0, F.col("sgn2")))
    )
    x = trailing.forward_fill(x, ["area"], "hour_utc", "_nz2", 12, "dir")
    x = x.withColumn("dir_age", F.col("dir_age") + 2)
    x = trailing.sign_run_length(x, ["area"], "hour_utc", "sgn2", "run2")
    x = trailing.rolling_median(x, ["area"], "hour_utc", "abs_gap2", 6, 3, "med_abs_gap6")
    s, c = tc.cyclic(F.hour("hour_utc"), 24)
    return (
        x.withColumn("rev5", F.col("wind_fc_5h_mwh") - F.col("wind_fc_da_mwh"))
        .withColumn("fc_share", F.try_divide("wind_fc_da_mwh", "consumption_mwh"))
        .withColumn("hod_sin", s)
        .withColumn("hod_cos", c)
        .withColumn("y", sgn)
        .withColumn("single_pricing", F.col("hour_utc") >= single_from)
        .withColumn("period", F.when(F.col("hour_utc") < separate_from, "training").otherwise("separate"))
        .drop("_nz2", "sgn2", "mfrr_up_mwh", "mfrr_down_mwh", "imbalance_mwh")
    )
