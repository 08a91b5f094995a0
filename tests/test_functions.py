import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.functions import exact, names, numbers
from gridtide.functions import timecols as tc
from gridtide.operators import publication

NY = "America/New_York"


def ts(text):
    return dt.datetime.fromisoformat(text)


def one(df, expr):
    return df.select(expr.alias("x")).first()[0]


@pytest.fixture(scope="module")
def row(spark):
    return spark.range(1)


def test_hour_floor_is_independent_of_the_session_zone(spark, row):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", NY)
        # 02:30 does not exist as New York wall time on this day
        assert one(row, tc.hour_floor(tc.ntz("2024-03-10 02:30:15"))) == ts("2024-03-10 02:00:00")
        assert one(row, tc.floor_minutes(tc.ntz("2024-03-10 02:44:59"), 15)) == ts("2024-03-10 02:30:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_decision_time_is_wall_clock_on_clock_change_days(row):
    d = lambda s: F.lit(s).cast("date")
    assert one(row, tc.decision_time(d("2024-03-10"), NY)) == ts("2024-03-10 09:00:00")  # 05:00 EDT
    assert one(row, tc.decision_time(d("2024-03-09"), NY)) == ts("2024-03-09 10:00:00")  # 05:00 EST


def test_first_usable_day_counts_the_exact_deadline(row):
    assert one(row, tc.first_usable_day(tc.ntz("2024-01-10 10:00:00"), NY)) == dt.date(2024, 1, 10)
    assert one(row, tc.first_usable_day(tc.ntz("2024-01-10 10:00:01"), NY)) == dt.date(2024, 1, 11)


def test_fall_back_twins_and_skipped_hours(spark):
    df = spark.createDataFrame(
        [(1, "2024-11-03 01:30:00"), (2, "2024-11-03 01:30:00"), (3, "2024-03-10 02:30:00"), (4, "2024-07-01 12:00:00")], "n int, t string"
    ).select("n", F.col("t").cast("timestamp_ntz").alias("t"), F.lit("a").alias("k"))
    got = {r.n: (r.instant_utc, r.missing_wall) for r in publication.localize_wall(df, "t", ["k"], "n", NY).collect()}
    assert got[1] == (ts("2024-11-03 05:30:00"), False)
    assert got[2] == (ts("2024-11-03 06:30:00"), False)
    assert got[3][1] is True
    assert got[4] == (ts("2024-07-01 16:00:00"), False)
    later = df.select("n", publication.localize_conservative(F.col("t"), NY).alias("u"))
    assert {r.n: r.u for r in later.collect()}[1] == ts("2024-11-03 06:30:00")


def test_publication_stamps(row):
    event, late = tc.ntz("2024-01-10 12:00:00"), tc.ntz("2024-01-12 00:00:00")
    none = F.lit(None).cast("timestamp_ntz")
    assert one(row, publication.publish_day_ahead(event, tc.ntz("2024-01-09 14:00:00"), NY)) == ts("2024-01-09 16:00:00")
    assert one(row, publication.publish_day_ahead(event, none, NY)) is None
    assert one(row, publication.publish_real_time(event, tc.ntz("2024-01-10 20:00:00"), NY)) == ts("2024-01-10 13:15:00")
    assert one(row, publication.publish_real_time(event, late, NY)) == ts("2024-01-12 00:00:00")
    assert one(row, publication.publish_weather(event, F.lit(48))) == ts("2024-01-08 20:00:00")


def test_holidays(row):
    d = lambda s: F.lit(s).cast("date")
    assert one(row, tc.is_us_federal_holiday(d("2021-12-31")))  # New Year 2022 fell on a Saturday
    assert one(row, tc.is_us_federal_holiday(d("2024-06-19"))) and not one(row, tc.is_us_federal_holiday(d("2019-06-19")))
    assert one(row, tc.is_nerc_holiday(d("2022-12-26"))) and not one(row, tc.is_nerc_holiday(d("2021-12-31")))
    assert one(row, tc.is_us_federal_holiday(d("2024-11-28")))


@pytest.mark.parametrize(
    "name,kv,cls,sites",
    [
        ("FARRAGUT_345KV_7W", 345, "345kv_up", ["FARRAGUT"]),
        ("HUDSONP_-FARRAGUT_345_B3402", 345, "345kv_up", ["HUDSONP", "FARRAGUT"]),
        ("STLAWRNC_230B_230D_PS 34", 230, "230kv", ["STLAWRNC"]),
        ("KERHONKS_69_KV_MK-234-FK", 69, "other_kv", ["KERHONKS"]),
        ("SCH-HQ-NYISO_LIMIT_1200", None, "other_kv", ["SCH-HQ-NYISO"]),
        ("BUCHAN_S_138KV_3", 138, "138kv", ["BUCHAN_S"]),
        ("AB_X", None, "other_kv", ["AB"]),
    ],
)
def test_equipment_names(row, name, kv, cls, sites):
    n = F.lit(name)
    assert one(row, names.voltage_kv(n)) == kv
    assert one(row, names.voltage_class(n)) == cls
    assert one(row, names.sites(n)) == sites


def test_slug_and_numbers(row):
    assert one(row, names.slug(F.lit("N.Y.C. (east)"))) == "n_y_c_east"
    assert one(row, names.decimal_comma(F.lit("-12,5"))) == -12.5
    null = F.lit(None).cast("double")
    assert one(row, numbers.clip(null, -1, 1)) is None
    assert one(row, numbers.later_of(null, F.lit(2.0))) == 2.0
    assert one(row, numbers.safe_ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(row, numbers.nan_to_null(F.lit(float("nan")))) is None


def test_means_of_small_values_keep_their_digits(spark):
    df = spark.createDataFrame([(0.00003,), (0.00005,), (None,)], "x double")
    assert one(df, exact.exact_avg("x")) == pytest.approx(4e-5, abs=1e-15)
    assert one(df, exact.exact_sum("x")) == pytest.approx(8e-5, abs=1e-15)


def test_large_sums_do_not_overflow(spark):
    df = spark.range(70_000).select(F.lit(1.4e10).alias("x"))
    assert one(df, exact.exact_sum("x")) == 9.8e14
    wide = spark.range(1000).select(F.lit(9e15).alias("x"))
    assert one(wide, exact.exact_sum("x")) == pytest.approx(9e18, rel=1e-15)
    assert one(wide, exact.exact_avg("x")) == 9e15


def test_sums_of_values_without_units(spark):
    nan, inf = float("nan"), float("inf")

    def both(*values):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        return str(one(df, exact.exact_sum("x"))), str(one(df, exact.exact_avg("x")))

    assert both(nan, 1.0) == ("nan", "nan") and both(inf, 1.0, None) == ("inf", "inf")
    assert both(inf, -inf) == ("nan", "nan") and both(-inf, 2.0) == ("-inf", "-inf")
    assert both(1e19, 1.0) == ("1e+19", "5e+18") and both(1e300, 1e300) == ("2e+300", "1e+300")
    assert both(None, None) == ("None", "None") and both() == ("None", "None")


def test_sums_are_rounded_once(spark):
    import math
    from fractions import Fraction

    values = [0.1] * 10 + [1 / 3, -2e9 / 7, 123456.789, -0.25, 5e-2]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert one(df, exact.exact_sum("x")) == float(sum(map(Fraction, values))) == math.fsum(values)
    tiny = spark.createDataFrame([(3e-11,), (3e-11,)], "x double")
    assert one(tiny, exact.exact_avg("x")) == pytest.approx(3e-11, abs=2**-50)
    window = Window.partitionBy(F.lit(1))
    assert df.select(exact.exact_sum_over("x", window)).first()[0] == math.fsum(values)


def test_units_of_a_value_without_units_are_an_error(spark):
    with pytest.raises(Exception, match="no exact units"):
        spark.createDataFrame([(float("nan"),)], "x double").select(exact.fixed("x")).collect()


def test_sums_do_not_depend_on_partitioning(spark):
    df = spark.range(1000).select((F.rand(3) * 1000 - 500).alias("x"))
    whole = df.collect()
    again = spark.createDataFrame(whole[::-1], "x double").repartition(7)
    assert one(again, exact.exact_sum("x")) == one(spark.createDataFrame(whole, "x double"), exact.exact_sum("x"))


def test_exact_aggregates_add_whole_numbers(spark):
    """Sums and means of groups are those of the units, rounded once, and no row is turned into a decimal."""
    import struct
    from fractions import Fraction

    from gridtide.functions import exact

    groups = {
        1: [0.1, 0.2, -0.3, 5e-16, -0.0], 2: [1e17, 3.3, -1e17, 7.7e17] * 3, 3: [2.0**52 + 1, 0.5, 0.25], 4: [-(2.0**52) - 1, -0.75, 2.0**-50], 5: [None, None], 6: [None, -1.5, 2.0**-51],
        7: [9.99e17] * 40, 8: [12345.67] * 41 + [-0.01], 9: [-12345.678, 12345.678, -(2.0**-49)],
    }
    odd = {20: [float("nan"), 1.0], 21: [float("inf"), 1.0], 22: [1e18, 1.0], 23: [1e300, -1e300]}
    rows = [(g, x) for g, xs in (groups | odd).items() for x in xs]
    got = spark.createDataFrame(rows, "g int, x double").repartition(4).groupBy("g").agg(exact.exact_sum("x").alias("s"), exact.exact_avg("x").alias("m"))
    assert "as decimal(18,0)" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = {r.g: (r.s, r.m) for r in got.collect()}
    for g, xs in groups.items():
        units = [int(x) * 2**50 + int((x - int(x)) * 2.0**50) for x in xs if x is not None]
        if not units:
            assert got[g] == (None, None)
            continue
        total = float(sum(units))
        assert struct.pack("<2d", *got[g]) == struct.pack("<2d", total / 2**50, total / (len(units) * 2.0**50))
        assert abs(Fraction(got[g][0]) - Fraction(sum(units), 2**50)) <= Fraction(abs(got[g][0])) * Fraction(1, 2**53)
    assert all(x != x for x in got[20]) and got[21] == (float("inf"),) * 2 and got[22] == (1e18 + 1.0, (1e18 + 1.0) / 2) and got[23] == (0.0, 0.0)
