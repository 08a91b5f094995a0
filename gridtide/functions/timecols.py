"""Wall-clock and calendar columns.

All instants are UTC ``timestamp_ntz``.  Nothing here depends on the session time zone: truncation
works on the fields of the value and zone changes use ``convert_timezone`` on NTZ values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UTC = "UTC"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(text: str) -> Column:
    """A zone-free timestamp literal; compares with parquet NTZ columns without a cast."""
    return F.expr(f"timestamp_ntz '{text}'")


def floor_minutes(c: Column | str, minutes: int) -> Column:
    """Start of the ``minutes``-wide slot of the hour (1..60, a divisor of 60)."""
    c = _col(c)
    minute = F.floor(F.minute(c) / F.lit(minutes)).cast("int") * F.lit(minutes) if minutes < 60 else F.lit(0)
    return F.call_function(
        "make_timestamp_ntz", F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), minute, F.lit(0).cast("decimal(8,6)")
    )


def hour_floor(c: Column | str) -> Column:
    return floor_minutes(c, 60)


def day_of(c: Column | str) -> Column:
    return _col(c).cast("date")


def month_start(c: Column | str) -> Column:
    return F.trunc(_col(c).cast("date"), "MM")


def quarter_start(c: Column | str) -> Column:
    return F.trunc(_col(c).cast("date"), "quarter")


def midnight(d: Column | str) -> Column:
    """00:00 of a date as NTZ."""
    return _col(d).cast("timestamp_ntz")


def to_local(c: Column | str, zone: str) -> Column:
    return F.convert_timezone(F.lit(UTC), F.lit(zone), _col(c))


def to_utc(c: Column | str, zone: str) -> Column:
    """Wall clock to UTC; a repeated hour takes the earlier instant, a missing one shifts forward."""
    return F.convert_timezone(F.lit(zone), F.lit(UTC), _col(c))


def local_date(c: Column | str, zone: str) -> Column:
    return to_local(c, zone).cast("date")


def local_hour(c: Column | str, zone: str) -> Column:
    return F.hour(to_local(c, zone))


def hours(n: Column | int | float) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(F.lit(0), n.cast("int"), F.lit(0), F.lit(0).cast("decimal(18,6)"))


def days(n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(n.cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(18,6)"))


def seconds(n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def epoch_seconds(c: Column | str) -> Column:
    """Whole seconds since 1970 of an NTZ value, computed without the session zone."""
    c = _col(c)
    return (
        F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
        + F.hour(c).cast("bigint") * 3600
        + F.minute(c).cast("bigint") * 60
        + F.second(c).cast("bigint")
    )


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return epoch_seconds(later) - epoch_seconds(earlier)


def decision_time(day: Column | str, zone: str, hour: int = 5, minute: int = 0) -> Column:
    """The wall-clock deadline of a local day as a UTC instant (not midnight plus elapsed hours)."""
    local = midnight(day) + F.make_dt_interval(
        F.lit(0), F.lit(hour), F.lit(minute), F.lit(0).cast("decimal(18,6)")
    )
    return to_utc(local, zone)


def first_usable_day(published: Column | str, zone: str, hour: int = 5) -> Column:
    """First local day whose deadline is at or after the publication; exactly on time counts."""
    local = to_local(published, zone)
    day = local.cast("date")
    deadline = midnight(day) + hours(hour)
    return F.when(local <= deadline, day).otherwise(F.date_add(day, 1))


def lead_days(target: Column | str, issue: Column | str) -> Column:
    return F.datediff(_col(target), _col(issue))


def iso_week_parity(c: Column | str) -> Column:
    """1 for odd ISO weeks, 0 for even ones."""
    return F.weekofyear(_col(c)) % 2


def season(c: Column | str) -> Column:
    m = F.month(_col(c))
    return (
        F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")
    )


def half_year(c: Column | str) -> Column:
    return F.concat(F.year(_col(c)).cast("string"), F.when(F.month(_col(c)) <= 6, "H1").otherwise("H2"))


def quarter_label(c: Column | str) -> Column:
    return F.concat(F.year(_col(c)).cast("string"), F.lit("Q"), F.quarter(_col(c)).cast("string"))


def cyclic(c: Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of a position in a cycle."""
    angle = F.lit(2.0) * F.pi() * c / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def weekday(c: Column | str) -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(_col(c))


def is_weekend(c: Column | str) -> Column:
    return weekday(c) >= 5


def _nth_weekday(year: Column, month: int, dow: int, n: int) -> Column:
    """Date of the n-th given weekday (0 = Monday) of a month; n = -1 is the last one."""
    if n > 0:
        first = F.make_date(year, F.lit(month), F.lit(1))
        return F.date_add(first, F.pmod(F.lit(dow) - F.weekday(first), F.lit(7)) + F.lit(7 * (n - 1)))
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(dow), F.lit(7)))


def _observed(day: Column, sunday_only: bool) -> Column:
    """Sunday holidays move to Monday; with the federal rule Saturday ones move to Friday."""
    moved = F.when(F.weekday(day) == 6, F.date_add(day, 1))
    if not sunday_only:
        moved = moved.when(F.weekday(day) == 5, F.date_sub(day, 1))
    return moved.otherwise(day)


def is_us_federal_holiday(c: Column | str) -> Column:
    """US federal holidays with weekend observance, Juneteenth from 2021."""
    d = _col(c).cast("date")

    def on(month: int, day: int, year_shift: int = 0) -> Column:
        return _observed(F.make_date(F.year(d) + F.lit(year_shift), F.lit(month), F.lit(day)), False)

    y = F.year(d)
    juneteenth = (y >= 2021) & (d == on(6, 19))
    return (
        (d == on(1, 1))
        | (d == on(1, 1, 1))
        | (d == _nth_weekday(y, 1, 0, 3))
        | (d == _nth_weekday(y, 2, 0, 3))
        | (d == _nth_weekday(y, 5, 0, -1))
        | juneteenth
        | (d == on(7, 4))
        | (d == _nth_weekday(y, 9, 0, 1))
        | (d == _nth_weekday(y, 10, 0, 2))
        | (d == on(11, 11))
        | (d == _nth_weekday(y, 11, 3, 4))
        | (d == on(12, 25))
    )


def is_nerc_holiday(c: Column | str) -> Column:
    """Grid-operator off-peak holidays: six days, Sunday moves to Monday."""
    d = _col(c).cast("date")
    y = F.year(d)

    def fixed_day(month: int, day: int) -> Column:
        return _observed(F.make_date(y, F.lit(month), F.lit(day)), True)

    return (
        (d == fixed_day(1, 1))
        | (d == _nth_weekday(y, 5, 0, -1))
        | (d == fixed_day(7, 4))
        | (d == _nth_weekday(y, 9, 0, 1))
        | (d == _nth_weekday(y, 11, 3, 4))
        | (d == fixed_day(12, 25))
    )


def floor_second(c: Column | str) -> Column:
    c = _col(c)
    return F.call_function(
        "make_timestamp_ntz", F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c), F.second(c).cast("decimal(8,6)")
    )
