"""Order-independent sums and means.

Adding doubles gives a result that depends on the order in which partitions are merged, so the same query can differ in
its last bits between two runs.  Here a value is a whole number of units of 2^-50: exact for every double from 8 to
10^18, and within 2^-50 below.  Units are added as whole numbers, so the result does not depend on partitioning or retries, and
it is rounded to a double once (a mean twice: when its sum becomes a double, and when that is divided).  Sums of units have room
for 8 * 10^22.  Aggregates of groups add four parts of the units as 64-bit numbers; windows add decimals.

NaN, infinities and values of 10^18 and more have no units; an aggregate that meets one is the plain sum or mean of doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 2**50


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _units(x: Column) -> Column:
    """The value in units (decimal), null where it has none."""
    whole = x.try_cast("bigint")
    rest = ((x - whole) * F.lit(float(UNITS))).try_cast("bigint")
    return whole.try_cast("decimal(18,0)") * F.lit(UNITS).cast("decimal(16,0)") + rest.cast("decimal(16,0)")


def fixed(c: Column | str) -> Column:
    """The value as a whole number of units (decimal); an error for NaN, infinities and values of 10^18 and more."""
    x = _col(c).cast("double")
    return F.when(x.isNotNull(), F.coalesce(_units(x), F.raise_error(F.lit("no exact units for this value")).cast("decimal(38,0)")))


def as_double(units: Column) -> Column:
    """The nearest double to a whole number of units (not yet divided by them)."""
    return units.cast("string").cast("double")


def rounded(c: Column | str, scale: int = 4) -> Column:
    """The value rounded to ``scale`` digits by plain double arithmetic (halves up)."""
    return F.floor(_col(c) * F.lit(float(10**scale)) + F.lit(0.5)).cast("double") / F.lit(float(10**scale))


def value_of(units: Column) -> Column:
    """A sum of ``fixed`` counts as a value."""
    return as_double(units) / F.lit(float(UNITS))


def mean_of(units: Column, n: Column) -> Column:
    """A sum of ``fixed`` counts over a number of values, as a mean."""
    return as_double(units) / (n.cast("double") * F.lit(float(UNITS)))


def _sum(c: Column | str, over: Callable[[Column], Column]) -> Column:
    x = _col(c).cast("double")
    has_units = over(F.max(F.abs(x))) < F.lit(float(10**18))
    return F.when(has_units, value_of(over(F.sum(_units(x))))).otherwise(over(F.sum(x)))


def _mean(c: Column | str, over: Callable[[Column], Column]) -> Column:
    x = _col(c).cast("double")
    has_units = over(F.max(F.abs(x))) < F.lit(float(10**18))
    return F.when(has_units, mean_of(over(F.sum(_units(x))), over(F.count(x)))).otherwise(over(F.avg(x)))


def _unit_parts(x: Column) -> list[Column]:
    """The value in units as four whole numbers of at most 31 bits, by falling weight: 2^80, 2^50, 2^25, 1. Null where it has none.
    Their sums as 64-bit numbers have room for 8 * 10^9 rows, and need no decimal per row."""
    whole = F.when(F.abs(x) < F.lit(float(10**18)), x.try_cast("bigint"))
    rest = ((x - whole) * F.lit(float(UNITS))).try_cast("bigint")
    low = lambda y, bits: y.bitwiseAND(F.lit(2**bits - 1))
    return [F.shiftright(whole, 30), low(whole, 30), F.shiftright(rest, 25), low(rest, 25)]


def _double_of(p: list[Column]) -> Column:
    """The nearest double to a number of units given by sums of ``_unit_parts``. While the whole part is below 2^52, both parts are
    doubles and adding them rounds once; a larger one goes by decimals."""
    rest = p[2] + F.shiftright(p[3], 25)
    whole = F.shiftleft(p[0], 30) + p[1] + F.shiftright(rest, 25)
    below = F.shiftleft(rest.bitwiseAND(F.lit(2**25 - 1)), 25) + p[3].bitwiseAND(F.lit(2**25 - 1))
    by, dec = [F.lit(2**30).cast("decimal(10,0)"), F.lit(UNITS).cast("decimal(16,0)"), F.lit(2**25).cast("decimal(8,0)")], [x.cast("decimal(19,0)") for x in p]
    large = (dec[0] * by[0] + dec[1]) * by[1] + dec[2] * by[2] + dec[3]
    fits = (F.abs(p[0]) < F.lit(2**21)) & (F.abs(p[1]) < F.lit(2**51)) & (F.abs(p[2]) < F.lit(2**61))
    return F.when(fits, whole.cast("double") * F.lit(float(UNITS)) + below.cast("double")).otherwise(as_double(large))


def _has_units(x: Column) -> Column:
    return F.max(F.abs(x)) < F.lit(float(10**18))  # NaN is above all


def exact_sum(c: Column | str) -> Column:
    x = _col(c).cast("double")
    return F.when(_has_units(x), _double_of([F.sum(p) for p in _unit_parts(x)]) / F.lit(float(UNITS))).otherwise(F.sum(x))


def exact_avg(c: Column | str) -> Column:
    """Mean of the non-null values; null for an empty set."""
    x = _col(c).cast("double")
    n = F.count(x)
    mean = _double_of([F.sum(p) for p in _unit_parts(x)]) / (n.cast("double") * F.lit(float(UNITS)))
    return F.when(_has_units(x), mean).otherwise(F.try_divide(F.sum(x), n))


def mean_parts(c: Column | str, name: str) -> dict[str, Column]:
    """Aggregates of parts of a group, from which ``mean_of_parts`` makes the ``exact_avg`` of the whole."""
    x = _col(c).cast("double")
    return {f"{name}_max": F.max(F.abs(x)), f"{name}_units": F.sum(_units(x)), f"{name}_n": F.count(x), f"{name}_sum": F.sum(x)}


def mean_of_parts(name: str) -> Column:
    n = F.sum(f"{name}_n")
    return F.when(F.max(f"{name}_max") < F.lit(float(10**18)), mean_of(F.sum(f"{name}_units"), n)).otherwise(F.try_divide(F.sum(f"{name}_sum"), n))


def exact_sum_over(c: Column | str, window) -> Column:
    return _sum(c, lambda a: a.over(window))


def exact_avg_over(c: Column | str, window) -> Column:
    return _mean(c, lambda a: a.over(window))


def _prefix_difference(agg: Column, ordered, first: int, last: int) -> Column:
    """An integer aggregate over RANGE first..last as the difference of two growing frames.

    Spark re-adds every row of a sliding frame for each output row; growing frames only add the new rows.
    With integers the difference is exact.  ``ordered`` is a window ordered by an integer day number.
    """
    from pyspark.sql import Window

    start = Window.unboundedPreceding
    upto = F.coalesce(agg.over(ordered.rangeBetween(start, last)), F.lit(0))
    before = F.coalesce(agg.over(ordered.rangeBetween(start, first - 1)), F.lit(0))
    return upto - before


def sliding_count(c: Column | str, ordered, first: int, last: int) -> Column:
    return _prefix_difference(F.count(_col(c)), ordered, first, last)


def sliding_fixed_sum(c: Column | str, ordered, first: int, last: int) -> Column:
    return _prefix_difference(F.sum(fixed(c)), ordered, first, last)


def sliding_avg(c: Column | str, ordered, first: int, last: int) -> Column:
    """Mean over the days first..last relative to the row's day; null without a value."""
    n = sliding_count(c, ordered, first, last)
    return F.when(n > 0, mean_of(sliding_fixed_sum(c, ordered, first, last), n))


def sliding_share(cond: Column, ordered, first: int, last: int) -> Column:
    """Share of the rows of the frame where a condition holds (rows where it is unknown are left out)."""
    n = sliding_count(cond, ordered, first, last)
    hits = sliding_count(F.when(cond, F.lit(1)), ordered, first, last)
    return F.when(n > 0, hits.cast("double") / n.cast("double"))
