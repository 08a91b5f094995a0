"""Small numeric expressions: null-safe sums, ratios, clipping, unit changes, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_safe_sum(*cols: Column | str) -> Column:
    """Sum with missing parts counted as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(_col(c), F.lit(0.0)) for c in cols])


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num/den where the denominator is positive, else null."""
    return F.when(_col(den) > 0, _col(num) / _col(den))


def ieee_divide(num: Column | str, den: Column | str) -> Column:
    """num/den of doubles by IEEE rules: infinite for a zero denominator (its sign counts), NaN for zero by zero."""
    num, den = _col(num), _col(den)
    return F.when(den == 0, num * F.pow(den, F.lit(-1.0))).otherwise(F.try_divide(num, den))


def presence_count(*cols: Column | str) -> Column:
    return reduce(lambda a, b: a + b, [_col(c).isNotNull().cast("int") for c in cols])


def later_of(*cols: Column | str) -> Column:
    """Null-skipping maximum."""
    return F.greatest(*[_col(c) for c in cols])


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Bound a value; null stays null (greatest/least skip nulls, so it is guarded)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(float(hi))), F.lit(float(lo))))


def row_range(*cols: Column | str) -> Column:
    cs = [_col(c) for c in cols]
    return F.greatest(*cs) - F.least(*cs)


def fahrenheit(c: Column | str) -> Column:
    return _col(c) * F.lit(9.0) / F.lit(5.0) + F.lit(32.0)


def heating_degrees(c: Column | str, base: float = 65.0) -> Column:
    return F.when(_col(c).isNotNull(), F.greatest(F.lit(base) - _col(c), F.lit(0.0)))


def cooling_degrees(c: Column | str, base: float = 65.0) -> Column:
    return F.when(_col(c).isNotNull(), F.greatest(_col(c) - F.lit(base), F.lit(0.0)))


def recency_weight(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_days / F.lit(float(half_life)))


def nan_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def sign_word(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c > 0, "positive").when(c < 0, "negative").otherwise("zero")
