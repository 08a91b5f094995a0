"""A parameterised catalogue of desk questions, answered by SQL on registered views.

A question is plain SQL with named parameters; the tables are temp views of lazy DataFrames, so the
optimizer sees the whole plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The metrics of the catalogue; {where} is the period and area filter.
METRICS = {
    "average price": "select {avg} as answer, count(*) as n from {hourly} where {where}",
    "lowest hour": "select min(price_eur) as answer, count(*) as n from {hourly} where {where}",
    "highest hour": "select max(price_eur) as answer, count(*) as n from {hourly} where {where}",
    "hours below the floor": "select cast(count_if(price_eur < 0) as double) as answer, count(*) as n from {hourly} where {where}",
    "share of hours below the floor": "select avg(cast(price_eur < 0 as double)) as answer, count(*) as n from {hourly} where {where}",
    "largest hour-to-hour jump": (
        "select max(j) as answer, count(*) as n from (select abs(price_eur - lag(price_eur) over (partition by area order by hour_utc)) as j,"
        " hour_utc, area, price_eur from {hourly}) where {where}"
    ),
}
# A sum and a mean of doubles in units of 2^-50, as in gridtide.functions.exact.
_UNITS = "(cast(cast({c} as bigint) as decimal(18,0))*cast(1125899906842624 as decimal(16,0)) + cast(cast(({c}-cast({c} as bigint))*1125899906842624D as bigint) as decimal(16,0)))"
_SUM = f"cast(cast(sum({_UNITS}) as string) as double)"
EXACT_SUM = _SUM + "/1125899906842624D"
EXACT_AVG = _SUM + "/(cast(count({c}) as double)*1125899906842624D)"


def answer(spark: SparkSession, metric: str, area: str, lo: str, hi: str, view: str) -> DataFrame:
    """One row for one metric, area and half-open period; values are bound as parameters."""
    sql = METRICS[metric].format(
        avg=EXACT_AVG.format(c="price_eur"), hourly=view, where="area = :area and hour_utc >= to_timestamp_ntz(:lo) and hour_utc < to_timestamp_ntz(:hi)"
    )
    return spark.sql(sql, args={"area": area, "lo": lo, "hi": hi})


def capped(answer: DataFrame, rows: int, order: list) -> DataFrame:
    """The first ``rows`` rows in a total order, each marked with whether the answer had more."""
    few = answer.orderBy(*order).limit(rows + 1)
    n = F.count(F.lit(1)).over(Window.partitionBy())  # over rows + 1 rows at most
    place = F.row_number().over(Window.partitionBy().orderBy(*order))
    return few.withColumn("truncated", n > rows).withColumn("_place", place).where(F.col("_place") <= rows).drop("_place")
