"""Walk-forward linear models of any number of periods from one aggregation of moments.

A least-squares fit needs only the sums of the products of its columns.  They are added once per (month of the row, first
period that may learn from it); a training set of a period is then a running sum over periods: a row's moments are added when it
may be learned from and taken away when it leaves the window, so windows of any length cost two small rows per cell and not a
scan per refit.  Moments are exact units, so what is taken away leaves nothing behind.  A recency weight is a factor per month.

A row may teach a period if its day ended two days before the period and its label was public by the deadline on the day before
it.  Features that are missing (null or NaN) count as zero and switch on a column of their own, so every row gets a prediction.
The few normal equations (one per entity, window and period) are solved by the sweep operator; a column that earlier columns
explain gets coefficient 0.  Periods with fewer than ``least`` rows to learn from have no model.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import fixed, value_of
from gridtide.operators.grid import bounds
from gridtide.operators.joins import null_safe
from gridtide.operators.quality import refuse_labels
from gridtide.plans import selection

GAP_DAYS = 2
TOLERANCE = 1e-9
#: Months of a period and the name that ``trunc`` has for it.
UNITS = {1: "MM", 3: "quarter", 12: "year"}


def first_period_from(d: Column, months: int) -> Column:
    """First period start at or after a date."""
    start = F.trunc(d, UNITS[months])
    return F.when(start == d, start).otherwise(F.add_months(start, months))


def first_taught_period(day: Column, published: Column, zone: str, months: int) -> Column:
    """First period whose fit may learn from a row; null when its label is never public."""
    usable = tc.first_usable_day(published, zone)
    return F.when(published.isNotNull(), first_period_from(F.greatest(F.date_add(day, GAP_DAYS), F.date_add(usable, 1)), months))


def design(features: Sequence[str]) -> list[Column]:
    """Intercept, the features (0 where missing) and their missing indicators."""
    missing = [F.col(f).isNull() | F.isnan(F.col(f).cast("double")) for f in features]
    values = [F.when(m, F.lit(0.0)).otherwise(F.col(f).cast("double")) for f, m in zip(features, missing, strict=True)]
    return [F.lit(1.0), *values, *[m.cast("double") for m in missing]]


def _sweep(moments: np.ndarray, columns: int) -> np.ndarray:
    """Coefficients of many normal equations: rows of (upper triangle of products, products with the label)."""
    a = np.zeros((len(moments), columns + 1, columns + 1))
    pairs = [(i, j) for i in range(columns) for j in range(i, columns)]
    for k, (i, j) in enumerate(pairs):
        a[:, i, j] = a[:, j, i] = moments[:, k]
    a[:, :columns, columns] = moments[:, len(pairs) :]
    first = np.einsum("nii->ni", a).copy()
    swept = np.zeros((len(moments), columns), bool)
    for j in range(columns):
        pivot = a[:, j, j]
        ok = pivot > TOLERANCE * first[:, j]
        swept[:, j] = ok
        d = np.where(ok, pivot, 1.0)
        row = a[:, j, :] / d[:, None]
        step = a - a[:, :, j, None] * row[:, None, :]
        step[:, j, :] = row
        a = np.where(ok[:, None, None], step, a)
    return np.where(swept, a[:, :columns, columns], 0.0)


def _solver(columns: int):
    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = batch.column("_sums").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            got = _sweep(sums, columns)
            kept = {x: batch.column(x) for x in batch.schema.names if x != "_sums"}
            yield pa.record_batch(kept | {f"c_{i}": pa.array(got[:, i]) for i in range(columns)})

    return solve


def fits(
    rows: DataFrame,
    day: str,
    published: str,
    zone: str,
    features: Sequence[str],
    label: Column,
    months: int = 1,
    windows: Sequence[int | None] = (None,),
    keys: Sequence[str] = (),
    half_life: float | None = None,
    least: int = 30,
) -> DataFrame:
    """(keys, window, period, train_rows, c_0 ...): one model per entity, training window in months (null: everything
    earlier) and period of ``months`` months from the first to the last day of the rows. ``half_life`` in months."""
    refuse_labels(features)
    keys = list(keys)
    z = design(features)
    products = [z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))] + [x * F.col("_y") for x in z]
    names = [f"_m{i}" for i in range(len(products))]
    taught = rows.withColumn("_y", label.cast("double")).where(F.col("_y").isNotNull() & ~F.isnan("_y"))
    taught = taught.withColumn("_entry", first_taught_period(F.col(day), F.col(published), zone, months)).where(F.col("_entry").isNotNull())
    cells = taught.groupBy(*keys, "_entry", F.trunc(day, "MM").alias("_month")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(fixed(p)).alias(n) for n, p in zip(names, products, strict=True)]
    )
    if half_life is None:
        weight, number = None, "decimal(38,0)"
    else:
        months_since = F.months_between("_month", F.lit("1970-01-01").cast("date"))
        weight, number = F.pow(F.lit(2.0), months_since / F.lit(float(half_life))), "double"
    value = {n: (F.col(n) if weight is None else value_of(F.col(n)) * weight) for n in names}
    events = []
    for w in windows:
        kind = F.lit(w).cast("int").alias("window")
        steps = [F.struct(F.col("_entry").alias("period"), F.lit(1).alias("sign"))]
        if w is not None:
            leaves = first_period_from(F.date_add(F.add_months("_month", w), 1), months)
            steps.append(F.struct(leaves.alias("period"), F.lit(-1).alias("sign")))
        inside = cells if w is None else cells.where(F.col("_entry") < leaves)
        step = inside.withColumn("_s", F.explode(F.array(*steps)))
        events.append(
            step.select(*keys, kind, "_s.period", (F.col("_n") * F.col("_s.sign")).alias("_n"), *[(v * F.col("_s.sign")).cast(number).alias(n) for n, v in value.items()])
        )
    span = bounds(rows.where(F.col(day).isNotNull()), keys, day)
    calendar = selection.month_calendar(span, keys).where(F.trunc("period", UNITS[months]) == F.col("period"))
    calendar = calendar.withColumn("window", F.explode(F.array(*[F.lit(w).cast("int") for w in windows])))
    empty = calendar.select(*keys, "window", "period", F.lit(0).cast("bigint").alias("_n"), *[F.lit(0).cast(number).alias(n) for n in names], F.lit(True).alias("_ask"))
    line = reduce(DataFrame.unionByName, events).withColumn("_ask", F.lit(False)).unionByName(empty)
    per = line.groupBy(*keys, "window", "period").agg(F.sum("_n").alias("_n"), *[F.sum(n).alias(n) for n in names], F.max("_ask").alias("_ask"))
    upto = Window.partitionBy(*keys, "window").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    held = per.select(*keys, "window", "period", "_ask", F.sum("_n").over(upto).alias("train_rows"), *[F.sum(n).over(upto).alias(n) for n in names])
    sums = F.array(*[value_of(F.col(n)) if weight is None else F.col(n) for n in names])
    ready = held.where(F.col("_ask") & (F.col("train_rows") >= least)).select(*keys, "window", "period", "train_rows", sums.alias("_sums"))
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ready.schema.fields if f.name != "_sums")
    return ready.mapInArrow(_solver(len(z)), own + ", ".join(f"c_{i} double" for i in range(len(z))))


def _coefficients(models: DataFrame) -> list[str]:
    return [c for c in models.columns if c.startswith("c_")]


def last_models(models: DataFrame, keys: Sequence[str], last: int) -> DataFrame:
    """Mean model of each period and the ``last - 1`` before it: for linear models the mean of the predictions."""
    w = Window.partitionBy(*keys, "window").orderBy("period").rowsBetween(-(last - 1), 0)
    means = [F.avg(c).over(w).alias(c) for c in _coefficients(models)]
    return models.select(*keys, "window", "period", "train_rows", F.count(F.lit(1)).over(w).alias("models"), *means)


def mean_of_windows(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean model of all training windows of a period."""
    return models.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("models"), *[F.avg(c).alias(c) for c in _coefficients(models)])


def sum_of_parts(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The model of a sum of targets, each of which has a model in every part (periods that lack one have none)."""
    both = reduce(DataFrame.unionByName, parts)
    added = both.groupBy(*keys, "window", "period").agg(F.count(F.lit(1)).alias("_parts"), *[F.sum(c).alias(c) for c in _coefficients(both)])
    return added.where(F.col("_parts") == len(parts)).drop("_parts")


def predicted(rows: DataFrame, models: DataFrame, day: str, features: Sequence[str], out: str, months: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the periods that have a model, with ``period`` and the prediction; one model per (keys, period)."""
    z = design(features)
    value = reduce(lambda a, b: a + b, [F.col(c) * x for c, x in zip(_coefficients(models), z, strict=True)])
    placed = rows.withColumn("period", F.trunc(day, UNITS[months]))
    joined = null_safe(placed, models.drop("train_rows", "window"), [*keys, "period"])
    return joined.withColumn(out, value).drop(*_coefficients(models))
