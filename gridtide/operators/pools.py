"""Quantiles and ranks in a pool that changes from day to day: all entities' values of the last days, or those public by then.

A value belongs to the pool of every decision day from its entry to its exit, so it is two events: its count is added on the one
day and taken away on the other, whatever the length of the window.  Values are cut into ranges of about equal mass.  Per range
and decision day the running sum of the events is the pool's histogram; a running sum over the ranges of a day gives how many
pool values lie below a range.  Then only the one range that holds the wanted position, or the asking value, is opened: its
events, in order of the day, form a wavelet matrix, which answers for any day how many values lie below a value, or which value
stands at a position, in as many steps as the range's values have bits.

Rows are never multiplied by the window length.  Running sums see one range (one row per day) or one day (one row per range);
an opened range holds some ``PER_RANGE`` values or the square root of the pool's, with their events.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.operators import ranking
from gridtide.operators.joins import null_safe

PER_RANGE = 1_000


class WaveletMatrix:
    """Weighted numbers in a fixed order; questions about the first ``j`` of them, many at once."""

    def __init__(self, numbers: np.ndarray, weights: np.ndarray):
        self.bits = max(int(numbers.max(initial=0)).bit_length(), 1)
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (numbers >> bit) & 1 == 0
            places = np.concatenate(([0], np.cumsum(zero)))
            below = np.concatenate(([0], np.cumsum(np.where(zero, weights, 0))))
            self.levels.append((bit, places, below))
            order = np.concatenate((np.flatnonzero(zero), np.flatnonzero(~zero)))
            numbers, weights = numbers[order], weights[order]

    def _down(self, choose, j: np.ndarray) -> None:
        low, high = np.zeros(len(j), np.int64), j.copy()
        for bit, places, below in self.levels:
            zeros = places[-1]
            right = choose(bit, below[high] - below[low])
            low0, high0 = places[low], places[high]
            low = np.where(right, zeros + low - low0, low0)
            high = np.where(right, zeros + high - high0, high0)

    def less(self, j: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Weight of the numbers below ``number`` among the first ``j``."""
        total = np.zeros(len(j), np.int64)

        def choose(bit: int, weight: np.ndarray) -> np.ndarray:
            right = (number >> bit) & 1 == 1
            total[right] += weight[right]
            return right

        self._down(choose, j)
        return total

    def at(self, j: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The number at a 0-based position (by weight) of the first ``j`` in ascending order."""
        found, rest = np.zeros(len(j), np.int64), position.copy()

        def choose(bit: int, weight: np.ndarray) -> np.ndarray:
            right = rest >= weight
            rest[right] -= weight[right]
            found[right] |= 1 << bit
            return right

        self._down(choose, j)
        return found


def _opened(asks: pa.Table, events: pa.Table, keys: Sequence[str], asked: str) -> pa.Table:
    """One range: asks (day, a value or a position) answered from its events."""
    by = [asks.column(k) for k in keys]
    day, want = asks.column("_day").to_numpy(), asks.column(asked).to_numpy()
    if not len(events):
        answer = np.zeros(len(day), np.int64) if asked == "_value" else np.full(len(day), np.nan)
    else:
        order = np.argsort(events.column("_day").to_numpy(), kind="stable")
        when = events.column("_day").to_numpy()[order]
        values, number = np.unique(events.column("_value").to_numpy()[order], return_inverse=True)
        matrix = WaveletMatrix(number.astype(np.int64), events.column("_c").to_numpy()[order])
        j = np.searchsorted(when, day, side="right").astype(np.int64)
        if asked == "_value":
            place = np.searchsorted(values, want).astype(np.int64)
            beyond = place == len(values)
            answer = matrix.less(j, np.where(beyond, 0, place))
            if beyond.any():
                answer[beyond] = np.concatenate(([0], np.cumsum(events.column("_c").to_numpy()[order])))[j[beyond]]
        else:
            answer = values[matrix.at(j, want)]
    return pa.table({**dict(zip(keys, by, strict=True)), "_day": asks.column("_day"), asked: asks.column(asked), "_answer": pa.array(answer)})


class Pool:
    """Values (keys, day, value) that are in the pool of the decision days after their own, for ``days`` days, and not before
    the day on which they are usable."""

    def __init__(self, values: DataFrame, day: str, value: str, days: int, keys: Sequence[str] = (), usable: str | None = None):
        self.keys = list(keys)
        number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
        entry = number(day) + 1 if usable is None else F.greatest(number(day) + 1, number(usable))
        known = F.lit(True) if usable is None else F.col(usable).isNotNull()
        cells = (
            values.where(F.col(value).isNotNull() & F.col(day).isNotNull() & known)
            .groupBy(*self.keys, entry.alias("_from"), (number(day) + days + 1).alias("_to"), F.col(value).cast("double").alias("_value"))
            .agg(F.count(F.lit(1)).alias("_c"))
            .where(F.col("_from") < F.col("_to"))
        )
        rv = ranking.ranked_values(cells, self.keys, "_value")
        size = F.greatest(F.lit(float(PER_RANGE)), F.sqrt("n"))
        self.ranges = rv.select(*self.keys, "_value", F.floor(F.col("below") / size).alias("_range"))
        both = F.explode(F.array(F.struct(F.col("_from").alias("_day"), F.col("_c").alias("_c")), F.struct(F.col("_to").alias("_day"), (-F.col("_c")).alias("_c"))))
        self.events = null_safe(cells.select(*self.keys, "_value", both.alias("_e")), self.ranges, [*self.keys, "_value"]).select(
            *self.keys, "_range", "_value", "_e._day", "_e._c"
        )

    def histogram(self, asked: DataFrame, named: DataFrame | None = None) -> DataFrame:
        """(keys, _range, _day, _in, _below, _n) for the asked days (keys, _day): pool values in the range, below it, and in all;
        also for the ``named`` (keys, _range, _day) that hold none."""
        per_day = self.events.groupBy(*self.keys, "_range", "_day").agg(F.sum("_c").alias("_c"))
        span = per_day.groupBy(*self.keys, "_range").agg(F.min("_day").alias("_a"), F.max("_day").alias("_b"))
        ask = null_safe(span.select(*self.keys, "_range", F.explode(F.sequence("_a", "_b")).alias("_day")), asked.distinct(), [*self.keys, "_day"])
        ask = ask.select(*self.keys, "_range", "_day")
        if named is not None:
            ask = ask.unionByName(named.select(*self.keys, "_range", "_day")).distinct()
        line = per_day.withColumn("_ask", F.lit(False)).unionByName(ask.withColumn("_c", F.lit(0).cast("bigint")).withColumn("_ask", F.lit(True)))
        over_days = Window.partitionBy(*self.keys, "_range").orderBy("_day").rangeBetween(Window.unboundedPreceding, 0)
        held = line.withColumn("_in", F.sum("_c").over(over_days)).where("_ask").select(*self.keys, "_range", "_day", "_in")
        over_ranges = Window.partitionBy(*self.keys, "_day")
        below = F.sum("_in").over(over_ranges.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        return held.withColumn("_below", F.coalesce(below, F.lit(0))).withColumn("_n", F.sum("_in").over(over_ranges))

    def opened(self, asks: DataFrame, asked: str) -> DataFrame:
        """asks (keys, _range, _day and a value or position) with ``_answer`` from their range."""
        by = [*self.keys, "_range"]
        kind = {"_value": ("double", "bigint"), "_at": ("bigint", "double")}[asked]
        own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in asks.select(*by).schema.fields)

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            return _opened(left, right, by, asked)

        left = asks.select(*by, "_day", asked)
        right = self.events.select(*[F.col(c).alias(c) for c in (*by, "_day", "_value", "_c")])
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(answer, f"{own}_day int, {asked} {kind[0]}, _answer {kind[1]}")


def _numbered(decisions: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    return decisions.where(F.col(day).isNotNull()).select(*keys, F.datediff(day, F.lit("1970-01-01").cast("date")).alias("_day")).distinct()


def rolling_quantile(pool: Pool, decisions: DataFrame, day: str, q: float, out: str) -> DataFrame:
    """The interpolated quantile of the pool of each decision day: (keys, day, ``out``, ``n``); null for an empty pool."""
    h = pool.histogram(_numbered(decisions, pool.keys, day)).where("_in > 0")
    position = (F.col("_n") - 1).cast("double") * F.lit(float(q))
    hits = h.withColumn("_k", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))))
    hits = hits.where((F.col("_below") <= F.col("_k")) & (F.col("_k") < F.col("_below") + F.col("_in")))
    hits = hits.withColumn("_at", F.col("_k") - F.col("_below")).withColumn("_share", position - F.floor(position))
    got = null_safe(hits, pool.opened(hits, "_at"), [*pool.keys, "_range", "_day", "_at"])
    low, high = F.min_by("_answer", "_k"), F.max_by("_answer", "_k")
    value = low + (high - low) * F.max("_share")
    found = got.groupBy(*pool.keys, "_day").agg(value.alias(out), F.max("_n").alias("n"))
    days = decisions.select(*pool.keys, day).distinct().withColumn("_day", F.datediff(day, F.lit("1970-01-01").cast("date")))
    joined = null_safe(days, found, [*pool.keys, "_day"], "left")
    return joined.select(*pool.keys, day, out, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def rolling_rank(pool: Pool, rows: DataFrame, day: str, value: str) -> DataFrame:
    """Rows with ``less`` (pool values of the row's day below its own) and ``n`` (pool values); a row's value is one of the
    values that the pool ever holds, or it has null for both."""
    asks = rows.where(F.col(value).isNotNull() & F.col(day).isNotNull()).select(
        *pool.keys, F.datediff(day, F.lit("1970-01-01").cast("date")).alias("_day"), F.col(value).cast("double").alias("_value")
    ).distinct()
    asks = null_safe(asks, pool.ranges, [*pool.keys, "_value"])
    h = pool.histogram(asks.select(*pool.keys, "_day"), asks)
    got = null_safe(asks, pool.opened(asks, "_value"), [*pool.keys, "_range", "_day", "_value"])
    got = null_safe(got, h, [*pool.keys, "_range", "_day"]).select(
        *pool.keys, "_day", "_value", (F.col("_below") + F.col("_answer")).alias("less"), F.col("_n").alias("n")
    )
    own: list[Column] = [F.datediff(day, F.lit("1970-01-01").cast("date")).alias("_day"), F.col(value).cast("double").alias("_value")]
    joined = null_safe(rows.select("*", *own), got, [*pool.keys, "_day", "_value"], "left")
    return joined.drop("_day", "_value")
