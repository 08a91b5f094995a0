"""Time joins expressed with equi keys so that they stay hash or sort-merge joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys match each other.

    Unlike a plain join it adds no not-null filter to either side, so two branches of one DataFrame keep
    the same plan and Spark runs their common shuffle once.
    """
    r = right.withColumnsRenamed({k: f"_rk_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_rk_{k}")) for k in keys])
    return left.join(r, cond, how).drop(*[f"_rk_{k}" for k in keys])


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    tie_break: str,
    tolerance_seconds: int | None = None,
    slot_seconds: int = 300,
) -> DataFrame:
    """Each left row with the newest right row at or before it (same key; null keys match each other).

    Both sides are unioned and the last right row is carried forward on three levels: inside a slot of
    ``slot_seconds`` of a (key, day), over the slots of a day (one row per slot), and over the days of a key (one row per
    day).  A key or a single (key, day) with a very large share of the rows is therefore split, and not sorted in one task.
    """
    payload = F.struct(F.col(right_ts).alias("_rts"), F.col(tie_break).alias("_rtb"), *[F.col(v) for v in values])
    r = right.select(*keys, F.col(right_ts).alias("_ts"), payload.alias("_r"), F.lit(None).cast(left.schema.simpleString()).alias("_l"))
    l = left.select(
        *keys,
        F.col(left_ts).alias("_ts"),
        F.lit(None).cast(r.schema["_r"].dataType).alias("_r"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_l"),
    )
    slot = F.floor(tc.epoch_seconds("_ts") / F.lit(slot_seconds))
    both = r.unionByName(l).withColumn("_day", tc.day_of("_ts")).withColumn("_slot", slot)
    at = [*keys, "_day", "_slot"]
    # right rows sort before left rows at the same instant, so an exact match counts
    order = [F.col("_ts"), F.col("_r").isNull(), F.col("_r._rtb")]
    in_slot = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # plain max of the struct of non-null right rows: newest stamp, then largest tie-break
    newest = F.max(F.when(F.col("_r").isNotNull(), F.struct("_r._rts", "_r._rtb", "_r")))
    per_slot = both.groupBy(*at).agg(newest.alias("_m"))
    per_day = per_slot.groupBy(*keys, "_day").agg(F.max("_m").alias("_m"))
    earlier_days = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    earlier_slots = Window.partitionBy(*keys, "_day").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    days = per_day.withColumn("_before_day", F.last("_m", ignorenulls=True).over(earlier_days)).drop("_m")
    slots = per_slot.withColumn("_before_slot", F.last("_m", ignorenulls=True).over(earlier_slots)).drop("_m")
    before = F.coalesce("_before_slot", "_before_day")
    known = null_safe(slots, days, [*keys, "_day"]).select(*at, before["_r"].alias("_before"))
    out = (
        null_safe(both.withColumn("_in_slot", F.last("_r", ignorenulls=True).over(in_slot)).where(F.col("_l").isNotNull()), known, at, "left")
        .withColumn("_hit", F.coalesce("_in_slot", "_before"))
    )
    if tolerance_seconds is not None:
        out = out.withColumn(
            "_hit", F.when(tc.seconds_between(F.col("_ts"), F.col("_hit._rts")) <= tolerance_seconds, F.col("_hit"))
        )
    return out.select("_l.*", F.col("_hit._rts").alias(f"asof_{right_ts}"), *[F.col(f"_hit.{v}").alias(f"asof_{v}") for v in values])


def _span(points: DataFrame, point_day: str) -> DataFrame:
    """First and last asked day: one row."""
    return points.agg(F.min(point_day).alias("_lo"), F.max(point_day).alias("_hi"))


def _levels() -> Column:
    """Levels of a binary tree over the days from ``_lo`` to ``_hi``."""
    return F.ceil(F.log2(F.datediff("_hi", "_lo") + F.lit(1.0))).cast("int")


def _shift(op: str, x: Column, by: Column) -> Column:
    return F.call_function(op, x, by)


def interval_nodes(points: DataFrame, intervals: DataFrame, start: str, end: str, point_day: str) -> DataFrame:
    """The intervals [start, end), cut to the span of the points, once per tree node (``_level``, ``_node``) that makes them up.

    Level k has nodes of 2^k days.  An interval is the disjoint union of at most two nodes of each level, so it makes some
    twice log2(days) rows whether it lasts a week, a decade or is still open (a null end), and a day lies in one of them only.
    """
    s = F.greatest(F.datediff(F.coalesce(F.col(start), F.col("_lo")), "_lo"), F.lit(0))
    e = F.least(F.datediff(F.coalesce(F.col(end), F.date_add("_hi", 1)), "_lo"), F.datediff("_hi", "_lo") + 1)

    def nodes(k: Column) -> Column:
        left = _shift("shiftright", F.col("_s") + _shift("shiftleft", F.lit(1), k) - 1, k)
        right = _shift("shiftright", F.col("_e"), k)
        node = lambda n: F.struct(k.alias("level"), n.alias("node"))
        odd = left % 2
        return F.array(F.when((left < right) & (odd == 1), node(left)), F.when((left + odd < right) & (right % 2 == 1), node(right - 1)))

    cut = intervals.join(F.broadcast(_span(points, point_day))).withColumn("_s", s).withColumn("_e", e).where(F.col("_s") < F.col("_e"))
    every = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), _levels()), nodes)), lambda n: n.isNotNull())
    return cut.withColumn("_n", F.explode(every)).select(*intervals.columns, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))


def point_nodes(points: DataFrame, point_day: str) -> DataFrame:
    """The points once per tree node that holds their day: one of each level."""
    day = F.datediff(point_day, "_lo")
    up = F.transform(F.sequence(F.lit(0), _levels()), lambda k: F.struct(k.alias("level"), _shift("shiftright", F.col("_d"), k).alias("node")))
    placed = points.where(F.col(point_day).isNotNull()).join(F.broadcast(_span(points, point_day))).withColumn("_d", day)
    return placed.withColumn("_n", F.explode(up)).select(*points.columns, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))


def interval_overlap(points: DataFrame, intervals: DataFrame, start: str, end: str, point_day: str) -> DataFrame:
    """Days joined with the half-open intervals that cover them; a null end is open, a null start was always there.

    An equi join on tree nodes: each pair meets in one node only, so there is no residual condition, and many long intervals
    or a crowded month do not meet in one key.
    """
    right = interval_nodes(points, intervals, start, end, point_day)
    return point_nodes(points, point_day).join(right, ["_level", "_node"]).drop("_level", "_node")


def interval_summary(
    points: DataFrame, intervals: DataFrame, start: str, end: str, point_day: str, keys: Sequence[str], aggregates: dict[str, tuple[Column, str]]
) -> DataFrame:
    """Per day and key, aggregates of the intervals that cover the day: (keys, day, name ...), without a row per pair.

    ``aggregates`` maps a name to an aggregate over intervals and the function (``sum``, ``min`` or ``max``) that merges it.
    Intervals are aggregated per tree node first; a day then merges the few nodes that hold it.
    """
    per_node = interval_nodes(points, intervals, start, end, point_day).groupBy(*keys, "_level", "_node").agg(*[a.alias(n) for n, (a, _) in aggregates.items()])
    met = point_nodes(points.select(point_day).distinct(), point_day).join(per_node, ["_level", "_node"])
    return met.groupBy(point_day, *keys).agg(*[F.call_function(merge, F.col(n)).alias(n) for n, (_, merge) in aggregates.items()])


def active_counts(intervals: DataFrame, start: str, end: str, keys: Sequence[str], span: DataFrame | None = None) -> DataFrame:
    """How many intervals cover each day, per key, without materialising one row per covered day.

    Days run from the first start to the last start or end of all intervals, or over ``span`` (one row: lo, hi).  Starts add
    one and ends take one away; the running sum over the calendar is the number open.  The window runs over one row per
    (key, day), after the deltas are aggregated.
    """
    if span is None:
        span = intervals.agg(F.min(start).alias("lo"), F.greatest(F.max(start), F.max(end)).alias("hi"))
    s = F.greatest(F.coalesce(F.col(start), F.col("lo")), F.col("lo"))
    e = F.least(F.coalesce(F.col(end), F.date_add("hi", 1)), F.date_add("hi", 1))
    placed = intervals.select(*keys, start, end).join(F.broadcast(span))
    base = placed.withColumn("_s", s).withColumn("_e", e).where(F.col("_s") < F.col("_e"))
    deltas = base.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("_s").alias("day"), F.lit(1).alias("d")),
                F.struct(F.col("_e").alias("day"), F.lit(-1).alias("d")),
            )
        ).alias("x"),
    ).groupBy(*keys, F.col("x.day").alias("day")).agg(F.sum("x.d").alias("_d"))
    days = placed.select(*keys, "lo", "hi").distinct().select(*keys, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return (
        null_safe(days, deltas, [*keys, "day"], "left")
        .withColumn("active", F.sum(F.coalesce("_d", F.lit(0))).over(w))
        .drop("_d")
    )


def effective_flags(days: DataFrame, day: str, changes: DataFrame, effective: str, cap_days: int = 1500) -> DataFrame:
    """Per day: number of changes in force and days since the last one (strictly before the day).

    ``changes`` may be any size: it is reduced to one row per effective date first.
    """
    per_day = changes.groupBy(F.col(effective).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
    line = (
        days.select(F.col(day).alias("_d"), F.lit(True).alias("_q"), F.lit(0).cast("bigint").alias("_c"))
        .unionByName(per_day.select("_d", F.lit(False).alias("_q"), "_c"))
    )
    # at most two rows per calendar day, whatever the size of the inputs: a bounded window
    n = line.withColumn("_i", F.datediff("_d", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy(F.lit(0)).orderBy("_i").rangeBetween(Window.unboundedPreceding, -1)
    return (
        n.withColumn("changes_in_force", F.coalesce(F.sum("_c").over(w), F.lit(0)))
        .withColumn("_last", F.max(F.when(~F.col("_q"), F.col("_i"))).over(w))
        .where("_q")
        .select(
            F.col("_d").alias(day),
            "changes_in_force",
            F.least(F.col("_i") - F.col("_last"), F.lit(cap_days)).alias("days_since_change"),
        )
    )


def shifted(df: DataFrame, keys: Sequence[str], ts: str, shift: str, cols: Sequence[str], suffix: str) -> DataFrame:
    """The values of ``shift`` earlier at each existing key: a join on the moved stamp, so a missing
    step gives null instead of the neighbour before it."""
    moved = df.select(*keys, (F.col(ts) + F.expr(f"interval {shift}")).cast(df.schema[ts].dataType).alias(ts),
                      *[F.col(c).alias(f"{c}{suffix}") for c in cols])
    return df.join(moved, [*keys, ts], "left")


def cardinality_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (must be empty on the one-side of a join)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join that fails at run time when the right side repeats a key, instead of multiplying rows.

    The check rides on the aggregate that makes the right side unique: no extra pass or action.
    """
    others = [c for c in right.columns if c not in keys]
    n = F.count(F.lit(1))
    checked = right.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in others],
        F.when(n > 1, F.raise_error(F.lit("right side of a many-to-one join repeats a key")).cast("boolean")).alias("_dup"),
    ).where(F.col("_dup").isNull()).drop("_dup")
    return left.join(checked, list(keys), how)


def side_by_side(base: DataFrame, tables: dict[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """One value column per table on common keys, by one union and one conditional aggregate instead
    of a chain of joins."""
    parts = [base.select(*keys, F.lit(None).cast("string").alias("_name"), F.lit(None).cast("double").alias("_v"))]
    for name, t in tables.items():
        parts.append(t.select(*keys, F.lit(name).alias("_name"), F.col(value).cast("double").alias("_v")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(*keys).agg(
        F.max(F.col("_name").isNull()).alias("_in_base"),
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(f"{value}_{name}") for name in tables],
    ).where("_in_base").drop("_in_base")


def unordered_pairs(df: DataFrame, keys: Sequence[str], entity: str, cols: Sequence[str]) -> DataFrame:
    """All i < j combinations of the entities of one key; the entity list is a fixed dimension."""
    def side(s: str) -> DataFrame:
        return df.select(*keys, F.col(entity).alias(f"{entity}_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cols])

    return side("i").join(side("j"), list(keys)).where(F.col(f"{entity}_i") < F.col(f"{entity}_j"))
