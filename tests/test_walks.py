"""Walk-forward models from moments against least squares on the listed training rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.plans import models, walks

ZONE = "Europe/Copenhagen"
SCHEMA = "d date, published timestamp_ntz, k string, x double, w double, y double"


def panel(seed=1, n=900, days=400):
    """Two entities, missing features, labels that come late or never."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        d = dt.date(2023, 1, 15) + dt.timedelta(days=int(rng.integers(0, days)))
        late = dt.timedelta(days=int(rng.choice([1, 1, 1, 45])))
        x = None if i % 9 == 0 else float(rng.normal())
        w = float("nan") if i % 13 == 0 else float(rng.normal(2))
        published = None if i % 17 == 0 else dt.datetime.combine(d, dt.time(3)) + late
        y = None if i % 29 == 0 else float(1 + 2 * (x or 0.3) - (0 if w != w else w) + rng.normal())
        out.append((d, published, "ab"[i % 2], x, w, y))
    return out


def months_before(d, m):
    at = d.year * 12 + d.month - 1 - m
    return dt.date(at // 12, at % 12 + 1, 1)


def taught(rows, period, window):
    """Rows whose day ended two days before and whose label was public by five in the morning (local) of the day before."""
    deadline = dt.datetime.combine(period - dt.timedelta(days=1), dt.time(5))
    from zoneinfo import ZoneInfo

    public = lambda p: p.replace(tzinfo=dt.UTC).astimezone(ZoneInfo(ZONE)).replace(tzinfo=None) <= deadline
    ok = [r for r in rows if r[5] is not None and r[1] is not None and r[0] <= period - dt.timedelta(days=2) and public(r[1])]
    return [r for r in ok if window is None or r[0] >= months_before(period, window)]


def design(r):
    missing = [r[3] is None, r[4] != r[4]]
    return [1.0, 0.0 if missing[0] else r[3], 0.0 if missing[1] else r[4], float(missing[0]), float(missing[1])]


@pytest.mark.parametrize(("months", "window", "keys"), [(1, None, []), (1, 4, []), (3, 5, []), (3, None, ["k"])])
def test_fits(spark, months, window, keys):
    rows = panel()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = walks.fits(df, "d", "published", ZONE, ["x", "w"], F.col("y"), months, [window], keys, least=40).collect()
    assert len(got) >= 3
    for r in got:
        mine = [x for x in rows if not keys or x[2] == r.k]
        train = taught(mine, r.period, window)
        assert r.train_rows == len(train) >= 40
        z, y = np.array([design(t) for t in train]), np.array([t[5] for t in train])
        assert [r[f"c_{i}"] for i in range(5)] == pytest.approx(np.linalg.lstsq(z, y, rcond=None)[0].tolist(), abs=1e-7)
    periods = {r.period for r in got}
    out = walks.predicted(df, walks.mean_of_windows(walks.fits(df, "d", "published", ZONE, ["x", "w"], F.col("y"), months, [window], keys, least=40), keys), "d", ["x", "w"], "p", months, keys)
    assert {r.period for r in out.collect()} <= periods and out.where("p is null").isEmpty()


def test_a_late_label_teaches_late(spark):
    base = [(dt.date(2024, 1, 1 + i % 20), dt.datetime(2024, 1, 25), "a", float(i), 1.0, float(2 * i)) for i in range(40)]
    late = [(dt.date(2024, 1, 5), dt.datetime(2024, 3, 30), "a", 5.0, 1.0, 1e6)]
    future = [(dt.date(2024, 5, 20), dt.datetime(2024, 5, 21), "a", 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(base + late + future, SCHEMA)
    got = {r.period: r.train_rows for r in walks.fits(df, "d", "published", ZONE, ["x"], F.col("y")).collect()}
    assert got == {dt.date(2024, 2, 1): 40, dt.date(2024, 3, 1): 40, dt.date(2024, 4, 1): 41, dt.date(2024, 5, 1): 41}
    trees = models.prepared(df, ["x"], F.col("y"), models.learnable_from("d", "published", ZONE))
    assert trees.where(models.may_train("2024-03-01")).count() == 40 and trees.where(models.may_train("2024-04-01")).count() == 41


def test_columns_that_others_explain_get_zero(spark):
    rows = [(dt.date(2024, 1, 1 + i % 20), dt.datetime(2024, 1, 25), "a", 3.0, float(i), float(i)) for i in range(60)]
    rows.append((dt.date(2024, 2, 5), None, "a", None, 1.0, None))
    r = walks.fits(spark.createDataFrame(rows, SCHEMA), "d", "published", ZONE, ["x", "w"], F.col("y")).first()
    assert [r[f"c_{i}"] for i in range(5)] == pytest.approx([0.0, 0.0, 1.0, 0.0, 0.0], abs=1e-9)


def test_recency(spark):
    rows = panel(3)
    df = spark.createDataFrame(rows, SCHEMA)
    for r in walks.fits(df, "d", "published", ZONE, ["x", "w"], F.col("y"), 3, [None], half_life=2.0, least=60).collect():
        train = taught(rows, r.period, None)
        s = np.sqrt([2.0 ** ((t[0].year * 12 + t[0].month) / 2.0 - 12000) for t in train])
        z, y = np.array([design(t) for t in train]), np.array([t[5] for t in train])
        assert [r[f"c_{i}"] for i in range(5)] == pytest.approx(np.linalg.lstsq(z * s[:, None] / s.max(), y * s / s.max(), rcond=None)[0].tolist(), abs=1e-6)
