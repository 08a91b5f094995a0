"""Rolling pools against pools listed value by value."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.operators import pools

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=int(i))


def rows(seed, n=3000, days=60):
    """Ties, a value with a third of all rows, empty days, nulls."""
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(0, 3, n), 1)
    v[rng.random(n) < 0.33] = 1.5
    d = rng.choice([x for x in range(days) if x % 11], n)
    return [(day(a), None if i % 50 == 0 else float(b), day(a + int(rng.integers(0, 40)))) for i, (a, b) in enumerate(zip(d, v, strict=True))]


def in_pool(data, at, days, masked):
    return sorted(v for d, v, u in data if v is not None and at - dt.timedelta(days=days) <= d < at and (not masked or u <= at))


@pytest.mark.parametrize("masked", [False, True])
@pytest.mark.parametrize("size", [1_000, 25])
def test_quantile(spark, monkeypatch, masked, size):
    monkeypatch.setattr(pools, "PER_RANGE", size)
    data = rows(size + masked)
    values = spark.createDataFrame(data, "d date, v double, u date").repartition(4)
    pool = pools.Pool(values, "d", "v", 14, usable="u" if masked else None)
    asks = spark.createDataFrame([(day(i),) for i in range(-2, 90)], "at date")
    got = {r.at: (r.q, r.n) for r in pools.rolling_quantile(pool, asks, "at", 0.3, "q").collect()}
    assert len(got) == 92
    for at, (q, n) in got.items():
        held = in_pool(data, at, 14, masked)
        assert n == len(held) and (q is None if not held else q == pytest.approx(np.quantile(held, 0.3), abs=1e-12))


def test_rank(spark, monkeypatch):
    monkeypatch.setattr(pools, "PER_RANGE", 25)
    data = rows(5)
    values = spark.createDataFrame(data, "d date, v double, u date").withColumn("k", F.lit(None).cast("string"))
    got = pools.rolling_rank(pools.Pool(values, "d", "v", 14, ["k"]), values, "d", "v").collect()
    assert len(got) == len(data)
    for r in got:
        held = in_pool(data, r.d, 14, False)
        assert (r.less, r.n) == ((None, None) if r.v is None else (sum(x < r.v for x in held), len(held)))


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    numbers, weights = rng.integers(0, 37, 500), rng.integers(1, 5, 500)
    m = pools.WaveletMatrix(numbers, weights)
    j, x = rng.integers(1, 501, 200), rng.integers(0, 37, 200)
    assert m.less(j, x).tolist() == [int(weights[:a][numbers[:a] < b].sum()) for a, b in zip(j, x, strict=True)]
    at = np.array([int(rng.integers(0, weights[:a].sum())) for a in j])
    assert m.at(j, at).tolist() == [int(np.sort(np.repeat(numbers[:a], weights[:a]))[p]) for a, p in zip(j, at, strict=True)]
