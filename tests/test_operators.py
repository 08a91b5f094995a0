import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.operators import dedup, episodes, grid, joins, quality, ranking, setops, trailing
from gridtide.plans import features, marts, positions, selection, studies, versions


def test_latest_wins_and_report(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 11.0), ("a", 2, 12.0), ("b", 1, None)], "k string, f int, v double")
    got = {r.k: r.v for r in dedup.latest_wins(df, ["k"], ["f", "v"]).collect()}
    assert got == {"a": 12.0, "b": None}
    r = dedup.duplicate_report(df, ["k"]).first()
    assert (r.rows, r.distinct_keys, r.dropped, r.repeated_keys) == (4, 2, 2, 1)


def test_latest_wins_limits_rows_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("f"))
    plan = dedup.latest_wins(df, ["k"], ["f"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Exchange") < plan.rindex("WindowGroupLimit")


@pytest.mark.parametrize("seed,small", [(1, ranking.PER_RANGE), (2, 3)])
def test_ranks_and_quantiles_with_a_hot_value_and_outliers(spark, monkeypatch, seed, small):
    monkeypatch.setattr(ranking, "PER_RANGE", small)  # 3: nearly every range is subdivided
    rng = random.Random(seed)
    vals = [0.0] * 300 + [rng.gauss(0, 1) for _ in range(400)] + [1e9, -1e9, 5.0, 5.0] + [1e6 + rng.random() for _ in range(300)]
    rows = [("hot", float(v), i) for i, v in enumerate(vals)] + [("cold", 1.0, 0), (None, 2.0, 1), (None, 3.0, 2)]
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(7)
    rv = ranking.ranked_values(df, ["g"], "v").toPandas()
    hot = rv[rv.g == "hot"].sort_values("v")
    s = pd.Series(vals)
    assert list(hot.below) == [int((s < v).sum()) for v in hot.v]
    assert set(hot.n) == {len(vals)} and int(hot.ties.sum()) == len(vals)
    assert len(rv[rv.g.isna()]) == 2
    q = ranking.quantile_columns(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.99}).toPandas().set_index("g")
    assert np.allclose(q.loc["hot", ["a", "b", "c"]].astype(float), s.quantile([0.05, 0.5, 0.99]))
    p = ranking.positions(df.where("g is not null"), ["g"], "v", "i").where("g = 'hot'").toPandas().sort_values(["v", "i"])
    assert list(p.position) == list(range(len(vals)))
    tiles = ranking.positions(df.where("g = 'hot'"), ["g"], "v", "i").groupBy(ranking.ntile_of_position(10).alias("t")).count().toPandas()
    assert sorted(tiles["count"]) == sorted(len(a) for a in np.array_split(range(len(vals)), 10))


def test_spearman_matches_average_ranks(spark):
    rng = random.Random(3)
    pdf = pd.DataFrame({"x": [rng.randint(0, 5) * 1.0 for _ in range(200)], "y": [rng.random() for _ in range(200)]})
    got = ranking.spearman(spark.createDataFrame(pdf), [], "x", "y").first().spearman
    assert abs(got - pdf.x.rank().corr(pdf.y.rank())) < 1e-12


def test_asof_ties_tolerance_and_day_boundary(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    left = spark.createDataFrame(
        [("a", 1, t("2024-01-03 00:00:00")), ("a", 2, t("2024-01-01 08:00:00")), ("b", 3, t("2024-01-01 08:00:00")), ("a", 4, t("2024-01-01 07:59:59"))],
        "k string, n int, ts timestamp_ntz",
    )
    right = spark.createDataFrame(
        [("a", t("2024-01-01 08:00:00"), 1.0, 1), ("a", t("2024-01-01 08:00:00"), 2.0, 2), ("a", t("2024-01-05 00:00:00"), 9.0, 3)],
        "k string, rts timestamp_ntz, v double, id int",
    )
    got = {r.n: r.asof_v for r in joins.asof_backward(left, right, ["k"], "ts", "rts", ["v"], "id").collect()}
    assert got == {1: 2.0, 2: 2.0, 3: None, 4: None}
    near = {r.n: r.asof_v for r in joins.asof_backward(left, right, ["k"], "ts", "rts", ["v"], "id", 3600).collect()}
    assert near == {1: None, 2: 2.0, 3: None, 4: None}


def test_many_to_one_refuses_a_repeated_key(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    ok = spark.createDataFrame([(1, "x")], "k int, v string")
    assert {r.k: r.v for r in joins.many_to_one(left, ok, ["k"]).collect()} == {1: "x", 2: None}
    bad = ok.unionByName(ok)
    with pytest.raises(Exception, match="repeats a key"):
        joins.many_to_one(left, bad, ["k"]).collect()


def test_open_intervals_agree_between_join_and_counting(spark):
    d = lambda s: dt.date.fromisoformat(s)
    iv = spark.createDataFrame(
        [("x", d("2023-12-20"), d("2024-01-03")), ("x", d("2024-01-02"), None), ("y", d("2024-02-01"), d("2024-02-01")), ("y", None, d("2024-01-02"))],
        "c string, s date, e date",
    )
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-02-10', interval 1 day)) as day")
    a = joins.interval_overlap(days, iv, "s", "e", "day").groupBy("day", "c").agg(F.count("*").alias("n")).toPandas()
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    b = joins.active_counts(iv, "s", "e", ["c"], span).where("active > 0").toPandas()
    c = joins.interval_summary(days, iv, "s", "e", "day", ["c"], {"n": (F.count("*"), "sum")}).toPandas()
    assert {(r.day, r.c): r.n for r in a.itertuples()} == {(r.day, r.c): r.active for r in b.itertuples()} == {(r.day, r.c): r.n for r in c.itertuples()}


def test_intervals_of_a_crowded_month_meet_in_many_nodes(spark):
    """Most intervals in one month, some open or very long: all pairs as listed, few rows per interval, no crowded key."""
    import numpy as np

    rng = np.random.default_rng(4)
    first = dt.date(2020, 1, 1)
    day = lambda i: first + dt.timedelta(days=int(i))
    rows = []
    for i in range(600):
        s = int(rng.integers(700, 730)) if i % 10 else int(rng.integers(-50, 1400))
        rows.append((i, None if i % 97 == 0 else day(s), None if i % 31 == 0 else day(s + int(rng.choice([0, 1, 5, 20, 900])))))
    points = spark.createDataFrame([(day(i),) for i in range(0, 1000, 3)] + [(None,)], "day date")
    iv = spark.createDataFrame(rows, "id int, s date, e date")
    got = sorted((r.day, r.id) for r in joins.interval_overlap(points, iv, "s", "e", "day").collect())
    asked = [day(i) for i in range(0, 1000, 3)]
    assert got == sorted((d, i) for d in asked for i, s, e in rows if (s is None or s <= d) and (e is None or d < e))
    nodes = joins.interval_nodes(points, iv, "s", "e", "day")
    assert nodes.groupBy("id").count().agg(F.max("count")).first()[0] <= 20
    assert nodes.groupBy("_level", "_node").count().agg(F.max("count")).first()[0] <= 250


def test_as_of_with_one_crowded_day(spark):
    """All but a few rows in one (key, day): the newest row before each, by listing, with and without a tolerance."""
    import bisect

    import numpy as np

    rng = np.random.default_rng(9)
    t0 = dt.datetime(2024, 3, 5)

    def stamps(n):
        some = [t0 + dt.timedelta(seconds=int(x)) for x in rng.integers(0, 86_400, n)]
        return some + [t0 + dt.timedelta(days=d, seconds=5) for d in (-3, 2, 9)]

    right = [("a", t, i) for i, t in enumerate(stamps(500))] + [("b", t0, -1), (None, t0, -2)]
    left = [("a", t, i) for i, t in enumerate(stamps(700))] + [("c", t0, -1), (None, t0 + dt.timedelta(days=40), -2), ("a", t0 - dt.timedelta(days=9), -3)]
    lf, rf = spark.createDataFrame(left, "k string, t timestamp_ntz, id int"), spark.createDataFrame(right, "k string, u timestamp_ntz, v int")
    known = {}
    for k, u, v in sorted(right, key=lambda r: r[1:]):
        known.setdefault(k, []).append((u, v))
    for tolerance in (None, 60):
        got = {(r.k, r.id): (r.asof_u, r.asof_v) for r in joins.asof_backward(lf, rf, ["k"], "t", "u", ["v"], "v", tolerance, slot_seconds=120).collect()}
        assert len(got) == len(left)
        for k, t, i in left:
            at = bisect.bisect_right(known.get(k, []), (t, 1 << 30)) - 1
            hit = known[k][at] if at >= 0 else (None, None)
            if tolerance is not None and hit[0] is not None and (t - hit[0]).total_seconds() > tolerance:
                hit = (None, None)
            assert got[k, i] == hit


def test_local_days_have_23_24_25_hours(spark):
    days = spark.sql("select explode(array(date'2025-03-30', date'2025-07-01', date'2025-10-26')) as d")
    n = grid.local_day_hours(days, "d", "Europe/Copenhagen").groupBy("d").count().orderBy("d").collect()
    assert [r["count"] for r in n] == [23, 24, 25]
    hours = grid.local_day_hours(days, "d", "Europe/Copenhagen")
    slots = grid.slot_of_hour(hours, [], "hour_utc", "Europe/Copenhagen")
    assert slots.where("slot = 24").count() == 1 and slots.where("d <> local_day").count() == 0


def test_time_weighted_hour_needs_full_coverage(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("z", t0 + dt.timedelta(minutes=5 * i), 10.0 if i <= 6 else 20.0) for i in range(1, 13)] + [("z", t0 + dt.timedelta(minutes=90), 5.0)]
    df = spark.createDataFrame(rows, "name string, t timestamp_ntz, lbmp double")
    got = {r.hour_utc.hour: (r.covered_seconds, r.lbmp) for r in grid.time_weighted_hourly(df, ["name"], "t", ["lbmp"]).collect()}
    assert got[0] == (3600, 15.0) and got[1][0] == 1800


def test_episodes_and_sign_runs(spark):
    t0 = dt.datetime(2024, 10, 27)
    df = spark.createDataFrame([("a", t0 + dt.timedelta(hours=h)) for h in (0, 5, 6, 7, 9)], "k string, t timestamp_ntz")
    e = episodes.flag_autumn_change(episodes.consecutive_episodes(df, ["k"], "t")).orderBy("start").collect()
    assert [(r.start.hour, r.steps, r.clock_change) for r in e] == [(0, 1, True), (5, 3, False), (9, 1, False)]
    v = [1.0, 2.0, None, -1.0, -2.0, -3.0, 0.0, 4.0]
    s = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, i int, v double")
    assert [r.run for r in trailing.sign_run_length(s, ["k"], "i", "v", "run").orderBy("i").collect()] == [1, 2, 0, 1, 2, 3, 0, 1]


def test_trailing_windows_skip_missing_days_and_match_brute_force(spark):
    rng = random.Random(5)
    days = sorted(rng.sample(range(120), 80))
    vals = {d: (None if rng.random() < 0.1 else round(rng.gauss(0, 3), 2)) for d in days}
    base = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("a", base + dt.timedelta(days=d), v) for d, v in vals.items()], "k string, d date, v double")
    out = trailing.trailing_mean(df, ["k"], "d", "v", 30, "m")
    out = trailing.trailing_rank(out, ["k"], "d", "v", "r", 30, 5).toPandas()
    for r in out.itertuples():
        i = (r.d - base).days
        hist = [vals[d] for d in days if i - 30 <= d <= i - 1 and vals[d] is not None]
        assert (pd.isna(r.m) and not hist) or abs(r.m - np.mean(hist)) < 1e-9
        want = None if vals[i] is None or len(hist) < 5 else np.mean([h < vals[i] for h in hist])
        assert (want is None and pd.isna(r.r)) or abs(want - r.r) < 1e-12


def test_table_differences_ignore_order_and_see_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string")
    b = a.select("s", "i").orderBy(F.desc("i"))
    assert setops.table_differences(a, b).count() == 0
    assert setops.table_differences(a, b.distinct()).count() == 1
    with pytest.raises(ValueError):
        setops.table_differences(a, a.select("i"))


def test_quality_guards(spark):
    with pytest.raises(quality.LookaheadError):
        quality.refuse_labels(["price_dm1", "y_rt"])
    df = spark.createDataFrame([(1,)], "v int")
    with pytest.raises(quality.LookaheadError):
        quality.no_lookahead({"a": df}, "published_at", "decision")


def test_snapshot_diff_counts(spark):
    cols = "area string, hour int, version string, v double"
    prev = spark.createDataFrame([("A", 1, "settled", 10.0), ("A", 2, "settled", 5.0), ("A", 3, "one-hour", 7.0)], cols)
    cur = spark.createDataFrame([("A", 1, "settled", 13.0), ("A", 2, "settled", 5.2), ("A", 4, "one-hour", 1.0)], cols)
    d = {r.version: r for r in versions.snapshot_diff(prev, cur, ["area", "hour", "version"], "version", "v").collect()}
    assert (d["settled"].revised, d["settled"].unchanged, d["settled"].max_abs_mwh) == (1, 1, 3.0)
    assert (d["one-hour"].appeared, d["one-hour"].vanished, d["one-hour"].revised) == (1, 1, 0)


def test_versions_keep_a_missing_version_as_null(spark):
    t = dt.datetime(2025, 1, 1)
    f = spark.createDataFrame([("DK1", t, "Offshore Wind", None, None, None, None)], "area string, hour_utc timestamp_ntz, forecast_type string, fc_day_ahead_mwh double, fc_intraday_mwh double, fc_5h_mwh double, fc_1h_mwh double")
    r = spark.createDataFrame([("DK1", t + dt.timedelta(hours=1), 5.0, 2.0), ("DK1", t + dt.timedelta(hours=1, minutes=5), 5.0, None)], "area string, minute_utc timestamp_ntz, onshore_wind_mw double, offshore_wind_mw double")
    s = spark.createDataFrame([("DK1", t + dt.timedelta(hours=1), 3.0, 4.0)], "area string, hour_utc timestamp_ntz, offshore_wind_mwh double, onshore_wind_mwh double")
    rows = marts.wind_versions(f, r, s).collect()
    assert len(rows) == 1  # a forecast row with every value null is not a version
    assert rows[0].v_day_ahead is None and rows[0].v_realtime == 7.0 and rows[0].realtime_readings == 1 and rows[0].versions_present == 2
    assert {x.version for x in marts.wind_versions_long(marts.wind_versions(f, r, s)).collect()} == {"real-time", "settled"}


def test_fixed_effects_match_least_squares(spark):
    rng = np.random.default_rng(0)
    n = 3000
    h, m, x = rng.integers(0, 24, n), rng.integers(1, 13, n), rng.random(n)
    y = 2 * h - m + 3 * x - x**2 + rng.normal(0, 1, n)
    train = rng.random(n) < 0.5
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "h": h, "m": m, "x": x, "y": y, "t": train}))
    got = studies.fixed_effects_ols(df, ["g"], "h", "m", "y", "x", F.col("t"), 10).first()
    d = np.column_stack([np.ones(n)] + [(h == k).astype(float) for k in range(1, 24)] + [(m == k).astype(float) for k in range(2, 13)])
    for cols, value in ((d, got.r2_without), (np.column_stack([d, x, x**2]), got.r2_with)):
        beta = np.linalg.lstsq(cols[train], y[train], rcond=None)[0]
        e = y[~train] - cols[~train] @ beta
        assert abs(1 - (e @ e) / ((y[~train] - y[~train].mean()) ** 2).sum() - value) < 1e-8


def test_bootstrap_does_not_depend_on_partitioning(spark):
    d = spark.createDataFrame([("a", i, float(i % 5)) for i in range(40)], "k string, i int, v double")
    a = studies.bootstrap_means(d.repartition(1), ["k"], "i", "v", 20, 7.0, 1).orderBy("draw").collect()
    b = studies.bootstrap_means(d.repartition(6), ["k"], "i", "v", 20, 7.0, 1).orderBy("draw").collect()
    assert a == b and len({r.boot_mean for r in a}) > 5


def test_ledger_signs_and_missing_gap(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, -1.0), (None, -1.0)], "gap double, p double").withColumn("load_cost", F.lit(0.1)).withColumn("supply_cost", F.lit(0.2))
    r = positions.ledger(df, F.col("p")).collect()
    assert [round(x.pnl, 6) for x in r] == [4.9, -5.2, 0.0] and r[2].pos == 0.0


def test_limit_bid_supply_wins_ties_and_negative_levels_sort(spark):
    base = spark.range(1).withColumn("load_cost", F.lit(0.0)).withColumn("supply_cost", F.lit(0.0))
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    bid = lambda lv, cd: base.select(positions.limit_bid(lv, cd).alias("b")).first().b
    assert bid(arr(10, 20, 30), arr(5, -1, -2)).asDict() == {"side": -1.0, "limit": 20.0}
    assert bid(arr(10, 20, 30), arr(5, 4, -2)).asDict() == {"side": 1.0, "limit": 20.0}
    assert bid(arr(-10, -20, -30), arr(-1, -1, 2)).asDict() == {"side": -1.0, "limit": -20.0}
    assert bid(arr(10, 20, 30), arr(0, 0, 0)).asDict() == {"side": 0.0, "limit": None}


def test_training_rows_respect_gap_and_publication(spark):
    d = lambda s: dt.date.fromisoformat(s)
    t = lambda s: dt.datetime.fromisoformat(s)
    rows = [
        ("z", d("2024-01-30"), t("2024-01-31 10:00:00"), 1.0),  # public exactly at 05:00 New York on 31 January: February
        ("z", d("2024-01-30"), t("2024-01-31 10:00:01"), 1.0),  # a second late: March
        ("z", d("2024-01-31"), t("2024-01-31 01:00:00"), 1.0),  # inside the two-day gap: March
        ("z", d("2024-01-10"), None, 1.0),  # never public
    ]
    df = spark.createDataFrame(rows, "k string, d date, p timestamp_ntz, v double")
    got = {r.period: r.train_rows for r in selection.training_rows(df, ["k"], "d", "p", "v", "America/New_York").collect()}
    assert got == {d("2024-02-01"): 1, d("2024-03-01"): 3}


def test_choice_ties_take_the_first_setting(spark):
    base = dt.date(2024, 1, 1)
    rows = [(base + dt.timedelta(days=i), s, f"s{s}", 1.0) for i in range(120) for s in (0, 1)]
    nets = spark.createDataFrame(rows, "d date, setting_index int, setting string, net double")
    c = {r.period: (r.setting_index, r.from_data) for r in selection.choose_setting(nets, "d", default_index=1).collect()}
    assert c[dt.date(2024, 1, 1)] == (1, False) and c[dt.date(2024, 4, 1)] == (0, True)


def test_lookahead_noise_does_not_move_filtered_features(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    df = spark.createDataFrame([("a", 1.0, t("2024-01-01 01:00:00")), ("a", 2.0, t("2024-01-02 01:00:00"))], "k string, v double, p timestamp_ntz")
    cut = tc.ntz("2024-01-01 12:00:00")
    good = lambda x: x.where(F.col("p") <= cut).groupBy("k").agg(F.sum("v").alias("s"))
    leaky = lambda x: x.groupBy("k").agg(F.sum("v").alias("s"))
    assert features.perturbation_differences(good, df, "p", cut, {"v": F.lit(99.0)}).count() == 0
    assert features.perturbation_differences(leaky, df, "p", cut, {"v": F.lit(99.0)}).count() == 2


def test_a_traded_year_without_a_fee_is_an_error(spark):
    from gridtide.plans import positions

    fees = spark.createDataFrame([(2024, 0.5, 0.7)], "year int, load_cost double, supply_cost double")
    rows = spark.createDataFrame([(dt.date(2024, 5, 1),), (dt.date(2025, 5, 1),)], "d date")
    assert positions.with_costs(rows.where("d < '2025-01-01'"), fees, "d").first().load_cost == 0.5
    with pytest.raises(Exception, match="no fee for the year 2025"):
        positions.with_costs(rows, fees, "d").collect()


def test_resampled_means_follow_their_blocks():
    """Means of a series with missing days, block by block; the mean block is about as long as asked for."""
    import math

    import numpy as np

    from gridtide.plans import studies

    rng = np.random.default_rng(2)
    n, draws = 101, np.arange(40)
    position = np.sort(rng.choice(n, 90, replace=False))
    value = np.floor(rng.normal(size=90) * studies.GRID) / studies.GRID
    for block in (1.0, 7.0):
        got = studies.resampled_means(position, value, n, draws, block, 5)
        many = math.ceil(n * (2.0 / block)) + 64
        k = np.arange(many)
        start = np.floor(studies._drawn(5, 2, draws, k) * n).astype(int)
        length = np.floor(np.log(1 - studies._drawn(5, 1, draws, k)) / math.log(1 - 1 / block)).astype(int) + 1 if block > 1 else np.ones((40, many), int)
        own = dict(zip(position.tolist(), value.tolist(), strict=True))
        for d in range(40):
            days: list[int] = []
            for j in range(many):
                days += [(int(start[d, j]) + i) % n for i in range(int(length[d, j]))]
                if len(days) >= n:
                    break
            held = [own[x] for x in days[:n] if x in own]
            assert got[d] == sum(held) / len(held)
        assert abs(length.mean() - block) < 0.25 * block
    u = studies._drawn(7, 1, np.arange(300), np.arange(300)).ravel()
    assert len(np.unique(u)) > 0.99 * len(u) and abs(u.mean() - 0.5) < 0.005 and np.histogram(u, 10, (0, 1))[0].min() > 0.09 * len(u)


def _days_without_loss(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(3)]
    rows = [("wins", d, 2.0) for d in days] + [("idle", d, 0.0) for d in days] + [("mixed", d, p) for d, p in zip(days, (3.0, -2.0, 1.0))]
    return spark.createDataFrame(rows, "strategy string, delivery_date date, pnl double")


def test_sizing_without_a_losing_day_equals_its_sql(spark):
    import duckdb

    from gridtide.workload.positions import SIZING

    d = _days_without_loss(spark)
    got = positions.sizing(d, ["strategy"], "delivery_date", "pnl", 100.0).withColumn("sortino", F.round("sortino", 7))
    daily = d.toPandas()  # noqa: F841 - named in the SQL
    want = duckdb.sql(f"with {SIZING} select strategy, net, worst_drawdown, scale, sortino from sz order by 1").fetchall()
    assert str([tuple(r) for r in got.orderBy("strategy").collect()]) == str(want)  # as text: NaN, and -0.0 apart from 0.0
    assert [str(r[4]) for r in want] == ["nan", str(want[1][4]), "inf"]


def test_books_without_a_drawdown_equal_their_sql(spark):
    import duckdb

    from gridtide.workload.positions import SIZING

    d = _days_without_loss(spark)
    got = positions.books_at_limits(d, ["strategy"], "delivery_date", "pnl", [50.0])
    daily = d.toPandas()  # noqa: F841 - named in the SQL
    q = f'with {SIZING}, l as (select 50.0e0 as "limit") select strategy, "limit", "limit" / worst_drawdown as size, "limit" / worst_drawdown * net as net, 0.7e0 * ("limit" / worst_drawdown) * net as net_fraction from sz cross join l order by 1'
    want = duckdb.sql(q).fetchall()
    assert str([tuple(r) for r in got.orderBy("strategy").collect()]) == str(want)
    assert [r[2] for r in want] == [float("-inf"), 25.0, float("-inf")]


def test_calibration_bins_split_shared_values_and_keep_null_keys_and_ties(spark):
    rng = random.Random(5)
    rows = [(g, float(rng.randint(0, 3)), rng.random(), None if i == 7 else i) for g in ("a", None) for i in range(41)]
    df = spark.createDataFrame(rows, "g string, p double, y double, tie int").repartition(5)
    got = studies.calibration_deciles(df, ["g"], "p", "y", "tie").collect()
    assert len(got) == 20 and sum(r.n for r in got) == 82
    for g in ("a", None):
        mine = sorted((r[1:] for r in rows if r[0] == g), key=lambda r: (r[0], r[2] is None, r[2]))
        for r in got:
            if r.g == g:
                own = [x for i, x in enumerate(mine) if max(-(-i * 10 // 40) - 1, 0) == r.bin]
                assert r.n == len(own) and np.isclose(r.real_mean, np.mean([x[1] for x in own])) and np.isclose(r.pred_mean, np.mean([x[0] for x in own]))
