import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.sources import landing
from gridtide.streaming import live


def test_land_union_by_name_and_watermark(spark, tmp_path):
    a = spark.createDataFrame([("DK1", "2024-01-01 00:00:00")], "area string, HourUTC string")
    b = spark.createDataFrame([("DK2", "2024-01-01 05:00:00", 1.5)], "area string, HourUTC string, extra double")
    root = str(tmp_path)
    assert landing.land(a, root, "feed", "r1") and landing.land(b, root, "feed", "r2")
    assert not landing.land(a.limit(0), root, "feed", "r3")
    raw = landing.read_raw(spark, f"{root}/feed")
    assert raw.count() == 2 and set(landing.PROVENANCE) <= set(raw.columns) and "extra" in raw.columns
    wm = landing.watermark(raw, "HourUTC")
    assert wm.first()[0] == dt.datetime(2024, 1, 1, 5)
    typed = raw.withColumn("t", F.col("HourUTC").cast("timestamp_ntz"))
    assert landing.incremental_slice(typed, "t", 0, wm).count() == 1
    assert landing.incremental_slice(typed, "t", 1, landing.watermark(raw.limit(0), "HourUTC")).count() == 2


def test_windows_cover_without_overlap(spark):
    w = [tuple(r) for r in landing.plan_windows(spark, "2024-01-15", "2024-07-02", 2).orderBy("window_start").collect()]
    d = dt.date
    assert w == [(d(2024, 1, 15), d(2024, 3, 1)), (d(2024, 3, 1), d(2024, 5, 1)), (d(2024, 5, 1), d(2024, 7, 1)), (d(2024, 7, 1), d(2024, 7, 2))]


def test_json_csv_dated_and_zipped_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"total": 2, "records": [{"a": 1}, {"a": 2}]}, indent=1))
    assert sorted(r.a for r in landing.read_json_records(spark, str(tmp_path / "r.json"), "a int").collect()) == [1, 2]
    (tmp_path / "fx.csv").write_text("TIME_PERIOD,CURRENCY,CURRENCY_DENOM,OBS_VALUE,OBS_STATUS\n2024-01-05,DKK,EUR,7.46,A\n2024-01-06,DKK,EUR,,M\n")
    fx = landing.read_fx_csv(spark, str(tmp_path / "fx.csv")).collect()
    assert len(fx) == 1 and fx[0].rate == 7.46
    days = tmp_path / "days"
    days.mkdir()
    (days / "20240105zone.csv").write_text("ts,name,v\n01/05/2024 00:00,WEST,1.5\n")
    r = landing.read_dated_files(spark, str(days), [("ts", "string"), ("name", "string"), ("v", "double")]).first()
    assert r.file_date == dt.date(2024, 1, 5) and r.v == 1.5
    z = tmp_path / "z"
    z.mkdir()
    with zipfile.ZipFile(z / "m.zip", "w") as f:
        info = zipfile.ZipInfo("20240105x.csv", (2024, 1, 6, 2, 30, 0))
        f.writestr(info, "ts,name,v,seventh\nA,WEST,1,9\nB,,2,9\n")
    rows = landing.read_zipped_csv(spark, str(z), ["ts", "name", "v"]).orderBy("ordinal").collect()
    assert [(x.ts, x.name, x.v) for x in rows] == [("A", "WEST", "1"), ("B", None, "2")]
    assert rows[0].entry_written_at == dt.datetime(2024, 1, 6, 2, 30)


def test_monthly_partitions_prune_and_replace(spark, tmp_path):
    p = str(tmp_path / "m")
    df = spark.sql("select explode(sequence(timestamp_ntz'2024-01-30', timestamp_ntz'2024-03-02', interval 12 hour)) as t, 1 as v")
    landing.write_monthly(df, "t", p)
    landing.write_monthly(df.where(F.col("t") >= tc.ntz("2024-03-01 00:00:00")).withColumn("v", F.lit(2)), "t", p)
    got = landing.read_months(spark, p, "t", "2024-02-28 00:00:00", "2024-03-02 00:00:00")
    assert got.count() == 6 and {r.v for r in got.collect()} == {1, 2}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan or "PartitionFilters: [(" in plan or "ym#" in plan


def test_read_before_raises_when_the_filter_is_bypassed(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01' as t union all select timestamp_ntz'2025-01-01'")
    assert landing.read_before(df, "t", tc.ntz("2024-06-01 00:00:00")).count() == 1


def test_log_replaces_last_entry_but_never_the_baseline(spark):
    cols = "night string, n int, baseline boolean"
    log = spark.createDataFrame([("01", 1, True), ("02", 2, False)], cols)
    same = landing.append_or_replace_last(log, spark.createDataFrame([("02", 9, False)], cols), "night", "baseline", "night")
    assert sorted(tuple(r) for r in same.collect()) == [("01", 1, True), ("02", 9, False)]
    base = log.where("baseline")
    again = landing.append_or_replace_last(base, spark.createDataFrame([("01", 5, False)], cols), "night", "baseline", "night")
    assert again.count() == 2


def test_stream_upsert_is_replayable(spark, tmp_path):
    sink = live.upsert_latest(["k"], ["f"], "part")
    path = str(tmp_path / "t")
    cols = "k int, f int, v string, part int"
    one = spark.createDataFrame([(1, 1, "old", 0), (2, 1, "keep", 1)], cols)
    two = spark.createDataFrame([(1, 2, "new", 0)], cols)
    for i, b in ((0, one), (1, two), (1, two)):
        sink(b, i, path)
    assert sorted((r.k, r.v) for r in live.upserted(spark, path, "part").collect()) == [(1, "new"), (2, "keep")]
    sink(one, 0, path)  # a late replay of the first batch changes nothing behind it
    assert sorted((r.k, r.v) for r in live.upserted(spark, path, "part").collect()) == [(1, "new"), (2, "keep")]


def test_stream_upsert_that_stops_before_its_commit_leaves_the_old_table(spark, tmp_path, monkeypatch):
    sink = live.upsert_latest(["k"], ["f"], "part")
    path = str(tmp_path / "t")
    cols = "k int, f int, v string, part int"
    sink(spark.createDataFrame([(1, 1, "old", 0), (2, 1, "keep", 1)], cols), 0, path)
    two = spark.createDataFrame([(1, 2, "new", 0), (3, 2, "more", 2)], cols)

    class Stopped(Exception):
        pass

    def stop(*_):
        raise Stopped

    with monkeypatch.context() as m, pytest.raises(Stopped):
        m.setattr(type(spark), "range", stop)  # the commit is what comes after the version is written
        sink(two, 1, path)
    assert (tmp_path / "t" / "versions" / "batch=1").exists()
    assert sorted((r.k, r.v) for r in live.upserted(spark, path, "part").collect()) == [(1, "old"), (2, "keep")]
    sink(two, 1, path)
    assert sorted((r.k, r.v) for r in live.upserted(spark, path, "part").collect()) == [(1, "new"), (2, "keep"), (3, "more")]


def test_a_late_settlement_alarm_is_raised_and_withdrawn(spark):
    import datetime as dt

    d = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    rows = [("a", d(0), True, False), ("a", d(20), False, True), ("b", d(0), True, False), ("b", d(16), False, True), ("c", d(30), False, True)]
    schema = "k string, t timestamp_ntz, s boolean, r boolean"
    got = {r.k: (r.lag_days, r.late) for r in live.late_settlements(spark.createDataFrame(rows, schema), "k", "t", "s", "r", 16).collect()}
    assert got == {"a": (20, True), "b": (16, False), "c": (None, False)}
    later = rows + [("a", d(10), True, False)]
    assert not live.late_settlements(spark.createDataFrame(later, schema), "k", "t", "s", "r", 16).where("late").count()


def test_revision_log_across_batches(spark, tmp_path):
    sink = live.revision_log(["k"], "night", "v", ["f"], 0.5)
    path = str(tmp_path / "log")
    cols = "k string, night int, v double, f int"
    sink(spark.createDataFrame([("a", 1, 10.0, 1), ("a", 1, 11.0, 2), ("b", 1, 1.0, 1)], cols), 0, path)
    for _ in range(2):  # a replayed batch replaces its own output
        sink(spark.createDataFrame([("a", 2, 14.0, 3), ("b", 2, 1.2, 3), ("c", 2, 1.0, 3)], cols), 1, path)
    log = live.current_events(spark.read.parquet(f"{path}/events"), ["k"], "night")
    got = sorted((r.k, r.night, r.before, r.after, r.status) for r in log.where("night = 2").collect())
    assert got == [("a", 2, 11.0, 14.0, "revised"), ("c", 2, None, 1.0, "appeared")]


def test_late_night_is_compared_with_its_own_predecessor(spark, tmp_path):
    sink = live.revision_log(["k"], "night", "v", ["f"], 0.5)
    path = str(tmp_path / "log")
    for i, (night, v) in enumerate([(1, 10.0), (3, 20.0), (2, 11.0), (4, 20.0)]):
        sink(spark.createDataFrame([("a", night, v, i)], "k string, night int, v double, f int"), i, path)
    log = live.current_events(spark.read.parquet(f"{path}/events"), ["k"], "night").orderBy("night").collect()
    assert [(r.night, r.before, r.after, r.status) for r in log] == [(1, None, 10.0, "appeared"), (2, 10.0, 11.0, "revised"), (3, 11.0, 20.0, "revised")]


def test_stream_reads_a_folder_of_files_in_several_batches(spark, tmp_path):
    at = str(tmp_path / "t.parquet")
    spark.range(100).repartition(4).write.parquet(at)
    seen = []
    live.run_each_batch(live.read_table(spark, at, 1), "folder", lambda df, i, _: seen.append(df.count()), "append")
    assert sum(seen) == 100 and len([n for n in seen if n]) == 4


def test_session_windows_and_live_hours_hold_back_the_open_hour(spark, tmp_path):
    src = tmp_path / "src"
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(minutes=5 * i), 1.0) for i in range(30)]
    spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double").coalesce(1).write.parquet(str(src))
    s = live.read_files(spark, str(src), "k string, ts timestamp_ntz, v double")
    got = live.run_to_table(live.live_hourly(s, ["k"], "ts", "v", "1 minute"), "t").orderBy("hour_utc").collect()
    assert [(r.hour_utc.hour, r.readings) for r in got] == [(0, 12), (1, 12)]


def test_stream_upsert_writes_a_partition_by_one_task(spark, tmp_path):
    sink = live.upsert_latest(["k"], ["f"], "part")
    batch = spark.range(0, 4000, 1, 8).select(F.col("id").alias("k"), F.lit(1).alias("f"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).cast("int").alias("part"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sink(batch, 0, str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "t" / "versions").rglob("*.parquet"))) == 5  # not tasks times partitions
    assert live.upserted(spark, str(tmp_path / "t"), "part").where("part is null").count() == 800
