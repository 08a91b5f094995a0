"""Streaming forms (Q1-Q6) run over the given tables as streams, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.streaming import live
from gridtide.workload.bindings import xavg
from gridtide.workload.registry import query


def stream(spark, sf, name):
    return live.read_table(spark, f"{sf}/{name}.parquet", files_per_batch=1)


@query(
    "live_hourly_mean",
    oracle=f"""select event_type, date_trunc('hour', ts) as hour_utc, {xavg('value')} as mean_value, count(*) as readings from events group by 1, 2
      having date_trunc('hour', any_value(ts)) + interval 1 hour <= (select max(ts) from events) - interval 30 minute""",
)
def live_hourly(spark, sf):
    return live.run_to_table(live.live_hourly(stream(spark, sf, "events"), ["event_type"], "ts", "value", "30 minutes"), "live_hourly")


_REST = "l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc, l_discount desc, l_tax desc, l_returnflag desc, l_linestatus desc"


@query(
    "live_latest_wins",
    oracle=f"""select * from (select *, (l_orderkey // 5000)::int as block from lineitem) qualify row_number() over (partition by l_orderkey, l_linenumber order by {_REST}) = 1""",
)
def live_latest(spark, sf):
    s = stream(spark, sf, "lineitem").withColumn("block", F.floor(F.col("l_orderkey") / 5000).cast("int"))
    order = [c.split()[0] for c in _REST.split(", ")]
    path = live.run_each_batch(s, "live_latest", live.upsert_latest(["l_orderkey", "l_linenumber"], order, "block"))
    return live.upserted(spark, path, "block").select(*s.columns)


@query("live_without_repeats", oracle="select user_id, event_type, count(*) as n from (select distinct user_id, event_type, date_trunc('day', ts) as d from events) group by 1, 2")
def live_repeats(spark, sf):
    # one delivery per user, type and day is kept
    s = stream(spark, sf, "events").withColumn("d", F.col("ts").cast("date"))
    t = live.run_to_table(live.without_repeats(s, ["user_id", "event_type", "d"], "ts", "40 days"), "live_repeats")
    return t.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "live_revision_log",
    oracle="""with n as (select event_type, user_id, ts::date as night, value from events qualify row_number() over (partition by event_type, user_id, ts::date order by ts desc, event_id desc) = 1),
      x as (select event_type, user_id, night, lag(value) over (partition by event_type, user_id order by night) as before, value as after from n),
      s as (select *, case when before is null then 'appeared' when abs(after - before) > 5.0 then 'revised' end as status from x)
      select * from s where status is not null""",
)
def live_revisions(spark, sf):
    s = stream(spark, sf, "events").select("event_type", "user_id", "value", "event_id", "ts", F.col("ts").cast("date").alias("night"))
    path = live.run_each_batch(s, "live_revisions", live.revision_log(["event_type", "user_id"], "night", "value", ["ts", "event_id"], 5.0))
    return live.current_events(spark.read.parquet(f"{path}/events"), ["event_type", "user_id"], "night")


@query(
    "live_late_settlement",
    oracle="""with x as (select l_suppkey, max(l_shipdate) filter (where l_linestatus = 'F') as settled_hi, max(l_shipdate) filter (where l_linestatus = 'O') as live_hi from lineitem group by 1)
      select *, date_diff('day', settled_hi, live_hi)::int as lag_days from x where date_diff('day', settled_hi, live_hi) > 16""",
)
def live_late(spark, sf):
    s = stream(spark, sf, "lineitem").select(
        "l_suppkey", "l_shipdate", (F.col("l_linestatus") == "F").alias("s"), (F.col("l_linestatus") == "O").alias("r")
    )
    x = live.late_settlements(s, "l_suppkey", "l_shipdate", "s", "r", 16)

    def sink(batch, i, path):
        # one row per key and batch: each batch is its own partition, so a replay replaces it
        batch.withColumn("batch", F.lit(i)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    path = live.run_each_batch(x, "live_late", sink)
    from gridtide.operators.dedup import latest_wins

    return latest_wins(spark.read.parquet(path), ["l_suppkey"], ["batch"]).where("late").drop("batch", "late")


@query(
    "live_outage_sessions",
    oracle="""with a as (select event_type, ts, case when ts - lag(ts) over (partition by event_type order by ts) >= interval 45 minute or lag(ts) over (partition by event_type order by ts) is null then 1 else 0 end as nw from events),
      b as (select *, sum(nw) over (partition by event_type order by ts rows unbounded preceding) as g from a),
      s as (select event_type, min(ts) as session_start, max(ts) + interval 45 minute as session_end, count(*) as readings from b group by event_type, g)
      select * from s where session_end <= (select max(ts) from events) - interval 30 minute""",
)
def live_sessions(spark, sf):
    return live.run_to_table(live.outage_sessions(stream(spark, sf, "events"), ["event_type"], "ts", "45 minutes", "30 minutes"), "live_sessions")
