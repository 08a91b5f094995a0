"""Point-in-time reads (M1-M7) on the given tables.

``events`` are forecasts: the target is a day one to three days after the event, the publication comes
some hours after it, and the deadline is 05:00 local on the day before the target.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.operators.dedup import newest_block
from gridtide.plans import knowledge
from gridtide.workload.bindings import FEED, ZONE, feed, with_
from gridtide.workload.registry import query


def vintages(spark, sf):
    f = feed(spark, sf)
    issue = F.col("ts").cast("date")
    return f.select(
        "event_id", "area", "user_id", "ts", "k", "value", issue.alias("issue_date"),
        F.date_add(issue, F.col("k") % 3 + 1).alias("target"),
        F.when(F.col("k") != 13, F.col("ts") + tc.hours(F.col("k") % 20)).alias("published_at"),
    ).withColumn("decision", tc.decision_time(F.date_sub("target", 1), ZONE))


VINTAGES = FEED + f""", vt as (select event_id, area, user_id, ts, k, value, ts::date as issue_date, ts::date + 1 + (k % 3)::int as target,
    case when k <> 13 then ts + (k % 20) * interval 1 hour end as published_at from feed),
  vintages as (select *, ((target - 1)::timestamp + interval 5 hour) at time zone '{ZONE}' at time zone 'UTC' as decision from vt)"""


def decisions(spark, sf):
    d = feed(spark, sf).select(F.col("ts").cast("date").alias("decision_day")).distinct()
    return d.withColumn("decision", tc.decision_time("decision_day", ZONE))


DECISIONS = f"""decisions as (select distinct ts::date as decision_day, ((ts::date)::timestamp + interval 5 hour) at time zone '{ZONE}' at time zone 'UTC' as decision from feed)"""


@query(
    "available_at_each_deadline",
    oracle=with_(VINTAGES, DECISIONS) + """
      select d.decision_day, v.area, count(*) as rows, max(v.published_at) as newest_published, max(v.event_id) as max_id from vintages v join decisions d
      on v.issue_date between d.decision_day - 3 and d.decision_day + 4 and v.published_at <= d.decision group by 1, 2""",
)
def available(spark, sf):
    x = knowledge.available_at(decisions(spark, sf), vintages(spark, sf).drop("decision"), "ts", "published_at", 3)
    return x.groupBy("decision_day", "area").agg(
        F.count(F.lit(1)).alias("rows"), F.max("published_at").alias("newest_published"), F.max("event_id").alias("max_id")
    )


@query(
    "visible_and_held_back",
    oracle=with_(VINTAGES, DECISIONS) + f""", l as (select area, issue_date, (published_at at time zone 'UTC') at time zone '{ZONE}' as lp from vintages),
      u as (select area, issue_date, case when lp <= lp::date + interval 5 hour then lp::date else lp::date + 1 end as usable from l)
      select area, decision_day, (count(*) filter (where usable <= decision_day))::bigint as visible, (count(*) - count(*) filter (where usable <= decision_day))::bigint as held_back
      from u join decisions on issue_date between decision_day - 20 and decision_day + 4 group by 1, 2""",
)
def visible(spark, sf):
    v = vintages(spark, sf)
    return knowledge.available_counts(
        v, ["area"], F.col("issue_date"), tc.first_usable_day("published_at", ZONE), decisions(spark, sf), "decision_day", 20, 4
    )


@query(
    "newest_public_vintage",
    oracle=with_(VINTAGES) + """
      select area, user_id, target, issue_date, published_at, value from vintages where published_at <= decision
      qualify row_number() over (partition by area, user_id, target order by published_at desc, event_id desc) = 1""",
)
def newest_vintage(spark, sf):
    x = knowledge.newest_vintage(vintages(spark, sf), ["area", "user_id", "target"], "published_at", "decision", ["event_id"])
    return x.select("area", "user_id", "target", "issue_date", "published_at", "value")


@query(
    "newest_public_issue",
    oracle=with_(VINTAGES) + """, p as (select * from vintages where published_at <= decision)
      select event_id, area, target, issue_date from p where (area, target, issue_date) in (select area, target, max(issue_date) from p group by 1, 2)""",
)
def newest_issue(spark, sf):
    p = vintages(spark, sf).where(knowledge.public_by("published_at", "decision"))
    return newest_block(p, ["area", "target"], "issue_date").select("event_id", "area", "target", "issue_date")


@query(
    "latest_public_snapshot",
    oracle=with_(VINTAGES, DECISIONS) + """, s as (select issue_date as snapshot_date, max(published_at) as t from vintages where published_at is not null group by 1)
      select decision_day, max(snapshot_date) as snapshot_date, decision_day - max(snapshot_date) as snapshot_age_days from decisions left join s on s.t <= decision group by 1""",
)
def latest_snapshot(spark, sf):
    s = vintages(spark, sf).select(F.col("issue_date").alias("snapshot_date"), "published_at")
    x = knowledge.latest_snapshot(s, decisions(spark, sf))
    return x.withColumn("snapshot_age_days", F.col("snapshot_age_days").cast("bigint"))


@query(
    "source_priority_rule",
    oracle=with_(VINTAGES) + """, x as (select area, user_id, target, hour(ts)::int as h, case when k % 2 = 0 then 48 else 72 end as lead, value, event_id from vintages where published_at <= decision),
      y as (select area, user_id, target, h, lead, max(value) as value from x group by all)
      select area, user_id, target, h, lead, value from y where (lead = 48 and h <= 21) or lead = 72
      qualify row_number() over (partition by area, user_id, target, h order by lead) = 1""",
)
def source_priority(spark, sf):
    x = vintages(spark, sf).where(knowledge.public_by("published_at", "decision")).groupBy(
        "area", "user_id", "target", F.hour("ts").alias("h"), F.when(F.col("k") % 2 == 0, 48).otherwise(72).alias("lead")
    ).agg(F.max("value").alias("value"))
    return knowledge.priority_source(x, ["area", "user_id", "target", "h"], "lead", "h")


@query(
    "preferred_source_per_day",
    oracle=with_(FEED) + """, a as (select area, ts::date as day, hour(ts)::int as h, max(value) as v from feed where k < 4 group by 1, 2, 3),
      b as (select area, ts::date as day, hour(ts)::int as h, max(value) as v from feed where k >= 30 group by 1, 2, 3),
      u as (select area, day, h, a.v as av, b.v as bv from a full join b using (area, day, h)),
      f as (select area, day, count(av) > 0 as ha, count(bv) > 0 as hb from u group by 1, 2)
      select area, day, h, case when ha then av else bv end as v, case when ha then 1 when hb then 2 else 0 end as source from u join f using (area, day)""",
)
def preferred_source(spark, sf):
    f = feed(spark, sf).select("area", F.col("ts").cast("date").alias("day"), F.hour("ts").alias("h"), "k", "value")
    a = f.where("k < 4").groupBy("area", "day", "h").agg(F.max("value").alias("v"))
    b = f.where("k >= 30").groupBy("area", "day", "h").agg(F.max("value").alias("v"))
    return knowledge.prefer_source(a, b, ["area", "day"], ["area", "day", "h"], "v")


@query(
    "vintage_revision",
    oracle=with_(VINTAGES) + """, r as (select *, row_number() over (partition by area, user_id, target order by published_at desc, event_id desc) as rn from vintages where published_at <= decision),
      g as (select area, user_id, target, max(value) filter (where rn = 1) as newest, max(value) filter (where rn = 2) as previous from r where rn <= 2 group by 1, 2, 3)
      select *, newest - previous as revision from g""",
)
def vintage_revision(spark, sf):
    return knowledge.vintage_revision(vintages(spark, sf), ["area", "user_id", "target"], "published_at", "decision", "value", ["event_id"])
