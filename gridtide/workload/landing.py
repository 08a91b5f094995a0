"""Sources, landing and incremental reading (A1-A18) on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_sum
from gridtide.session import working_dir
from gridtide.sources import landing
from gridtide.workload.bindings import FEED, feed, load, with_, xsum
from gridtide.workload.registry import query

# Fee rates for the years of the given tables.
EARLIER = {y: (0.05 + 0.01 * (y - 1995), 0.01, 0.002 * (y - 1994)) for y in range(1995, 2002)}


def fees(spark):
    return landing.fees_dim(spark, EARLIER)


def fees_sql() -> str:
    rates = {**landing.FEES, **EARLIER}
    rows = ", ".join(f"({y}, {round(a + b, 6)!r}e0, {round(a + b + c, 6)!r}e0)" for y, (a, b, c) in sorted(rates.items()))
    return f"fees as (select year::int as year, load_cost::double as load_cost, supply_cost::double as supply_cost from (values {rows}) t(year, load_cost, supply_cost))"


@query(
    "landed_with_provenance",
    oracle="""select '_events' as _source, max(ts) as _fetched_at, count(*) as rows, count(distinct event_type) as series, 'all' as _request
      from events""",
)
def landed(spark, sf):
    raw = landing.with_provenance(load(spark, sf, "events"), "_events", "all", F.col("ts"))
    return raw.groupBy("_source", "_request").agg(
        F.max("_fetched_at").alias("_fetched_at"), F.count(F.lit(1)).alias("rows"), F.countDistinct("event_type").alias("series")
    )


@query("watermark", oracle="select max(ts) as watermark from events")
def watermark(spark, sf):
    return landing.watermark(load(spark, sf, "events"), "ts")


@query(
    "request_windows",
    oracle="""with b as (select min(o_orderdate)::date as a, max(o_orderdate)::date + 1 as b from orders),
      w as (select a, b, unnest(generate_series(date_trunc('month', a), (b - 1)::timestamp, interval 5 month))::date as w from b)
      select greatest(w, a) as window_start, least((w + interval 5 month)::date, b) as window_end from w""",
)
def request_windows(spark, sf):
    b = load(spark, sf, "orders").agg(
        F.min(F.col("o_orderdate").cast("date")).alias("a"), F.date_add(F.max(F.col("o_orderdate").cast("date")), 1).alias("b")
    )
    return landing.windows_of(b, 5)


@query(
    "incremental_slice",
    oracle="""select o_orderkey, o_orderdate from orders where o_orderdate >= (select max(o_orderdate) from orders) - interval 100 day""",
)
def incremental_slice(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return landing.incremental_slice(o, "o_orderdate", 100, landing.watermark(o, "o_orderdate"))


@query(
    "json_records",
    oracle=with_(FEED) + " select area, k, count(*) as n from feed group by 1, 2",
)
def json_records(spark, sf):
    # each event becomes a {"records": [...]} document and is parsed back
    e = load(spark, sf, "events")
    doc = F.concat(F.lit('{"records":['), F.col("props"), F.lit("]}"))
    parsed = e.select(
        F.col("event_type").alias("area"),
        F.explode(F.from_json(doc, "records array<struct<k: int>>")["records"]).alias("r"),
    )
    return parsed.groupBy("area", F.col("r.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "parallel_arrays",
    oracle=with_(FEED) + """, x as (select area, ts, value, k from feed union all select area, ts + interval 1 hour, value + 1.0e0, null from feed)
      select area, cast(ts as date) as d, count(*) as n, count(k) as with_k, """ + xsum("value") + """ as total, max(k) as max_k from x group by 1, 2""",
)
def parallel_arrays(spark, sf):
    # every event becomes a document with three parallel arrays (two hours, the second without k)
    docs = feed(spark, sf).select(
        "area", F.array("ts", F.col("ts") + tc.hours(1)).alias("time"), F.array("value", F.col("value") + 1.0).alias("temperature"),
        F.array(F.col("k"), F.lit(None)).alias("kk"),
    )
    rows = landing.explode_parallel_arrays(docs, {"time": "ts", "temperature": "value", "kk": "k"}, ["area"])
    return rows.groupBy("area", F.col("ts").cast("date").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.count("k").alias("with_k"), exact_sum("value").alias("total"), F.max("k").alias("max_k")
    )


@query(
    "nested_maps",
    oracle=with_(FEED) + """ select event_id, k as lead_hours, area as point, value from feed where k <= 60""",
)
def nested_maps(spark, sf):
    f = feed(spark, sf)
    text = F.to_json(F.create_map(F.col("k").cast("string"), F.create_map(F.col("area"), F.col("value"))))
    return landing.explode_nested_map(f.select("event_id", text.alias("j")), "j", ["event_id"], 60)


@query(
    "fill_missing_days",
    oracle=f"""with p as (select o_orderstatus, o_orderdate::date as day, {xsum('o_totalprice')} as total from orders where o_orderpriority = '1-URGENT' group by 1, 2),
      b as (select o_orderstatus, o_orderdate::date as day, {xsum('o_totalprice')} as total from orders group by 1, 2)
      select *, 'primary' as origin from p union all select *, 'backup' from b anti join p using (o_orderstatus, day)""",
)
def fill_missing_days(spark, sf):
    o = load(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))

    def daily(df):
        return df.groupBy("o_orderstatus", "day").agg(exact_sum("o_totalprice").alias("total"))

    return landing.fill_missing_days(daily(o.where(F.col("o_orderpriority") == "1-URGENT")), daily(o), ["o_orderstatus"], "day")


@query(
    "slice_window",
    oracle="select event_id, ts, value from events where ts >= timestamp '2024-01-15 00:00:00' and ts < timestamp '2024-01-18 12:00:00'",
)
def slice_window(spark, sf):
    e = load(spark, sf, "events").select("event_id", "ts", "value")
    return landing.slice_window(e, "ts", tc.ntz("2024-01-15 00:00:00"), tc.ntz("2024-01-18 12:00:00"))


@query(
    "rounded_export",
    oracle="select event_type, count(*) as n, round(max(value), 1) as high, round(min(value), 1) as low from events group by 1",
)
def rounded_export(spark, sf):
    g = load(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("high"), F.min("value").alias("low")
    )
    return landing.rounded_export(g, 1, ["event_type"])


@query("read_before_bound", oracle="select count(*) as n, max(o_orderdate) as newest from orders where o_orderdate < timestamp '2000-01-01'")
def read_before(spark, sf):
    o = landing.read_before(load(spark, sf, "orders"), "o_orderdate", tc.ntz("2000-01-01 00:00:00"))
    return o.agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("newest"))


@query(
    "append_or_replace_last",
    oracle="""with d as (select cast(ts as date) as night, count(*) as n from events group by 1),
      log as (select night, n, night = (select min(night) from d) as baseline from d)
      select night, n, baseline from log where night < (select max(night) from d)
      union all select max(night), max(n) * 10, false from d""",
)
def append_or_replace(spark, sf):
    d = load(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("night")).agg(F.count(F.lit(1)).alias("n"))
    first = d.agg(F.min("night").alias("_m"))
    log = d.join(F.broadcast(first)).select("night", "n", (F.col("night") == F.col("_m")).alias("baseline"))
    entry = d.agg(F.max("night").alias("night"), (F.max("n") * 10).alias("n"), F.lit(False).alias("baseline"))
    return landing.append_or_replace_last(log, entry, "night", "baseline", "night")


@query(
    "fees_by_year_and_side",
    oracle="with " + fees_sql() + """
      select l_linestatus, year(l_shipdate) as year, count(*) as n, max(case when l_linestatus = 'F' then supply_cost else load_cost end) as cost
      from lineitem join fees on year = year(l_shipdate) group by 1, 2""",
)
def fees_by_year(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    # the fee table has one row per calendar year
    j = li.join(F.broadcast(fees(spark)), "year")
    cost = F.when(F.col("l_linestatus") == "F", F.col("supply_cost")).otherwise(F.col("load_cost"))
    return j.groupBy("l_linestatus", "year").agg(F.count(F.lit(1)).alias("n"), F.max(cost).alias("cost"))


# ---------------------------------------------------------------- files written in a feed's shape, then read by the operator


@query(
    "landed_then_read",
    oracle="""select event_type, 'feed' as _source, case when event_id % 2 = 0 then 'even' else 'odd' end as _request, max(ts) as _fetched_at, count(*) as rows,
        count(case when event_id % 2 = 1 then value end) as with_extra from events group by 1, 2, 3""",
)
def landed_then_read(spark, sf):
    # two requests, the second with one more column; an empty third one writes nothing
    root, e = working_dir(spark, "landing"), load(spark, sf, "events")
    stamp = F.col("ts")
    landing.land(e.where("event_id % 2 = 0").select("event_id", "event_type", "ts"), root, "feed", "even", stamp)
    landing.land(e.where("event_id % 2 = 1").select("event_id", "event_type", "ts", "value"), root, "feed", "odd", stamp)
    landing.land(e.where("false"), root, "feed", "none", stamp)
    raw = landing.read_raw(spark, f"{root}/feed")
    return raw.groupBy("event_type", "_source", "_request").agg(
        F.max("_fetched_at").alias("_fetched_at"), F.count(F.lit(1)).alias("rows"), F.count("value").alias("with_extra")
    )


@query("json_files", oracle="select event_id, event_type, cast(json_extract_string(props, '$.k') as int) as k from events")
def json_files(spark, sf):
    # one {"records": [...]} object per user and day
    path, e = working_dir(spark, "json"), load(spark, sf, "events")
    record = F.struct("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    body = e.groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(F.collect_list(record).alias("records"))
    body.select("records").write.option("compression", "gzip").json(path)
    return landing.read_json_files(spark, path, "event_id long, event_type string, k int")


@query(
    "reference_rate_files",
    oracle="""select o_orderdate::date as date, o_orderpriority as currency, 'EUR' as denominator, o_totalprice as rate, o_orderstatus as status from orders where o_orderstatus <> 'P'""",
)
def reference_rate_files(spark, sf):
    # observations of status P are published empty and drop out
    path, o = working_dir(spark, "rates"), load(spark, sf, "orders")
    value = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("string"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    shape = o.select(day.alias("TIME_PERIOD"), F.col("o_orderpriority").alias("CURRENCY"), F.lit("EUR").alias("CURRENCY_DENOM"), value.alias("OBS_VALUE"), F.col("o_orderstatus").alias("OBS_STATUS"))
    shape.write.option("header", "true").csv(path)
    return landing.read_fx_csv(spark, path)


@query(
    "monthly_write_and_pruned_read",
    oracle="""select o_orderkey, o_orderdate, case when o_orderdate >= timestamp '1997-03-01' and o_orderdate < timestamp '1997-04-01' then 2 else 1 end as version
      from orders where o_orderdate >= timestamp '1997-01-15' and o_orderdate < timestamp '1997-05-02'""",
)
def monthly(spark, sf):
    # all months, then one month again: only that one is replaced
    path = working_dir(spark, "months")
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    landing.write_monthly(o.withColumn("version", F.lit(1)), "o_orderdate", path)
    march = (F.col("o_orderdate") >= tc.ntz("1997-03-01 00:00:00")) & (F.col("o_orderdate") < tc.ntz("1997-04-01 00:00:00"))
    landing.write_monthly(o.where(march).withColumn("version", F.lit(2)), "o_orderdate", path)
    return landing.read_months(spark, path, "o_orderdate", "1997-01-15 00:00:00", "1997-05-02 00:00:00")


@query(
    "exported_then_read",
    oracle="select o_orderkey, round(o_totalprice, 1) as o_totalprice, o_orderdate from orders",
)
def exported(spark, sf):
    path = working_dir(spark, "export")
    landing.export_rounded(load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), path, 1, ["o_orderkey"])
    return landing.read_raw(spark, path)
