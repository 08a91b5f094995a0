"""Projection, typing and scalar expressions (B1-B18, S1-S3) on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions import names, numbers
from gridtide.functions import timecols as tc
from gridtide.workload.bindings import FEED, feed, load, with_
from gridtide.workload.registry import query


@query(
    "typed_projection",
    oracle="""select l_orderkey as order_id, cast(l_quantity as int) as qty, 15 as interval_minutes, 'EUR/MWh' as unit,
      l_returnflag || '_DA' as instrument, l_linestatus || ' per ' || l_returnflag as pair from lineitem""",
)
def typed_projection(spark, sf):
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_quantity").cast("int").alias("qty"), F.lit(15).alias("interval_minutes"),
        F.lit("EUR/MWh").alias("unit"), F.concat("l_returnflag", F.lit("_DA")).alias("instrument"),
        F.concat("l_linestatus", F.lit(" per "), "l_returnflag").alias("pair"),
    )


@query(
    "null_safe_expressions",
    oracle=with_(FEED) + """, x as (select *, case when k < 30 then value end as a, case when k >= 20 then value / 2.0e0 end as b from feed)
      select event_id, coalesce(a, 0.0e0) + coalesce(b, 0.0e0) as total, case when k - 10 > 0 then value / (k - 10) end as ratio,
        (a is not null)::int + (b is not null)::int as present, greatest(a, b) as later, case when a is not null then greatest(least(a, 50.0e0), 5.0e0) end as clipped,
        abs(value - k) as gap, cast(sign(value - k) as double) as side, case when value > k then 'positive' when value < k then 'negative' else 'zero' end as word,
        greatest(value, k) - least(value, k) as rng from x""",
)
def null_safe(spark, sf):
    x = feed(spark, sf).withColumn("a", F.when(F.col("k") < 30, F.col("value"))).withColumn("b", F.when(F.col("k") >= 20, F.col("value") / 2.0))
    d = F.col("value") - F.col("k")
    return x.select(
        "event_id", numbers.null_safe_sum("a", "b").alias("total"), numbers.safe_ratio("value", F.col("k") - 10).alias("ratio"),
        numbers.presence_count("a", "b").alias("present"), numbers.later_of("a", "b").alias("later"), numbers.clip("a", 5, 50).alias("clipped"),
        F.abs(d).alias("gap"), F.signum(d).alias("side"), numbers.sign_word(d).alias("word"),
        numbers.row_range("value", F.col("k").cast("double")).alias("rng"),
    )


@query(
    "filters_and_predicates",
    oracle="""select p_partkey, p_name, p_size from part where p_name like '%ring%' and p_size in (1, 5, 11, 23) and p_type not in ('SMALL')
      union all select p_partkey, p_name, p_size from part where p_retailprice >= 950 and p_retailprice < 955""",
)
def predicates(spark, sf):
    p = load(spark, sf, "part")
    cols = ["p_partkey", "p_name", "p_size"]
    a = p.where(F.col("p_name").like("%ring%") & F.col("p_size").isin(1, 5, 11, 23) & ~F.col("p_type").isin("SMALL"))
    b = p.where((F.col("p_retailprice") >= 950) & (F.col("p_retailprice") < 955))
    return a.select(cols).unionByName(b.select(cols))


@query(
    "unit_transforms",
    oracle=with_(FEED) + """
      select area, cast(ts as date) as d, round(max(k * 9.0e0 / 5.0e0 + 32.0e0), 6) as max_f, sum(cast(greatest(65.0e0 - k, 0.0e0) as bigint)) as hdd,
        sum(cast(greatest(k - 65.0e0, 0.0e0) as bigint)) as cdd from feed group by 1, 2""",
)
def unit_transforms(spark, sf):
    k = F.col("k").cast("double")
    return feed(spark, sf).groupBy("area", F.col("ts").cast("date").alias("d")).agg(
        F.round(F.max(numbers.fahrenheit(k)), 6).alias("max_f"), F.sum(numbers.heating_degrees(k).cast("bigint")).alias("hdd"),
        F.sum(numbers.cooling_degrees(k).cast("bigint")).alias("cdd"),
    )


@query(
    "cyclic_calendar",
    oracle=f"""with d as (select distinct o_orderdate::date as d from orders)
      select d, round(sin(2.0e0 * pi() * dayofyear(d) / 365.25e0), 9) as doy_sin, round(cos(2.0e0 * pi() * dayofyear(d) / 365.25e0), 9) as doy_cos,
        round(sin(2.0e0 * pi() * (isodow(d) - 1) / 7.0e0), 9) as dow_sin, (isodow(d) - 1)::int as dow, isodow(d) >= 6 as weekend, (weekofyear(d) % 2)::int as odd_week,
        case when month(d) in (12, 1, 2) then 'winter' when month(d) <= 5 then 'spring' when month(d) <= 8 then 'summer' else 'autumn' end as season,
        year(d)::varchar || case when month(d) <= 6 then 'H1' else 'H2' end as half, year(d)::varchar || 'Q' || quarter(d)::varchar as quarter from d""",
)
def cyclic_calendar(spark, sf):
    d = load(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    ys, yc = tc.cyclic(F.dayofyear("d"), 365.25)
    ws, _ = tc.cyclic(tc.weekday("d"), 7)
    return d.select(
        "d", F.round(ys, 9).alias("doy_sin"), F.round(yc, 9).alias("doy_cos"), F.round(ws, 9).alias("dow_sin"), tc.weekday("d").alias("dow"),
        tc.is_weekend("d").alias("weekend"), tc.iso_week_parity("d").alias("odd_week"), tc.season("d").alias("season"),
        tc.half_year("d").alias("half"), tc.quarter_label("d").alias("quarter"),
    )


@query(
    "holiday_flags",
    oracle="""with d as (select distinct o_orderdate::date as d from orders),
      y as (select unnest(range(1994, 2003)) as y),
      raw as (
        select make_date(y, 1, 1) as h, 'ny' as k from y union all select make_date(y, 7, 4), 'jul' from y union all select make_date(y, 11, 11), 'vet' from y
        union all select make_date(y, 12, 25), 'xmas' from y
        union all select make_date(y, 1, 15 + (8 - isodow(make_date(y, 1, 15)))::int % 7), 'mlk' from y
        union all select make_date(y, 2, 15 + (8 - isodow(make_date(y, 2, 15)))::int % 7), 'pres' from y
        union all select make_date(y, 5, 25 + (8 - isodow(make_date(y, 5, 25)))::int % 7), 'mem' from y
        union all select make_date(y, 9, 1 + (8 - isodow(make_date(y, 9, 1)))::int % 7), 'labor' from y
        union all select make_date(y, 10, 8 + (8 - isodow(make_date(y, 10, 8)))::int % 7), 'col' from y
        union all select make_date(y, 11, 22 + (11 - isodow(make_date(y, 11, 22)))::int % 7), 'thanks' from y),
      fed as (select case isodow(h) when 6 then h - 1 when 7 then h + 1 else h end as h from raw),
      nerc as (select case isodow(h) when 7 then h + 1 else h end as h from raw where k in ('ny', 'mem', 'jul', 'labor', 'thanks', 'xmas'))
      select d, d in (select h from fed) as federal, d in (select h from nerc) as nerc from d""",
)
def holiday_flags(spark, sf):
    d = load(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return d.select("d", tc.is_us_federal_holiday("d").alias("federal"), tc.is_nerc_holiday("d").alias("nerc"))


@query(
    "equipment_names",
    oracle="""with n as (select p_partkey, upper(replace(p_name, ' ', '_')) || '_' || case when p_size < 10 then '345KV' when p_size < 20 then '230B' when p_size < 30 then '138' else 'X12 69 KV' end || '_' || p_size as nm from part),
      t as (select p_partkey, nm, list_filter([regexp_extract(x, '^(\\d{2,3})(KV|[A-Z])?$', 1) for x in regexp_split_to_array(nm, '[_\\s]+')],
        lambda v: v in ('765','500','345','230','220','138','115','69','46','34')) as toks from n),
      k as (select p_partkey, nm, case when len(toks) > 0 then toks[1]::int when regexp_extract(nm, '(\\d{2,3})\\s*KV', 1) <> '' then regexp_extract(nm, '(\\d{2,3})\\s*KV', 1)::int end as kv from t)
      select p_partkey, kv, case when kv >= 345 then '345kv_up' when kv = 230 then '230kv' when kv = 138 then '138kv' else 'other_kv' end as class,
        case when length(nm) > 8 and substr(nm, 9, 1) = '_' then trim(substr(nm, 1, 8), '_') else split_part(nm, '_', 1) end as site,
        trim(regexp_replace(lower(nm), '[^a-z0-9]+', '_', 'g'), '_') as slug from k""",
)
def equipment_names(spark, sf):
    size = F.col("p_size")
    tail = F.when(size < 10, "345KV").when(size < 20, "230B").when(size < 30, "138").otherwise("X12 69 KV")
    nm = F.concat(F.upper(F.regexp_replace("p_name", " ", "_")), F.lit("_"), tail, F.lit("_"), size.cast("string"))
    p = load(spark, sf, "part").select("p_partkey", nm.alias("nm"))
    return p.select(
        "p_partkey", names.voltage_kv("nm").alias("kv"), names.voltage_class("nm").alias("class"), names.sites("nm")[0].alias("site"), names.slug("nm").alias("slug")
    )


@query(
    "local_clock",
    oracle=f"""select o_orderkey, cast((t at time zone 'UTC') at time zone 'America/New_York' as date) as local_day,
        hour((t at time zone 'UTC') at time zone 'America/New_York')::int as local_hour,
        ((t::date + interval 5 hour) at time zone 'America/New_York') at time zone 'UTC' as decision
      from (select o_orderkey, o_orderdate + (o_orderkey % 24) * interval 1 hour as t from orders)""",
)
def local_clock(spark, sf):
    z = "America/New_York"
    o = load(spark, sf, "orders").select("o_orderkey", (F.col("o_orderdate") + tc.hours(F.col("o_orderkey") % 24)).alias("t"))
    return o.select(
        "o_orderkey", tc.local_date("t", z).alias("local_day"), tc.local_hour("t", z).alias("local_hour"),
        tc.decision_time(F.col("t").cast("date"), z).alias("decision"),
    )
