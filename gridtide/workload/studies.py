"""Study statistics (N1-N30) on the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_avg, exact_sum, rounded
from gridtide.plans import studies
from gridtide.workload.aggregating import _DAY_NET, day_net
from gridtide.workload.bindings import FEED, PANEL, ZONE, Warehouse, feed, load, panel, warehouse_sql, with_, xavg, xsum, xunits
from gridtide.workload.registry import query

# hours with a price, a forecast, an outcome and a gap
SH = FEED + f""", sh as (select area, hour_utc, price, fc, actual, floor((actual - fc)*10000.0e0+0.5e0)/10000.0e0 as err, floor((price - 20.0e0)*10000.0e0+0.5e0)/10000.0e0 as gap, fc2 from (
    select area, date_trunc('hour', ts) as hour_utc, {xavg('value')} as price, {xavg('k')} as fc, max(k) * 1.0e0 as actual, min(k) * 1.0e0 as fc2 from feed group by 1, 2))"""


def sh(spark, sf):
    g = feed(spark, sf).groupBy("area", tc.hour_floor("ts").alias("hour_utc")).agg(
        exact_avg("value").alias("price"), exact_avg("k").alias("fc"), (F.max("k") * 1.0).alias("actual"), (F.min("k") * 1.0).alias("fc2")
    )
    return g.withColumn("err", rounded(F.col("actual") - F.col("fc"))).withColumn("gap", rounded(F.col("price") - 20.0))


@query("fixed_effects_r2")
def fixed_effects(spark, sf):
    o = load(spark, sf, "orders").select(
        "o_orderstatus", F.year("o_orderdate").alias("year"), (F.dayofmonth("o_orderdate") % 24).alias("h"), F.month("o_orderdate").alias("m"),
        (F.col("o_totalprice") / 1000.0).alias("y"), (F.col("o_custkey") / 1000.0).alias("x"), tc.iso_week_parity(F.col("o_orderdate").cast("date")).alias("odd"),
    )
    r = studies.fixed_effects_ols(o, ["o_orderstatus", "year"], "h", "m", "y", "x", F.col("odd") == 1, 100)
    return r.select("o_orderstatus", "year", *[F.round(c, 6).alias(c) for c in ("r2_without", "r2_with", "x_adds")], "n_train", "n_test")


@query(
    "error_profile_by_local_hour",
    oracle=with_(SH) + f" select area, hour((hour_utc at time zone 'UTC') at time zone '{ZONE}')::int as h, {xavg('abs(err)')} as mae, {xavg('err')} as bias, count(err) as n from sh group by 1, 2",
)
def error_profile(spark, sf):
    return studies.error_profile(sh(spark, sf), ["area", tc.local_hour("hour_utc", ZONE).alias("h")], "err")


@query(
    "naive_baselines",
    oracle=with_(SH) + f""", m as (select area, {xavg('price')} as a, {xavg("case when hour_utc < timestamp '2024-01-15' then price end")} as t from sh group by 1)
      select x.area, {xavg('abs(x.price - y.price)')} as mae_yesterday, {xavg('abs(x.price - m.a)')} as mae_long_run, {xavg('abs(x.price - m.t)')} as mae_training_mean, count(x.price) as n
      from sh x join m using (area) left join sh y on y.area = x.area and y.hour_utc = x.hour_utc - interval 24 hour group by 1""",
)
def naive(spark, sf):
    return studies.naive_baselines(sh(spark, sf), ["area"], "hour_utc", "price", F.col("hour_utc") < tc.ntz("2024-01-15 00:00:00"))


@query(
    "bias_of_monthly_means",
    oracle=with_(PANEL) + f""", m as (select zone, date_trunc('month', delivery_date) as p, year(delivery_date)::int as year, {xavg('gap')} as b, {xavg('y_da')} as l from panel group by 1, 2, 3)
      select zone, year, {xavg('b')} as mean_of_means, count(*) as periods, round(corr(b, l), 7) as corr_bias_level from m group by 1, 2""",
)
def monthly_bias(spark, sf):
    return studies.bias_of_means(panel(spark, sf), ["zone"], tc.month_start("delivery_date"), F.year("delivery_date"), "gap", "y_da")


_SA = """avg(case when sign(err) = -sign(gap) then 1.0e0 else 0.0e0 end) as sign_agreement"""


@query(
    "sign_agreement_by_regime",
    oracle=with_(SH) + f""" select area, case when hour_utc < timestamp '2024-01-10' then 'dual' else 'single' end as regime, {_SA}, {xavg('case when err > 0 then gap end')} as gap_when_over,
      {xavg('case when err < 0 then gap end')} as gap_when_under, avg(case when gap = 0 then 1.0e0 else 0.0e0 end) as zero_share, count(*) as n from sh group by 1, 2""",
)
def sign_agreement(spark, sf):
    x = sh(spark, sf).withColumn("regime", F.when(F.col("hour_utc") < tc.ntz("2024-01-10 00:00:00"), "dual").otherwise("single"))
    return studies.sign_agreement(x, ["area", "regime"], "err", "gap")


@query(
    "gap_by_error_decile",
    oracle=with_(SH) + f""", r as (select area, gap, (rank() over (partition by area order by err) + (count(*) over (partition by area, err) - 1) / 2.0e0) / count(*) over (partition by area) as pct from sh)
      select area, least(9, floor(pct * 10.0e0))::int as decile, count(*) as n, {xavg('gap')} as mean_gap from r group by 1, 2""",
)
def gap_deciles(spark, sf):
    return studies.decile_means(sh(spark, sf), ["area"], "err", "gap")


_RULE = """count(pnl) as trades, {avg} as mean, round(stddev_samp(pnl) / sqrt(count(pnl)::double), 6) as se, avg(case when pnl > 0 then 1.0e0 else 0.0e0 end) as hit_rate"""


@query(
    "revision_signal_rule",
    oracle=with_(SH) + f""", x as (select area, gap, floor((fc - fc2)*10000.0e0+0.5e0)/10000.0e0 as rev, hour_utc from sh), c as (select area, quantile_cont(abs(rev), 0.75) as th from x where hour_utc < timestamp '2024-01-15' group by 1),
      t as (select area, round(-sign(rev) * gap - 0.6e0, 6) as pnl from x join c using (area) where abs(rev) > th),
      g as (select area, {_RULE.format(avg=xavg('pnl'))} from t group by 1),
      r as (select *, row_number() over (partition by area order by pnl desc) as rn, count(*) over (partition by area) as n from t),
      b as (select area, case when sum(pnl) > 0 then round(sum(pnl) filter (where rn <= greatest(1, n // 10)) / sum(pnl), 7) end as best_decile_share from r group by 1)
      select g.*, case when abs(mean) <= se then 'null' when mean > 0 then 'positive' else 'negative' end as verdict, best_decile_share from g join b using (area)""",
)
def revision_rule(spark, sf):
    x = sh(spark, sf).withColumn("rev", rounded(F.col("fc") - F.col("fc2")))
    r = studies.revision_rule(x, "area", "rev", "gap", F.col("hour_utc") < tc.ntz("2024-01-15 00:00:00"), 0.6)
    return r.withColumn("best_decile_share", F.round("best_decile_share", 7))


@query(
    "cost_by_horizon",
    oracle=with_(SH) + f""", x as (select area, actual, gap, unnest([{{'horizon': 'early', 'fc': fc}}, {{'horizon': 'late', 'fc': fc2}}], recursive := true) from sh),
      g as (select area, horizon, count(*) as hours, {xsum('-(0.1e0 * actual - 0.1e0 * fc) * gap')} as total, {xsum('0.1e0 * actual')} as a, {xsum('abs(0.1e0 * actual - 0.1e0 * fc)')} as i from x where fc is not null group by 1, 2)
      select area, horizon, hours, total, total / nullif(a, 0) as per_unit, i / nullif(a, 0) as imbalance_share from g""",
)
def cost_by_horizon(spark, sf):
    return studies.cost_by_horizon(sh(spark, sf), ["area"], "actual", "gap", {"early": "fc", "late": "fc2"}, 0.1)


@query(
    "sign_persistence_by_lag",
    oracle=with_(SH) + """, s as (select area, hour_utc, sign(gap) as s from sh), l as (select unnest([1, 2, 3, 6]) as lag),
      m as (select area, greatest(avg(case when s > 0 then 1.0e0 else 0.0e0 end), avg(case when s < 0 then 1.0e0 else 0.0e0 end)) as majority from s where s <> 0 group by 1)
      select x.area, l.lag, avg(case when x.s = y.s then 1.0e0 else 0.0e0 end) as persistence, count(*) as n, any_value(m.majority) as majority
      from s x cross join l join s y on y.area = x.area and y.hour_utc = x.hour_utc - l.lag * interval 1 hour join m on m.area = x.area where x.s <> 0 and y.s <> 0 group by 1, 2""",
)
def persistence(spark, sf):
    return studies.persistence(sh(spark, sf), ["area"], "hour_utc", "gap", [1, 2, 3, 6])


@query(
    "value_of_freshness",
    oracle=with_(SH) + f""", l as (select unnest([0, 1, 2, 3, 4, 5, 6]) as delay),
      g as (select x.area, l.delay, {xavg('sign(y.gap) * x.gap - 0.5e0')} as value, count(*) as n from sh x cross join l join sh y on y.area = x.area and y.hour_utc = x.hour_utc - l.delay * interval 1 hour where y.gap <> 0 group by 1, 2)
      select *, value >= max(case when delay = 0 then value end) over (partition by area) / 2 as keeps_half from g""",
)
def freshness(spark, sf):
    return studies.freshness_value(sh(spark, sf), ["area"], "hour_utc", "gap", list(range(7)), 0.5)


@query(
    "low_price_profile",
    oracle=with_(SH) + f""", x as (select area, hour((hour_utc at time zone 'UTC') at time zone '{ZONE}') as h from sh where price - 10 <= 0)
      select area, count(*) as hours, avg(case when h between 10 and 16 then 1.0e0 else 0.0e0 end) as midday_share, avg(case when h >= 22 or h <= 5 then 1.0e0 else 0.0e0 end) as night_share,
        [""" + ", ".join(f"count(*) filter (where h = {i})" for i in range(24)) + "] as by_hour from x group by 1",
)
def low_profile(spark, sf):
    x = sh(spark, sf).withColumn("p", F.col("price") - 10)
    return studies.negative_profile(x, ["area"], "p", tc.local_hour("hour_utc", ZONE))


@query(
    "refusal_waterfall",
    oracle=with_(SH) + f""" select case when fc > 80 then 'forecast too high' when price < 8 then 'price too low' when abs(err) > 40 then 'error too large' else 'kept' end as reason, count(*) as rows,
      {xavg('gap')} as mean_if_traded, {xsum('gap')} as total_if_traded from sh group by 1""",
)
def waterfall(spark, sf):
    reasons = [("forecast too high", F.col("fc") > 80), ("price too low", F.col("price") < 8), ("error too large", F.abs("err") > 40)]
    return studies.refusal_waterfall(sh(spark, sf), reasons, "gap")


@query(
    "threshold_curve",
    oracle=with_(SH) + f""", q as (select unnest([0.0e0, 10.0e0, 25.0e0, 50.0e0, 75.0e0, 90.0e0]) as q), a as (select {xsum('gap')} as all_total from sh)
      select q, count(*) filter (where fc >= q) as kept, count(*) filter (where fc < q) as removed, coalesce({xsum('case when fc >= q then gap end')}, 0.0e0) as kept_total,
        {xavg('case when fc >= q then gap end')} as kept_mean, coalesce({xsum('case when fc >= q then gap end')}, 0.0e0) >= any_value(all_total) as does_not_lose from sh cross join q cross join a group by q""",
)
def threshold_curve(spark, sf):
    return studies.threshold_curve(sh(spark, sf), "fc", "gap", [0.0, 10.0, 25.0, 50.0, 75.0, 90.0])


_PROB = "pr as (select doc_id, quality, toxic, round(n_chars / (n_chars + 2000.0e0), 6) as p from labels join documents using (doc_id))"


def prob(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "n_chars")
    return load(spark, sf, "labels").join(d, "doc_id").select("doc_id", "quality", "toxic", F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 6).alias("p"))


@query(
    "brier_and_auc",
    oracle=with_(_PROB) + f""", r as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0e0 as rk from pr),
      g as (select sum(rk) filter (where quality = 1) as r, sum(quality)::bigint as pos, count(*) as n, {xavg('(p - quality) * (p - quality)')} as brier from r)
      select n, pos as positives, round((r - pos * (pos + 1) / 2.0e0) / (pos * (n - pos)), 9) as auc, brier from g""",
)
def brier_auc(spark, sf):
    return studies.brier_and_auc(prob(spark, sf), [], "p", "quality").withColumn("auc", F.round("auc", 9))


@query(
    "reliability_by_bin",
    oracle=with_(_PROB) + f""", r as (select *, row_number() over (order by p, doc_id) - 1 as i, count(*) over () as n from pr)
      select greatest(ceil(i * 8.0e0 / greatest(n - 1, 1)) - 1, 0)::int as bin, count(*) as n, {xavg('p')} as mean_p, avg(quality::double) as rate from r group by 1""",
)
def reliability(spark, sf):
    return studies.reliability(prob(spark, sf), "p", "quality", "doc_id", 8)


@query(
    "class_weight_removed",
    oracle=with_(_PROB) + " select doc_id, round(p / (p + 3.0e0 * (1 - p)), 9) as p_true from pr",
)
def class_weight(spark, sf):
    return prob(spark, sf).select("doc_id", F.round(studies.reweighted(F.col("p"), 3.0), 9).alias("p_true"))


@query(
    "calibration_deciles",
    oracle=f"""with r as (select l_returnflag, l_quantity, l_extendedprice / 1000.0e0 as real, round(l_quantity + l_discount * 7, 4) as pred, l_orderkey * 1000 + l_linenumber * 100000000 + l_partkey % 1000 as tie from lineitem),
      u as (select l_returnflag, pred, tie, max(real) as real from r group by 1, 2, 3),
      p as (select *, row_number() over (partition by l_returnflag order by pred, tie) - 1 as i, count(*) over (partition by l_returnflag) as n from u)
      select l_returnflag, greatest(ceil(i * 10.0e0 / greatest(n - 1, 1)) - 1, 0)::int as bin, {xavg('pred')} as pred_mean, {xavg('real')} as real_mean, count(*) as n from p group by 1, 2""",
)
def calibration(spark, sf):
    li = load(spark, sf, "lineitem").select(
        "l_returnflag", F.round(F.col("l_quantity") + F.col("l_discount") * 7, 4).alias("pred"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber").cast("bigint") * 100000000 + F.col("l_partkey") % 1000).alias("tie"), (F.col("l_extendedprice") / 1000.0).alias("real"),
    )
    # dealt in parts of some 500,000 rows, so that what a task holds does not grow with the table
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), li.count() // 500_000 + 1)
    dealt = li.repartition(parts, "l_returnflag", "pred", "tie")
    u = dealt.groupBy("l_returnflag", "pred", "tie").agg(F.max("real").alias("real"))
    return studies.calibration_deciles(u, ["l_returnflag"], "pred", "real", "tie")


@query(
    "daily_spread_rule",
    oracle=warehouse_sql(f"""
, pair as (select hour_utc, any_value(price_eur) filter (area = 'click') as price_a, any_value(price_eur) filter (area = 'view') as price_b, any_value(wind_fc_share) filter (area = 'click') as share_a,
    any_value(wind_fc_share) filter (area = 'view') as share_b from forecast_hourly where price_eur is not null and wind_fc_share is not null group by hour_utc having price_a is not null and price_b is not null),
days as (select hour_utc::date as day, {xavg('share_a')} - {xavg('share_b')} as ds, {xavg('price_a')} - {xavg('price_b')} as spread from pair group by 1),
ruled as (select case when abs(ds) > cut then -sign(ds) * spread - 0.6e0 end as pnl, cut from days, (select quantile_cont(abs(ds), 0.75) as cut from days))
select round(max(cut), 9) as threshold, count(pnl) as days_traded, count(*) as days_total, {xavg('pnl')} as mean_pnl, round(stddev_samp(pnl) / sqrt(count(pnl)), 8) as standard_error,
  case when count(pnl) = 0 then 'no trades' when abs({xavg('pnl')}) <= stddev_samp(pnl) / sqrt(count(pnl)) then 'null' when {xavg('pnl')} > 0 then 'positive' else 'negative' end as verdict from ruled"""),
)
def spread_rule(spark, sf):
    x = studies.daily_spread_rule(Warehouse(spark, sf).forecast_hourly, "area", "hour_utc", "price_eur", "wind_fc_share", ("click", "view"))
    return x.withColumn("threshold", F.round("threshold", 9)).withColumn("standard_error", F.round("standard_error", 8))


# ---------------------------------------------------------------- resampling

DRAWS = 10_000


def positioned(spark, sf):
    """All days of all zones, numbered from the first."""
    d = day_net(spark, sf)
    first = d.agg(F.min("delivery_date").alias("_a"))  # one row
    return d.join(F.broadcast(first)).withColumn("i", F.datediff("delivery_date", "_a")).drop("_a")


def _boot_sql(block: float, seed: int) -> str:
    length = f"floor(ln(1 - u1) / {math.log(1 - 1 / block)!r}e0)::bigint + 1" if block > 1 else "1"
    return _DAY_NET + f""", dn as (select zone, (delivery_date - (select min(delivery_date) from day_net))::bigint as i, floor(net * 16777216.0e0 + 0.5e0) / 16777216.0e0 as v from day_net),
      n as (select max(i) + 1 as n from dn), dr as (select unnest(range({DRAWS})) as draw), k as (select unnest(range(ceil(n * {2.0 / block!r}e0)::bigint + 64)) as k, n from n),
      d0 as (select draw, x1, xor(x2a, x2a >> 16) as x2 from (select draw, xor(x1c, x1c >> 16) as x1, ((xor(x2b, x2b >> 13)::hugeint * 3266489909) & 4294967295)::bigint as x2a
        from (select draw, ((xor(x1b, x1b >> 13)::hugeint * 3266489909) & 4294967295)::bigint as x1c, x2b from (select draw, ((xor(t1, t1 >> 16)::hugeint * 2246822507) & 4294967295)::bigint as x1b,
          ((xor(t2, t2 >> 16)::hugeint * 2246822507) & 4294967295)::bigint as x2b from (select draw, xor({8 * seed + 1}, draw) as t1, xor({8 * seed + 2}, draw) as t2 from dr))))),
      m0 as (select draw, k, n, (x1 + k) & 4294967295 as y1, (x2 + k) & 4294967295 as y2 from d0, k),
      m1 as (select draw, k, n, ((xor(y1, y1 >> 16)::hugeint * 2246822507) & 4294967295)::bigint as y1, ((xor(y2, y2 >> 16)::hugeint * 2246822507) & 4294967295)::bigint as y2 from m0),
      m2 as (select draw, k, n, ((xor(y1, y1 >> 13)::hugeint * 3266489909) & 4294967295)::bigint as y1, ((xor(y2, y2 >> 13)::hugeint * 3266489909) & 4294967295)::bigint as y2 from m1),
      m3 as (select draw, k, n, xor(y1, y1 >> 16) / 4294967296.0e0 as u1, xor(y2, y2 >> 16) / 4294967296.0e0 as u2 from m2),
      b as (select draw, k, n, {length} as len, floor(u2 * n)::bigint as a from m3),
      c as (select *, sum(len) over (partition by draw order by k) - len as fr from b), d as (select draw, n, a, least(len, n - fr) as len from c where fr < n),
      ends as (select draw, a as j, -1 as c from d union all select draw, least(a + len, n), 1 from d union all select draw, a + len - n, 1 from d where a + len > n),
      grid as (select zone, unnest(range(n + 1)) as j from (select distinct zone from dn), n),
      vals as (select g.zone, g.j, coalesce(v, 0) as v, case when v is null then 0 else 1 end as c from grid g left join dn on dn.zone = g.zone and dn.i = g.j - 1),
      pre as (select zone, j, sum(v) over (partition by zone order by j rows unbounded preceding) as s, sum(c) over (partition by zone order by j rows unbounded preceding) as m from vals),
      bm as (select zone, draw, sum(c * s) / sum(c * m) as boot_mean from ends join pre using (j) group by 1, 2)"""


@query("stationary_bootstrap_means", oracle=with_(_boot_sql(7.0, 2026)) + " select zone, draw, boot_mean from bm")
def boot_means(spark, sf):
    return studies.bootstrap_means(positioned(spark, sf), ["zone"], "i", "net", DRAWS, 7.0, 2026)


@query(
    "bootstrap_interval_and_p",
    oracle=with_(_boot_sql(7.0, 11)) + """
      select zone, round(quantile_cont(boot_mean, 0.025), 8) as lo, round(quantile_cont(boot_mean, 0.975), 8) as hi,
        least(1.0e0, 2 * least((count(*) filter (where boot_mean <= 0) + 1) / (count(*) + 1.0e0), (count(*) filter (where boot_mean >= 0) + 1) / (count(*) + 1.0e0))) as p_two_sided, round(stddev_samp(boot_mean), 8) as se,
        case when quantile_cont(boot_mean, 0.025) > 0 then 'pays' when quantile_cont(boot_mean, 0.975) < 0 then 'doesn''t pay' else 'inconclusive' end as verdict from bm group by 1""",
)
def boot_interval(spark, sf):
    m = studies.bootstrap_means(positioned(spark, sf), ["zone"], "i", "net", DRAWS, 7.0, 11)
    s = studies.bootstrap_summary(m, ["zone"]).withColumn("verdict", studies.verdict(F.col("lo"), F.col("hi")))
    return s.select("zone", *[F.round(c, 8).alias(c) for c in ("lo", "hi", "se")], "p_two_sided", "verdict")


@query("day_bootstrap_means", oracle=with_(_boot_sql(1.0, 5)) + " select zone, draw, boot_mean from bm")
def day_boot(spark, sf):
    return studies.bootstrap_means(positioned(spark, sf), ["zone"], "i", "net", DRAWS, 1.0, 5)


@query(
    "holm_step_down",
    oracle=with_(_DAY_NET) + """, t as (select zone, round(exp(-abs(avg(net)) / (stddev_samp(net) / sqrt(count(*)))), 9) as p from day_net group by 1),
      r as (select *, row_number() over (order by p, zone)::int as rank, count(*) over () as m from t), a as (select *, 0.05e0 / (m - rank + 1) as alpha from r),
      k as (select *, coalesce(bool_and(p < alpha) over (order by p, zone rows between unbounded preceding and 1 preceding), true) as reached from a)
      select zone, p, rank, alpha, reached, reached and p < alpha as rejected, 1 - alpha as level from k""",
)
def holm(spark, sf):
    t = day_net(spark, sf).groupBy("zone").agg(
        F.round(F.exp(-F.abs(F.avg("net")) / (F.stddev_samp("net") / F.sqrt(F.count(F.lit(1)).cast("double")))), 9).alias("p")
    )
    return studies.holm(t, "zone", "p")


@query(
    "equivalence_and_detectable_effect",
    oracle=with_(_DAY_NET) + """, t as (select zone, avg(net) as m, stddev_samp(net) / sqrt(count(*)) as se from day_net group by 1), b as (select zone, m - 2 * se as lo, m + 2 * se as hi, se from t)
      select zone, case when lo > 0 then 'better' when hi < 0 then 'worse' when lo >= -5 and lo <= 0 and hi >= 0 and hi <= 5 then 'equivalent' else 'inconclusive' end as verdict, round(se * 2.8015852181, 6) as mde from b""",
)
def equivalence(spark, sf):
    t = day_net(spark, sf).groupBy("zone").agg(F.avg("net").alias("m"), (F.stddev_samp("net") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("se"))
    lo, hi = F.col("m") - 2 * F.col("se"), F.col("m") + 2 * F.col("se")
    return t.select("zone", studies.equivalence(lo, hi, F.lit(5.0)).alias("verdict"), F.round(studies.minimum_detectable(F.col("se")), 6).alias("mde"))


# ---------------------------------------------------------------- tables

@query(
    "zone_supply_sanity",
    oracle=with_(PANEL) + f""", q as (select zone, quantile_cont(gap, 0.99) as q from panel group by 1)
      select zone, {xavg('-gap')} as mean_supply, avg(case when -gap < 0 then 1.0e0 else 0.0e0 end) as share_negative, {xavg('case when gap <= q then -gap end')} as mean_without_top_1pct, min(-gap) as worst, count(gap) as n from panel join q using (zone) group by 1""",
)
def supply_sanity(spark, sf):
    return studies.supply_sanity(panel(spark, sf), "zone", "gap")


@query(
    "correlation_matrix_by_year",
    oracle=with_(_DAY_NET) + """ select a.year::int as year, a.zone as zone_i, b.zone as zone_j, round(corr(a.net, b.net), 7) as pearson, count(*) as days from day_net a join day_net b on a.delivery_date = b.delivery_date and a.zone < b.zone group by 1, 2, 3""",
)
def corr_matrix(spark, sf):
    return studies.correlation_matrix(day_net(spark, sf), "delivery_date", "zone", "net", ["year"]).withColumn("pearson", F.round("pearson", 7))


@query(
    "tail_comovement",
    oracle=with_(_DAY_NET) + """, w as (select zone as worst_of, delivery_date from day_net qualify row_number() over (partition by zone order by net, delivery_date) <= 20)
      select worst_of, zone, avg(case when net < 0 then 1.0e0 else 0.0e0 end) as share_losing, count(*) as days from w join day_net using (delivery_date) where zone <> worst_of group by 1, 2""",
)
def tail(spark, sf):
    return studies.tail_comovement(day_net(spark, sf).drop("year"), "delivery_date", "zone", "net", 20)


@query(
    "attribution",
    oracle=f"""select year(l_shipdate)::int as year, l_returnflag, month(l_shipdate)::int as month, {xsum('l_extendedprice*(1-l_discount)/1000.0e0')} as energy, {xsum('l_extendedprice*l_discount/1000.0e0')} as congestion,
      {xsum('l_extendedprice*l_tax/1000.0e0')} as loss, {xsum('0.1e0*l_quantity')} as fees, count(*) as n from lineitem group by 1, 2, 3""",
)
def attribution(spark, sf):
    p = F.col("l_extendedprice")
    return load(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("year"), "l_returnflag", F.month("l_shipdate").alias("month")).agg(
        exact_sum(p * (1 - F.col("l_discount")) / 1000.0).alias("energy"), exact_sum(p * F.col("l_discount") / 1000.0).alias("congestion"),
        exact_sum(p * F.col("l_tax") / 1000.0).alias("loss"), exact_sum(F.lit(0.1) * F.col("l_quantity")).alias("fees"), F.count(F.lit(1)).alias("n"),
    )


@query(
    "position_overlap",
    oracle=with_(PANEL) + f""", p as (select delivery_date, zone, slot, case when gap < -1 then -1.0e0 when gap > 2 then 1.0e0 else 0.0e0 end as pa, case when y_da > 50 then -1.0e0 when slot > 5 then 1.0e0 else 0.0e0 end as pb, gap from panel)
      select case when pa = 0 and pb = 0 then 'both flat' when pa = pb then 'same' when pb = 0 then 'only first' when pa = 0 then 'only second' when sign(pa) = -sign(pb) then 'opposite' else 'different size' end as category,
        count(*) as rows, {xsum('pa * gap - pb * gap')} as net_difference from p group by 1""",
)
def overlap(spark, sf):
    p = panel(spark, sf)
    k = ["delivery_date", "zone", "slot"]
    a = p.withColumn("pos", F.when(F.col("gap") < -1, -1.0).when(F.col("gap") > 2, 1.0).otherwise(0.0))
    b = p.withColumn("pos", F.when(F.col("y_da") > 50, -1.0).when(F.col("slot") > 5, 1.0).otherwise(0.0))
    net = F.col("pos") * F.col("gap")
    return studies.overlap_categories(a.withColumn("net", net), b.withColumn("net", net), k, "pos", "net")


@query(
    "event_windows",
    oracle=with_(_DAY_NET) + f""", d as (select delivery_date, {xsum('net')} as net from day_net group by 1),
      e as (select *, case when delivery_date between '1996-02-01' and '1996-02-20' then 'storm' when delivery_date between '1999-07-01' and '1999-07-31' then 'heat' else 'none' end as event from d)
      select event, {xsum('net')} as net, min(net) as worst_day, count(*) as days from e group by 1""",
)
def event_windows(spark, sf):
    d = day_net(spark, sf).groupBy("delivery_date").agg(exact_sum("net").alias("net"))
    return studies.event_windows(d, "delivery_date", "net", {"storm": ("1996-02-01", "1996-02-20"), "heat": ("1999-07-01", "1999-07-31")})


@query(
    "market_baseline",
    oracle=f"""with d as (select o_orderdate::date as day, {xavg('o_totalprice')} as lv from orders group by 1), b as (select o_orderdate::date as day, {xavg('o_custkey')} as rate from orders where o_orderpriority = '1-URGENT' group by 1),
      j as (select day, lv, last_value(rate ignore nulls) over (order by day rows unbounded preceding) as r from d full join b using (day)), k as (select *, max(lv) over (order by day rows unbounded preceding) as peak from j where lv is not null),
      g as (select arg_min(lv, day) as first_level, arg_max(lv, day) as last_level, max(day) - min(day) as span_days, min(lv / peak - 1) as worst_drawdown, {xavg('r')} as mean_rate from k)
      select first_level, last_level, span_days::int as span_days, worst_drawdown, mean_rate, round(pow(last_level / first_level, 365.0e0 / span_days) - 1, 9) as annual_return from g""",
)
def market_baseline(spark, sf):
    o = load(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    d = o.groupBy("day").agg(exact_avg("o_totalprice").alias("lv"))
    b = o.where(F.col("o_orderpriority") == "1-URGENT").groupBy("day").agg(exact_avg("o_custkey").alias("rate"))
    return studies.market_baseline(d, "day", "lv", b, "rate").withColumn("annual_return", F.round("annual_return", 9))


@query(
    "cell_correction",
    oracle=with_(PANEL) + f""", r as (select zone, slot, quarter(delivery_date)::int as q, gap + 0.5e0 as res from panel), g as (select zone, slot, q, count(res) as n, {xavg('res')} as m, stddev_samp(res) as s from r group by 1, 2, 3)
      select zone, slot, q, n, round(m / (s / sqrt(n::double)), 6) as t, round(case when abs(m / (s / sqrt(n::double))) >= 2 then m * n / (n + 200.0e0) else 0.0e0 end, 9) as correction from g""",
)
def cell_correction(spark, sf):
    r = panel(spark, sf).select("zone", "slot", F.quarter("delivery_date").alias("q"), (F.col("gap") + 0.5).alias("res"))
    x = studies.cell_correction(r, ["zone", "slot", "q"], "res")
    return x.withColumn("t", F.round("t", 6)).withColumn("correction", F.round("correction", 9))


@query(
    "run_spread",
    oracle=with_(_DAY_NET) + f""", y as (select zone, year::int as year, {xsum('net')} as total from day_net group by 1, 2)
      select zone, min(total) as low, round(median(total), 8) as middle, max(total) as high, count(*) filter (where total < 0) as negative_runs, count(*) as runs from y group by 1""",
)
def run_spread(spark, sf):
    y = day_net(spark, sf).groupBy("zone", "year").agg(exact_sum("net").alias("total"))
    return studies.run_spread(y, ["zone"], "total").withColumn("middle", F.round("middle", 8))


@query(
    "season_control",
    oracle=with_(_DAY_NET) + f""" select month(delivery_date) in (1, 2, 7, 8) as flagged, {xsum('case when month(delivery_date) in (1, 2, 7, 8) then 0.0e0 else -net end')} as filtered_net, {xsum('-net')} as always_net, count(*) as days from day_net group by 1""",
)
def season_control(spark, sf):
    flag = F.month("delivery_date").isin(1, 2, 7, 8)
    return day_net(spark, sf).groupBy(flag.alias("flagged")).agg(
        exact_sum(F.when(flag, 0.0).otherwise(-F.col("net"))).alias("filtered_net"), exact_sum(-F.col("net")).alias("always_net"), F.count(F.lit(1)).alias("days")
    )
