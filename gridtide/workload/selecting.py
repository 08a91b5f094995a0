"""Walk-forward selection and placebos (P1-P8, P17, P21; O6, O7, O10) on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions.exact import exact_avg, exact_sum
from gridtide.plans import positions as pos
from gridtide.plans import selection as sel
from gridtide.workload.bindings import PANEL, ZONE, panel, with_, xavg, xsum
from gridtide.workload.positions import PAIRS, RULES, ledger_sql, pair_rows, rule_panel
from gridtide.workload.registry import query

CUTS = (-0.5, 0.0, 0.5, 1.0)
DRAWS = 1_000
DAY = "delivery_date"


@query(
    "training_rows_per_refit",
    oracle=with_(PANEL) + f""", f as (select *, (label_published_at at time zone 'UTC') at time zone '{ZONE}' as lp from panel),
      m as (select distinct zone, unnest(generate_series(date '1995-02-01', date '2002-02-01', interval 1 month))::date as period from panel),
      j as (select m.zone, m.period, count(*) as train_rows, max(delivery_date) as train_last from m join f on f.zone = m.zone and f.delivery_date <= m.period - 2 and f.lp <= (m.period - 1) + interval 5 hour group by 1, 2)
      select * from j where (zone, period) in (select zone, period from j qualify train_rows > coalesce(lag(train_rows) over (partition by zone order by period), 0))""",
)
def training_rows(spark, sf):
    return sel.training_rows(panel(spark, sf), ["zone"], DAY, "label_published_at", "gap", ZONE)


@query(
    "quarter_calendar",
    oracle="""select p::date as period, (p + interval 3 month)::date as period_end, year(p)::varchar || 'Q' || quarter(p)::varchar as label from (
      select unnest(generate_series(date_trunc('quarter', min(o_orderdate)), date_trunc('quarter', max(o_orderdate)), interval 3 month)) as p from orders)""",
)
def quarter_calendar(spark, sf):
    from gridtide.operators.grid import bounds
    from gridtide.workload.bindings import load

    o = load(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return sel.quarter_calendar(bounds(o, [], "d"))


def nets(spark, sf):
    """Daily net of each cut of a sit-out rule."""
    p = rule_panel(spark, sf)
    g = F.coalesce("gap", F.lit(0.0))
    settings = []
    for c in CUTS:
        x = F.when(F.col("gap").isNull() | F.col("s28").isNull(), 0.0).otherwise(pos.flagged_days(F.col("s28"), c))
        settings.append((f"cut {c}", x * g - F.abs(x) * pos.side_cost(x)))
    return sel.setting_nets(p, [DAY], settings)


NETS = """sn as (select delivery_date, i as setting_index, 'cut ' || c as setting, coalesce(""" + xsum(
    "case when gap is null or s28 is null then 0.0e0 when s28 > c then 0.0e0 else -gap - supply_cost end"
) + """, 0.0e0) as net from rp cross join (values (0, -0.5e0), (1, 0.0e0), (2, 0.5e0), (3, 1.0e0)) s(i, c) group by delivery_date, i, c)"""

QTRS = "qs as (select unnest(generate_series(date_trunc('quarter', (select min(delivery_date) from panel)), date_trunc('quarter', (select max(delivery_date) from panel)) + interval 3 month, interval 3 month))::date as period)"

CHOICE = f"""ch as (with t as (select q.period, s.setting_index, any_value(s.setting) as setting, count(*) filter (where d.delivery_date >= q.period - interval 12 month and d.delivery_date <= q.period - 2) as n,
      coalesce({xsum('case when d.delivery_date >= q.period - interval 12 month and d.delivery_date <= q.period - 2 then d.net end')}, 0.0e0) as trailing_net
    from qs q cross join (select distinct setting_index, setting from sn) s join sn d on d.setting_index = s.setting_index group by 1, 2),
  r as (select *, row_number() over (partition by period order by trailing_net desc, setting_index) as rk, max(n) over (partition by period) as mn, max(trailing_net) over (partition by period) as best_net from t)
  select period, setting_index, setting, best_net, mn > 0 as from_data from r where case when mn > 0 then rk = 1 else setting_index = 1 end)"""


@query("setting_nets", oracle=with_(*RULES, NETS) + " select * from sn")
def setting_nets(spark, sf):
    return nets(spark, sf)


@query("trailing_setting_choice", oracle=with_(*RULES, NETS, QTRS, CHOICE) + " select * from ch")
def choose(spark, sf):
    return sel.choose_setting(nets(spark, sf), DAY, default_index=1)


@query(
    "walk_with_neighbours",
    oracle=with_(*RULES, NETS, QTRS, CHOICE) + f""", w as (select s.shift, year(d.delivery_date)::int as year, {xsum('d.net')} as net from sn d join ch on ch.period = date_trunc('quarter', d.delivery_date)::date
        cross join (values (-1), (0), (1)) s(shift) where d.setting_index = greatest(0, least(ch.setting_index + s.shift, 3)) group by 1, 2) select * from w""",
)
def walk(spark, sf):
    n = nets(spark, sf)
    walked = sel.apply_choice(n, sel.choose_setting(n, DAY, default_index=1), DAY, len(CUTS), (-1, 0, 1))
    return walked.groupBy("shift", F.year(DAY).alias("year")).agg(exact_sum("net").alias("net"))


@query(
    "chosen_pairs_per_quarter",
    oracle=with_(*RULES, PAIRS, QTRS) + f""", d as (select delivery_date, pair, {xsum('pnl')} as net from pl group by 1, 2),
      t as (select q.period, d.pair, {xsum('d.net')} as trailing_net from qs q join d on d.delivery_date >= q.period - interval 12 month and d.delivery_date <= q.period - 2 group by 1, 2)
      select period, pair, row_number() over (partition by period order by trailing_net desc, pair)::int as place, trailing_net from t where trailing_net > 0 qualify row_number() over (partition by period order by trailing_net desc, pair) <= 3""",
)
def chosen_pairs(spark, sf):
    d = pair_rows(spark, sf).groupBy(DAY, "pair").agg(exact_sum("pnl").alias("net"))
    return sel.choose_pairs(d, DAY, "pair", 3)


@query(
    "static_pairs",
    oracle=with_(*RULES, PAIRS, QTRS) + f""", sp as (select delivery_date, slot, pair, spread, cost from pairs where spread is not null),
      sd as (select q.period, s.pair, s.slot, cast(sign({xsum('s.spread')}) as double) as side from qs q join sp s on s.delivery_date >= q.period - interval 36 month and s.delivery_date <= q.period - 2 group by 1, 2, 3),
      n as (select q.period, s.pair, {xsum('o.side * s.spread - abs(o.side) * s.cost')} as trailing_net from qs q join sp s on s.delivery_date >= q.period - interval 12 month and s.delivery_date <= q.period - 2
        join sd o on o.pair = s.pair and o.slot = s.slot and o.period = q.period - interval 12 month group by 1, 2),
      c as (select *, row_number() over (partition by period order by trailing_net desc, pair)::int as place from n where trailing_net > 0 qualify row_number() over (partition by period order by trailing_net desc, pair) <= 3)
      select period, pair, slot, place, trailing_net, side from c join sd using (period, pair)""",
)
def static_pairs(spark, sf):
    p = rule_panel(spark, sf)
    from gridtide.operators.joins import unordered_pairs

    u = unordered_pairs(p, [DAY, "slot"], "zone", ["gap", "load_cost", "supply_cost"])
    s = u.select(
        DAY, "slot", F.concat_ws("|", "zone_i", "zone_j").alias("pair"), (F.col("gap_i") - F.col("gap_j")).alias("spread"),
        (F.col("load_cost_i") + F.col("supply_cost_i")).alias("cost"),
    )
    return sel.static_pairs(s, DAY, "pair", "slot", "spread", "cost", 3)


@query(
    "setting_and_pairs_choice",
    oracle=with_(*RULES, QTRS) + f""", pr as (select a.delivery_date, a.zone || '|' || b.zone as pair, m.i as setting_index, 'scale ' || m.m as setting, (a.s28 - b.s28) * m.m as d, a.gap - b.gap as spread, a.load_cost + a.supply_cost as cost
        from rp a join rp b on a.delivery_date = b.delivery_date and a.slot = b.slot and a.zone < b.zone cross join (values (0, 0.5e0), (1, 1.0e0), (2, 2.0e0)) m(i, m)),
      n as (select delivery_date, pair, setting_index, setting, coalesce({xsum('case when d >= cost then spread - cost when d <= -cost then -spread - cost else 0.0e0 end')}, 0.0e0) as net from pr group by 1, 2, 3, 4),
      t as (select q.period, n.pair, n.setting_index, n.setting, {xsum('n.net')} as tn from qs q join n on n.delivery_date >= q.period - interval 12 month and n.delivery_date <= q.period - 2 group by 1, 2, 3, 4),
      k as (select * from t where tn > 0 qualify row_number() over (partition by period, setting_index order by tn desc, pair) <= 3),
      g as (select period, setting_index, setting, {xsum('tn')} as top_net, count(*) as pairs from k group by 1, 2, 3)
      select * from g qualify row_number() over (partition by period order by top_net desc, setting_index) = 1""",
)
def setting_pairs(spark, sf):
    from gridtide.operators.joins import unordered_pairs

    u = unordered_pairs(rule_panel(spark, sf), [DAY, "slot"], "zone", ["gap", "s28", "load_cost", "supply_cost"])
    cost = F.col("load_cost_i") + F.col("supply_cost_i")
    spread = F.col("gap_i") - F.col("gap_j")
    settings = []
    for m in (0.5, 1.0, 2.0):
        d = (F.col("s28_i") - F.col("s28_j")) * m
        settings.append((f"scale {m}", F.when(d >= cost, spread - cost).when(d <= -cost, -spread - cost).otherwise(0.0)))
    n = sel.setting_nets(u, [DAY, F.concat_ws("|", "zone_i", "zone_j").alias("pair")], settings)
    return sel.best_setting_pairs(n, DAY, "pair", 3)


@query(
    "best_grid_on_validation",
    oracle=with_(*RULES) + f""", s as (select unnest([1.0e0, 2.0e0, 4.0e0]) as level), c as (select unnest([0.0e0, 0.5e0]) as cut),
      d as (select level, cut, delivery_date, {xsum('case when gap is null or s28 is null or s28 > cut or s365 > level / 10.0e0 then 0.0e0 else -gap - supply_cost end')} as net from rp cross join s cross join c where delivery_date >= date '1999-01-01' and delivery_date < date '2000-01-01' group by 1, 2, 3)
      select level, cut, {xavg('net')} as mean_daily_net from d group by 1, 2 order by 3 desc, 1, 2 limit 1""",
)
def best_grid(spark, sf):
    p = rule_panel(spark, sf).where((F.col(DAY) >= F.lit("1999-01-01").cast("date")) & (F.col(DAY) < F.lit("2000-01-01").cast("date")))
    settings = []
    for level in (1.0, 2.0, 4.0):
        for cut in (0.0, 0.5):
            off = F.col("gap").isNull() | F.col("s28").isNull() | (F.col("s28") > cut) | F.coalesce(F.col("s365") > level / 10.0, F.lit(False))
            settings.append((f"{level}|{cut}", F.when(off, 0.0).otherwise(-F.col("gap") - F.col("supply_cost"))))
    n = sel.setting_nets(p, [DAY], settings)
    g = n.groupBy("setting").agg(exact_avg("net").alias("mean_daily_net"))
    x = F.split("setting", r"\|")
    return g.select(x[0].cast("double").alias("level"), x[1].cast("double").alias("cut"), "mean_daily_net").orderBy(F.desc("mean_daily_net"), "level", "cut").limit(1)


@query(
    "conformal_half_width",
    oracle=with_(*RULES) + """, r as (select zone, date_trunc('quarter', delivery_date)::date as q, abs(gap - s28) as a from rp where s28 is not null and gap is not null)
      select zone, (q + interval 3 month)::date as period, round(quantile_cont(a, 0.8), 11) as half_width, count(*) as n from r group by 1, 2""",
)
def conformal(spark, sf):
    # residual quantile of a zone and quarter, used for the next quarter; a quarter is bounded by the calendar
    r = rule_panel(spark, sf).where(F.col("s28").isNotNull() & F.col("gap").isNotNull())
    return r.groupBy("zone", F.add_months(F.trunc(DAY, "quarter"), 3).alias("period")).agg(
        F.round(F.percentile(F.abs(F.col("gap") - F.col("s28")), 0.8), 11).alias("half_width"), F.count(F.lit(1)).alias("n")
    )


# ---------------------------------------------------------------- placebos

DAYS = f"""dsc as (select delivery_date, {xavg('s28')} as score, {xsum('case when gap is null then 0.0e0 else -gap - supply_cost end')} as net from rp group by 1)"""


def day_scores(spark, sf):
    p = rule_panel(spark, sf)
    return p.groupBy(DAY).agg(
        exact_avg("s28").alias("score"), exact_sum(F.when(F.col("gap").isNull(), 0.0).otherwise(-F.col("gap") - F.col("supply_cost"))).alias("net")
    )


@query(
    "one_day_late_placebo",
    oracle=with_(*RULES, DAYS) + f""", l as (select *, lag(score) over (order by delivery_date) as late from dsc)
      select year(delivery_date)::int as year, {xsum('case when score > 0 then 0.0e0 else net end')} as real_net, {xsum('case when late > 0 then 0.0e0 else net end')} as late_net from l group by 1""",
)
def late(spark, sf):
    d = day_scores(spark, sf).withColumn("_one", F.lit(0))
    x = sel.one_day_late(d.withColumn("late", F.col("score")), ["_one"], DAY, "late")
    return x.groupBy(F.year(DAY).alias("year")).agg(
        exact_sum(F.when(F.col("score") > 0, 0.0).otherwise(F.col("net"))).alias("real_net"),
        exact_sum(F.when(F.col("late") > 0, 0.0).otherwise(F.col("net"))).alias("late_net"),
    )


def _deal_sql(block: str, draws: int, seed: int) -> str:
    return f"""t as (select delivery_date as d, {block} as b, row_number() over (partition by {block} order by delivery_date) as r from (select distinct delivery_date from dsc)),
      s as (select draw, b, d, row_number() over (partition by b, draw order by ('0x' || substr(md5('{seed}|' || draw || '|' || d), 1, 8))::bigint, d) as r from t cross join (select unnest(range({draws})) as draw)),
      deal as (select s.draw, s.d as source_day, t.d as target_day from s join t using (b, r))"""


@query(
    "permuted_days_placebo",
    oracle=with_(*RULES, DAYS, _deal_sql("year(delivery_date)", DRAWS, 3)) + f"""
      select draw::int as draw, {xsum('case when a.score > 0 then 0.0e0 else b.net end')} as total from deal join dsc a on a.delivery_date = source_day join dsc b on b.delivery_date = target_day group by 1""",
)
def permuted(spark, sf):
    d = day_scores(spark, sf)
    return sel.permuted_nets(d, d, DAY, "score", "net", 0.0, DRAWS, 3)


RANDOM = f"""rr as (select *, {"case when s28 <= -supply_cost then -1.0e0 when s28 >= load_cost then 1.0e0 else 0.0e0 end"} as pos from rp),
  mm as (select a.delivery_date as source_day, b.delivery_date as target_day, {xsum('a.pos * coalesce(b.gap, 0.0e0) - abs(a.pos) * case when a.pos < 0 then b.supply_cost else b.load_cost end')} as value
    from rr a join rr b on a.zone = b.zone and a.slot = b.slot and date_trunc('month', a.delivery_date) = date_trunc('month', b.delivery_date) group by 1, 2)"""


def random_rows(spark, sf):
    return rule_panel(spark, sf).withColumn("pos", pos.two_sided(F.col("s28")))


@query(
    "random_days_placebo",
    oracle=with_(*RULES, DAYS, _deal_sql("date_trunc('month', delivery_date)", DRAWS, 8), RANDOM) + f""" select draw::int as draw, coalesce({xsum('value')}, 0.0e0) as total from deal left join mm using (source_day, target_day) group by 1""",
)
def random_days(spark, sf):
    return sel.random_days_placebo(random_rows(spark, sf), DAY, ["zone", "slot"], "pos", "gap", DRAWS, 8)


@query(
    "random_days_identity",
    oracle=with_(*RULES, DAYS, RANDOM, ledger_sql("case when s28 <= -supply_cost then -1.0e0 when s28 >= load_cost then 1.0e0 else 0.0e0 end"))
    + f""", a as (select delivery_date, {xsum('pnl')} as own from led group by 1) select delivery_date, value as own_day_value, own as ledger_value from mm join a on a.delivery_date = source_day and source_day = target_day""",
)
def random_identity(spark, sf):
    r = random_rows(spark, sf)
    m = sel.month_matrix(r, DAY, ["zone", "slot"], "pos", "gap").where(F.col("source_day") == F.col("target_day"))
    led = pos.ledger(rule_panel(spark, sf), pos.two_sided(F.col("s28"))).groupBy(DAY).agg(exact_sum("pnl").alias("ledger_value"))
    return m.select(F.col("source_day").alias(DAY), F.col("value").alias("own_day_value")).join(led, DAY)


@query(
    "fragility_verdict",
    oracle=with_(*RULES, DAYS, _deal_sql("year(delivery_date)", DRAWS, 3)) + f""", dr as (select draw, {xsum('case when a.score > 0 then 0.0e0 else b.net end')} as total from deal join dsc a on a.delivery_date = source_day join dsc b on b.delivery_date = target_day group by 1),
      real as (select {xsum('case when score > 0 then 0.0e0 else net end')} as real_total, {xsum('case when score > -0.2 then 0.0e0 else net end')} as lower_total, {xsum('case when score > 0.2 then 0.0e0 else net end')} as higher_total from dsc),
      y as (select year(delivery_date) as year, case when score > 0 then 0.0e0 else net end as n from dsc), b as (select year, sum(n) as s from (select *, row_number() over (partition by year order by n desc) as r from y) where r <= 10 group by 1),
      sm as (select avg(case when total > real_total then 1.0e0 else 0.0e0 end) as share_beats_rule from dr, real)
      select real_total, lower_total, higher_total, share_beats_rule, round((select max(s) from b), 6) as best_ten_days,
        list_filter([case when sign(lower_total) <> sign(real_total) or sign(higher_total) <> sign(real_total) then 'sign changes at a neighbouring setting' end,
          case when real_total - (select max(s) from b) < 0 then 'negative without one year''s best days' end, case when share_beats_rule > 0.2 then 'random days win too often' end], lambda x: x is not null) as reasons from real, sm""",
)
def fragility(spark, sf):
    from gridtide.operators import ranking

    d = day_scores(spark, sf)
    taken = lambda c: F.when(F.col("score") > c, 0.0).otherwise(F.col("net"))
    real = d.agg(exact_sum(taken(0.0)).alias("real_total"), exact_sum(taken(-0.2)).alias("lower_total"), exact_sum(taken(0.2)).alias("higher_total"))
    y = d.select(F.year(DAY).alias("year"), taken(0.0).alias("n"))
    best = ranking.trimmed_sums(y, ["year"], "n", [10]).agg(F.max(F.col("total") - F.col("without_best_10")).alias("best_ten_days"))
    share = sel.placebo_summary(sel.permuted_nets(d, d, DAY, "score", "net", 0.0, DRAWS, 3), real.select("real_total")).select("share_beats_rule")
    x = real.join(best).join(share)  # one row each
    reasons = sel.fragility(
        F.col("real_total"), [F.col("lower_total"), F.col("higher_total")], [F.col("real_total") - F.col("best_ten_days")], F.col("share_beats_rule")
    )
    return x.select("real_total", "lower_total", "higher_total", "share_beats_rule", F.round("best_ten_days", 6).alias("best_ten_days"), reasons.alias("reasons"))
