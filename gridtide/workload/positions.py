"""Positions, ledgers and portfolios (O1-O32) on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.exact import exact_avg, exact_sum, sliding_avg
from gridtide.operators import trailing
from gridtide.plans import positions as pos
from gridtide.workload.bindings import PANEL, panel, with_, xavg, xavg_over, xsum, xsum_over
from gridtide.workload.landing import fees, fees_sql
from gridtide.workload.registry import query

_W = "partition by zone, slot order by delivery_date range between interval {n} day preceding and interval 1 day preceding"
RULES = (
    PANEL,
    fees_sql(),
    f"""rp as (select p.*, {xavg_over('gap', _W.format(n=365))} as s365, {xavg_over('gap', _W.format(n=28))} as s28, load_cost, supply_cost
      from panel p left join fees on year = year(delivery_date))""",
)


def rule_panel(spark, sf, override=None):
    """The panel with two trailing scores (known before the day) and the costs of both sides."""
    p = panel(spark, sf)
    o = trailing.by_day(["zone", "slot"], "delivery_date")
    p = p.select("*", sliding_avg("gap", o, -365, -1).alias("s365"), sliding_avg("gap", o, -28, -1).alias("s28"))
    return pos.with_costs(p, fees(spark), "delivery_date", override)


def ledger_sql(expr: str, name: str = "led", src: str = "rp") -> str:
    """A ledger CTE for a position expression."""
    return f"""{name} as (select *, abs(pos) as mwh, pos * coalesce(gap, 0.0e0) as gross, abs(coalesce(gap, 0.0e0)) as absgap,
      pos * coalesce(gap, 0.0e0) - abs(pos) * case when pos < 0 then supply_cost else load_cost end as pnl
      from (select *, case when gap is null then 0.0e0 else {expr} end as pos from {src}))"""


SIDE = "case when s365 < 0 then -1.0e0 when s365 > 0 then 1.0e0 else 0.0e0 end"
TWO = "case when s28 <= -supply_cost then -1.0e0 when s28 >= load_cost then 1.0e0 else 0.0e0 end"
_LEDCOLS = ["delivery_date", "zone", "slot", "pos", "mwh", "gross", "pnl", "absgap"]


@query("ledger_of_trailing_side", oracle=with_(*RULES, ledger_sql(SIDE)) + " select " + ", ".join(_LEDCOLS) + " from led")
def ledger_side(spark, sf):
    return pos.ledger(rule_panel(spark, sf), pos.trailing_side(F.col("s365"))).select(_LEDCOLS)


def _rules():
    p, s = F.col("s28"), F.col("s365")
    return {
        "always_supply": F.lit(-1.0),
        "cheap_supply": pos.cheap_supply(s),
        "probability_gate": pos.probability_gate(p, 0.5),
        "three_way": pos.three_way(p, 0.2, 1.0),
        "two_sided": pos.two_sided(p),
        "trailing_side": pos.trailing_side(s),
        "tail_size": pos.tail_size(p, p - 1.0, p + 2.0, 2.0),
        "width_size": pos.width_size(p, p - 1.0, p + F.abs(s), 2.0),
        "conformal_skip": pos.conformal_skip(p, F.lit(0.3)),
        "outside_window": pos.outside_window(
            "delivery_date", F.lit("1997-01-01").cast("date"), F.lit("1997-04-01").cast("date"), pos.two_sided(p)
        ),
    }


def _rule_sql() -> str:
    names = {
        "always_supply": "-1.0e0", "cheap_supply": "case when s365 <= -supply_cost then -1.0e0 else 0.0e0 end",
        "probability_gate": "case when s28 is null then 0.0e0 when s28 > 0.5 then 0.0e0 else -1.0e0 end",
        "three_way": "case when s28 >= 1.0 then 1.0e0 when s28 > 0.2 then 0.0e0 else -1.0e0 end", "two_sided": TWO, "trailing_side": SIDE,
        "tail_size": f"coalesce({TWO} * least(3.0e0, 2.0e0 * case when {TWO} < 0 then -s28 - supply_cost when {TWO} > 0 then s28 - load_cost else 0.0e0 end / greatest(case when {TWO} < 0 then s28 + 2.0e0 else -(s28 - 1.0e0) end, 1.0e0)), 0.0e0)",
        "width_size": f"case when s28 is null or s365 is null then 0.0e0 else {TWO} * least(3.0e0, 2.0e0 / greatest((s28 + abs(s365)) - (s28 - 1.0e0), 1e-6)) end",
        "conformal_skip": "case when s28 + 0.3e0 <= -supply_cost then -1.0e0 when s28 - 0.3e0 >= load_cost then 1.0e0 else 0.0e0 end",
        "outside_window": f"case when delivery_date >= date '1997-01-01' and delivery_date < date '1997-04-01' then 0.0e0 else {TWO} end",
    }
    ctes = [ledger_sql(e, f"led_{n}") for n, e in names.items()]
    parts = [f"select '{n}' as rule, year(delivery_date)::int as year, {xsum('pnl')} as net, {xsum('gross')} as gross, {xsum('mwh')} as mwh from led_{n} group by 2" for n in names]
    return with_(*RULES, *ctes) + " " + " union all ".join(parts)


@query("rule_nets_by_year", oracle=_rule_sql())
def rule_nets(spark, sf):
    # all rules are columns of one row: one pass over the panel, one aggregate
    p = rule_panel(spark, sf)
    cells = []
    g = F.coalesce("gap", F.lit(0.0))
    for name, rule in _rules().items():
        x = F.when(F.col("gap").isNull(), 0.0).otherwise(rule)
        gross = x * g
        cells.append(F.struct(F.lit(name).alias("rule"), exact_sum(gross - F.abs(x) * pos.side_cost(x)).alias("net"), exact_sum(gross).alias("gross"), exact_sum(F.abs(x)).alias("mwh")))
    a = p.groupBy(F.year("delivery_date").alias("year")).agg(F.array(*cells).alias("_c"))
    return a.select("year", F.explode("_c").alias("c")).select("c.rule", "year", "c.net", "c.gross", "c.mwh")


PAIRS = """pairs as (select a.delivery_date, a.slot, a.zone || '|' || b.zone as pair, a.zone as zone_i, b.zone as zone_j, a.s28 - b.s28 as pred_spread, a.gap - b.gap as spread,
    a.load_cost + a.supply_cost as cost, case when a.gap is not null and b.gap is not null and a.s28 - b.s28 >= a.load_cost + a.supply_cost then 1.0e0
      when a.gap is not null and b.gap is not null and a.s28 - b.s28 <= -(a.load_cost + a.supply_cost) then -1.0e0 else 0.0e0 end as pos
    from rp a join rp b on a.delivery_date = b.delivery_date and a.slot = b.slot and a.zone < b.zone),
  pl as (select *, 2 * abs(pos) as mwh, pos * coalesce(spread, 0.0e0) as gross, pos * coalesce(spread, 0.0e0) - abs(pos) * cost as pnl from pairs)"""


def pair_rows(spark, sf):
    return pos.pair_legs(rule_panel(spark, sf), ["delivery_date", "slot"], "zone", "s28", "gap")


@query("pair_rule_ledger", oracle=with_(*RULES, PAIRS) + f" select pair, year(delivery_date)::int as year, {xsum('pnl')} as net, {xsum('mwh')} as mwh, count(*) filter (where pos <> 0) as trades from pl group by 1, 2")
def pair_rule(spark, sf):
    return pair_rows(spark, sf).groupBy("pair", F.year("delivery_date").alias("year")).agg(
        exact_sum("pnl").alias("net"), exact_sum("mwh").alias("mwh"), F.count_if(F.col("pos") != 0).alias("trades")
    )


@query(
    "net_positions_from_pairs",
    oracle=with_(*RULES, PAIRS) + f""", legs as (select delivery_date, slot, zone_i as zone, pos as mw from pl union all select delivery_date, slot, zone_j, -pos from pl)
      select delivery_date, slot, zone, {xsum('mw')} as mw from legs group by 1, 2, 3""",
)
def net_positions(spark, sf):
    return pos.legs_to_zones(pair_rows(spark, sf), ["delivery_date", "slot"], "zone")


@query(
    "limit_price_bids",
    oracle=with_(*RULES) + """, l as (select delivery_date, zone, slot, y_da, load_cost, supply_cost, unnest([{'k': 0, 'm': 0.5e0}, {'k': 1, 'm': 0.8e0}, {'k': 2, 'm': 1.0e0}, {'k': 3, 'm': 1.3e0}, {'k': 4, 'm': 2.0e0}], recursive := true), s365, s28 from rp where s365 is not null and s28 is not null),
      x as (select *, y_da * m as lv, s28 + s365 * (m - 1.0e0) * 3.0e0 as cd from l),
      y as (select *, bool_and(-cd - supply_cost > 0) over (partition by delivery_date, zone, slot order by lv desc, cd desc rows unbounded preceding) as up, bool_and(cd - load_cost > 0) over (partition by delivery_date, zone, slot order by lv, cd rows unbounded preceding) as dn,
        row_number() over (partition by delivery_date, zone, slot order by lv, cd) as r from x),
      g as (select delivery_date, zone, slot, any_value(y_da) as y_da, any_value(supply_cost) as sc, any_value(load_cost) as lc, min(lv) filter (where up) as sl, max(lv) filter (where dn) as ll, max(cd) filter (where r = 3) as mid from y group by 1, 2, 3),
      h as (select *, case when sl is not null and (ll is null or -mid - sc >= mid - lc) then -1.0e0 when ll is not null then 1.0e0 else 0.0e0 end as side from g)
      select delivery_date, zone, slot, side, case when side < 0 then sl when side > 0 then ll end as limit_price, case when side < 0 and y_da >= sl then -1.0e0 when side > 0 and y_da <= ll then 1.0e0 else 0.0e0 end as pos from h""",
)
def limit_bids(spark, sf):
    p = rule_panel(spark, sf).where(F.col("s365").isNotNull() & F.col("s28").isNotNull())
    ms = [0.5, 0.8, 1.0, 1.3, 2.0]
    levels = F.array(*[F.col("y_da") * m for m in ms])
    cond = F.array(*[F.col("s28") + F.col("s365") * (F.lit(m) - 1.0) * 3.0 for m in ms])
    p = p.withColumn("lv", levels).withColumn("cd", cond).withColumn("bid", pos.limit_bid(F.col("lv"), F.col("cd")))
    side, limit = F.col("bid.side"), F.col("bid.limit")
    return p.select("delivery_date", "zone", "slot", side.alias("side"), limit.alias("limit_price"), pos.cleared(side, limit, F.col("y_da")).alias("pos"))


@query(
    "level_plus_shape_grid",
    oracle=with_(*RULES) + " select delivery_date, zone, slot, s28 + (s365 - 1.0e0) - (s365 * 1.5e0) as c0, s28 + (s365 * 1.5e0) - (s365 * 1.5e0) as c1, s28 + (s365 + y_da) - (s365 * 1.5e0) as c2 from rp",
)
def level_shape(spark, sf):
    cond = F.array(F.col("s365") - 1.0, F.col("s365") * 1.5, F.col("s365") + F.col("y_da"))
    x = rule_panel(spark, sf).withColumn("g", pos.level_plus_shape(F.col("s28"), cond))
    return x.select("delivery_date", "zone", "slot", *[F.col("g")[i].alias(f"c{i}") for i in range(3)])


_DAYSCORE = f"""ds as (select delivery_date, {xavg('s28')} as score from rp group by 1)"""


@query(
    "flagged_day_rules",
    oracle=with_(*RULES, _DAYSCORE) + f""", j as (select rp.*, score from rp join ds using (delivery_date)),
      """ + ledger_sql("case when score > 0.0 then 0.0e0 else -1.0e0 end", "led_f", "j") + ", " + ledger_sql("case when score > 0.0 then 1.0e0 else -1.0e0 end", "led_l", "j") + ", "
    + ledger_sql("case when score > 0.0 and zone in ('ASIA', 'EUROPE') then 1.0e0 when score > 0.0 and zone in ('AFRICA') then -1.0e0 when score > 0.0 then 0.0e0 else -1.0e0 end", "led_p", "j")
    + f""" select 'filter' as rule, zone, {xsum('pnl')} as net, {xsum('mwh')} as mwh from led_f group by 2 union all select 'flip', zone, {xsum('pnl')}, {xsum('mwh')} from led_l group by 2
      union all select 'pairs', zone, {xsum('pnl')}, {xsum('mwh')} from led_p group by 2""",
)
def flagged_rules(spark, sf):
    p = rule_panel(spark, sf)
    ds = p.groupBy("delivery_date").agg(exact_avg("s28").alias("score"))
    j = p.join(ds, "delivery_date")
    s = F.col("score")
    out = []
    for name, rule in (
        ("filter", pos.flagged_days(s, 0.0)), ("flip", pos.flagged_days(s, 0.0, 1.0)),
        ("pairs", pos.flagged_pairs(s, 0.0, F.col("zone"), ["ASIA", "EUROPE"], ["AFRICA"])),
    ):
        out.append(pos.ledger(j, rule).groupBy(F.lit(name).alias("rule"), "zone").agg(exact_sum("pnl").alias("net"), exact_sum("mwh").alias("mwh")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "rolling_cut_filter",
    oracle=with_(*RULES) + f""", c as (select d.delivery_date, quantile_cont(p.s28, 0.9) as cut from (select distinct delivery_date from rp) d left join rp p on p.delivery_date >= d.delivery_date - 30 and p.delivery_date <= d.delivery_date - 1 group by 1),
      j as (select rp.*, cut from rp join c using (delivery_date)), """ + ledger_sql("case when s28 is not null and s28 > cut then 0.0e0 else -1.0e0 end", "led", "j")
    + f" select zone, year(delivery_date)::int as year, {xsum('pnl')} as net, count(*) filter (where pos = 0) as sat_out from led group by 1, 2",
)
def rolling_cut(spark, sf):
    p = rule_panel(spark, sf)
    cut = trailing.pooled_rolling_cut(p.select("delivery_date", "s28"), "delivery_date", "s28", 30, 0.1, "cut")
    j = p.join(cut, "delivery_date")
    led = pos.ledger(j, F.when(F.col("s28").isNotNull() & (F.col("s28") > F.col("cut")), 0.0).otherwise(-1.0))
    return led.groupBy("zone", F.year("delivery_date").alias("year")).agg(exact_sum("pnl").alias("net"), F.count_if(F.col("pos") == 0).alias("sat_out"))


@query(
    "zone_subset",
    oracle=with_(*RULES, ledger_sql("-1.0e0")) + f""", q as (select zone, quantile_cont(gap, 0.99) as q from rp group by 1),
      m as (select zone, {xsum('case when gap <= q then pnl else 0.0e0 end')} as trimmed from led join q using (zone) group by 1),
      d as (select zone, delivery_date, {xsum('pnl')} as net from led group by 1, 2), w as (select zone, min(net) as worst from d group by 1)
      select zone, trimmed, worst, row_number() over (order by worst desc, zone)::int as place from m join w using (zone) where trimmed > 0 qualify row_number() over (order by worst desc, zone) <= 3""",
)
def zone_subset(spark, sf):
    from gridtide.operators import ranking

    led = pos.ledger(rule_panel(spark, sf), F.lit(-1.0))
    q = ranking.quantile_columns(led.select("zone", "gap"), ["zone"], "gap", {"q": 0.99}).drop("n")
    m = led.join(q, "zone").groupBy("zone").agg(exact_sum(F.when(F.col("gap") <= F.col("q"), F.col("pnl")).otherwise(0.0)).alias("trimmed"))
    worst = led.groupBy("zone", "delivery_date").agg(exact_sum("pnl").alias("net")).groupBy("zone").agg(F.min("net").alias("worst"))
    # one row per zone
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("worst"), "zone"))
    return m.join(worst, "zone").where("trimmed > 0").withColumn("place", place).where("place <= 3")


@query(
    "border_spread_summary",
    oracle=with_(*RULES) + f""", b as (select delivery_date, slot, gap as bgap, s28 as bs from rp where zone = 'ASIA'),
      j as (select rp.*, bgap, s28 - bs as spread from rp join b using (delivery_date, slot) where zone <> 'ASIA'),
      k as (select *, case when spread >= supply_cost + load_cost then 1.0e0 when spread <= -(supply_cost + load_cost) then -1.0e0 else 0.0e0 end as pos from j)
      select zone, year(delivery_date)::int as year, {xsum('pos * (gap - bgap) - abs(pos) * (supply_cost + load_cost)')} as net, {xsum('2 * abs(pos)')} as mwh from k group by 1, 2""",
)
def border_summary(spark, sf):
    p = rule_panel(spark, sf)
    b = p.where(F.col("zone") == "ASIA").select("delivery_date", "slot", F.col("gap").alias("bgap"), F.col("s28").alias("bs"))
    j = p.where(F.col("zone") != "ASIA").join(b, ["delivery_date", "slot"]).withColumn("pos", pos.border_leg(F.col("s28") - F.col("bs")))
    net = F.col("pos") * (F.col("gap") - F.col("bgap")) - F.abs("pos") * (F.col("supply_cost") + F.col("load_cost"))
    return j.groupBy("zone", F.year("delivery_date").alias("year")).agg(exact_sum(net).alias("net"), exact_sum(2 * F.abs("pos")).alias("mwh"))


# ---------------------------------------------------------------- daily series and performance

DAILY = ledger_sql(TWO, "led_two") + ", " + ledger_sql("-1.0e0", "led_sup") + ", " + ledger_sql(SIDE, "led_side") + f""",
  alld as (select 'two_sided' as strategy, delivery_date, {xsum('pnl')} as pnl, {xsum('mwh')} as mwh from led_two group by 2
    union all select 'supply', delivery_date, {xsum('pnl')}, {xsum('mwh')} from led_sup group by 2
    union all select 'side', delivery_date, {xsum('pnl')}, {xsum('mwh')} from led_side group by 2),
  cal as (select strategy, unnest(generate_series((select min(delivery_date) from alld), (select max(delivery_date) from alld), interval 1 day))::date as delivery_date from (select distinct strategy from alld)),
  daily as (select strategy, delivery_date, coalesce(pnl, 0.0e0) as pnl, coalesce(mwh, 0.0e0) as mwh from cal left join alld using (strategy, delivery_date))"""


def daily(spark, sf, override=None):
    p = rule_panel(spark, sf, override)
    g = F.coalesce("gap", F.lit(0.0))
    rules = {"two_sided": pos.two_sided(F.col("s28")), "supply": F.lit(-1.0), "side": pos.trailing_side(F.col("s365"))}
    cells = []
    for n, r in rules.items():
        x = F.when(F.col("gap").isNull(), 0.0).otherwise(r)
        cells.append(F.struct(F.lit(n).alias("strategy"), exact_sum(x * g - F.abs(x) * pos.side_cost(x)).alias("pnl"), exact_sum(F.abs(x)).alias("mwh")))
    d = p.groupBy("delivery_date").agg(F.array(*cells).alias("c")).select("delivery_date", F.explode("c").alias("c")).select("delivery_date", "c.*")
    return pos.daily_series(d, "delivery_date", ["strategy"], ["pnl", "mwh"])


@query("daily_series_on_calendar", oracle=with_(*RULES, DAILY) + " select * from daily")
def daily_calendar(spark, sf):
    return daily(spark, sf)


def perf_sql(group: str, src: str = "daily") -> str:
    return f"""(with e as (select *, {xsum_over('pnl', f'partition by {group} order by delivery_date rows unbounded preceding')} as cum from {src}),
      dd as (select *, cum - greatest(0.0e0, max(cum) over (partition by {group} order by delivery_date rows unbounded preceding)) as drawdown,
        row_number() over (partition by {group} order by pnl desc) as rk from e)
      select {group}, {xsum('pnl')} as net, count(*) as days, 100.0e0 * {xsum('pnl')} / 500000.0e0 * 365.0e0 / count(*) as return_pct,
        round(case when stddev_samp(pnl) > 0 then avg(pnl) / stddev_samp(pnl) * sqrt(365.0e0) end, 7) as sharpe, min(drawdown) as max_drawdown, min(pnl) as worst_day_pnl,
        arg_min(delivery_date, (pnl, delivery_date)) as worst_day, max(pnl) as best_day_pnl, arg_max(delivery_date, (pnl, -(delivery_date - date '1970-01-01'))) as best_day,
        {xsum('pnl')} - {xsum('case when rk <= 3 then pnl end')} as net_without_best_3, {xsum('pnl')} - {xsum('case when rk <= 5 then pnl end')} as net_without_best_5,
        {xsum('mwh')} / count(*) as mwh_per_day, {xsum('pnl')} / nullif({xsum('mwh')}, 0) as usd_per_mwh from dd group by {group})"""


def _rounded(df):
    return df.withColumn("sharpe", F.round("sharpe", 7))


@query("performance", oracle=with_(*RULES, DAILY) + " select * from " + perf_sql("strategy"))
def performance(spark, sf):
    return _rounded(pos.performance(daily(spark, sf), ["strategy"], "delivery_date", "pnl", "mwh"))


@query(
    "performance_by_year",
    oracle=with_(*RULES, DAILY) + ", dy as (select *, year(delivery_date)::int as year from daily) select * from " + perf_sql("strategy, year", "dy"),
)
def performance_year(spark, sf):
    d = daily(spark, sf).withColumn("year", F.year("delivery_date"))
    return _rounded(pos.performance(d, ["strategy", "year"], "delivery_date", "pnl", "mwh"))


BAR = {"avg_net_per_year": 100.0, "positive_years": 4, "sharpe": 1.0, "stress_total": 0.0}


@query(
    "evaluation_against_bar",
    oracle=with_(*RULES, DAILY) + f""", sd as (select * from daily where strategy = 'supply'), dy as (select *, year(delivery_date)::int as year from sd), y as (select * from {perf_sql('year', 'dy')}),
      so as (select *, 1 as one from sd), w as (select * from {perf_sql('one', 'so')}),
      st as (select {xsum('case when gap is null then 0.0e0 else -gap - 0.5e0 end')} as stress_net from panel)
      select avg_net_per_year, positive_years, too_good_years, sharpe_all, drawdown_all, stress_net, avg_net_per_year >= 100 and positive_years >= 4 and sharpe_all > 1 and stress_net > 0 as passes from (
        select round(avg(net), 6) as avg_net_per_year, count(*) filter (where net > 0) as positive_years, count(*) filter (where sharpe > 3 or (net > 0 and best_day_pnl > 0.5 * net)) as too_good_years from y),
        (select sharpe as sharpe_all, max_drawdown as drawdown_all from w), st""",
)
def evaluation(spark, sf):
    d = daily(spark, sf).where(F.col("strategy") == "supply")
    by_year = pos.performance(d.withColumn("year", F.year("delivery_date")), ["year"], "delivery_date", "pnl", "mwh")
    whole = pos.performance(d, [], "delivery_date", "pnl", "mwh").withColumn("sharpe", F.round("sharpe", 7))
    stress = pos.ledger(pos.with_costs(panel(spark, sf), fees(spark), "delivery_date", 0.5), F.lit(-1.0)).agg(exact_sum("pnl").alias("stress_net"))
    return pos.evaluation(by_year, whole, stress, BAR).withColumn("avg_net_per_year", F.round("avg_net_per_year", 6))


@query(
    "stress_and_seasons",
    oracle=with_(*RULES) + f""", l as (select unnest([0.5e0, 1.0e0]) as stress), x as (select stress, year(delivery_date)::varchar || case when month(delivery_date) <= 6 then 'H1' else 'H2' end as half,
        case when month(delivery_date) in (12, 1, 2) then 'winter' when month(delivery_date) <= 5 then 'spring' when month(delivery_date) <= 8 then 'summer' else 'autumn' end as season, -gap - stress as pnl from rp cross join l)
      select stress, half, season, {xsum('pnl')} as net from x group by 1, 2, 3""",
)
def stress_seasons(spark, sf):
    p = panel(spark, sf)
    cells = F.array(*[F.struct(F.lit(s).alias("stress"), exact_sum(-F.col("gap") - s).alias("net")) for s in (0.5, 1.0)])
    g = p.groupBy(tc.half_year("delivery_date").alias("half"), tc.season("delivery_date").alias("season")).agg(cells.alias("c"))
    return g.select("half", "season", F.explode("c").alias("c")).select("c.stress", "half", "season", "c.net")


@query(
    "versus_baseline",
    oracle=with_(*RULES, DAILY) + f""", m as (select date_trunc('month', a.delivery_date)::date as month, {xsum('a.pnl')} as idea, {xsum('a.pnl - b.pnl')} as diff from daily a join daily b using (delivery_date) where a.strategy = 'two_sided' and b.strategy = 'side' group by 1)
      select count(*) as months, {xsum('idea')} as idea_net, {xsum('diff')} as diff_net, min(idea) as worst_month_idea_net, arg_min(month, (idea, month)) as worst_month_idea, min(diff) as worst_month_diff_net,
        count(*) filter (where idea > 0) as months_positive_idea, count(*) filter (where diff > 0) as months_positive_diff from m""",
)
def versus_baseline(spark, sf):
    d = daily(spark, sf)
    return pos.versus_baseline(d.where(F.col("strategy") == "two_sided"), d.where(F.col("strategy") == "side"), "delivery_date", "pnl")


@query(
    "money_per_zone_and_year",
    oracle=with_(*RULES, ledger_sql(TWO)) + f" select zone, year(delivery_date)::int as year, {xsum('pnl')} as pnl_usd, {xsum('mwh')} as mwh, {xsum('pnl')} / nullif({xsum('mwh')}, 0) as profit_per_mwh, {xsum('gross')} / nullif({xsum('mwh')}, 0) as break_even_fee, {xsum('case when absgap <= 8 then pnl else 0.0e0 end')} as pnl_without_extremes from led group by 1, 2",
)
def money(spark, sf):
    led = pos.ledger(rule_panel(spark, sf), pos.two_sided(F.col("s28"))).withColumn("year", F.year("delivery_date"))
    return pos.money(led, ["zone", "year"], F.lit(8.0))


SIZING = f"""sz as (with e as (select *, {xsum_over('pnl', 'partition by strategy order by delivery_date rows unbounded preceding')} as cum from daily),
    dd as (select *, cum - greatest(0.0e0, max(cum) over (partition by strategy order by delivery_date rows unbounded preceding)) as drawdown from e)
    select strategy, {xsum('pnl')} as net, -min(drawdown) as worst_drawdown, case when -min(drawdown) > 0 then least(5.0e0, 100.0e0 / -min(drawdown)) else 5.0e0 end as scale,
      round(avg(pnl) / sqrt(avg(pow(least(pnl, 0.0e0), 2))) * sqrt(365.0e0), 7) as sortino from dd group by 1)"""


@query("drawdown_scaled_size", oracle=with_(*RULES, DAILY, SIZING) + " select * from sz")
def sizing(spark, sf):
    return pos.sizing(daily(spark, sf), ["strategy"], "delivery_date", "pnl", 100.0).withColumn("sortino", F.round("sortino", 7))


@query(
    "equal_risk_portfolio",
    oracle=with_(*RULES, DAILY, SIZING) + f""", s as (select strategy, scale / count(*) over () as weight from sz where net > 0)
      select delivery_date, {xsum('weight * pnl')} as portfolio_pnl from daily join s using (strategy) group by 1""",
)
def equal_risk(spark, sf):
    return pos.equal_risk(daily(spark, sf), "strategy", "delivery_date", "pnl", 100.0)


@query(
    "weighted_mix",
    oracle=with_(*RULES, DAILY) + f""" select delivery_date, {xsum("case strategy when 'supply' then 0.5e0 when 'side' then month(delivery_date) / 24.0e0 else 0.25e0 end * pnl")} as mix_pnl from daily group by 1""",
)
def weighted_mix(spark, sf):
    d = daily(spark, sf)
    s = F.col("strategy")
    w = d.select("delivery_date", "strategy", F.when(s == "supply", 0.5).when(s == "side", F.month("delivery_date") / 24.0).otherwise(0.25).alias("weight"))
    return pos.weighted_mix(d, w, "strategy", "delivery_date", "pnl")


@query(
    "books_at_drawdown_limits",
    oracle=with_(*RULES, DAILY, SIZING) + """, l as (select unnest([50.0e0, 100.0e0, 250.0e0]) as "limit") select strategy, "limit", "limit" / worst_drawdown as size, "limit" / worst_drawdown * net as net, 0.7e0 * ("limit" / worst_drawdown) * net as net_fraction from sz cross join l""",
)
def books(spark, sf):
    return pos.books_at_limits(daily(spark, sf), ["strategy"], "delivery_date", "pnl", [50.0, 100.0, 250.0])


@query(
    "carried_sizing",
    oracle=with_(*RULES, DAILY) + f""", d0 as (select * from daily where delivery_date < date '2000-01-01'), e as (select *, {xsum_over('pnl', 'partition by strategy order by delivery_date rows unbounded preceding')} as cum from d0),
      dd as (select *, cum - greatest(0.0e0, max(cum) over (partition by strategy order by delivery_date rows unbounded preceding)) as drawdown from e),
      s as (select strategy, case when -min(drawdown) > 0 then least(5.0e0, 100.0e0 / -min(drawdown)) else 5.0e0 end as scale from dd group by 1)
      select strategy, {xsum('pnl')} as unit_net, count(*) as days, any_value(scale) as scale, {xsum('pnl')} * any_value(scale) as scaled_net from daily join s using (strategy) where delivery_date >= date '2000-01-01' group by 1""",
)
def carried(spark, sf):
    return pos.carried_scale(daily(spark, sf), ["strategy"], "delivery_date", "pnl", F.lit("2000-01-01").cast("date"), 100.0)


@query(
    "display_series",
    oracle=with_(*RULES, DAILY) + f""", e as (select *, {xsum_over('pnl', 'partition by strategy order by delivery_date rows unbounded preceding')} as cum from daily),
      d as (select *, cum - greatest(0.0e0, max(cum) over (partition by strategy order by delivery_date rows unbounded preceding)) as drawdown,
        case when count(pnl) over w = 365 and stddev_samp(pnl) over w > 0 then round(avg(pnl) over w / stddev_samp(pnl) over w * sqrt(365.0e0), 6) end as sharpe, row_number() over (partition by strategy order by delivery_date desc) - 1 as b from e
        window w as (partition by strategy order by delivery_date rows between 364 preceding and current row))
      select strategy, delivery_date, cum, drawdown, sharpe from d where b % 7 = 0""",
)
def display(spark, sf):
    return pos.display_series(daily(spark, sf), ["strategy"], "delivery_date", "pnl", 365, 7).withColumn("sharpe", F.round("sharpe", 6))


@query(
    "candidate_day_profits",
    oracle=with_(*RULES, DAILY) + """ select delivery_date, max(pnl) filter (where strategy = 'supply') as pnl_supply, max(pnl) filter (where strategy = 'side') as pnl_side, max(pnl) filter (where strategy = 'two_sided') as pnl_two_sided from alld group by 1""",
)
def candidates(spark, sf):
    p = rule_panel(spark, sf)
    g = F.coalesce("gap", F.lit(0.0))
    rules = {"supply": F.lit(-1.0), "side": pos.trailing_side(F.col("s365")), "two_sided": pos.two_sided(F.col("s28"))}
    aggs = []
    for n, r in rules.items():
        x = F.when(F.col("gap").isNull(), 0.0).otherwise(r)
        aggs.append(exact_sum(x * g - F.abs(x) * pos.side_cost(x)).alias(f"pnl_{n}"))
    return p.groupBy("delivery_date").agg(*aggs)


@query(
    "run_reconciliation",
    oracle=with_(*RULES, ledger_sql(TWO)) + f""", a as (select year(delivery_date)::int as year, {xsum('pnl')} as v from led group by 1), b as (select year(delivery_date)::int as year, {xsum('pnl')} as v from led where slot <= 6 and year(delivery_date) > 1995 group by 1)
      select year, a.v as recomputed, b.v as published, abs(a.v - b.v) as abs_diff from a full join b using (year)""",
)
def reconciliation(spark, sf):
    led = pos.ledger(rule_panel(spark, sf), pos.two_sided(F.col("s28"))).withColumn("year", F.year("delivery_date"))
    a = led.groupBy("year").agg(exact_sum("pnl").alias("v"))
    b = led.where("slot <= 6 and year > 1995").groupBy("year").agg(exact_sum("pnl").alias("v"))
    return pos.reconcile(a, b, ["year"], "v")
