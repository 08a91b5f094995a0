"""Model jobs (P9-P16, P18-P20) on the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.functions.exact import exact_sum
from gridtide.plans import models, walks
from gridtide.workload.bindings import ZONE, with_, xsum
from gridtide.workload.positions import RULES, rule_panel
from gridtide.workload.registry import query

DAY = "delivery_date"
KEYS = [DAY, "zone", "slot"]
FEATURES = ["s28", "s365", "da_level"]
ONE = "s28"


def rows(spark, sf, features=FEATURES, label=None):
    p = rule_panel(spark, sf).drop("n_trades", "load_cost", "supply_cost").withColumn("da_level", F.col("y_da"))
    learnable = models.learnable_from(DAY, "label_published_at", ZONE)
    return models.prepared(p, features, label if label is not None else models.clipped_target("gap"), learnable)


# One feature, its missing indicator and ordinary least squares: the SQL regression functions can follow every refit.
def _per(months: int) -> str:
    unit = {1: "month", 3: "quarter"}[months]
    return (
        f"per as (select p::date as s, (p + interval {months} month)::date as e from (select unnest(generate_series(date_trunc('{unit}', min(delivery_date)),"
        f" date_trunc('{unit}', max(delivery_date)), interval {months} month)) as p from rp))"
    )


_TAUGHT = f"taught as (select *, (label_published_at at time zone 'UTC') at time zone '{ZONE}' as lp from rp)"
_MAY = "delivery_date <= s - 2 and lp <= (s - 1) + interval 5 hour"


def _fit(y: str = "gap", x: str = "s28", window: int | None = None, name: str = "fit", group: str = "") -> str:
    back = f" and delivery_date >= s - interval {window} month" if window else ""
    by = f"{group}, " if group else ""
    return (
        f"{name} as (select s, e, {by}count(*) as n, regr_slope({y}, {x}) as b, regr_intercept({y}, {x}) as a, avg({y}) filter (where {x} is null) as m"
        f" from per join taught on {_MAY}{back} group by all having count(*) >= 30)"
    )


def _says(f: str = "", x: str = "s28") -> str:
    """What a fit predicts: rows without the feature get the mean of such rows, or the intercept where there were none."""
    return f"case when {x} is not null then {f}a + {f}b * {x} else coalesce({f}m, {f}a) end"


_IN = "delivery_date >= s and delivery_date < e"


def learned(spark, sf, label=None, features=(ONE,), panel_=None, **options):
    """The panel and its walk-forward models."""
    p = rule_panel(spark, sf)
    p = panel_(p) if panel_ else p
    return p, walks.fits(p, DAY, "label_published_at", ZONE, list(features), F.col("gap") if label is None else label, **options)


@query(
    "walk_forward_linear",
    oracle=with_(*RULES, _per(1), _TAUGHT, _fit()) + f" select delivery_date, zone, slot, s as period, round({_says()}, 6) as pred from rp join fit on {_IN}",
)
def walk_linear(spark, sf):
    p, models_ = learned(spark, sf)
    return walks.predicted(p, models_, DAY, [ONE], "pred").select(*KEYS, "period", F.round("pred", 6).alias("pred"))


@query(
    "recency_weighted_fit",
    oracle=with_(*RULES, _per(3), _TAUGHT)
    + f""", w as (select s, e, power(2.0e0, datediff('month', date '1970-01-01', delivery_date) / 12.0e0) as w, s28 as x, gap as y from per join taught on {_MAY} and delivery_date >= s - interval 60 month),
      t as (select s, e, count(*) as n, sum(w * y) filter (where x is null) / sum(w) filter (where x is null) as m,
        sum(w) filter (where x is not null) as w0, sum(w * x) as wx, sum(w * x * x) as wxx, sum(w * y) filter (where x is not null) as wy, sum(w * x * y) as wxy from w group by 1, 2 having count(*) >= 30),
      c as (select *, (w0 * wxy - wx * wy) / (w0 * wxx - wx * wx) as b from t), fit as (select *, (wy - b * wx) / w0 as a from c)
      select delivery_date, zone, slot, s as period, round({_says()}, 6) as pred from rp join fit on {_IN}""",
)
def recency(spark, sf):
    p, models_ = learned(spark, sf, months=3, windows=(60,), half_life=12)
    return walks.predicted(p, models_, DAY, [ONE], "pred", 3).select(*KEYS, "period", F.round("pred", 6).alias("pred"))


@query("walk_forward_trees")
def walk_trees(spark, sf):
    r = rows(spark, sf)
    w = models.walk_forward(r, DAY, models.year_periods(r, DAY), lambda: models.tree_regressor(3, 5), "pred")
    return w.select(*KEYS, "period", F.round("pred", 6).alias("pred"))


@query("event_probability_trees")
def event_trees(spark, sf):
    r = rows(spark, sf, label=models.event_target("gap", 2.0))
    w = models.walk_forward(r, DAY, models.year_periods(r, DAY), lambda: models.tree_classifier(2, 5), "p_event")
    return w.select(*KEYS, "period", F.round("p_event", 6).alias("p_event"))


# First day on which a fit may use a row, and the first year that begins then or later.
_FROM = """fr as (select *, greatest(delivery_date + 2, (case when lp <= lp::date + interval 5 hour then lp::date else lp::date + 1 end) + 1) as learnable from taught)"""


def _year_from(c: str) -> str:
    return f"(year({c}) + case when {c} = date_trunc('year', {c}) then 0 else 1 end)"


@query(
    "quantile_cells",
    oracle=with_(*RULES, _TAUGHT, _FROM) + f" select zone, slot, {_year_from('learnable')}::int as period, round(quantile_cont(gap, 0.1), 11) as q10, round(quantile_cont(gap, 0.5), 11) as q50, round(quantile_cont(gap, 0.9), 11) as q90, count(gap) as n from fr where gap is not null group by 1, 2, 3",
)
def quantile_cells(spark, sf):
    p = rule_panel(spark, sf).select("zone", "slot", DAY, "label_published_at", "gap")
    year = F.year(walks.first_taught_period(F.col(DAY), F.col("label_published_at"), ZONE, 12))
    q = models.quantile_cells(p, ["zone", "slot"], year, "gap", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return q.select("zone", "slot", "period", *[F.round(c, 11).alias(c) for c in ("q10", "q50", "q90")], "n")


@query(
    "conditional_grid_scores",
    oracle=with_(*RULES, _per(3), _TAUGHT, _fit(x="y_da")) + f""", k as (select unnest([0.25e0, 0.5e0, 0.75e0, 0.9e0, 1.0e0, 1.1e0, 1.25e0, 1.5e0, 2.0e0]) as multiple)
      select delivery_date, zone, slot, multiple, y_da * multiple as level, round(a + b * (y_da * multiple), 6) as cond from rp join fit on {_IN} cross join k""",
)
def conditional_grid(spark, sf):
    p, models_ = learned(spark, sf, features=["da_level"], panel_=lambda q: q.withColumn("da_level", F.col("y_da")), months=3)
    multiples = F.array(*[F.lit(m) for m in (0.25, 0.5, 0.75, 0.9, 1.0, 1.1, 1.25, 1.5, 2.0)])
    grid = p.withColumn("multiple", F.explode(multiples)).withColumn("da_level", F.col("da_level") * F.col("multiple"))
    scored = walks.predicted(grid, models_, DAY, ["da_level"], "cond", 3)
    return scored.select(*KEYS, "multiple", F.col("da_level").alias("level"), F.round("cond", 6).alias("cond"))


@query(
    "last_models_ensemble",
    oracle=with_(*RULES, _per(3), _TAUGHT, _fit()) + f""", u as (select delivery_date, zone, slot, {_says("f.")} as pred from rp join per p on {_IN.replace("s and", "p.s and").replace("< e", "< p.e")} join fit f on f.s <= p.s and f.s >= p.s - interval 9 month)
      select delivery_date, zone, slot, round(avg(pred), 6) as pred, count(*) as models from u group by 1, 2, 3""",
)
def ensemble(spark, sf):
    p, models_ = learned(spark, sf, months=3)
    mean = walks.last_models(models_, [], 4)
    return walks.predicted(p, mean, DAY, [ONE], "pred", 3).select(*KEYS, F.round("pred", 6).alias("pred"), "models")


@query(
    "multi_length_windows",
    oracle=with_(*RULES, _per(1), _TAUGHT, *[_fit(window=n, name=f"f{n}") for n in (12, 24, 36, 60)]) + f""", fit as (select * from f12 union all select * from f24 union all select * from f36 union all select * from f60)
      select delivery_date, zone, slot, round(avg({_says()}), 6) as pred, count(*) as models from rp join fit on {_IN} group by 1, 2, 3""",
)
def multi_length(spark, sf):
    p, models_ = learned(spark, sf, windows=(12, 24, 36, 60))
    x = walks.predicted(p, walks.mean_of_windows(models_, []), DAY, [ONE], "pred")
    return x.select(*KEYS, F.round("pred", 6).alias("pred"), "models")


@query(
    "zone_specialist_fit",
    oracle=with_(*RULES, _per(3), _TAUGHT, _fit(group="zone")) + f" select delivery_date, zone, slot, s as period, round({_says()}, 6) as pred from rp join fit using (zone) where {_IN}",
)
def specialist(spark, sf):
    p, models_ = learned(spark, sf, months=3, keys=["zone"])
    x = walks.predicted(p, models_, DAY, [ONE], "pred", 3, ["zone"])
    return x.select(*KEYS, "period", F.round("pred", 6).alias("pred"))


@query(
    "out_of_fold_residuals",
    oracle=with_(*RULES) + f""", f as (select k, regr_slope(gap, s28) as b, regr_intercept(gap, s28) as a, avg(gap) filter (where s28 is null) as m from rp cross join range(3) t(k) where gap is not null and year(delivery_date) % 3 <> k group by 1)
      select delivery_date, zone, slot, round(gap - ({_says()}), 6) as residual from rp join f on year(delivery_date) % 3 = k where gap is not null""",
)
def residuals(spark, sf):
    x = models.fold_residuals(rows(spark, sf, [ONE]), F.year(DAY) % 3, [0, 1, 2], models.linear)
    return x.select(*KEYS, F.round("residual", 6).alias("residual"))


@query(
    "decomposed_target",
    oracle=with_(*RULES, _per(3), _TAUGHT, _fit(y="gap - 0.1e0 * y_da", name="f1"), _fit(y="0.1e0 * y_da", name="f2")) + f"""
      select delivery_date, zone, slot, round({_says("f1.")} + {_says("f2.")}, 6) as pred from rp join f1 on {_IN} join f2 using (s)""".replace("f1 on delivery_date >= s and delivery_date < e", "f1 on delivery_date >= f1.s and delivery_date < f1.e"),
)
def decomposed(spark, sf):
    p, rest = learned(spark, sf, F.col("gap") - 0.1 * F.col("y_da"), months=3)
    _, level = learned(spark, sf, 0.1 * F.col("y_da"), months=3)
    whole = walks.sum_of_parts([rest, level], [])
    return walks.predicted(p, whole, DAY, [ONE], "pred", 3).select(*KEYS, F.round("pred", 6).alias("pred"))


def day_results(spark, sf):
    from gridtide.functions.exact import exact_avg

    d = rule_panel(spark, sf).groupBy(DAY).agg(
        exact_sum(-F.col("gap")).alias("pnl"), exact_avg("s28").alias("score"), exact_avg("s365").alias("long_score"), F.count(F.lit(1)).alias("n_rows"),
        F.max("label_published_at").alias("published"),
    )
    return d.withColumn("learnable", models.learnable_from(DAY, "published", ZONE)).drop("published")


@query(
    "bad_day_labels",
    oracle=with_(*RULES, _TAUGHT, _FROM) + f""", d as (select delivery_date, {xsum('-gap')} as pnl, max(learnable) as learnable from fr group by 1), y as (select unnest(range(min(year(delivery_date)), max(year(delivery_date)) + 1)) as y from d),
      c as (select make_date(y::bigint, 1, 1) as period, quantile_cont(pnl, 0.05) as c from y join d on learnable <= make_date(y::bigint, 1, 1) group by 1)
      select period, delivery_date, pnl, case when pnl <= c then 1.0e0 else 0.0e0 end as bad_day from d join c on year(delivery_date) <= year(period)""",
)
def bad_days(spark, sf):
    return models.bad_day_target(day_results(spark, sf), DAY, "pnl", "learnable", 0.05).select("period", DAY, "pnl", "bad_day")


@query("bad_day_classifier")
def bad_day_classifier(spark, sf):
    labelled = models.bad_day_target(day_results(spark, sf), DAY, "pnl", "learnable", 0.05)
    r = models.prepared(labelled, ["score", "long_score"], F.col("bad_day"), F.col("learnable"))
    parts = [models.walk_forward(r.where(F.col("period") == F.lit(p[0]).cast("date")).drop("period"), DAY, [p], lambda: models.tree_classifier(2, 5), "p_bad") for p in models.year_periods(r, DAY)]
    w = reduce(DataFrame.unionByName, parts)
    return w.select(DAY, "period", F.round("p_bad", 6).alias("p_bad"))


@query("configuration_neighbours")
def neighbours(spark, sf):
    # one of two settings flipped at a time, each a full refit of the last period
    r = rows(spark, sf)
    periods = models.year_periods(r, DAY)[-1:]
    out = None
    for c in models.configuration_neighbours({"depth": (2, 3), "rounds": (3, 5)}):
        w = models.walk_forward(r, DAY, periods, lambda c=c: models.tree_regressor(c["depth"], c["rounds"]), "pred")
        e = w.groupBy(F.lit(f"depth {c['depth']} rounds {c['rounds']}").alias("configuration")).agg(
            F.round(F.avg(F.abs(F.col("gap") - F.col("pred"))), 6).alias("mae"), F.count(F.lit(1)).alias("rows")
        )
        out = e if out is None else out.unionByName(e)
    return out
