"""Model jobs on Spark MLlib: walk-forward tree fits, residuals, conditional quantiles and day classifiers.

A refit is a distributed MLlib fit on the rows a period may learn from; the driver only loops over the years of the data.  The
panel is cut from its lineage once (reliable checkpoint) so that the fits do not recompute its joins and windows.  Missing
features count as zero with an indicator of their own, so every row gets a prediction.  Linear models are in ``plans.walks``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions import timecols as tc
from gridtide.functions.numbers import clip
from gridtide.operators.quality import refuse_labels
from gridtide.plans import walks
from gridtide.session import checkpoint_dir

CLIP = 250.0
GAP_DAYS = 2


def linear(weight: str | None = None) -> Estimator:
    m = LinearRegression(featuresCol="_features", labelCol="_label", predictionCol="_pred", solver="normal")
    return m.setWeightCol(weight) if weight else m


def tree_regressor(depth: int = 3, rounds: int = 10, weight: str | None = None) -> Estimator:
    m = GBTRegressor(featuresCol="_features", labelCol="_label", predictionCol="_pred", maxDepth=depth, maxIter=rounds, seed=7)
    return m.setWeightCol(weight) if weight else m


def tree_classifier(depth: int = 3, rounds: int = 10) -> Estimator:
    return GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_cls", maxDepth=depth, maxIter=rounds, seed=7).setProbabilityCol(
        "_prob"
    )


def prepared(df: DataFrame, features: Sequence[str], label: Column, learnable: Column | None = None) -> DataFrame:
    """Rows with a feature vector, the label and ``_from``, the first day on which a fit may use the row (null: never; all
    rows from the beginning if not given); checkpointed for reuse."""
    refuse_labels(features)
    checkpoint_dir(df.sparkSession)
    z = walks.design(features)[1:]
    names = [f"_x{i}" for i in range(len(z))]
    first = F.lit("0001-01-01").cast("date") if learnable is None else learnable
    rows = df.select("*", label.cast("double").alias("_label"), first.alias("_from"), *[x.alias(n) for n, x in zip(names, z, strict=True)])
    return VectorAssembler(inputCols=names, outputCol="_features").transform(rows).drop(*names).checkpoint()


def learnable_from(day: str, published: str, zone: str) -> Column:
    """First day on which a fit may use a row: two days after its own, and a day after its label was public by the deadline."""
    usable = tc.first_usable_day(published, zone)
    return F.when(F.col(published).isNotNull(), F.greatest(F.date_add(day, GAP_DAYS), F.date_add(usable, 1)))


def year_periods(rows: DataFrame, day: str) -> list[tuple[str, str]]:
    """Calendar years of the rows that have something to learn from; one row comes to the driver."""
    lo, hi = rows.agg(F.min(F.when(F.col("_label").isNotNull(), F.col("_from"))), F.max(day)).first()
    if lo is None or hi is None:
        return []
    first = lo.year if (lo.month, lo.day) == (1, 1) else lo.year + 1
    return [(f"{y:04d}-01-01", f"{y + 1:04d}-01-01") for y in range(first, hi.year + 1)]


def clipped_target(gap: str, bound: float = CLIP) -> Column:
    return clip(gap, -bound, bound)


def event_target(gap: str, level: float) -> Column:
    return F.when(F.col(gap).isNotNull(), (F.col(gap) >= level).cast("double"))


def _score(model, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    if "_prob" in out.columns:
        return out.withColumn("_pred", vector_to_array("_prob")[1]).drop("_prob", "rawPrediction", "_cls")
    return out


def may_train(period_start: str) -> Column:
    """Rows a period may learn from."""
    return F.col("_label").isNotNull() & (F.col("_from") <= F.lit(period_start).cast("date"))


def walk_forward(rows: DataFrame, day: str, periods: Sequence[tuple[str, str]], make: Callable[[], Estimator], out: str) -> DataFrame:
    """One fit per period [start, end), predictions for all rows of that period."""
    parts = []
    for start, end in periods:
        test = rows.where((F.col(day) >= F.lit(start).cast("date")) & (F.col(day) < F.lit(end).cast("date")))
        parts.append(_score(make().fit(rows.where(may_train(start))), test).withColumn("period", F.lit(start).cast("date")))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("_pred", out).drop("_features", "_label", "_from")


def quantile_cells(rows: DataFrame, cell: Sequence[str], period: Column, value: str, probs: dict[str, float]) -> DataFrame:
    """Empirical conditional quantiles per cell and period (MLlib has no quantile loss)."""
    return rows.where(F.col(value).isNotNull()).groupBy(*cell, period.alias("period")).agg(
        *[F.percentile(value, p).alias(n) for n, p in probs.items()], F.count(value).alias("n")
    )


def fold_residuals(
    rows: DataFrame, fold: Column, folds: Sequence[int], make: Callable[[], Estimator], out: str = "residual"
) -> DataFrame:
    """Out-of-fold residuals: each fold is predicted by the model of the other folds."""
    r = rows.withColumn("_fold", fold)
    parts = []
    for f in folds:
        model = make().fit(r.where((F.col("_fold") != f) & F.col("_label").isNotNull()))
        parts.append(_score(model, r.where((F.col("_fold") == f) & F.col("_label").isNotNull())))
    return reduce(DataFrame.unionByName, parts).withColumn(out, F.col("_label") - F.col("_pred")).drop("_features", "_from")


def bad_day_target(days: DataFrame, day: str, pnl: str, learnable: str, q: float) -> DataFrame:
    """Per year with earlier days, 1 for the days in the worst quantile of the days that were learnable when it began:
    (period, bad_day) for all days up to its end.  One row per calendar day and later year."""
    span = days.agg(F.year(F.min(learnable)).alias("_a"), F.year(F.max(day)).alias("_b"))  # one row
    years = days.join(F.broadcast(span)).withColumn("period", F.explode(F.sequence(F.year(day), F.col("_b"))))
    years = years.withColumn("period", F.make_date("period", F.lit(1), F.lit(1))).drop("_a", "_b")
    cut = years.where(F.col(learnable) <= F.col("period")).groupBy("period").agg(F.percentile(pnl, q).alias("_cut"))
    return years.join(cut, "period").withColumn("bad_day", (F.col(pnl) <= F.col("_cut")).cast("double")).drop("_cut")


def configuration_neighbours(config: dict[str, Sequence]) -> list[dict]:
    """The chosen configuration (first value of each setting) and those with one setting flipped."""
    base = {k: v[0] for k, v in config.items()}
    return [base] + [{**base, k: v[1]} for k, v in config.items() if len(v) > 1]
