"""Walk-forward evaluation: every fold's models know only what was known at its origin."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.operators import forecasts, models
from quarrylane.operators.panel import SERIES
from quarrylane.operators.splits import Fold

Origins = Callable[[dt.date], Sequence[dt.date]]


def error_origins(fold: Fold, protection_days: int, step: int = 1) -> list[dt.date]:
    """Days of a fold's window from which a protection window still ends inside it, the fold's origin first."""
    last = fold.end - dt.timedelta(days=protection_days)
    return [fold.origin + dt.timedelta(days=i) for i in range(0, (last - fold.origin).days + 1, step)]


def origins_needed(folds: Sequence[Fold], training: Origins, protection_days: int | None = None, step: int = 1) -> list[dt.date]:
    """Every origin of any fold, so that features at origins are built once for all."""
    days = {f.origin for f in folds} | {o for f in folds for o in training(f.origin)}
    if protection_days:
        days |= {o for f in folds for o in error_origins(f, protection_days, step)}
    return sorted(days)


def training_rows(rows: DataFrame, fold: Fold, training: Origins) -> DataFrame:
    """Rows of the fold's training origins whose label was known at its origin."""
    return rows.where(F.col("origin").isin(list(training(fold.origin))) & (F.col("target_date") <= F.lit(fold.origin)))


def evaluated_rows(rows: DataFrame, fold: Fold, protection_days: int | None = None, step: int = 1) -> DataFrame:
    """``test`` rows of the fold's origin, and ``error`` rows of origins stepped through its window."""
    test = rows.where((F.col("origin") == F.lit(fold.origin)) & (F.col("target_date") <= F.lit(fold.end))).withColumn("part", F.lit("test"))
    if protection_days:
        within = F.col("origin").isin(error_origins(fold, protection_days, step)) & (F.col("horizon") <= protection_days)
        test = test.unionByName(rows.where(within).withColumn("part", F.lit("error")))
    return test.withColumn("fold", F.lit(fold.name))


def walk_forward(rows: DataFrame, folds: Sequence[Fold], training: Origins, families: Mapping[str, Mapping], numeric: Sequence[str],
                 categorical: Sequence[str], protection_days: int | None = None, step: int = 1, workers: int = 4) -> DataFrame:
    """Refit each family in each fold and forecast its window.

    ``rows`` holds the features at all ``origins_needed``, written once; features at an origin use days up to it only.
    Fits of folds and families run as parallel jobs over that table. A fold's error rows are forecast by the model that
    was fitted before the fold began. A fold without training rows is refused.
    Returns fold, part, model, series, origin, target_date, horizon, y_true and forecast.
    """
    jobs = [(fold, family) for fold in folds for family in families]

    def run(job: tuple[Fold, str]) -> DataFrame:
        fold, family = job
        train = training_rows(rows, fold, training)
        if train.isEmpty():
            raise ValueError(f"no training rows before {fold.origin} for {fold.name}")
        fitted = models.fit_demand(train, family, numeric, categorical, **families[family])
        test = evaluated_rows(rows, fold, protection_days, step)
        # The horizon is a feature, so it is kept apart from the filled features.
        ident = test.withColumn("__horizon", F.col("horizon").cast("long"))
        got = models.predict_demand(fitted, ident, numeric, "forecast", 0.0 if family == "tweedie" else -999.0)
        return got.select("fold", "part", F.lit(family).alias("model"), SERIES, "origin", "target_date",
                          F.col("__horizon").alias("horizon"), "y_true", "forecast")

    with ThreadPool(max(1, min(workers, len(jobs)))) as pool:
        parts = pool.map(inheritable_thread_target(rows.sparkSession)(run), jobs)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_scores(forecast: DataFrame) -> DataFrame:
    """Scores of each model per fold and part."""
    d = forecast.withColumnRenamed("model", "family")
    return forecasts.scores(d, ["forecast"], ["fold", "part", "family"]).drop("model").withColumnRenamed("family", "model")
