"""Staged scoring of a boosted ensemble: what each round adds, and what the starting margin does to the ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.operators.rankstats import ranking_quality

MARGINS = "margins"
#: Rounds that are looked at, and the probability below which a positive counts as buried.
ROUNDS = (1, 5, 10, 25, 50, 100, 200, 300)
BURIED = 1e-4


def stump_margins(df: DataFrame, stumps: Sequence[tuple[str, float, float, float]]) -> DataFrame:
    """``margins``: one margin per round of stated stumps (column, threshold, margin above it, margin otherwise)."""
    return df.withColumn(MARGINS, F.array(*[F.when(F.col(c) > cut, F.lit(above)).otherwise(F.lit(below)) for c, cut, above, below in stumps]))


def tree_margins(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``margins``: the weighted margin of every tree of a fitted boosted classifier, all trees in one pass over the rows."""
    booster, out = model.stages[-1], df
    for stage in model.stages[:-1]:
        out = stage.transform(out)
    names = []
    for i, (tree, weight) in enumerate(zip(booster.trees, booster.treeWeights)):
        # A margin of the ensemble is half a log-odds.
        name = f"__tree_{i}"
        scored = tree.setFeaturesCol(booster.getFeaturesCol()).setPredictionCol(name).transform(out)
        out = scored.withColumn(name, 2.0 * weight * F.col(name))
        names.append(name)
    return out.select(*df.columns, F.array(*names).alias(MARGINS))


def log_odds(p: Column | float) -> Column:
    p = p if isinstance(p, Column) else F.lit(float(p))
    return F.log(p / (1 - p))


def staged_scores(df: DataFrame, starts: Mapping[str, Column | float], rounds: Sequence[int] = ROUNDS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row, start and number of rounds: ``start``, ``rounds``, ``margin`` and ``p``.

    Every stage's sum is folded from the one array of margins; rounds beyond the ensemble are left out.
    """
    stages = F.explode(F.array(*[F.struct(F.lit(r).alias("rounds"), F.aggregate(F.slice(MARGINS, 1, r), F.lit(0.0), lambda a, m: a + m).alias("sum")) for r in rounds]))
    d = df.select(*keep, F.size(MARGINS).alias("__size"), stages.alias("__r")).where(F.col("__r.rounds") <= F.col("__size"))
    start = F.explode(F.array(*[F.struct(F.lit(n).alias("start"), log_odds(p).alias("base")) for n, p in starts.items()]))
    d = d.select(*keep, "__r", start.alias("__s"))
    margin = F.col("__s.base") + F.col("__r.sum")
    return d.select(*keep, F.col("__r.rounds").alias("rounds"), F.col("__s.start").alias("start"), margin.alias("margin"), (1 / (1 + F.exp(-margin))).alias("p"))


def diagnosis(scored: DataFrame, y: str, digits: int = 12) -> DataFrame:
    """Per start and number of rounds: ROC and PR AUC, smallest probability, and the positives below ``BURIED``.

    Probabilities are rounded to ``digits`` before they are ranked: where boosting has saturated, scores that differ only
    beyond them are ties, which is what the diagnosis looks for.
    """
    d = scored.withColumn("p", F.round("p", digits))
    quality = ranking_quality(d, "p", y, ["start", "rounds"]).select("start", "rounds", "roc_auc", "pr_auc")
    positive = F.col(y) == 1
    low = d.groupBy("start", "rounds").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("positives"), F.min("p").alias("min_p"), F.sum("margin").alias("margin_total"),
        F.count_if(positive & (F.col("p") < BURIED)).alias("buried"))
    low = low.withColumn("buried_share", F.try_divide("buried", F.col("positives")))
    return low.join(quality, ["start", "rounds"])


def saturated(table: DataFrame, drop: float = 0.02) -> DataFrame:
    """Per start whether the AUC falls by more than ``drop`` below its last value at an earlier number of rounds."""
    last = F.max_by("roc_auc", "rounds")
    return table.groupBy("start").agg(F.min("roc_auc").alias("lowest"), last.alias("last"), (F.min("roc_auc") < last - drop).alias("non_monotonic"))
