"""Exact ranking statistics of a score against a binary label.

Everything starts from one row per distinct score (``score_counts``), so tied scores
are handled exactly and the data that is ordered never exceeds the distinct scores.
A row without a score ranks below all others and is counted like them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.plans.bounded import each
from quarrylane.plans.prefix import join_null_safe, running_totals
from quarrylane.session import checkpointed


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate; NaN where either side has no spread, which stops ``corr`` under ANSI rules."""
    both = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(both == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(x, y), both))


def score_counts(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    y = F.col(label).cast("long")
    return df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def cumulative_counts(df: DataFrame, score: str, label: str, keys: Sequence[str] = (),
                      buckets: int | None = None) -> DataFrame:
    """Counts at or above each distinct score: ``cum_pos`` and ``cum_neg``."""
    return running_totals(score_counts(df, score, label, keys), "score", ["pos", "neg"],
                          keys, descending=True, buckets=buckets)


def ranking_quality(df: DataFrame, score: str, label: str, keys: Sequence[str] = (),
                    buckets: int | None = None) -> DataFrame:
    """ROC AUC and average precision; NULL where only one class is present."""
    c = cumulative_counts(df, score, label, keys, buckets)
    above = F.col("cum_pos") - F.col("pos")
    wins = F.sum(F.col("neg") * (above + F.col("pos") / 2.0))
    steps = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    agg = c.groupBy(*keys).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        wins.alias("__wins"), steps.alias("__steps"))
    p, n = F.col("positives"), F.col("negatives")
    both = (p > 0) & (n > 0)
    return agg.select(
        *keys, "positives", "negatives",
        F.when(both, F.try_divide(F.col("__wins"), p * n)).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("__steps"), p)).alias("pr_auc"))


def pr_curve(df: DataFrame, score: str, label: str, buckets: int | None = None) -> DataFrame:
    """Precision, recall and F1 at every distinct threshold."""
    counts = checkpointed(score_counts(df, score, label))
    c = running_totals(counts, "score", ["pos", "neg"], descending=True, buckets=buckets)
    total = counts.agg(F.sum("pos").alias("p")).scalar()
    c = c.withColumn("__p", total)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    recall = F.try_divide(F.col("cum_pos"), F.col("__p"))
    return c.select(
        F.col("score").alias("threshold"), precision.alias("precision"), recall.alias("recall"),
        (2 * precision * recall / (precision + recall + F.lit(1e-12))).alias("f1"))


def best_f1(curve: DataFrame) -> DataFrame:
    """The threshold with the highest F1; the lowest threshold wins a tie."""
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                    F.struct(F.round("f1", 12), -F.col("threshold")))
    return curve.agg(best.alias("b")).select("b.*")


def review_budgets(df: DataFrame, score: str, label: str, row_id: str,
                   fractions: Sequence[float], buckets: int | None = None) -> DataFrame:
    """Positives caught when only the top fraction of scores is reviewed.

    Scores strictly above the cut are counted per distinct score. Rows tied at the
    cut are taken in ``row_id`` order, through a second running total over the ids,
    so even a score shared by most rows is split over tasks.
    """
    counts = checkpointed(score_counts(df, score, label))
    size = counts.agg(F.sum(F.col("pos") + F.col("neg")).alias("n")).scalar()
    positives = counts.agg(F.sum("pos").alias("p")).scalar()
    upto = F.col("cum_pos") + F.col("cum_neg")
    start = upto - F.col("pos") - F.col("neg")
    cuts = (
        running_totals(counts, "score", ["pos", "neg"], descending=True, buckets=buckets)
        .withColumns({"__n": size, "budget_frac": each([float(f) for f in fractions])})
        .withColumn("alerts", F.greatest(F.floor(F.col("budget_frac") * F.col("__n")), F.lit(1)))
        .where((start < F.col("alerts")) & (upto >= F.col("alerts")))
        .select("budget_frac", "alerts", "score", (F.col("cum_pos") - F.col("pos")).alias("above"),
                (F.col("alerts") - start).alias("room"))
    )
    # One row per requested fraction: broadcasting the cuts is bounded by the caller.
    cut_scores = F.broadcast(cuts.select("score").distinct())
    tied = join_null_safe(df.select(F.col(score).cast("double").alias("score"), F.col(row_id).alias("rid"),
                                    F.col(label).cast("long").alias("pos"), F.lit(1).cast("long").alias("one")),
                          cut_scores, ["score"])
    run = running_totals(tied, "rid", ["pos", "one"], ["score"], buckets=buckets)
    got = join_null_safe(run, F.broadcast(cuts), ["score"]).where(F.col("cum_one") == F.col("room"))
    caught = F.col("above") + F.col("cum_pos")
    return got.select(
        "budget_frac", "alerts", caught.alias("caught"),
        (caught / F.greatest(positives, F.lit(1))).alias("recall"),
        (caught / F.col("alerts")).alias("precision"))
