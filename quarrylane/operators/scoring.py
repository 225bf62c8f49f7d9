"""Scores against outcomes: thresholds, calibration, segments, error classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.functions import vocab
from quarrylane.functions.cleaning import left_closed_band
from quarrylane.operators.rankstats import ranking_quality
from quarrylane.operators.rounds import one_row_to_long

KINDS = ("true_positive", "false_negative", "false_positive", "true_negative")


def checked_score(p: Column | str) -> Column:
    """A probability; a missing one, or one outside [0, 1], stops the job by name."""
    c = (F.col(p) if isinstance(p, str) else p).cast("double")
    return F.when(c.between(0, 1), c).otherwise(F.raise_error(F.lit("a score is missing or outside [0, 1]")).cast("double"))


def threshold_metrics(df: DataFrame, p: str, y: str, threshold: float) -> DataFrame:
    """Confusion counts and every threshold metric in one aggregate."""
    df = df.withColumn(p, checked_score(p))
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    clipped = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col(p)))
    a = df.agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"),
        F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"),
        F.avg(-F.when(pos, F.ln(clipped)).otherwise(F.ln(1 - clipped))).alias("log_loss"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return a.withColumns({
        "precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
        "recall": F.coalesce(F.try_divide(tp, tp + fn), zero),
        "specificity": F.coalesce(F.try_divide(tn, tn + fp), zero),
        "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero),
        "accuracy": (tp + tn) / (tp + fp + fn + tn)})


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Mean score and positive rate per equal-width bin."""
    df = df.withColumn(p, checked_score(p))
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")
    return df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_score"),
                             F.avg(y).alias("positive_rate"))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Mean gap between score and rate, weighted by bin size."""
    r = reliability(df, p, y, bins)
    gap = F.abs(F.col("mean_score") - F.col("positive_rate")) * F.col("n")
    return r.agg((F.sum(gap) / F.sum("n")).alias("ece"))


def risk_band(p: Column) -> Column:
    return left_closed_band(checked_score(p), vocab.RISK_BANDS)


def band_summary(df: DataFrame, p: str, y: str, value: str) -> DataFrame:
    """Size, predicted risk, realised rate and value at risk per band."""
    s = df.groupBy(risk_band(F.col(p)).alias("risk_segment")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg(p).alias("avg_predicted_risk"),
        F.avg(y).alias("realised_rate"), F.sum(y).alias("churners"),
        F.avg(value).alias("avg_value"), F.sum(value).alias("value_at_risk"))
    every = Window.partitionBy()  # at most four rows
    return s.withColumns({
        "share_of_customers": F.col("customers") / F.sum("customers").over(every),
        "share_of_churners": F.col("churners") / F.greatest(F.sum("churners").over(every), F.lit(1))})


def band_validation(summary: DataFrame) -> DataFrame:
    """Whether realised rates rise with the bands, the worst gap and the lift."""
    names = [n for n, _ in vocab.RISK_BANDS]
    pos = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("risk_segment"))
    rows = F.sort_array(F.collect_list(F.struct(pos.alias("i"), "realised_rate", "avg_predicted_risk")))
    s = summary.agg(rows.alias("r"))
    first, last = F.get("r", F.lit(0)), F.element_at("r", -1)
    rises = F.forall(F.sequence(F.lit(1), F.size("r")),
                     lambda i: (i == 1) | (F.get("r", i - 1)["realised_rate"] > F.get("r", F.greatest(i - 2, F.lit(0)))["realised_rate"]))
    gap = F.array_max(F.transform("r", lambda x: F.abs(x["avg_predicted_risk"] - x["realised_rate"])))
    return s.select(rises.alias("monotonic"), gap.alias("max_gap"),
                    first["realised_rate"].alias("lowest_rate"), last["realised_rate"].alias("highest_rate"),
                    F.try_divide(last["realised_rate"], first["realised_rate"]).alias("lift"))


def segment_performance(df: DataFrame, p: str, y: str, threshold: float,
                        attributes: Sequence[str], min_size: int = 50) -> DataFrame:
    """Metrics per level of every attribute, all attributes in one pass."""
    cell = F.explode(F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("segment")) for a in attributes]))
    d = df.select(F.col(p).alias("p"), F.col(y).cast("long").alias("y"), cell.alias("x")).select("p", "y", "x.*")
    keys = ["attribute", "segment"]
    hit = F.col("p") >= threshold
    tp = F.count_if(hit & (F.col("y") == 1))
    a = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("positive_rate"),
        F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg("p").alias("mean_predicted"),
        (F.avg("p") - F.avg("y")).alias("calibration_gap"),
        (tp / F.greatest(F.sum("y"), F.lit(1))).alias("recall"),
        (tp / F.greatest(F.count_if(hit), F.lit(1))).alias("precision"),
        F.avg(hit.cast("int")).alias("flag_rate")).where(F.col("n") >= min_size)
    q = ranking_quality(d, "p", "y", keys).select(*keys, "roc_auc", "pr_auc")
    return a.join(q, keys)


def disparities(performance: DataFrame) -> DataFrame:
    """Spread of AUC and recall across the levels of each attribute."""
    def spread(c: str) -> Column:
        return F.when(F.count(c) > 1, F.max(c) - F.min(c)).alias(f"{c}_spread")

    return performance.groupBy("attribute").agg(spread("roc_auc"), spread("recall"))


def error_kind(p: Column, y: Column, threshold: float) -> Column:
    hit = p >= threshold
    return (F.when(hit & (y == 1), "true_positive").when(~hit & (y == 0), "true_negative")
            .when(hit, "false_positive").otherwise("false_negative"))


def error_profile(df: DataFrame, kind: str, numeric: Sequence[str]) -> DataFrame:
    """Mean of each number per outcome class, one row per number."""
    aggs = [F.avg(F.when(F.col(kind) == k, F.col(c))).alias(f"{c}__{k}") for c in numeric for k in KINDS]
    return one_row_to_long(df.agg(*aggs), list(numeric), "feature", KINDS)


def category_profile(df: DataFrame, kind: str, column: str) -> DataFrame:
    """Share of each level within each outcome class."""
    c = df.groupBy(column).pivot(kind, list(KINDS)).count().fillna(0, list(KINDS))
    every = Window.partitionBy()  # one row per level of a low-cardinality attribute
    return c.select(column, *[F.try_divide(F.col(k), F.sum(k).over(every)).alias(k) for k in KINDS])


def hardest_cases(df: DataFrame, p: str, kind: str, ident: str, n: int = 5,
                  keep: Sequence[str] = ()) -> DataFrame:
    """The most confidently wrong rows in each direction."""
    cols = [ident, p, kind, *keep]
    fn = df.where(F.col(kind) == "false_negative").select(*cols).orderBy(F.asc(p), ident).limit(n)
    fp = df.where(F.col(kind) == "false_positive").select(*cols).orderBy(F.desc(p), ident).limit(n)
    return fn.unionByName(fp)


def error_costs(df: DataFrame, kind: str, value: str, success: float, cost: float) -> DataFrame:
    """What misses and wasted contacts cost."""
    fn, fp = F.col(kind) == "false_negative", F.col(kind) == "false_positive"
    a = df.agg(F.count_if(fn).alias("n_false_negative"), F.count_if(fp).alias("n_false_positive"),
               (F.coalesce(F.sum(F.when(fn, F.col(value))), F.lit(0.0)) * success).alias("fn_cost"))
    mean = F.col("fn_cost") / F.greatest("n_false_negative", F.lit(1))
    return a.withColumns({"fp_cost": F.col("n_false_positive") * cost, "mean_fn_cost": mean,
                          "mean_fp_cost": F.lit(float(cost)), "cost_ratio": mean / cost})


def noise_ceiling(df: DataFrame, kind: str, conflicting: DataFrame) -> DataFrame:
    """Observed error next to the floor set by rows with conflicting labels."""
    n_conf = conflicting.select("n_conflicting_rows").scalar()
    wrong = F.col(kind).isin("false_negative", "false_positive").cast("int")
    a = df.agg(F.avg(wrong).alias("observed_error_rate"), F.count(F.lit(1)).alias("n"))
    floor = n_conf / (2 * F.col("n"))
    return a.select("observed_error_rate", floor.alias("irreducible_floor"),
                    F.coalesce(F.try_divide(floor, F.col("observed_error_rate")), F.lit(0.0)).alias("share_irreducible"))


def rate_table(df: DataFrame, keys: Mapping[str, Column] | Sequence[str], y: str) -> DataFrame:
    """Positive rate and size per level."""
    cols = [c.alias(n) for n, c in keys.items()] if isinstance(keys, Mapping) else list(keys)
    return df.groupBy(*cols).agg(F.avg(y).alias("rate"), F.count(F.lit(1)).alias("n"))


def rate_pivot(df: DataFrame, row: str, column: str, levels: Sequence[str], y: str) -> DataFrame:
    """Positive rate and volume as a row x column table; empty cells are zero."""
    t = df.groupBy(row).pivot(column, list(levels)).agg(F.avg(y).alias("rate"), F.count(F.lit(1)).alias("n"))
    return t.fillna(0)
