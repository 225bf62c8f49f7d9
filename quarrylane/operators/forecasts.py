"""Forecast accuracy, intervals and error attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.operators.features import BASELINES, weekly_strength
from quarrylane.operators.panel import DEMAND, SERIES
from quarrylane.operators.rankstats import correlation
from quarrylane.plans.bounded import small_side
from quarrylane.plans.hotkeys import join_counted
from quarrylane.plans.prefix import exact_quantiles, running_totals
from quarrylane.session import checkpointed

EPS = 1e-9
SCORES = ("mae", "rmse", "wape", "mase", "smape", "bias", "bias_pct", "zero_share_actual", "pred_zero_share")


def long_models(df: DataFrame, models: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per prediction and model."""
    m = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).cast("double").alias("f")) for n in models]))
    return df.select(*keep, m.alias("m")).select(*keep, "m.model", "m.f")


def score_columns(y: Column, f: Column, scale: Column | None) -> list[Column]:
    """The full metric set as aggregates; NULL where a denominator vanishes."""
    err = F.abs(y - f)
    half = (F.abs(y) + F.abs(f)) / 2
    total = F.sum(y)
    bias = F.avg(f - y)
    mase = F.avg(F.when(scale > EPS, err / scale)) if scale is not None else F.lit(None).cast("double")
    return [
        F.count(F.lit(1)).alias("n"), F.avg(err).alias("mae"), F.sqrt(F.avg(F.pow(y - f, 2))).alias("rmse"),
        F.when(F.sum(F.abs(y)) > EPS, F.sum(err) / F.sum(F.abs(y))).alias("wape"), mase.alias("mase"),
        (100 * F.avg(F.when(half < EPS, 0.0).otherwise(err / F.greatest(half, F.lit(EPS))))).alias("smape"),
        bias.alias("bias"), F.when(total > EPS, bias * F.count(F.lit(1)) / total).alias("bias_pct"),
        F.avg((y == 0).cast("int")).alias("zero_share_actual"), F.avg((f < 0.5).cast("int")).alias("pred_zero_share")]


def scores(df: DataFrame, models: Sequence[str], keys: Sequence[str] = (), actual: str = "y_true",
           scale: str | None = None) -> DataFrame:
    """Scores of every model per key; models are unpivoted, so one shuffle serves all."""
    keep = [*keys, actual, *([scale] if scale else [])]
    d = long_models(df, models, keep)
    return d.groupBy("model", *keys).agg(*score_columns(
        F.col(actual).cast("double"), F.col("f"), F.col(scale) if scale else None))


def skill(table: DataFrame, reference: str, metric: str = "wape") -> DataFrame:
    """Improvement over a reference model in percent."""
    ref = table.where(F.col("model") == reference).select(metric).scalar()
    return table.withColumn(f"skill_vs_{reference}_pct", 100 * (ref - F.col(metric)) / ref)


def fold_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and spread of each model's scores over the folds."""
    return per_fold.groupBy("model").agg(
        F.countDistinct("fold").alias("folds"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"),
        F.avg("wape").alias("wape"), F.stddev_samp("wape").alias("wape_std"), F.avg("mase").alias("mase"),
        F.avg("smape").alias("smape"), F.avg("bias").alias("bias")).orderBy("wape", "model")


def fold_pivot(per_fold: DataFrame, folds: Sequence[str], metric: str = "wape") -> DataFrame:
    return per_fold.groupBy("model").pivot("fold", list(folds)).agg(F.first(metric))


def best_per_segment(per_segment: DataFrame, key: str, metric: str = "wape") -> DataFrame:
    """Winner per segment and its margin over the best baseline."""
    order = F.struct(F.round(metric, 12), "model")
    base = F.col("model").isin(list(BASELINES))
    b = per_segment.where(F.col(metric).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct("model", metric, "n"), order).alias("b"),
        F.min_by(F.struct("model", metric), F.when(base, order)).alias("s"))
    gain = 100 * (F.col(f"s.{metric}") - F.col(f"b.{metric}")) / F.col(f"s.{metric}")
    return b.select(key, F.col("b.n").alias("n"), F.col("b.model").alias("best_model"),
                    F.col(f"b.{metric}").alias(f"best_{metric}"), F.col("s.model").alias("best_baseline"),
                    F.col(f"s.{metric}").alias(f"baseline_{metric}"), gain.alias("improvement_pct"))


def series_errors(df: DataFrame, model: str, actual: str = "y_true") -> DataFrame:
    y, f = F.col(actual).cast("double"), F.col(model).cast("double")
    return df.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("total_actual"), F.sum(f).alias("total_pred"),
        F.avg(F.abs(y - f)).alias("mae"), F.sqrt(F.avg(F.pow(y - f, 2))).alias("rmse"), F.avg(f - y).alias("bias"),
        F.try_divide(F.sum(F.abs(y - f)), F.sum(y)).alias("wape"))


def series_characteristics(history: DataFrame) -> DataFrame:
    """Level, spread, zeros, price and weekly rhythm of each series."""
    c = history.groupBy(SERIES).agg(
        F.avg(DEMAND).alias("mean_demand"), F.stddev_samp(DEMAND).alias("std_demand"),
        F.sum(DEMAND).alias("total_demand"), F.avg((F.col(DEMAND) == 0).cast("int")).alias("zero_share"),
        F.count(F.lit(1)).alias("history_days"), F.avg("sell_price").alias("price_mean"),
        F.try_divide(F.stddev_samp("sell_price"), F.avg("sell_price")).alias("price_cv"),
        F.avg("snap").alias("snap_share"))
    c = c.withColumn("cv_demand", F.try_divide("std_demand", F.col("mean_demand")))
    return c.join(weekly_strength(history), SERIES)


def attribution(errors: DataFrame, characteristics: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Error of each series next to its characteristics and segment."""
    out = errors.join(characteristics, SERIES, "left")
    return out if segments is None else out.join(segments, SERIES, "left")


def worst_series(att: DataFrame, n: int = 15, min_actual: float = 10.0) -> DataFrame:
    """Highest relative error among series with enough demand."""
    return att.where(F.col("total_actual") >= min_actual).orderBy(F.desc_nulls_last("wape"), SERIES).limit(n)


def average_rank(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Rows per (keys, value) with the average rank of tied values and their number ``n``."""
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    r = running_totals(c, value, ["n"], keys)
    return r.select(*keys, value, (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("avg_rank"), "n")


def error_drivers(att: DataFrame, columns: Sequence[str], target: str = "wape", min_rows: int = 10) -> DataFrame:
    """Spearman correlation of each characteristic with the error; NaN for one that is the same in all series."""
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("characteristic"), F.col(c).cast("double").alias("x")) for c in columns]))
    d = (att.where(F.col("total_actual") >= 10.0).select(F.col(target).alias("y"), x.alias("v"))
         .select("v.characteristic", "v.x", "y").where("x IS NOT NULL AND y IS NOT NULL"))
    d = checkpointed(d)  # the ranks join back on these very numbers
    j = d.select("characteristic", *[F.struct("characteristic", v).alias(f"k{v}") for v in "xy"])
    for v in "xy":
        # A value may be that of very many series.
        ranks = average_rank(d, v, ["characteristic"]).select(F.struct("characteristic", v).alias(f"k{v}"), F.col("avg_rank").alias(f"r{v}"), "n")
        j = join_counted(j, checkpointed(ranks), f"k{v}", "n")
    out = j.groupBy("characteristic").agg(correlation("rx", "ry").alias("spearman"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= min_rows)


def flagged_day_errors(df: DataFrame, model: str) -> DataFrame:
    """Accuracy on flagged days and on the others."""
    cond = F.when(F.col("snap") == 1, "snap_day").when(F.col("snap") == 0, "non_snap_day")
    d = df.withColumn("condition", cond).where("condition IS NOT NULL")
    mean = d.groupBy("condition").agg(F.avg("y_true").alias("mean_actual"))
    s = scores(d, [model], ["condition"]).select("condition", "n", "wape", "mae", "bias")
    return s.join(mean, "condition")


def residual_quantiles(df: DataFrame, point: str, keys: Sequence[str] = ("horizon",),
                       probs: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Quantiles of validation errors, per horizon."""
    d = df.select(*keys, (F.col("y_true") - F.col(point)).alias("err"))
    return exact_quantiles(d, "err", {f"resid_q{int(p * 100)}": p for p in probs}, list(keys))


def with_intervals(df: DataFrame, point: str, resid: DataFrame, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Point forecast plus residual quantiles, never negative; NULL where a horizon has no residuals."""
    names = [c for c in resid.columns if c.startswith("resid_q")]
    d = df.join(small_side(resid), list(keys), "left")
    bound = {c.replace("resid_", ""): F.col(point) + F.col(c) for c in names}
    # greatest() skips NULL, so the guard comes first.
    return d.withColumns({n: F.when(b.isNotNull(), F.greatest(F.lit(0.0), b)) for n, b in bound.items()}).drop(*names)


def interval_report(df: DataFrame, quantiles: dict[float, str], keys: Sequence[str] = ()) -> DataFrame:
    """Coverage, width, pinball loss and exceedance of interval forecasts."""
    lo, hi = quantiles[min(quantiles)], quantiles[max(quantiles)]
    nominal = max(quantiles) - min(quantiles)
    y = F.col("y_true").cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.lit(nominal).alias("nominal_coverage"),
            F.avg(y.between(F.col(lo), F.col(hi)).cast("int")).alias("empirical_coverage"),
            F.avg(F.col(hi) - F.col(lo)).alias("mean_interval_width")]
    for q, c in quantiles.items():
        e = y - F.col(c)
        aggs += [F.avg(F.greatest(F.lit(q) * e, F.lit(q - 1) * e)).alias(f"pinball_q{int(q * 100)}"),
                 F.avg((y > F.col(c)).cast("int")).alias(f"exceedance_above_q{int(q * 100)}")]
    a = df.groupBy(*keys).agg(*aggs).withColumn("coverage_gap", F.col("empirical_coverage") - F.col("nominal_coverage"))
    width = exact_quantiles(df.select(*keys, (F.col(hi) - F.col(lo)).alias("w")), "w", {"median_interval_width": 0.5}, keys)
    if keys:
        return a.join(width, list(keys))
    return a.withColumn("median_interval_width", width.scalar())


def lead_time_distribution(df: DataFrame, lo: str, hi: str, point: str, lead_time: int) -> DataFrame:
    """Demand over the lead time; daily half widths are combined in quadrature."""
    half = (F.col(hi) - F.col(lo)) / 2
    g = df.where(F.col("horizon") <= lead_time).groupBy(SERIES).agg(
        F.sum(point).alias("lt_demand_point"), F.sum("y_true").alias("lt_demand_actual"),
        F.sqrt(F.sum(F.pow(half, 2))).alias("lt_half_width"), F.count(F.lit(1)).alias("n_days"))
    return g.withColumn("lt_sigma_implied", F.col("lt_half_width") / 1.2816)


def stack_folds(parts: dict[str, DataFrame]) -> DataFrame:
    """Predictions of every fold, tagged with its name."""
    out = None
    for name, d in parts.items():
        tagged = d.select(F.lit(name).alias("fold"), "*")
        out = tagged if out is None else out.unionByName(tagged)
    return out


def paired_folds(per_fold: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """Paired comparison of two models over the same folds: difference and t statistic."""
    d = per_fold.groupBy("fold").agg(F.max(F.when(F.col("model") == a, F.col(metric))).alias("x"),
                                     F.max(F.when(F.col("model") == b, F.col(metric))).alias("y"))
    both = F.col("sxy") / (2 * F.col("folds")) - F.pow((F.col("mean_a") + F.col("mean_b")) / 2, 2)
    s = d.agg(F.count(F.lit(1)).alias("folds"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"),
              F.stddev_samp(F.col("x") - F.col("y")).alias("sd"), F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("sxy"))
    diff = F.col("mean_a") - F.col("mean_b")
    return s.select(
        "folds", "mean_a", "mean_b", diff.alias("difference"),
        F.coalesce(F.try_divide(diff, F.sqrt(F.greatest(both, F.lit(0.0)))), F.lit(0.0)).alias("difference_in_sd"),
        F.when(F.col("sd") < 1e-12, None).otherwise(diff / (F.col("sd") / F.sqrt("folds"))).alias("t_statistic"))


