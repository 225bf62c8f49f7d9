"""From scores to contact decisions under stated economics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.functions import vocab
from quarrylane.operators.scoring import checked_score, risk_band
from quarrylane.plans.bounded import each_record, small_side
from quarrylane.plans.prefix import exact_quantiles, quantile_value


@dataclass(frozen=True)
class Economics:
    """Declared assumptions; nothing here is measured."""

    contact_cost: float = 5.0
    incentive_cost: float = 30.0
    success_rate: float = 0.30
    horizon_months: int = 12

    @property
    def cost(self) -> float:
        return self.contact_cost + self.incentive_cost

    def value(self, monthly: Column) -> Column:
        return monthly.cast("double") * self.horizon_months

    def breakeven(self, value: Column) -> Column:
        return F.lit(self.cost) / (F.lit(self.success_rate) * F.greatest(value, F.lit(1e-9)))


def grid_step(p: Column, steps: int) -> Column:
    """Index of the highest grid threshold that the score reaches."""
    width, p = 1.0 / steps, checked_score(p)
    b = F.floor(p * steps)
    b = F.when((b + 1) * width <= p, b + 1).when(b * width > p, b - 1).otherwise(b)
    return F.least(b, F.lit(steps)).cast("int")


def sweep_counts(df: DataFrame, p: str, y: str, value: str, steps: int = 100) -> DataFrame:
    """Contacts, positives and their value at or above every grid threshold.

    Rows are reduced to one row per grid step first, so the cumulative part runs
    over ``steps + 1`` rows whatever the size of the population.
    """
    d = df.groupBy(grid_step(F.col(p), steps).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"),
        F.sum(F.when(F.col(y) == 1, F.col(value)).otherwise(0.0)).alias("v"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    full = grid.join(F.broadcast(d), "step", "left").fillna(0)
    w = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    return full.select(
        (F.col("step") / steps).alias("threshold"), F.sum("n").over(w).alias("contacted"),
        F.sum("pos").over(w).alias("true_positives"), F.sum("v").over(w).alias("saved_base"),
        F.sum("n").over(every).alias("population"), F.sum("pos").over(every).alias("positives"))


def net_value_curve(counts: DataFrame, success: Column, cost: Column) -> DataFrame:
    """Rates and net value along the threshold grid."""
    n, tp = F.col("contacted"), F.col("true_positives")
    return counts.withColumns({
        "contact_rate": n / F.col("population"), "false_positives": n - tp,
        "precision": F.coalesce(F.try_divide(tp, n), F.lit(0.0)),
        "recall": tp / F.greatest("positives", F.lit(1)),
        "net_value": F.col("saved_base") * success - n * cost})


def sweep(df: DataFrame, p: str, y: str, value: str, econ: Economics, steps: int = 100) -> DataFrame:
    c = net_value_curve(sweep_counts(df, p, y, value, steps), F.lit(econ.success_rate), F.lit(econ.cost))
    return c.select("threshold", "contacted", "contact_rate", "true_positives", "false_positives",
                    "precision", "recall", "net_value")


def _best(*fields: str) -> Column:
    """The row with the highest net value; the lowest threshold wins a tie."""
    return F.max_by(F.struct(*fields), F.struct(F.round("net_value", 6), -F.col("threshold")))


def compare_policies(df: DataFrame, p: str, y: str, value: str, econ: Economics) -> DataFrame:
    """Best global threshold, contact-all and the per-customer rule."""
    curve = sweep(df, p, y, value, econ)
    best = curve.agg(_best("threshold", "net_value").alias("b"),
                     F.max(F.when(F.col("threshold") == 0, F.col("net_value"))).alias("contact_all"))
    go = F.col(p) > econ.breakeven(F.col(value))
    own = df.agg(
        F.sum(F.when(go, F.when(F.col(y) == 1, F.col(value) * econ.success_rate).otherwise(0.0) - econ.cost)
              .otherwise(0.0)).alias("per_customer_value"),
        F.count_if(go).alias("per_customer_contacts"))
    return best.select(
        F.col("b.threshold").alias("best_threshold"), F.col("b.net_value").alias("best_net_value"),
        "contact_all", (F.col("b.net_value") - F.col("contact_all")).alias("uplift"),
        own.select("per_customer_value").scalar().alias("per_customer_value"),
        own.select("per_customer_contacts").scalar().alias("per_customer_contacts"))


def sensitivity(df: DataFrame, p: str, y: str, value: str, econ: Economics,
                success_rates: Sequence[float], incentives: Sequence[float]) -> DataFrame:
    """Best threshold per assumed success rate and incentive.

    The population is reduced once to the threshold grid; the per-customer rule of
    every assumption pair is summed in one further pass.
    """
    pairs = [(float(s), float(i)) for s in success_rates for i in incentives]
    grid = sweep_counts(df, p, y, value).withColumn(
        "g", each_record([{"success_rate": s, "incentive_cost": i} for s, i in pairs])).select("*", "g.*")
    cost = F.col("incentive_cost") + F.lit(econ.contact_cost)
    curve = net_value_curve(grid, F.col("success_rate"), cost)
    best = curve.groupBy("success_rate", "incentive_cost").agg(
        _best("threshold", "net_value", "contact_rate", "precision", "recall").alias("b"))
    sums = []
    for k, (s, i) in enumerate(pairs):
        c = econ.contact_cost + i
        go = F.col(p) > F.lit(c) / (F.lit(s) * F.greatest(F.col(value), F.lit(1e-9)))
        gain = F.when(F.col(y) == 1, F.col(value) * s).otherwise(0.0) - c
        sums.append(F.sum(F.when(go, gain).otherwise(0.0)).alias(f"v{k}"))
    rule = df.agg(*sums).select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("success_rate"), F.lit(i).alias("incentive_cost"),
                 F.col(f"v{k}").alias("per_customer_value")) for k, (s, i) in enumerate(pairs)])).alias("x")).select("x.*")
    return best.select("success_rate", "incentive_cost", "b.*").join(
        F.broadcast(rule), ["success_rate", "incentive_cost"]).withColumnRenamed("threshold", "best_threshold")


def decide(df: DataFrame, p: str, monthly: str, econ: Economics, high_value_q: float = 0.70,
           value_cut: float | None = None, actions: DataFrame | None = None) -> DataFrame:
    """Decision table: band, value tier, expected value, working order and channel per customer.

    ``actions`` (``risk_segment``, ``value_tier``, ``recommended_action``) says what to do in each cell; a cell it does not name has NULL.
    """
    d = df.withColumn("customer_value", econ.value(F.col(monthly)))
    cut = quantile_value(d, "customer_value", high_value_q) if value_cut is None else value_cut
    expected = F.col(p) * econ.success_rate * F.col("customer_value") - econ.cost
    d = d.withColumns({
        "risk_segment": risk_band(F.col(p)),
        "value_tier": F.when(F.col("customer_value") >= F.lit(cut), "High value").otherwise("Standard value"),
        "breakeven_probability": econ.breakeven(F.col("customer_value")), "expected_value": expected,
        "contact_recommended": expected > 0})
    action = F.map_from_entries(F.array(*[
        F.struct(F.lit(f"{b}|{t}"), F.struct(F.lit(n).alias("priority"), F.lit(c).alias("channel")))
        for (b, t), (n, c) in vocab.CONTACT_ORDER.items()]))
    d = d.withColumn("__a", F.element_at(action, F.concat_ws("|", "risk_segment", "value_tier")))
    d = d.select("*", "__a.*", (F.col("contact_recommended") & F.col("risk_segment").isin(
        "Low Risk", "Medium Risk")).alias("ev_overrides_segment")).drop("__a")
    if actions is None:
        return d
    cells = actions.groupBy("risk_segment", "value_tier").agg(F.min("recommended_action").alias("recommended_action"))
    return d.join(small_side(cells), ["risk_segment", "value_tier"], "left")


def campaign(decisions: DataFrame, p: str) -> DataFrame:
    """Plan per band and tier; only positive expected values are summed."""
    ev = F.col("expected_value")
    return (decisions.groupBy("risk_segment", "value_tier").agg(
        F.count(F.lit(1)).alias("customers"), F.avg(p).alias("avg_risk"),
        F.avg("customer_value").alias("avg_value"), F.count_if("contact_recommended").alias("contacts"),
        F.sum(F.when(ev > 0, ev).otherwise(0.0)).alias("expected_value"), F.max("priority").alias("priority"))
        .orderBy("priority"))


def band_representatives(df: DataFrame, p: str, ident: str) -> DataFrame:
    """Per band, the row closest to the band's exact median score."""
    d = df.select(ident, F.col(p).alias("p"), risk_band(F.col(p)).alias("risk_segment"))
    med = exact_quantiles(d, "p", {"median_score": 0.5}, ["risk_segment"])
    near = F.struct(F.round(F.abs(F.col("p") - F.col("median_score")), 12), F.col(ident))
    return d.join(F.broadcast(med), "risk_segment").groupBy("risk_segment", "median_score").agg(
        F.min_by(F.struct(ident, "p"), near).alias("r")).select(
        "risk_segment", "median_score", F.col(f"r.{ident}").alias(ident), F.col("r.p").alias("score"))

