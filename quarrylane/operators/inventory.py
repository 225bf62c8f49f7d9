"""Stock policy from forecast errors, replay over stored demand, and costs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylane.operators.features import normal_quantile
from quarrylane.operators.panel import DATE, DEMAND, SERIES
from quarrylane.plans.bounded import each_record
from quarrylane.plans.prefix import exact_quantiles

DAYS_PER_YEAR = 365.0


@dataclass(frozen=True)
class PolicyTerms:
    """Lead time, review period and service level; all are assumptions."""

    lead_time_days: int = 7
    review_period_days: int = 7
    service_level: float = 0.95

    @property
    def protection_days(self) -> int:
        return self.lead_time_days + self.review_period_days

    @property
    def z(self) -> float:
        return normal_quantile(self.service_level)


@dataclass(frozen=True)
class StockEconomics:
    """Declared cost assumptions; only the unit value comes from data."""

    gross_margin: float = 0.25
    holding_rate_annual: float = 0.25
    ordering_cost_per_order: float = 2.0
    stockout_penalty_multiplier: float = 2.0

    def holding_per_unit_day(self, value: Column) -> Column:
        return value * self.holding_rate_annual / DAYS_PER_YEAR

    def understock(self, value: Column, multiplier: Column | None = None) -> Column:
        m = F.lit(self.stockout_penalty_multiplier) if multiplier is None else multiplier
        return value * self.gross_margin * m

    def overstock(self, value: Column, days: float) -> Column:
        return self.holding_per_unit_day(value) * float(days)

    def critical_ratio(self, value: Column, days: float) -> Column:
        cu, co = self.understock(value), self.overstock(value, days)
        return F.try_divide(cu, cu + co)


def lead_time_errors(pred: DataFrame, point: str, days: int) -> DataFrame:
    """Forecast error summed over the protection window, per series and origin."""
    g = pred.where(F.col("horizon") <= days).groupBy(SERIES, "origin").agg(
        F.sum("y_true").alias("lt_actual"), F.sum(point).alias("lt_forecast"), F.count("y_true").alias("n_days"))
    return g.withColumn("lt_error", F.col("lt_actual") - F.col("lt_forecast"))


def error_spread(errors: DataFrame) -> DataFrame:
    """Spread of lead-time error per series; a missing deviation takes the median one.

    A series has one window per origin, so the grouped quantiles are bounded.
    """
    q = F.percentile("lt_error", [0.5, 0.9, 0.95, 0.99])
    s = errors.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("lt_error").alias("error_mean"),
        F.stddev_samp("lt_error").alias("error_std"), q.alias("q"))
    median = exact_quantiles(s, "error_std", {"m": 0.5}).scalar()
    return s.select(SERIES, "n_windows", "error_mean", F.coalesce("error_std", median).alias("error_std"),
                    *[F.get("q", F.lit(i)).alias(f"error_q{n}") for i, n in enumerate((50, 90, 95, 99))])


def safety_normal(std: Column, z: Column | float) -> Column:
    """Stock against normal errors; NULL without a spread."""
    need = std * z
    return F.when(need.isNotNull(), F.greatest(F.lit(0.0), need))


def build_policy(pred: DataFrame, point: str, errors: DataFrame, terms: PolicyTerms,
                 levels: Sequence[float] | None = None) -> DataFrame:
    """Safety stock by both estimators and reorder points, per series and service level."""
    levels = list(levels or [terms.service_level])
    days = terms.protection_days
    latest = pred.agg(F.max("origin").alias("o")).scalar()
    expected = (pred.where((F.col("horizon") <= days) & (F.col("origin") == latest)).groupBy(SERIES)
                .agg(F.sum(point).alias("expected_lt_demand")))
    emp = errors.groupBy(SERIES).agg(F.percentile("lt_error", levels).alias("__emp"))
    grid = each_record([{"i": i, "service_level": float(s), "z": normal_quantile(s)} for i, s in enumerate(levels)])
    p = (error_spread(errors).join(expected, SERIES, "left").join(emp, SERIES, "left")
         .withColumn("g", grid).select("*", "g.service_level", "g.z", F.get("__emp", F.col("g.i")).alias("__e")).drop("g", "__emp"))
    p = p.withColumns({
        "lead_time_days": F.lit(terms.lead_time_days), "review_period_days": F.lit(terms.review_period_days),
        "protection_days": F.lit(days), "safety_stock_normal": safety_normal(F.col("error_std"), F.col("z"))})
    p = p.withColumn("safety_stock_empirical", F.when(F.col("__e").isNotNull(), F.greatest(F.lit(0.0), F.col("__e"))).otherwise(F.col("safety_stock_normal")))
    for kind in ("normal", "empirical"):
        need = F.coalesce("expected_lt_demand", F.lit(0.0)) + F.col(f"safety_stock_{kind}")
        p = p.withColumn(f"reorder_point_{kind}", F.ceil(F.round(need, 9)).cast("double"))
    return p.withColumn("ss_ratio_emp_over_normal",
                        F.try_divide("safety_stock_empirical", F.col("safety_stock_normal"))).drop("__e")


def order_quantity_eoq(annual_demand: Column, ordering_cost: float, holding: Column) -> Column:
    """Economic order quantity, at least one unit."""
    q = F.sqrt(F.try_divide(2.0 * annual_demand * ordering_cost, F.when(holding > 0, holding)))
    return F.greatest(F.lit(1.0), F.coalesce(q, F.lit(1.0)))


def baseline_policy(history: DataFrame, terms: PolicyTerms, as_of: dt.date, lookback: int = 90) -> DataFrame:
    """The policy to beat: stock sized by recent demand variability."""
    recent = history.where((F.col(DATE) <= F.lit(as_of)) & (F.col(DATE) > F.lit(as_of - dt.timedelta(days=lookback))))
    days = terms.protection_days
    g = recent.groupBy(SERIES).agg(F.coalesce(F.avg(DEMAND), F.lit(0.0)).alias("daily_mean"),
                                   F.coalesce(F.stddev_samp(DEMAND), F.lit(0.0)).alias("daily_std"))
    g = g.withColumns({
        "expected_lt_demand": F.col("daily_mean") * days,
        "safety_stock_normal": safety_normal(F.col("daily_std") * F.sqrt(F.lit(float(days))), terms.z),
        "service_level": F.lit(terms.service_level), "protection_days": F.lit(days)})
    return g.withColumn("reorder_point_normal", F.ceil(
        F.round(F.col("expected_lt_demand") + F.col("safety_stock_normal"), 9)).cast("double"))


def default_order_quantity(terms: PolicyTerms) -> Column:
    """Expected demand of one review period, at least one unit."""
    days = F.greatest(F.col("protection_days").cast("double"), F.lit(1.0))
    q = F.coalesce("expected_lt_demand", F.lit(1.0)) / days * terms.review_period_days
    return F.greatest(F.lit(1.0), F.round(q, 9))


def replay_column(demand: Column, reorder_point: Column, quantity: Column, lead: int, review: int) -> Column:
    """Fold a day-ordered demand array through a periodic-review policy with lost sales.

    ``due[k]`` is what arrives k + 1 days ahead. The array holds one entry per day of
    the evaluation window, so it stays short whatever the number of series.
    """
    zero = F.lit(0.0)
    none = F.lit(0).cast("long")
    start = F.struct(
        none.alias("t"), (reorder_point + quantity).cast("double").alias("on_hand"),
        F.array_repeat(zero, lead).alias("due"), zero.alias("units_short"), none.alias("stockout_days"),
        none.alias("cycles"), none.alias("bad_cycles"), F.lit(False).alias("cycle_short"),
        zero.alias("stock_sum"), zero.alias("max_inventory"), none.alias("orders"), zero.alias("total"))

    def day(s: Column, d: Column) -> Column:
        have = s["on_hand"] + F.get(s["due"], F.lit(0))
        left = F.greatest(have - d, zero)
        short = F.greatest(d - have, zero)
        due = F.concat(F.slice(s["due"], 2, lead), F.array(zero))
        position = left + F.aggregate(due, zero, lambda a, x: a + x)
        is_review = s["t"] % review == 0
        gap = reorder_point + quantity - position
        order = F.when(is_review & (position <= reorder_point),
                       F.ceil(gap / F.greatest(quantity, F.lit(1e-9))) * quantity).otherwise(zero)
        was_short = s["cycle_short"] | (short > 0)
        return F.struct(
            (s["t"] + 1).alias("t"), left.alias("on_hand"),
            F.concat(F.slice(due, 1, lead - 1), F.array(F.element_at(due, -1) + order)).alias("due"),
            (s["units_short"] + short).alias("units_short"),
            (s["stockout_days"] + (short > 0).cast("long")).alias("stockout_days"),
            (s["cycles"] + is_review.cast("long")).alias("cycles"),
            (s["bad_cycles"] + (is_review & was_short & (s["cycles"] >= 1)).cast("long")).alias("bad_cycles"),
            (was_short & ~is_review).alias("cycle_short"), (s["stock_sum"] + left).alias("stock_sum"),
            F.greatest(s["max_inventory"], left).alias("max_inventory"),
            (s["orders"] + (order > 0).cast("long")).alias("orders"), (s["total"] + d).alias("total"))

    return F.aggregate(demand, start, day)


def replay(panel: DataFrame, policy: DataFrame, start: dt.date, end: dt.date, terms: PolicyTerms,
           reorder: str = "reorder_point_normal", quantity: Column | None = None,
           keys: Sequence[str] = ()) -> DataFrame:
    """Outcome of running each series' policy over the stored demand of a window."""
    w = panel.where(F.col(DATE).between(F.lit(start), F.lit(end)))
    # At most one row per day of the window and series.
    arr = w.groupBy(SERIES).agg(F.array_sort(F.collect_list(F.struct(DATE, F.col(DEMAND).cast("double").alias("d")))).alias("x"))
    arr = arr.select(SERIES, F.transform("x", lambda v: v["d"]).alias("demand"))
    q = default_order_quantity(terms) if quantity is None else quantity
    p = policy.select(SERIES, *keys, F.col(reorder).alias("reorder_point"), q.alias("order_quantity"))
    r = replay_column(F.col("demand"), F.col("reorder_point"), F.col("order_quantity"),
                      terms.lead_time_days, terms.review_period_days)
    d = arr.join(p, SERIES).withColumn("r", r)
    bad = F.col("r.bad_cycles") + F.col("r.cycle_short").cast("long")
    return d.select(
        SERIES, *keys, "reorder_point", "order_quantity", F.col("r.t").alias("days"), F.col("r.total").alias("total_demand"),
        F.col("r.units_short").alias("units_short"),
        (1 - F.col("r.units_short") / F.greatest("r.total", F.lit(1e-9))).alias("fill_rate"),
        F.col("r.stockout_days").alias("stockout_days"),
        (1 - bad / F.greatest("r.cycles", F.lit(1))).alias("cycle_service_level"),
        (F.col("r.stock_sum") / F.col("r.t")).alias("avg_inventory"), F.col("r.max_inventory").alias("max_inventory"),
        F.col("r.on_hand").alias("ending_inventory"), F.col("r.orders").alias("orders_placed"))


def policy_summary(outcome: DataFrame, name: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Fill rate, service level, stockouts and stock of a replayed policy."""
    s = outcome.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("series"), F.sum("total_demand").alias("total_demand"),
        F.sum("units_short").alias("units_short"),
        (1 - F.sum("units_short") / F.greatest(F.sum("total_demand"), F.lit(1e-9))).alias("fill_rate"),
        F.avg("cycle_service_level").alias("cycle_service_level"),
        (F.sum("stockout_days") / F.greatest(F.sum("days"), F.lit(1))).alias("stockout_day_rate"),
        F.sum("avg_inventory").alias("avg_inventory_units"), F.sum("orders_placed").alias("orders_placed"),
        F.count_if(F.col("units_short") > 0).alias("series_with_stockout"))
    return s if name is None else s.select(F.lit(name).alias("policy"), "*")


def watch_list(outcome: DataFrame, n: int = 20) -> DataFrame:
    """Series that ran short by most units."""
    d = outcome.withColumn("shortfall_share", F.try_divide("units_short", F.col("total_demand")))
    return d.orderBy(F.desc("units_short"), SERIES).limit(n)


def coverage_days(outcome: DataFrame) -> DataFrame:
    daily = F.try_divide("total_demand", F.col("days"))
    return outcome.select(SERIES, daily.alias("daily_demand"), "avg_inventory",
                          F.try_divide(F.col("avg_inventory"), daily).alias("coverage_days"))


def unit_values(panel: DataFrame, as_of: dt.date) -> DataFrame:
    """Mean selling price per series up to a day."""
    return panel.where(F.col(DATE) <= F.lit(as_of)).groupBy(SERIES).agg(F.avg("sell_price").alias("unit_value"))


def costed(outcome: DataFrame, values: DataFrame, econ: StockEconomics, days: int,
           multiplier: Column | None = None) -> DataFrame:
    """Holding, stockout and ordering cost per series; a missing value takes the median."""
    median = exact_quantiles(values, "unit_value", {"m": 0.5}).scalar()
    d = outcome.join(values, SERIES, "left").withColumn("unit_value", F.coalesce("unit_value", median))
    v = F.col("unit_value")
    d = d.withColumns({
        "holding_cost": econ.holding_per_unit_day(v) * F.col("avg_inventory") * float(days),
        "stockout_cost": econ.understock(v, multiplier) * F.col("units_short"),
        "ordering_cost": F.lit(econ.ordering_cost_per_order) * F.col("orders_placed")})
    return d.withColumn("total_cost", F.col("holding_cost") + F.col("stockout_cost") + F.col("ordering_cost"))


def cost_summary(d: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    total = F.greatest(F.sum("total_demand"), F.lit(1e-9))
    return d.groupBy(*keys).agg(
        F.sum("holding_cost").alias("holding_cost"), F.sum("stockout_cost").alias("stockout_cost"),
        F.sum("ordering_cost").alias("ordering_cost"), F.sum("total_cost").alias("total_cost"),
        F.sum("units_short").alias("units_short"), (1 - F.sum("units_short") / total).alias("fill_rate"),
        F.sum("avg_inventory").alias("avg_inventory_units"), (F.sum("total_cost") / total).alias("cost_per_unit_demand"))


def scenarios(panel: DataFrame, policies: DataFrame, values: DataFrame, econ: StockEconomics, terms: PolicyTerms,
              start: dt.date, end: dt.date, kind: str = "normal",
              multipliers: Sequence[float] | None = None) -> DataFrame:
    """Every service level (and penalty) replayed and costed in one job.

    ``policies`` holds one row per series and service level. The replay does not
    depend on the penalty, so penalties multiply the replayed rows, not the replay.
    """
    days = (end - start).days + 1
    out = replay(panel, policies, start, end, terms, f"reorder_point_{kind}", keys=["service_level", "z"])
    keys = ["service_level", "z"]
    mult = None
    if multipliers is not None:
        out = out.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
        mult, keys = F.col("multiplier"), [*keys, "multiplier"]
    c = costed(out, values, econ, days, mult)
    s = cost_summary(c, keys).join(c.groupBy(*keys).agg(F.avg("cycle_service_level").alias("achieved_cycle_sl")), keys)
    stock = policies.groupBy("service_level").agg(
        F.avg(f"safety_stock_{kind}").alias("mean_safety_stock"), F.sum(f"safety_stock_{kind}").alias("total_safety_stock"))
    s = s.join(F.broadcast(stock), "service_level")
    w = Window.partitionBy(*(["multiplier"] if multipliers is not None else []))  # one row per level
    return s.withColumn("is_cost_minimum", F.col("total_cost") == F.min("total_cost").over(w))


def cost_optimal_levels(table: DataFrame) -> DataFrame:
    """Cheapest service level per penalty."""
    best = F.min_by(F.struct("service_level", "total_cost", "fill_rate", "avg_inventory_units"),
                    F.struct(F.round("total_cost", 6), "service_level"))
    return table.groupBy("multiplier").agg(best.alias("b")).select(
        F.col("multiplier").alias("stockout_penalty_multiplier"), F.col("b.service_level").alias("cost_optimal_service_level"),
        F.col("b.total_cost").alias("total_cost"), F.col("b.fill_rate").alias("achieved_fill_rate"),
        F.col("b.avg_inventory_units").alias("avg_inventory_units"))


def newsvendor(values: DataFrame, econ: StockEconomics, days: float) -> DataFrame:
    """Analytical optimal service level from unit costs."""
    v = F.col("unit_value")
    d = values.where(v.isNotNull()).select(econ.critical_ratio(v, days).alias("cr"), econ.understock(v).alias("cu"),
                                           econ.overstock(v, days).alias("co"))
    median = exact_quantiles(d, "cr", {"m": 0.5}).scalar()
    return d.agg(F.avg("cr").alias("critical_ratio_mean"), F.avg("cu").alias("cu_mean"),
                 F.avg("co").alias("co_mean")).withColumn("critical_ratio_median", median)


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    from statistics import NormalDist
    n = NormalDist()
    return x.map(lambda v: None if pd.isna(v) else n.cdf(v))


def recommend(forecast: DataFrame, policy: DataFrame | None, terms: PolicyTerms) -> DataFrame:
    """Reorder point and stockout risk for every series at once.

    The stored safety stock is used; another service level rescales its deviation, and
    a series without a policy falls back on the spread of its interval.
    """
    z = terms.z
    lt = F.col("horizon") <= terms.protection_days
    spread = F.pow(F.greatest(F.col("q90") - F.col("forecast"), F.lit(0.0)), 2)
    d = forecast.where(lt).groupBy(SERIES).agg(
        F.sum("forecast").alias("expected_lt_demand"), F.sqrt(F.sum(spread)).alias("__fallback"))
    if policy is not None:
        p = policy.select(SERIES, "error_std", "safety_stock_empirical", F.col("service_level").alias("__sl"))
        stored = F.when(F.col("__sl") == terms.service_level, F.col("safety_stock_empirical")).otherwise(F.col("error_std") * z)
        d = d.join(p, SERIES, "left").withColumn("safety_stock", F.coalesce(stored, F.col("__fallback")))
    else:
        d = d.withColumn("safety_stock", F.col("__fallback"))
    rop = F.ceil(F.round(F.col("expected_lt_demand") + F.col("safety_stock"), 9)).cast("double")
    d = d.withColumn("reorder_point", rop)
    sigma = F.greatest(F.col("safety_stock") / F.greatest(F.lit(z), F.lit(1e-9)), F.lit(1e-9))
    d = d.withColumn("__x", (F.col("reorder_point") - F.col("expected_lt_demand")) / sigma)
    return d.select(SERIES, "expected_lt_demand", "safety_stock", "reorder_point",
                    (1 - normal_cdf("__x")).alias("stockout_risk"), F.lit(terms.service_level).alias("service_level"))
