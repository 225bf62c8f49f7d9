"""Demand panel: one row per series and day, its audits, classes and summaries.

A series has one row per day, so every window over a series is bounded by the
calendar and never by the number of source rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.functions import vocab
from quarrylane.operators.audit import assert_unique
from quarrylane.plans.bounded import hash_order, small_side
from quarrylane.plans.prefix import exact_quantiles, running_totals
from quarrylane.session import checkpointed

SERIES, DATE, DEMAND = "series_id", "date", "demand"


def dense_panel(sales: DataFrame, fill: dict) -> DataFrame:
    """Every day of every series from its first row to the last day of the table."""
    last = sales.agg(F.max(DATE).alias("m")).scalar()
    span = sales.groupBy(SERIES).agg(F.min(DATE).alias("first"))
    days = span.select(SERIES, F.explode(F.sequence("first", last)).alias(DATE))
    return days.join(sales, [SERIES, DATE], "left").fillna(fill)


def with_static(panel: DataFrame, static: DataFrame, key: str = SERIES) -> DataFrame:
    """Attributes of a series; the key must be unique on the attribute side."""
    return panel.join(small_side(assert_unique(static, [key])), key, "left")


def with_temporal(panel: DataFrame, temporal: DataFrame) -> DataFrame:
    """Prices and flags per series and day; the pair must be unique."""
    return panel.join(assert_unique(temporal, [SERIES, DATE]), [SERIES, DATE], "left")


def flag_of_state(state: Column, flags: dict[str, Column]) -> Column:
    """Collapse one flag column per state to the series' own state."""
    out = None
    for s, c in flags.items():
        out = F.when(state == s, c) if out is None else out.when(state == s, c)
    return out


def build_panel(parts: Sequence[DataFrame], static: DataFrame, temporal: DataFrame,
                keep: DataFrame | None = None) -> DataFrame:
    """Stack target files, keep chosen series, add attributes, prices and flags."""
    target = parts[0]
    for p in parts[1:]:
        target = target.unionByName(p)
    if keep is not None:
        target = target.join(keep.select(SERIES), SERIES, "left_semi")
    return with_temporal(with_static(target, static), temporal)


def demand_stats(panel: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Intermittency and variability of each series."""
    d = F.col(DEMAND)
    sold = F.when(d > 0, d)
    s = panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"), F.count(sold).alias("n_nonzero"),
        F.sum(d).alias("total_demand"), F.avg(d).alias("mean_demand"),
        F.avg(sold).alias("nonzero_mean"), F.stddev_samp(sold).alias("nonzero_std"))
    return s.withColumns({
        "zero_share": 1 - F.col("n_nonzero") / F.col("n_periods"),
        "adi": F.try_divide(F.col("n_periods"), F.col("n_nonzero")),
        "cv2": F.pow(F.try_divide(F.col("nonzero_std"), F.col("nonzero_mean")), 2)})


def demand_class(adi: Column, cv2: Column) -> Column:
    frequent = F.coalesce(adi, F.lit(float("inf"))) < vocab.ADI_CUT
    steady = F.coalesce(cv2, F.lit(0.0)) < vocab.CV2_CUT
    return (F.when(frequent & steady, "Smooth").when(frequent, "Erratic")
            .when(steady, "Intermittent").otherwise("Lumpy"))


def cumulative_share(per_series: DataFrame, value: str, ident: str = SERIES) -> DataFrame:
    """Rank and cumulative share of a total, largest first, ties by identifier.

    Equal totals form one step of the running total; inside a step a second running
    total over the identifiers decides, so many equal totals are no hot spot.
    """
    per_series = checkpointed(per_series)
    steps = per_series.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    run = running_totals(steps, value, ["n", "s"], descending=True).select(
        value, (F.col("cum_n") - F.col("n")).alias("__n0"), (F.col("cum_s") - F.col("s")).alias("__s0"))
    local = running_totals(per_series.withColumn("__1", F.lit(1).cast("long")), ident, ["__1"], [value])
    local = local.withColumnRenamed("cum___1", "__i").drop("__1")
    total = per_series.agg(F.sum(value).alias("t")).scalar()
    return local.join(run, value).withColumns({
        "rank": F.col("__n0") + F.col("__i"),
        "cum_share": (F.col("__s0") + F.col("__i") * F.col(value)) / F.greatest(total, F.lit(1e-9)),
    }).drop("__i", "__n0", "__s0")


def segments(panel: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Demand class and volume class per series, from history only."""
    hist = panel if as_of is None else panel.where(F.col(DATE) <= F.lit(as_of))
    s = demand_stats(hist)
    s = s.withColumn("demand_class", demand_class(F.col("adi"), F.col("cv2")))
    s = cumulative_share(s, "total_demand")
    a, b = vocab.VOLUME_CUTS
    share = F.round("cum_share", 12)
    s = s.withColumn("volume_class", F.when(share <= a, "A").when(share <= b, "B").otherwise("C"))
    return s.withColumn("segment", F.concat_ws("-", "volume_class", "demand_class"))


def segment_summary(seg: DataFrame) -> DataFrame:
    """Size and character of each demand class."""
    a = seg.groupBy("demand_class").agg(
        F.count(F.lit(1)).alias("series"), F.sum("total_demand").alias("total_demand"),
        F.avg("mean_demand").alias("mean_daily_demand"), F.avg("zero_share").alias("mean_zero_share"))
    adi = exact_quantiles(seg, "adi", {"median_adi": 0.5}, ["demand_class"])
    cv2 = exact_quantiles(seg, "cv2", {"median_cv2": 0.5}, ["demand_class"])
    a = a.join(adi, "demand_class", "left").join(cv2, "demand_class", "left")
    every = Window.partitionBy()  # at most four rows
    return a.withColumns({
        "demand_share": F.col("total_demand") / F.sum("total_demand").over(every),
        "series_share": F.col("series") / F.sum("series").over(every)})


def volume_matrix(seg: DataFrame) -> DataFrame:
    """Series counts, volume class by demand class."""
    classes = ["Erratic", "Intermittent", "Lumpy", "Smooth"]
    return seg.groupBy("volume_class").pivot("demand_class", classes).count().fillna(0, classes)


def select_series(panel: DataFrame, n_items: int, min_days: int, seed: int = 42) -> DataFrame:
    """Items sampled per category and demand class, kept in every store.

    A stratum gets its share of ``n_items``, at least one; inside a stratum the items
    with the lowest hash are taken.
    """
    keys = [SERIES, "sku_id", "store_id", "cat_id"]
    s = demand_stats(panel, keys).where(F.col("n_periods") >= min_days)
    s = s.withColumn("demand_class", demand_class(F.col("adi"), F.col("cv2")))
    stores = panel.agg(F.countDistinct("store_id").alias("n")).scalar()
    item = s.groupBy("sku_id", "cat_id").agg(
        F.countDistinct("store_id").alias("n_stores"), F.mode("demand_class", True).alias("demand_class"))
    item = item.where(F.col("n_stores") == stores)
    return proportional_sample(item, ["cat_id", "demand_class"], "sku_id", n_items, seed)


def proportional_sample(df: DataFrame, strata: Sequence[str], ident: str, n: int, seed: int = 42) -> DataFrame:
    """Seeded sample with each stratum's share of ``n``, at least one row each, at most ``n``."""
    size = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__size"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    alloc = F.greatest(F.bround(F.col("__size") / total * n, 0), F.lit(1))
    h = hash_order(F.col(ident), seed)
    w = Window.partitionBy(*strata).orderBy(h, ident)
    picked = (df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
              .join(small_side(size), list(strata)).where(F.col("__rn") <= alloc))
    return picked.drop("__rn", "__size").orderBy(ident).limit(n)


def equal_sample(df: DataFrame, stratum: str, ident: str, n: int, classes: int, seed: int = 42) -> DataFrame:
    """Seeded sample with the same number of rows from every class."""
    per = max(1, n // max(classes, 1))
    w = Window.partitionBy(stratum).orderBy(hash_order(F.col(ident), seed), ident)
    return (df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= per).drop("__rn")
            .orderBy(ident).limit(n))


def calendar_gaps(panel: DataFrame) -> DataFrame:
    """Series with missing days between their first and last day."""
    g = panel.groupBy(SERIES).agg(F.min(DATE).alias("first"), F.max(DATE).alias("last"),
                                  F.count(F.lit(1)).alias("n"))
    expected = F.datediff("last", "first") + 1
    return g.where(F.col("n") != expected).select(SERIES, "n", expected.alias("expected"))


def _sale_bounds(panel: DataFrame) -> DataFrame:
    sold = F.when(F.col(DEMAND) > 0, F.col(DATE))
    return panel.groupBy(SERIES).agg(F.min(sold).alias("first_sale"), F.max(sold).alias("last_sale"),
                                     F.min(DATE).alias("first_day"), F.max(DATE).alias("last_day"))


def duplicate_days(df: DataFrame) -> DataFrame:
    """Days of a series that have several rows, and how many rows are surplus; equal keys are counted, never collected."""
    n = df.groupBy(SERIES, DATE).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("repeated_days"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"))


def zero_taxonomy(panel: DataFrame) -> DataFrame:
    """Zeros before launch, after the last sale and in between."""
    d = panel.select(SERIES, DATE, DEMAND).join(_sale_bounds(panel), SERIES)
    zero = F.col(DEMAND) == 0
    pre = F.coalesce(zero & (F.col(DATE) < F.col("first_sale")), F.lit(False))
    post = F.coalesce(zero & (F.col(DATE) > F.col("last_sale")), F.lit(False))
    a = d.agg(F.count_if(zero).alias("n_zero"), F.avg(zero.cast("int")).alias("zero_share"),
              F.count_if(pre).alias("n_pre_launch"), F.count_if(post).alias("n_post_discontinuation"),
              F.count_if(zero & ~pre & ~post).alias("n_true_zero"))
    return a.withColumn("true_zero_share", F.col("n_true_zero") / F.greatest("n_zero", F.lit(1)))


def lifecycle(panel: DataFrame) -> DataFrame:
    """Late launches, discontinued series and length of history."""
    b = _sale_bounds(panel)
    first, last = (panel.agg(f(DATE).alias("d")).scalar() for f in (F.min, F.max))
    history = F.datediff("last_day", "first_day")
    h = b.select("*", history.alias("history"), first.alias("panel_first"), last.alias("panel_last"))
    median = exact_quantiles(h, "history", {"m": 0.5}).scalar()
    return h.agg(
        F.count(F.lit(1)).alias("n_series"),
        F.count_if(F.col("first_day") > F.col("panel_first")).alias("n_launched_late"),
        F.countDistinct("first_day").alias("n_distinct_starts"),
        F.count_if(F.datediff("panel_last", "last_sale") > vocab.DISCONTINUED_DAYS).alias("n_discontinued"),
        F.min("history").cast("double").alias("min_history_days"),
    ).withColumn("median_history_days", median)


def spikes(panel: DataFrame, multiple: float = vocab.SPIKE_MULTIPLE) -> DataFrame:
    """Days far above the median of the series' selling days."""
    med = panel.where(F.col(DEMAND) > 0).groupBy(SERIES).agg(F.percentile(DEMAND, 0.5).alias("med"))
    d = panel.select(SERIES, DEMAND).join(med, SERIES).where(F.col(DEMAND) > F.lit(multiple) * F.nullif("med", F.lit(0.0)))
    return d.agg(F.count(F.lit(1)).alias("n_spike_days"), F.countDistinct(SERIES).alias("n_spike_series"))


def coverage(panel: DataFrame) -> DataFrame:
    """Series, items, stores and departments, and whether every item is in every store."""
    d = panel.select(SERIES, "sku_id", "store_id", "dept_id", "cat_id").distinct()
    a = d.agg(*[F.countDistinct(c).alias(n) for c, n in (
        (SERIES, "n_series"), ("sku_id", "n_skus"), ("store_id", "n_stores"), ("dept_id", "n_departments"),
        ("cat_id", "n_categories"))])
    return a.withColumn("complete_cross_product", F.col("n_series") == F.col("n_skus") * F.col("n_stores"))


def series_per(panel: DataFrame, key: str) -> DataFrame:
    return panel.groupBy(key).agg(F.countDistinct(SERIES).alias("n_series"))


def period_totals(panel: DataFrame, period: Column, name: str) -> DataFrame:
    """Total and mean demand per period."""
    return panel.groupBy(period.alias(name)).agg(F.sum(DEMAND).alias("total"), F.avg(DEMAND).alias("mean"))


def weekly_growth(panel: DataFrame, weeks: int = 8) -> DataFrame:
    """Mean of the last weeks over the first weeks, minus one."""
    week = F.date_trunc("week", DATE).cast("date").alias("week")
    t = panel.groupBy(week).agg(F.sum(DEMAND).alias("total"))
    head = t.orderBy("week").limit(weeks).agg(F.avg("total").alias("m")).scalar()
    tail = t.orderBy(F.desc("week")).limit(weeks).agg(F.avg("total").alias("m")).scalar()
    return t.agg(F.count(F.lit(1)).alias("n_weeks")).select("n_weeks", (tail / head - 1).alias("growth"))


def seasonality(panel: DataFrame) -> DataFrame:
    """Busiest weekday, weekday ratio and lift of flagged days."""
    by = panel.groupBy(F.weekday(DATE).alias("dow")).agg(F.avg(DEMAND).alias("m"))
    lift = panel.agg((F.avg(F.when(F.col("snap") == 1, F.col(DEMAND)))
                      / F.avg(F.when(F.col("snap") == 0, F.col(DEMAND))) - 1).alias("x")).scalar()
    return by.agg(F.max_by("dow", "m").alias("peak_dow"), (F.max("m") / F.min("m")).alias("dow_ratio")).withColumn(
        "snap_lift_pct", 100 * lift)


def pareto(panel: DataFrame) -> DataFrame:
    """Cumulative share of demand by ranked series."""
    per = panel.groupBy(SERIES).agg(F.sum(DEMAND).alias("total"))
    return cumulative_share(per, "total").select(SERIES, "total", "rank", "cum_share")


def head_series_share(curve: DataFrame, share: float = 0.2) -> DataFrame:
    """Share of demand held by the top part of the series."""
    n = curve.agg(F.count(F.lit(1)).alias("n")).scalar()
    return curve.where(F.col("rank") == F.floor(n * share) + 1).select(F.col("cum_share").alias("head_share"))


def price_bands(panel: DataFrame) -> DataFrame:
    """Mean demand on selling days by price relative to the series' median price."""
    d = panel.where(F.col(DEMAND) > 0)
    med = d.groupBy(SERIES).agg(F.percentile("sell_price", 0.5).alias("med"))
    rel = F.col("sell_price") / F.col("med")
    band = (F.when(rel <= 0, None).when(rel <= 0.85, "<-15%").when(rel <= 0.95, "-15..-5%")
            .when(rel <= 1.05, "±5%").when(rel <= 1.15, "+5..15%").when(rel <= 10, ">+15%"))
    return (d.join(med, SERIES).groupBy(band.alias("price_band")).agg(
        F.avg(DEMAND).alias("mean_demand"), F.count(F.lit(1)).alias("n")).where("price_band IS NOT NULL"))


def volatility(panel: DataFrame) -> DataFrame:
    """Mean, spread and share of selling days per series."""
    v = panel.groupBy(SERIES).agg(
        F.avg(DEMAND).alias("mean"), F.stddev_samp(DEMAND).alias("std"),
        F.avg((F.col(DEMAND) > 0).cast("int")).alias("selling_day_share"))
    return v.where("mean > 0").withColumn("cv", F.col("std") / F.col("mean"))


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Latest row per key, by a map-side aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def future_rows(panel: DataFrame, origin: dt.date, horizon: int) -> DataFrame:
    """Each series' last row carried over the horizon with unknown demand."""
    last = keep_last(panel, [SERIES], DATE)
    days = F.explode(F.sequence(F.lit(origin + dt.timedelta(days=1)), F.lit(origin + dt.timedelta(days=horizon))))
    typ = panel.schema[DEMAND].dataType
    return last.withColumn(DATE, days).withColumn(DEMAND, F.lit(None).cast(typ)).select(*panel.columns)


def with_future(panel: DataFrame, origin: dt.date, horizon: int) -> DataFrame:
    return panel.unionByName(future_rows(panel, origin, horizon))

