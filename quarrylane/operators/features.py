"""Forecast features that never look past their origin, and the supervised frame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.functions.calendar import us_holidays, with_calendar
from quarrylane.operators.panel import DATE, DEMAND, SERIES
from quarrylane.plans.bounded import each

LAGS = (1, 7, 14, 28)
WINDOWS = (7, 14, 28)
CROSTON_ALPHA = 0.1
CROSTON_DAYS = 365
NEVER = 99


def at_origins(panel: DataFrame, origins: Sequence[dt.date], days: int | None = None) -> DataFrame:
    """Repeat each row for the origins that may see it, those at most ``days`` days later; the future is dropped here."""
    every = F.array(*[F.lit(o) for o in sorted(origins)])
    date = F.col(DATE)
    seen = F.filter(every, lambda o: (o >= date) if days is None else (o >= date) & (F.datediff(o, date) < days))
    d = panel.where(date <= F.lit(max(origins)))
    if days is not None:
        d = d.where(date > F.lit(min(origins) - dt.timedelta(days=days)))
    return d.withColumn("origin", F.explode(seen))


def history_totals(panel: DataFrame, origins: Sequence[dt.date]) -> DataFrame:
    """Level, spread, share of selling days and age of each series at each origin.

    Rows are summed between one origin and the next, and only these few sums are repeated for the later origins.
    """
    every = F.array(*[F.lit(o) for o in sorted(origins)])
    y = F.col(DEMAND).cast("double")
    first = F.array_min(F.filter(every, lambda o: o >= F.col(DATE)))
    part = panel.where(F.col(DATE) <= F.lit(max(origins))).groupBy(SERIES, first.alias("__from")).agg(
        F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"), F.count_if(y > 0).alias("pos"), F.min(DATE).alias("first"))
    each_origin = part.withColumn("origin", F.explode(F.filter(every, lambda o: o >= F.col("__from"))))
    t = each_origin.groupBy(SERIES, "origin").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "pos")], F.min("first").alias("first"))
    n, mean = F.col("n"), F.try_divide(F.col("s"), F.col("n"))
    spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * mean)) / (n - 1)))
    return t.select(SERIES, "origin", mean.alias("hist_mean"), spread.alias("hist_std"), F.try_divide(F.col("pos"), n).alias("hist_nonzero_rate"),
                    F.datediff("origin", "first").alias("series_age_days"))


def croston_level(sales: Column, window_start: Column, alpha: float = CROSTON_ALPHA) -> tuple[Column, Column]:
    """Smoothed size and interval over date-ordered (date, size) sales, updated on sales only.

    The list holds at most one entry per day of the lookback.
    """
    first = F.get(sales, F.lit(0))
    a = F.lit(alpha)
    start = F.struct(first["size"].alias("z"), (F.datediff(first["date"], window_start) + 1).cast("double").alias("p"),
                     first["date"].alias("d"))

    def step(s: Column, x: Column) -> Column:
        gap = F.datediff(x["date"], s["d"]).cast("double")
        return F.struct((a * x["size"] + (1 - a) * s["z"]).alias("z"), (a * gap + (1 - a) * s["p"]).alias("p"),
                        x["date"].alias("d"))

    later = F.slice(sales, F.lit(2), F.greatest(F.size(sales) - 1, F.lit(0)))
    end = F.aggregate(later, start, step)
    return end["z"], end["p"]


def croston_at_origins(panel: DataFrame, origins: Sequence[dt.date], first_date: dt.date) -> DataFrame:
    """Croston level per series and origin over the sales of the last ``CROSTON_DAYS`` days.

    A series' sales are gathered once (at most one a day) and cut to every origin's days in place, so no row moves per origin.
    """
    y = F.col(DEMAND).cast("double")
    inside = (F.col(DATE) <= F.lit(max(origins))) & (F.col(DATE) > F.lit(min(origins) - dt.timedelta(days=CROSTON_DAYS)))
    sales = panel.where((y > 0) & inside).groupBy(SERIES).agg(
        F.array_sort(F.collect_list(F.struct(F.col(DATE).alias("date"), y.alias("size")))).alias("__all"))

    def seen(o: Column) -> Column:
        held = F.filter("__all", lambda s: (s["date"] <= o) & (F.datediff(o, s["date"]) < CROSTON_DAYS))
        return F.struct(o.alias("origin"), held.alias("__sales"))

    d = sales.select(SERIES, F.inline(F.transform(F.array(*[F.lit(o) for o in sorted(origins)]), seen))).where(F.size("__sales") > 0)
    z, p = croston_level(F.col("__sales"), F.greatest(F.date_sub("origin", CROSTON_DAYS - 1), F.lit(first_date)))
    return d.select(SERIES, "origin", F.try_divide(z, p).alias("croston_at_origin"))


def origin_features(panel: DataFrame, origins: Sequence[dt.date], first_date: dt.date,
                    lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """One row per series and origin.

    Each pass reaches back as far as it looks: lags, windows and prices over the last 28 days (a row has one copy per origin
    within them), Croston over one list of sales per series, level and age from sums between origins.
    """
    reach = max(28, *lags, *windows)
    d = at_origins(panel.select(SERIES, DATE, DEMAND, "sell_price"), origins, reach)
    age = F.datediff("origin", DATE)  # 0 on the origin day
    y, price = F.col(DEMAND).cast("double"), F.col("sell_price").cast("double")
    aggs = [F.max(F.when(age == k - 1, y)).alias(f"lag_{k}") for k in lags]
    for w in windows:
        inside = F.when(age < w, y)
        aggs += [F.avg(inside).alias(f"rolling_mean_{w}"), F.stddev_samp(inside).alias(f"rolling_std_{w}"),
                 F.max(inside).alias(f"rolling_max_{w}"),
                 (F.count_if((age < w) & (y > 0)) / F.lit(float(w))).alias(f"nonzero_rate_{w}")]
    aggs += [
        F.min(F.when((age < 28) & (y > 0), age)).alias("__since"),
        F.avg(F.when((age < 28) & (y > 0), y)).alias("mean_nonzero_size_28"),
        F.avg(F.when(age < 28, price)).alias("price_mean_28_at_origin"),
        F.max(F.when(age == 0, price)).alias("price_at_origin"),
    ]
    # A series without a row in the last days has a rate of zero, as one whose days were all without sales.
    rates = [f"nonzero_rate_{w}" for w in windows]
    f = history_totals(panel, origins).join(d.groupBy(SERIES, "origin").agg(*aggs), [SERIES, "origin"], "left")
    f = f.join(croston_at_origins(panel, origins, first_date), [SERIES, "origin"], "left")
    f = f.withColumns({
        **{c: F.coalesce(c, F.lit(0.0)) for c in rates},
        "days_since_last_sale": F.coalesce("__since", F.lit(NEVER)),
        "trend_7_28": F.try_divide("rolling_mean_7", F.col("rolling_mean_28")),
        "croston_at_origin": F.coalesce("croston_at_origin", F.lit(0.0))})
    return f.withColumn("sba_at_origin", F.col("croston_at_origin") * (1 - CROSTON_ALPHA / 2)).drop("__since")


def rolling_for_all_days(panel: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Rolling statistics ending at every day of a series, for all origins at once.

    The window is by day distance, so a missing day is not skipped over.
    """
    day = F.datediff(F.col(DATE), F.lit(dt.date(1970, 1, 1)))
    d = panel.select(SERIES, DATE, DEMAND).withColumn("__day", day)
    cols = {}
    for w in windows:
        win = Window.partitionBy(SERIES).orderBy("__day").rangeBetween(-(w - 1), 0)
        cols |= {f"rolling_mean_{w}": F.avg(DEMAND).over(win), f"rolling_max_{w}": F.max(DEMAND).over(win),
                 f"nonzero_rate_{w}": F.count_if(F.col(DEMAND) > 0).over(win) / F.lit(float(w))}
    for k in LAGS:
        win = Window.partitionBy(SERIES).orderBy("__day").rangeBetween(-(k - 1), -(k - 1))
        cols[f"lag_{k}"] = F.max(DEMAND).over(win)
    return d.withColumns(cols).drop("__day")


def seasonal_reference(target: Column, horizon: Column) -> Column:
    """Same weekday, stepped back in whole weeks to the origin or before."""
    weeks = F.ceil(horizon / F.lit(7.0)).cast("int")
    return F.date_sub(target, weeks * 7)


def lookup_day(df: DataFrame, panel: DataFrame, day: str, names: dict[str, str]) -> DataFrame:
    """Values of a series on a given day, NULL where the day is absent."""
    side = panel.select(SERIES, F.col(DATE).alias(day), *[F.col(c).alias(n) for c, n in names.items()])
    return df.join(side, [SERIES, day], "left")


def supervised(panel: DataFrame, origins: Sequence[dt.date], horizons: Sequence[int], first_date: dt.date,
               static: DataFrame | None = None, require_actuals: bool = True) -> DataFrame:
    """Rows (series, origin, horizon) with features, known exogenous values and the actual."""
    feats = origin_features(panel, origins, first_date)
    d = feats.withColumn("horizon", each([int(h) for h in horizons]))
    d = d.withColumn("target_date", F.date_add("origin", F.col("horizon")))
    d = d.withColumn("ref_date", seasonal_reference(F.col("target_date"), F.col("horizon")))
    reach = panel.where(F.col(DATE).between(
        F.lit(min(origins) - dt.timedelta(days=7)), F.lit(max(origins) + dt.timedelta(days=max(horizons)))))
    d = lookup_day(d, reach, "target_date", {DEMAND: "y_true", "sell_price": "sell_price", "snap": "snap"})
    d = lookup_day(d, reach, "ref_date", {DEMAND: "snaive_lag"})
    d = d.withColumns({
        "product_age_days": F.col("series_age_days") + F.col("horizon"),
        "discount_vs_28d": 1 - F.try_divide("sell_price", F.col("price_mean_28_at_origin")),
        "price_ratio_vs_origin": F.try_divide("sell_price", F.col("price_at_origin"))})
    first, last = min(origins), max(origins) + dt.timedelta(days=max(horizons))
    margin = dt.timedelta(days=400)
    d = with_calendar(d, "target_date", us_holidays(first - margin, last + margin))
    if static is not None:
        d = d.join(static, SERIES, "left")
    return d.where(F.col("y_true").isNotNull()) if require_actuals else d


# Baseline forecasts and the column each one repeats.
BASELINES = {"naive": "lag_1", "seasonal_naive": "snaive_lag", "moving_average_7": "rolling_mean_7",
             "moving_average_28": "rolling_mean_28", "croston": "croston_at_origin", "sba": "sba_at_origin",
             "zero": None}


def with_baselines(df: DataFrame) -> DataFrame:
    """The seven baseline forecasts, never negative, with their fallback chain."""
    zero = F.lit(0.0)
    return df.withColumns({
        name: zero if c is None else F.greatest(zero, F.coalesce(
            F.col(c).cast("double"), F.col("rolling_mean_7"), F.col("lag_1").cast("double"), zero))
        for name, c in BASELINES.items()})


def seasonal_scale(panel: DataFrame, origins: Sequence[dt.date], season: int = 7) -> DataFrame:
    """In-sample seasonal-naive error per series and origin; NULL where it is zero."""
    w = Window.partitionBy(SERIES).orderBy(DATE)
    diff = panel.select(SERIES, DATE, F.abs(F.col(DEMAND) - F.lag(DEMAND, season).over(w)).alias(DEMAND))
    scale = history_totals(diff, origins).select(SERIES, "origin", F.col("hist_mean").alias("mase_scale"))
    return scale.withColumn("mase_scale", F.when(F.col("mase_scale") != 0, F.col("mase_scale")))


def monotone_quantiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sort crossing quantile forecasts within each row."""
    s = F.array_sort(F.array(*[F.col(c) for c in columns]))
    return df.withColumn("__q", s).withColumns(
        {c: F.get("__q", F.lit(i)) for i, c in enumerate(columns)}).drop("__q")


def weekly_strength(panel: DataFrame) -> DataFrame:
    """Share of a series' variance explained by its weekday means; 0 for a flat series."""
    by_day = panel.groupBy(SERIES, F.weekday(DATE).alias("dow")).agg(
        F.count(DEMAND).alias("n"), F.sum(DEMAND).alias("s"), F.sum(F.col(DEMAND) * F.col(DEMAND)).alias("ss"))
    m = F.col("s") / F.col("n")
    a = by_day.groupBy(SERIES).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
                                   F.sum(F.col("n") * m * m).alias("between"))
    mean_sq = F.pow(F.col("s") / F.col("n"), 2)
    var = F.col("ss") / F.col("n") - mean_sq
    strength = (F.col("between") / F.col("n") - mean_sq) / var
    return a.select(SERIES, F.when(F.sqrt(F.greatest(var, F.lit(0.0))) < 1e-9, 0.0).otherwise(strength).alias("weekly_strength"))


def normal_quantile(p: float) -> float:
    from statistics import NormalDist
    if not 0.0 < p < 1.0:
        raise ValueError("probability must be strictly between 0 and 1")
    return NormalDist().inv_cdf(p)


