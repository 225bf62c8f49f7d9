"""Calendar columns, holidays and cyclical encodings."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    first = dt.date(year, month, 1)
    day = first + dt.timedelta(days=(weekday - first.weekday()) % 7)
    return day + dt.timedelta(weeks=n - 1)


def _last_monday_of_may(year: int) -> dt.date:
    last = dt.date(year, 5, 31)
    return last - dt.timedelta(days=last.weekday())


def _observed(day: dt.date) -> dt.date:
    if day.weekday() == 5:
        return day - dt.timedelta(days=1)
    return day + dt.timedelta(days=1) if day.weekday() == 6 else day


def us_holidays(first: dt.date, last: dt.date) -> list[dt.date]:
    """US federal holidays on their observed days. Juneteenth counts from 2021."""
    out = set()
    for y in range(first.year - 1, last.year + 2):
        out |= {_observed(dt.date(y, 1, 1)), _nth(y, 1, 0, 3), _nth(y, 2, 0, 3),
                _last_monday_of_may(y), _observed(dt.date(y, 7, 4)), _nth(y, 9, 0, 1),
                _nth(y, 10, 0, 2), _observed(dt.date(y, 11, 11)), _nth(y, 11, 3, 4),
                _observed(dt.date(y, 12, 25))}
        if y < 1986:
            out.discard(_nth(y, 1, 0, 3))
        if y >= 2021:
            out.add(_observed(dt.date(y, 6, 19)))
    return sorted(d for d in out if first <= d <= last)


def date_dimension(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row per day."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date"))


def holiday_distance(day: Column, holidays: list[dt.date], limit: int = 30) -> Column:
    """Signed days to the nearest holiday, positive before it; ties look ahead.

    Distances of all days within ``limit`` of the list are worked out once and looked up by position.
    """
    days = sorted(holidays)
    if not days:
        return F.lit(None).cast("int")
    first, last = days[0] - dt.timedelta(days=limit), days[-1] + dt.timedelta(days=limit)
    known, near, k = [], [first + dt.timedelta(days=i) for i in range((last - first).days + 1)], 0
    for d in near:
        while k < len(days) and days[k] < d:
            k += 1
        ahead = (days[k] - d).days if k < len(days) else None
        behind = (d - days[k - 1]).days if k else None
        signed = ahead if ahead is not None and (behind is None or ahead <= behind) else -behind
        known.append(max(-limit, min(limit, signed)))
    table = F.split(F.lit(",".join(map(str, known))), ",").cast("array<int>")
    return (F.when(day < F.lit(first), F.lit(limit)).when(day > F.lit(last), F.lit(-limit))
            .otherwise(F.get(table, F.datediff(day, F.lit(first)))))


def cyclical(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def with_calendar(df: DataFrame, day: str, holidays: list[dt.date] | None = None) -> DataFrame:
    """Calendar features of a date column."""
    d = F.col(day)
    dow = F.weekday(d)
    out = df.withColumns({
        "dow": dow, "day_of_month": F.dayofmonth(d), "week_of_year": F.weekofyear(d),
        "month": F.month(d), "quarter": F.quarter(d), "year": F.year(d),
        "is_weekend": (dow >= 5).cast("int"), "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"),
    })
    if holidays:
        out = out.withColumns({
            "is_holiday": d.isin(holidays).cast("int"),
            "days_to_holiday": holiday_distance(d, holidays)})
    ds, dc = cyclical(dow, 7)
    ys, yc = cyclical(F.dayofyear(d), 365.25)
    return out.withColumns({"dow_sin": ds, "dow_cos": dc, "doy_sin": ys, "doy_cos": yc})
