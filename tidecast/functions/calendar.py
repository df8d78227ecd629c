"""Calendar features of a date column (``ds`` unless named otherwise)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import by_day, week_of_month

# Fixed values: (first month, first day, last month, last day), both ends included.
SPECIAL_PERIODS = {
    "is_golden_week": (4, 29, 5, 5),
    "is_obon": (8, 10, 8, 16),
    "is_year_end": (12, 28, 1, 3),
}

CALENDAR = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "quarter": F.quarter,
    "day_of_year": F.dayofyear,
    "weekday": F.weekday,
    "week_of_year": F.weekofyear,
    "week_of_month": week_of_month,
}


def flag(c: Column) -> Column:
    return c.cast("int")


def calendar(df: DataFrame, day: str = "ds", parts: Sequence[str] = tuple(CALENDAR)) -> DataFrame:
    """Add calendar parts; ``weekday`` counts from Monday = 0."""
    return df.withColumns({p: CALENDAR[p](F.col(day)) for p in parts})


def cyclic(df: DataFrame, periods: Mapping[str, int]) -> DataFrame:
    """Sine and cosine of a calendar part, e.g. ``{"month": 12, "weekday": 7}``."""
    out = {}
    for c, period in periods.items():
        angle = F.col(c) * F.lit(2.0) * F.pi() / F.lit(float(period))
        out[f"{c}_sin"], out[f"{c}_cos"] = F.sin(angle), F.cos(angle)
    return df.withColumns(out)


def edge_flags(df: DataFrame, lo: int = 3, hi: int = 28) -> DataFrame:
    return df.withColumns(
        {
            "is_month_start": flag(F.dayofmonth("ds") <= lo),
            "is_month_end": flag(F.dayofmonth("ds") >= hi),
        }
    )


def day_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "is_weekend": flag(F.weekday("ds") >= 5),
            "is_monday": flag(F.weekday("ds") == 0),
            "is_friday": flag(F.weekday("ds") == 4),
        }
    )


def quarter_flags(df: DataFrame) -> DataFrame:
    month, day = F.month("ds"), F.dayofmonth("ds")
    return df.withColumns(
        {
            "is_quarter_start": flag((month % 3 == 1) & (day <= 5)),
            "is_quarter_end": flag((month % 3 == 0) & (day >= 25)),
        }
    )


def holiday_flag(df: DataFrame, holidays: DataFrame | None) -> DataFrame:
    """1 on the days of a holiday table ``(ds, ...)``, else 0; without a table all 0.
    Catalyst broadcasts the table when its measured size allows."""
    if holidays is None:
        return df.withColumn("is_holiday", F.lit(0))
    days = holidays.select("ds").distinct().withColumn("_hit", F.lit(1))
    return (
        df.join(days, "ds", "left")
        .withColumn("is_holiday", F.coalesce("_hit", F.lit(0)))
        .drop("_hit")
    )


def special_periods(
    df: DataFrame, periods: Mapping[str, tuple[int, int, int, int]] = SPECIAL_PERIODS
) -> DataFrame:
    """Flags for yearly periods; one that ends before it starts runs over New Year."""
    today = F.month("ds") * 100 + F.dayofmonth("ds")
    out = {}
    for name, (m1, d1, m2, d2) in periods.items():
        start, end = m1 * 100 + d1, m2 * 100 + d2
        inside = (today >= start) & (today <= end) if start <= end else (today >= start) | (today <= end)
        out[name] = flag(inside)
    return df.withColumns(out)


def trend(df: DataFrame) -> DataFrame:
    """Position of the day in its series, from 0."""
    return df.withColumn("trend", F.row_number().over(by_day()) - 1)
