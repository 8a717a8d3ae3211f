"""Calendar features of a date or timestamp column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default holiday calendar.
HOLIDAYS = ("2024-01-01", "2024-07-04", "2024-11-28", "2024-12-25")

# Names of the calendar features, in output order.
TIME_FEATURES = (
    "day_of_week", "day_of_month", "day_of_year", "week_of_year", "month", "quarter", "year",
    "is_weekend", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end",
    "days_until_holiday", "weeks_until_holiday",
)


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def days_to_nearest_holiday(d: Column, holidays: Sequence[str] = HOLIDAYS) -> Column:
    """Whole days (rounded down) between ``d`` and the nearest holiday, before or after it."""
    distances = [F.abs(F.timestamp_diff("DAY", F.lit(h).cast("timestamp"), d)) for h in holidays]
    nearest = distances[0] if len(distances) == 1 else F.least(*distances)
    return nearest.cast("int")


def time_feature_columns(date_col: str, holidays: Sequence[str] = HOLIDAYS) -> dict[str, Column]:
    d = F.col(date_col)
    month, day = F.month(d), F.dayofmonth(d)
    last_day = F.to_date(d) == F.last_day(d)
    distance = days_to_nearest_holiday(d, holidays)
    columns = [
        F.weekday(d),
        day,
        F.dayofyear(d),
        F.weekofyear(d),
        month,
        F.quarter(d),
        F.year(d),
        _flag(F.weekday(d) >= 5),
        _flag(day == 1),
        _flag(last_day),
        _flag((day == 1) & (month % 3 == 1)),
        _flag(last_day & (month % 3 == 0)),
        distance,
        F.floor(distance / 7).cast("int"),
    ]
    return dict(zip(TIME_FEATURES, columns, strict=True))


def add_time_features(df: DataFrame, date_col: str = "date", holidays: Sequence[str] = HOLIDAYS) -> DataFrame:
    """Calendar features; a frame without the date column is returned as it is."""
    if date_col not in df.columns:
        return df
    return df.withColumns(time_feature_columns(date_col, holidays))


def _cycle(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi) / F.lit(period)
    return F.sin(angle), F.cos(angle)


def add_seasonal_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Month and weekday as points on a circle."""
    if date_col not in df.columns:
        return df
    month_sin, month_cos = _cycle(F.month(date_col), 12)
    week_sin, week_cos = _cycle(F.weekday(date_col), 7)
    return df.withColumns({
        "month_sin": month_sin,
        "month_cos": month_cos,
        "day_of_week_sin": week_sin,
        "day_of_week_cos": week_cos,
    })


def parse_dates(df: DataFrame, columns: Sequence[str] = ("date", "timestamp", "created_at")) -> DataFrame:
    """Turn the string columns among ``columns`` into timestamps; unreadable text becomes null."""
    strings = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    present = {c: F.try_to_timestamp(F.col(c)) for c in columns if c in strings}
    return df.withColumns(present) if present else df

