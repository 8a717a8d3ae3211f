from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfcast.functions.calendar import add_seasonal_features, add_time_features, parse_dates
from shelfcast.functions.numeric import add_interactions, nan_to_null


def one(spark, text):
    df = spark.createDataFrame([(text,)], "date string").select(F.col("date").cast("timestamp").alias("date"))
    return add_seasonal_features(add_time_features(df)).first()


def test_calendar_of_a_new_years_sunday(spark):
    r = one(spark, "2023-01-01")
    assert (r.day_of_week, r.day_of_month, r.day_of_year, r.week_of_year) == (6, 1, 1, 52)
    assert (r.month, r.quarter, r.year, r.is_weekend) == (1, 1, 2023, 1)
    assert (r.is_month_start, r.is_quarter_start, r.is_month_end, r.is_quarter_end) == (1, 1, 0, 0)
    assert (r.days_until_holiday, r.weeks_until_holiday) == (365, 52)


def test_calendar_of_a_quarter_end(spark):
    r = one(spark, "2024-06-30 23:00:00")
    assert (r.is_month_end, r.is_quarter_end, r.is_month_start) == (1, 1, 0)
    assert r.month_sin == pytest.approx(0, abs=1e-12) and r.month_cos == pytest.approx(-1)


@pytest.mark.parametrize("text,days", [
    ("2024-01-01", 0), ("2024-01-01 18:00:00", 0), ("2024-01-02 18:00:00", 1), ("2023-12-31 06:00:00", 0),
    ("2024-12-10", 12), ("2024-12-24 23:59:59", 0), ("2024-12-26 00:00:00", 1),
])
def test_holiday_distance_is_whole_days_either_way(spark, text, days):
    assert one(spark, text).days_until_holiday == days


def test_frames_without_date_stay_as_they_are(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert add_time_features(df).columns == ["x"] and add_seasonal_features(df).columns == ["x"]


def test_null_date_gives_null_features(spark):
    r = add_time_features(spark.createDataFrame([(None,)], "date timestamp")).first()
    assert r.day_of_week is None and r.days_until_holiday is None


def test_parse_dates_nulls_unreadable_text(spark):
    df = spark.createDataFrame([("2024-05-06", "x"), ("soon", "y")], "date string, note string")
    rows = parse_dates(df).collect()
    assert [r.date for r in rows] == [datetime(2024, 5, 6), None] and rows[0].note == "x"


def test_interactions(spark):
    df = spark.createDataFrame([(4.0, 2.0, 1.0), (0.0, 3.0, None), (5.0, 1.0, -1.0)],
                               "quantity double, price double, quantity_lag_1 double")
    a, b, c = add_interactions(df).collect()
    assert a.revenue == 8.0 and a.log_revenue == pytest.approx(2.1972245773)
    assert (a.quantity_change, a.quantity_change_pct) == (3.0, 150.0)
    assert b.log_quantity == 0.0 and b.quantity_change is None
    assert c.quantity_change == 6.0 and c.quantity_change_pct is None  # divided by zero


def test_interactions_need_price(spark):
    assert add_interactions(spark.createDataFrame([(1.0,)], "quantity double")).columns == ["quantity"]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "a double, b int")
    assert [r.a for r in nan_to_null(df).collect()] == [None, 2.0]
