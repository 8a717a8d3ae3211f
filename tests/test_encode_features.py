import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.operators.encode import (
    LabelCodes,
    OneHot,
    StandardScale,
    align_columns,
    categorical_columns,
    prepare_matrix,
)
from shelfcast.plans.features import FeatureConfig, FeatureModel, fit_features


def test_one_hot_has_a_column_per_sorted_category(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 4)], "c string, i int")
    fitted = OneHot.fit(df, ["c"])
    assert fitted.categories == {"c": ["a", "b", None]}
    rows = fitted.transform(df).orderBy("i").collect()
    assert rows[0].asDict() == {"i": 1, "c_a": 0.0, "c_b": 1.0, "c_None": 0.0}
    assert [sum(list(r)[1:]) for r in rows] == [1.0] * 4
    unseen = OneHot.from_json(fitted.to_json()).transform(spark.createDataFrame([("z", 1)], "c string, i int"))
    assert list(unseen.first()) == [1, 0.0, 0.0, 0.0]


def test_one_hot_refuses_wide_columns(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="20 categories"):
        OneHot.fit(df, ["c"], max_categories=10)


def test_categorical_columns_leave_out_keys_and_date(spark):
    df = spark.createDataFrame([("p", "2024-01-01", "x", 1.0)], "product_id string, date string, c string, q double")
    assert categorical_columns(df, ("product_id", "date")) == ["c"]


def test_scale_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5, None), (3.0, 5, None), (None, 5, None)], "a double, b int, c double")
    scaled = StandardScale.fit(df).transform(df).collect()
    assert [r.a for r in scaled] == [-1.0, 1.0, None]
    assert [r.b for r in scaled] == [0.0, 0.0, 0.0] and scaled[0].c is None
    again = StandardScale.from_json(StandardScale.fit(df).to_json())
    assert [r.a for r in again.transform(df).collect()] == [-1.0, 1.0, None]


def test_label_codes(spark):
    df = spark.createDataFrame([("pear", 1.0), ("apple", 2.0), (None, 3.0)], "c string, x double")
    codes = LabelCodes.fit(df, ["c"])
    assert {r.value: r.code for r in codes.table.collect()} == {"apple": 0, "pear": 1, "unknown": 2}
    new = spark.createDataFrame([("pear", "k", 1.0), ("fig", "k", 2.0), (None, "k", 3.0)], "c string, d string, x double")
    rows = codes.transform(new).orderBy("x").collect()
    assert [r.c for r in rows] == [1, 0, 2] and "d" not in rows[0].asDict()


def test_prepare_and_align(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), "s", True, 1.5, None)],
                               "date timestamp, c string, b boolean, x double, y int")
    matrix = prepare_matrix(df)
    assert matrix.first().asDict() == {"x": 1.5, "y": 0}
    assert align_columns(matrix, ["z", "x"]).first().asDict() == {"z": 0, "x": 1.5}


def sales(spark, n=60, **kinds):
    rng = random.Random(1)
    rows = [(datetime(2024, 1, 1) + timedelta(days=i % 30), "AB"[i // 30 % 2], float(rng.randint(1, 99)),
             rng.uniform(10, 100), f"store{i // 30 % 2}") for i in range(n)]
    return spark.createDataFrame(
        rows, "date timestamp, product_id string, quantity double, price double, store_id string")


CONFIG = FeatureConfig(lags=(1, 7), windows=(7, 14))


def test_chain_scales_everything_but_keys_and_seasons(spark):
    model, features = fit_features(sales(spark), CONFIG)
    names = features.columns
    assert {"quantity_lag_7", "price_roll_mean_14", "quantity_mean", "store_id_store0", "month_sin",
            "days_until_holiday", "quantity_change_pct"} <= set(names)
    assert "store_id" not in names and features.count() == 60
    row = features.agg(F.avg("quantity"), F.stddev_pop("quantity"), F.max("month_sin"), F.max("store_id_store0")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1)
    assert row[2] == pytest.approx(0.5) and row[3] == pytest.approx(1)
    again = FeatureModel.from_json(model.to_json())
    assert again == model
    a = {(r.product_id, r.date): r.quantity for r in features.collect()}
    b = {(r.product_id, r.date): r.quantity for r in again.transform(sales(spark)).collect()}
    assert a == pytest.approx(b)


def test_fit_is_reused_on_new_rows(spark):
    model, _ = fit_features(sales(spark), CONFIG)
    new = sales(spark, 30).withColumn("store_id", F.lit("elsewhere"))
    row = model.transform(new).select("store_id_store0", "store_id_store1").distinct().collect()
    mean, deviation = model.scale.moments["store_id_store0"]
    assert len(row) == 1 and row[0][0] == pytest.approx((0 - mean) / deviation)


def test_variants(spark):
    excluded = FeatureConfig(lags=(1,), windows=(7,), scale_exclude=("quantity",), categorical=())
    model, features = fit_features(sales(spark), excluded)
    assert "store_id" in features.columns and "quantity" not in model.scale.moments
    seasonal = FeatureConfig(lags=(1,), windows=(7,), seasonal_first=True)
    assert "day_of_week_sin" in fit_features(sales(spark), seasonal)[0].scale.moments
    past = FeatureConfig(lags=(1,), windows=(7,), as_of=True, scale=False)
    first = fit_features(sales(spark), past)[1].filter(F.dayofmonth("date") == 1).first()
    assert first.quantity_count == 0 and first.quantity_mean is None
    plain = FeatureConfig(lags=(1,), windows=(7,), time_features=False)
    assert "day_of_week" not in fit_features(sales(spark), plain)[1].columns


def test_string_dates_are_parsed_not_encoded(spark):
    text = sales(spark).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    _, features = fit_features(text, CONFIG)
    assert dict(features.dtypes)["date"] == "timestamp" and "month_sin" in features.columns
