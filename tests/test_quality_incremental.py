from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import incremental, quality
from shelfcast.plans.queries import QUERIES
from shelfcast.sources.sinks import append_results, newest_results


def sales(spark, values=(100, 200, 150), columns="product_id int, sales int, date string"):
    return spark.createDataFrame([(i, v, "2024-01-01") for i, v in enumerate(values)], columns)


def test_valid_sales(spark):
    result = quality.validate_sales(sales(spark))
    assert result.is_valid and result.errors == [] and result.metadata == {"row_count": "3"}


@pytest.mark.parametrize("column", ["product_id", "sales", "date"])
def test_missing_column(spark, column):
    result = quality.validate_sales(sales(spark).drop(column))
    assert not result.is_valid and result.errors[0] == f"Missing required column: {column}"


@pytest.mark.parametrize("values,n", [((1, -50, -2), 2), ((0, 1, 2), 0), ((None, 1, 2), 0)])
def test_negative_sales(spark, values, n):
    result = quality.validate_sales(sales(spark, values))
    assert result.errors == ([f"Found {n} negative sales values"] if n else [])


def test_nan_is_not_negative(spark):
    df = sales(spark, (float("nan"), -1.0), "product_id int, sales double, date string")
    assert quality.validate_sales(df).errors == ["Found 1 negative sales values"]


def test_configured_columns_and_null_option(spark):
    df = sales(spark, (None, 1)).drop("date")
    assert quality.validate_sales(df, required=("product_id",)).is_valid
    result = quality.validate_sales(df, required=("product_id",), reject_null=True)
    assert result.errors == ["Found 1 null values in sales"]


def test_empty_input_warns(spark):
    result = quality.validate_sales(sales(spark).limit(0))
    assert result.is_valid and result.warnings == ["DataFrame is empty"]


def test_forecast(spark):
    df = spark.createDataFrame([(1, "d", -3.0), (2, "d", 0.0)], "product_id int, forecast_date string, predicted_demand double")
    assert quality.validate_forecast(df).errors == ["Found 1 negative demand predictions"]
    assert "forecast_date" in quality.validate_forecast(df.drop("forecast_date")).errors[0]


@pytest.mark.parametrize("value,low,high,failures", [
    (5.0, 0, 10, 0), (0.0, 0, 10, 0), (10.0, 0, 10, 0), (-1.0, 0, 10, 1), (11.0, 0, 10, 1), (11.0, 0, None, 0),
    (-1.0, None, 10, 0), (5.0, 10, 0, 2), (float("nan"), 0, 10, 0),
])
def test_range(spark, value, low, high, failures):
    df = spark.createDataFrame([(value,)], "v double")
    assert len(quality.run_checks(df, quality.range_checks(df, "v", low, high)).errors) == failures


def test_range_of_text_and_booleans(spark):
    df = spark.createDataFrame([("a", True)], "t string, b boolean")
    assert "non-numeric" in quality.run_checks(df, quality.range_checks(df, "t", 0, 1)).errors[0]
    assert quality.run_checks(df, quality.range_checks(df, "b", 0, 1)).is_valid


@pytest.mark.parametrize("column,expected,ok", [
    ("s", "str", True), ("s", "float", False), ("i", "int", True), ("i", "str", False), ("d", "float", True),
    ("b", "bool", True), ("b", "int", True), ("l", "list", True), ("m", "dict", True), ("r", "dict", True),
    ("l", "dict", False), ("n", "int", True), ("t", "datetime", True), ("i", "float", False),
])
def test_types(spark, column, expected, ok):
    df = spark.sql("""SELECT 'x' AS s, 1 AS i, 1.5D AS d, true AS b, array(1) AS l, map('a', 1) AS m,
        named_struct('a', 1) AS r, '12' AS n, timestamp'2024-01-01' AS t""")
    assert quality.run_checks(df, quality.type_checks(df, {column: expected})).is_valid is ok


def test_record_schema(spark):
    df = spark.createDataFrame([("Ann", 30), (None, 31)], "name string, age int")
    checks = quality.required_checks(df, ["name", "age", "mail"])
    assert quality.run_checks(df, checks).errors == ["Missing required field: name", "Missing required field: mail"]


def test_rules_run_in_order_and_unknown_ones_are_ignored(spark):
    rules = [{"type": "range", "column": "sales", "max": 120}, {"type": "nonsense"}, {"type": "sales"}]
    errors = quality.validate(sales(spark, (-1, 200)), rules).errors
    assert errors == ["1 values of sales are greater than maximum 120", "Found 1 negative sales values"]
    parts = [quality.ValidationResult(), quality.ValidationResult(False, ["e"], ["w"], {"k": "v"})]
    total = quality.combine(parts)
    assert (total.is_valid, total.errors, total.warnings, total.metadata) == (False, ["e"], ["w"], {})


def test_all_counters_come_from_one_job(spark):
    df = sales(spark, (-1, 200))
    checks = quality.configured_checks(df, [{"type": "sales"}, {"type": "range", "column": "sales", "min": 0}])
    plan = quality.count_checks(df, checks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") <= 1
    tagged = quality.tag_rows(df, checks).orderBy("product_id").collect()
    assert [r._errors for r in tagged] == [["negative:sales", "range_min:sales"], []]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("product_id,sales,date\n1,100,2024-01-01\n2,-3,2024-01-02\n")
    (tmp_path / "a.json").write_text('[{"name": "Ann", "age": 30}]')
    (tmp_path / "a.xml").write_text("<a/>")
    (tmp_path / "bad.json").write_text("")
    run = lambda name, rules: quality.validate_file(spark, str(tmp_path / name), rules)
    assert run("a.csv", [{"type": "sales"}]).errors == ["Found 1 negative sales values"]
    assert run("a.json", [{"type": "schema", "schema": {"required": ["name"], "types": {"age": "int"}}}]).is_valid
    assert run("a.xml", []).errors[0].startswith("Unsupported file type")
    assert run("none.csv", []).errors[0].startswith("File not found")


def test_records(spark):
    rules = [{"type": "sales"}]
    record = {"product_id": 1, "sales": -5, "date": "2024-01-01"}
    assert quality.validate_records(spark, record, rules).errors == ["Found 1 negative sales values"]
    assert len(quality.validate_records(spark, [record, {"product_id": 2, "sales": -1}], rules).errors) == 1
    empty = quality.validate_records(spark, [], rules)
    assert not empty.is_valid and empty.warnings == ["DataFrame is empty"]
    assert quality.validate_records(spark, "text", rules).errors[0].startswith("Invalid data type")
    assert quality.validate_records(spark, sales(spark), rules).is_valid


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.0), (4, 1.0)], "a int, b double")
    rows = {r.column: r for r in quality.null_profile(df, 0.5).collect()}
    assert (rows["a"].nulls, rows["b"].nulls, rows["b"].null_ratio, rows["b"].within_threshold) == (0, 2, 0.5, True)


def test_results_history(spark, tmp_path):
    path = str(tmp_path / "results")
    for i in range(3):
        append_results(spark, path, [(f"s{i}", quality.ValidationResult(warnings=["w"]))], datetime(2024, 1, 1 + i))
    rows = newest_results(spark, path, 2).collect()
    assert [r.stage for r in rows] == ["s2", "s1"] and rows[0].warnings == ["w"]


def test_mark_never_moves_back(spark):
    day = datetime(2024, 1, 5)
    old = spark.createDataFrame([("a", day), ("b", day)], "k string, last_processed timestamp")
    new = spark.createDataFrame([("a", day - timedelta(days=1)), ("b", day + timedelta(days=1)), ("c", None)],
                                "k string, date timestamp")
    marks = {r.k: r.last_processed for r in incremental.high_water_mark(new, ["k"], previous=old).collect()}
    assert marks == {"a": day, "b": day + timedelta(days=1), "c": None}
    text = spark.createDataFrame([("2024-02-01",), ("junk",)], "date string")
    assert incremental.high_water_mark(text).first().last_processed == datetime(2024, 2, 1)


def test_since_mark(spark):
    df = spark.createDataFrame([(datetime(2024, 1, d),) for d in range(1, 20)], "date timestamp")
    end = F.lit("2024-01-15").cast("timestamp")
    days = [r.date.day for r in incremental.since_mark(df, None, end=end).collect()]
    assert days == list(range(8, 16))
    mark = F.lit("2024-01-13").cast("timestamp")
    assert incremental.since_mark(df, mark, end=end).count() == 3


def test_unseen_compares_ids_as_text(spark):
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (None, "e")], "id int, v string")
    ledger = spark.createDataFrame([("1",), (None,)], "id string")
    assert sorted(r.v for r in incremental.unseen(batch, ledger).collect()) == ["b", "c", "d", "e"]
    once = incremental.unseen(batch, ledger, dedupe_within_batch=True, newest_by="v")
    assert sorted(r.v for r in once.collect()) == ["c", "d", "e"]


def test_trim(spark):
    ledger = spark.range(100).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("id"))
    assert incremental.trim_ledger(ledger, "seq", above=100, keep=10).count() == 100
    kept = incremental.trim_ledger(ledger.repartition(7), "seq", above=99, keep=10)
    assert sorted(r.seq for r in kept.collect()) == list(range(90, 100))
    grown = incremental.mark_seen(kept.select("id", "seq"), spark.createDataFrame([(95,), (200,)], "x int"), "x",
                                  F.lit(500).cast("bigint"))
    assert {r.id: r.seq for r in grown.collect()}["95"] == 95 and grown.count() == 11


def test_new_files(spark):
    listing = spark.createDataFrame([("a.parquet",), ("b.parquet",), ("c.txt",)], "path string")
    ledger = spark.createDataFrame([("a.parquet",)], "path string")
    assert [r.path for r in incremental.new_files(listing, ledger).collect()] == ["b.parquet"]


def test_new_files_of_tables_stored_as_folders(spark, tmp_path):
    rows = spark.range(10).repartition(3)
    for name in ("part", "orders", "region"):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    (tmp_path / "lineitem.parquet").write_bytes(b"PAR1")
    (tmp_path / "notes.txt").write_text("no table")
    got = QUERIES["new_files"](spark, f"{tmp_path}/").collect()
    assert sorted(r.path for r in got) == ["lineitem.parquet", "orders.parquet", "region.parquet"]


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    assert sorted(r.v for r in incremental.latest_per_key(df, ["k"], ["t"]).collect()) == ["y", "z"]
