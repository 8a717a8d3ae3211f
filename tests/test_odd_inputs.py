"""Inputs that the given tables do not hold: ties, missing values, dotted names, text versions, typed records."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.models.score import linear_scorer, score_requests
from shelfcast.models.store import production_versions
from shelfcast.models.train import Trainer
from shelfcast.operators import incremental, quality, requestlog
from shelfcast.operators.encode import OneHot, StandardScale
from shelfcast.operators.skew import BROADCAST_BYTES, table_bytes
from shelfcast.operators.split import time_split

START = datetime(2024, 1, 1)


def test_default_split_is_exact_with_ties(spark):
    panel = spark.range(200).select(
        (F.lit(START) + F.make_dt_interval(F.floor(F.col("id") / 50).cast("int"))).alias("date"), "id",
        F.col("id").cast("double").alias("quantity"))
    got = {r.split: r["count"] for r in time_split(panel).groupBy("split").count().collect()}
    assert got == {"train": 140, "val": 30, "test": 30}
    one_day = time_split(panel.limit(10).withColumn("date", F.lit(START)))
    assert {r.split: r["count"] for r in one_day.groupBy("split").count().collect()} == {"train": 7, "val": 1, "test": 2}
    trained = Trainer("random_forest", hyperparameters={"n_estimators": 2, "max_depth": 2}).train(panel)
    assert {r.split: r.n for r in trained.metrics.collect()} == {"train": 140, "val": 30, "test": 30}


def test_a_run_log_that_fails_is_a_warning(spark, tmp_path, caplog):
    (tmp_path / "file").write_text("x")
    rows = spark.createDataFrame([(START + timedelta(i), float(i), float(i % 5)) for i in range(40)],
                                 "date timestamp, f double, quantity double")
    sizes = {"n_estimators": 2, "max_depth": 2}
    trained = Trainer("random_forest", hyperparameters=sizes, log_root=str(tmp_path / "file")).train(rows)
    assert trained.features == ["f"] and "was not logged" in caplog.text
    logged = Trainer("random_forest", hyperparameters=sizes, log_root=str(tmp_path / "log"), fit_rows=10).train(rows)
    assert {r.run_id for r in spark.read.parquet(str(tmp_path / "log/run_metrics")).collect()} == {logged.run_id}


def test_requests_are_scored_by_product_and_store(spark):
    store = spark.createDataFrame([("p", "s1", START, 1.0), ("p", "s2", START + timedelta(1), 9.0)],
                                  "product_id string, store_id string, date timestamp, f double")
    asked = spark.createDataFrame([("p", "s1", "2024-01-01", {}), ("p", "s2", "2024-01-01", {})],
                                  "product_id string, store_id string, date string, features map<string,double>")
    got = {r.store_id: r.predicted_quantity for r in score_requests(
        asked, store, linear_scorer({"f": 1.0}), ["f"], "1").collect()}
    assert got == {"s1": 1.0, "s2": 9.0}


def test_requests_without_latency_or_time(spark):
    log = spark.createDataFrame([(START, 2.0), (START + timedelta(seconds=1), None), (None, 1.0)],
                                "ts timestamp, latency_s double")
    got = [(r.change, r.active) for r in requestlog.active_requests(log).orderBy("at").collect()]
    assert got == [(1, 1), (1, 2), (-1, 1)]


def test_dotted_and_clashing_categories(spark):
    rows = spark.createDataFrame([("St. Ives", 1.0), (None, 2.0), ("None", 3.0), ("none", 4.0)],
                                 "`shop.name` string, x double")
    one_hot = OneHot.fit(rows, ["shop.name"])
    assert len(set(n.lower() for n in one_hot.names())) == 4
    encoded = OneHot.from_json(one_hot.to_json()).transform(rows)
    scaled = StandardScale.fit(encoded).transform(encoded)
    assert scaled.columns == ["x", *one_hot.names()] and scaled.count() == 4
    assert all(sum(r[1:]) == 1.0 for r in encoded.collect())


def test_text_versions_compare_as_numbers(spark):
    rows = [("m", "9", "Production"), ("m", "10", "Production"), ("k", "v1", "Production"), ("k", "v2", "Production")]
    got = production_versions(spark.createDataFrame(rows, "model_name string, version string, stage string"))
    assert {r.model_name: r.version for r in got.collect()} == {"m": "10", "k": "v2"}


def test_deduplication_of_rows_with_maps(spark):
    rows = spark.createDataFrame([(1, {"a": 1}, 5), (1, {"a": 2}, 6), (None, {}, 1)], "id int, m map<string,int>, t int")
    ledger = spark.createDataFrame([("7",)], "id string")
    got = incremental.unseen(rows, ledger, dedupe_within_batch=True, newest_by="t").collect()
    assert sorted((r.id or 0, r.t) for r in got) == [(0, 1), (1, 6)]


@pytest.mark.parametrize(("records", "types", "errors"), [
    ({"age": "30"}, {"age": "int"}, 1), ({"age": 30}, {"age": "int"}, 0), ({"age": True}, {"age": "int"}, 0),
    ([{"name": "A"}, {"name": 1}], {"name": "str"}, 1), ({"age": None}, {"age": "int"}, 0),
    ({"tags": ["x"]}, {"tags": "list"}, 0), ({"tags": "x"}, {"tags": "dict"}, 1), ({"age": 1}, {"age": None}, 0),
])
def test_record_types_are_strict(spark, records, types, errors):
    result = quality.validate_records(spark, records, [{"type": "data_type", "types": types}])
    assert len(result.errors) == errors and result.is_valid == (errors == 0)


def test_rules_without_column_or_types_give_results(spark):
    rules = [{"type": "range", "column": "absent", "min": 0}, {"type": "range"}, {"type": "data_type"}, {"type": "schema"}]
    result = quality.validate_records(spark, [{"x": 1}, {"x": None}], rules)
    assert result.errors == ["Cannot validate range of missing column: absent"]
    needed = [{"type": "schema", "schema": {"required": ["x", "y"], "types": {"x": "int"}}}]
    assert len(quality.validate_records(spark, [{"x": 1}, {"x": None}], needed).errors) == 2


def test_wide_tables_are_not_broadcast(spark):
    wide = spark.range(10).select("id", F.struct(*[F.lit(1.0).alias(f"f{i}") for i in range(1000)]).alias("_stored"))
    assert table_bytes(wide, 10) >= 10 * 8000
    assert table_bytes(wide, 100_000) > BROADCAST_BYTES
    texts = spark.range(10).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    assert table_bytes(texts, 10) >= 10 * 10_000
