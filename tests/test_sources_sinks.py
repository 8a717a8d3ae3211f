import json
import sys
from datetime import date, datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.sources import collect, files, kafka, paged_api, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests

PAGE = T.StructType([T.StructField("id", T.StringType()), T.StructField("date", T.TimestampType()),
                     T.StructField("amount", T.IntegerType())])


def api(start, end, limit, offset):
    """Five records a day."""
    days = (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
    first = date.fromisoformat(start).toordinal()
    records = [{"id": f"{first + d}-{i}", "date": date.fromordinal(first + d).isoformat(), "amount": i}
               for d in range(days) for i in range(5)]
    return {"data": records[offset: offset + limit], "has_more": offset + limit < len(records)}


def no_data(start, end, limit, offset):
    return {"data": []}


def fails_on_second_page(start, end, limit, offset):
    if offset:
        raise ValueError("bad page")
    return {"data": [{"id": "1", "date": start, "amount": 1}], "has_more": True}


@pytest.mark.parametrize("page_size,slice_days,stripes", [(1000, 1, 1), (2, 1, 1), (2, 3, 2), (3, 4, 3)])
def test_pages_are_read_once_each(spark, page_size, slice_days, stripes):
    df = paged_api.read_pages(spark, api, PAGE, date(2024, 1, 1), date(2024, 1, 4), page_size, slice_days, stripes)
    rows = df.collect()
    assert len(rows) == 20 and len({r.id for r in rows}) == 20
    assert {r.date for r in rows} == {datetime(2024, 1, d) for d in range(1, 5)}


def test_no_pages(spark):
    assert paged_api.read_pages(spark, no_data, PAGE, date(2024, 1, 1), date(2024, 1, 2)).count() == 0
    assert paged_api.date_slices(date(2024, 1, 2), date(2024, 1, 1), 1) == []


def test_broken_slice_keeps_its_first_pages_or_raises(spark):
    day = date(2024, 1, 1)
    lenient = paged_api.read_pages(spark, fails_on_second_page, PAGE, day, day, 1, fail_on_error=False)
    assert lenient.count() == 1
    with pytest.raises(Exception, match="bad page"):
        paged_api.read_pages(spark, fails_on_second_page, PAGE, day, day, 1).count()


def test_retries_wait_longer_each_time():
    calls, waits = [], []

    def flaky(*args):
        calls.append(args)
        if len(calls) < 3:
            raise ConnectionError
        return {"data": [], "has_more": False}

    assert paged_api.fetch_with_retry(flaky, 1, sleep=waits.append) == {"data": [], "has_more": False}
    assert len(calls) == 3 and waits == [2.0, 4.0]
    with pytest.raises(TimeoutError):
        paged_api.fetch_with_retry(lambda: (_ for _ in ()).throw(TimeoutError()), sleep=waits.append)
    with pytest.raises(ValueError):
        paged_api.fetch_with_retry(lambda: (_ for _ in ()).throw(ValueError()), sleep=lambda _: pytest.fail("retried"))


def test_default_dates():
    now = datetime(2024, 1, 10, 5)
    assert paged_api.default_dates(None, now) == (date(2024, 1, 3), date(2024, 1, 10))
    assert paged_api.default_dates(datetime(2024, 1, 9), now)[0] == date(2024, 1, 9)


def test_messages(spark):
    rows = [('{"a": 1, "b": "x"}', 0, 5), (None, 0, 6), ("{oops", 1, 7), ('{"a": 2}', 1, 8), ('{"a": "z"}', 1, 9)]
    df = spark.createDataFrame(rows, "value string, partition int, offset long").withColumn(
        "value", F.col("value").cast("binary"))
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    got = kafka.decode_messages(df, schema).orderBy("_offset").collect()
    assert [tuple(r) for r in got] == [(1, "x", 0, 5), (2, None, 1, 8), (None, None, 1, 9)]
    rejects = kafka.rejected_messages(df).orderBy("_offset").collect()
    assert [(r.reason, r._offset) for r in rejects] == [("no value", 6), ("not JSON", 7)]


def test_file_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "o.json").write_text(json.dumps({"x": 3}))
    (tmp_path / "a.csv").write_text("x,y\n1,a\n")
    assert sorted(r.x for r in files.read_json(spark, f"{tmp_path}/*.json").collect()) == [1, 2, 3]
    assert dict(files.read_csv(spark, str(tmp_path / "a.csv")).dtypes) == {"x": "int", "y": "string"}
    spark.range(3).write.parquet(f"{tmp_path}/data/sales/train")
    assert files.read_split(spark, f"{tmp_path}/data", "sales").count() == 3
    row = files.read_prefix(spark, f"{tmp_path}/data").first()
    assert row._source_file.endswith(".parquet") and row._ingestion_timestamp is not None


def test_collect_goes_on_after_a_failure(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/b/p")
    spark.createDataFrame([("2024-01-01",)], "date string").write.parquet(f"{tmp_path}/r/d/train")
    sources = [
        {"type": "s3", "name": "gone", "bucket": str(tmp_path), "prefix": "nothing"},
        {"type": "s3", "name": "one", "bucket": f"{tmp_path}/b", "prefix": "p"},
        {"type": "pigeon", "name": "odd"},
        {"type": "huggingface", "name": "two", "root": f"{tmp_path}/r", "dataset": "d"},
        {"type": "api", "name": "three", "fetch": api, "schema": PAGE, "start": date(2024, 1, 1), "end": date(2024, 1, 1)},
    ]
    rows, errors = collect.collect_sources(spark, sources)
    assert {r._source: r["count"] for r in rows.groupBy("_source").count().collect()} == {"one": 2, "two": 1, "three": 5}
    assert dict(rows.dtypes)["date"] == "timestamp"
    assert [(r.source, r.type) for r in errors.collect()] == [("gone", "s3")]
    with pytest.raises(ValueError, match="Unknown source type: pigeon"):
        collect.collect_sources(spark, sources, strict=True)
    nothing, _ = collect.collect_sources(spark, [])
    assert nothing is None


def test_feature_view_expires(spark, tmp_path):
    path, now = str(tmp_path / "views"), datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([("p1", 1.0)], "product_id string, f double")
    sinks.write_feature_view(df, path, "v", F.lit(datetime(2024, 1, 1, 11, 30)))
    sinks.write_feature_view(df, path, "v", F.lit(datetime(2024, 1, 1, 10)))
    sinks.write_feature_view(df, path, "w", F.lit(now))
    assert sinks.read_feature_view(spark, path, "v", now=now).count() == 1
    assert sinks.read_feature_view(spark, path, "v", ttl=None).count() == 2


def test_run_log(spark, tmp_path):
    metrics = spark.createDataFrame([("r1", "train", "mse", 1.0)], "run_id string, split string, metric string, value double")
    sinks.log_run(spark, str(tmp_path), "r1", {"model_type": "random_forest", "features": ["a"]}, metrics)
    sinks.log_run(spark, str(tmp_path), "r2", {"model_type": "xgboost"}, metrics)
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 3
    assert spark.read.parquet(f"{tmp_path}/run_metrics").count() == 2
