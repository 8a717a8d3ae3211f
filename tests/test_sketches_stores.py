"""Mergeable sketches, counters gathered at load time, bucketed stores, horizons for a model, the streamed gauge."""

import random
import time
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import quality, sketches
from shelfcast.operators.horizon import horizon_training
from shelfcast.operators.lookup import BucketedStore, online_features
from shelfcast.operators.requestlog import active_requests, running_gauge
from shelfcast.session import drop_table, store_table
from shelfcast.streaming import jobs
from shelfcast.streaming.run import run_totals


def test_merged_quantiles_are_within_the_rank_error(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), h, rng.lognormvariate(0, 2)) for h in range(24) for _ in range(400)]
    rows += [("a", 0, None), ("a", 1, float("nan")), ("c", 1, 7.0)]
    df = spark.createDataFrame(rows, "g string, hour int, v double")
    hourly = sketches.quantile_sketches(df, "v", ["g", "hour"])
    got = {r.g: r for r in sketches.merged_quantiles(hourly, ["g"], {"q10": 0.1, "q95": 0.95}).collect()}
    for g in "ab":
        values = sorted(v for x, _, v in rows if x == g and v is not None and v == v)
        assert (got[g].n, got[g].least, got[g].most) == (len(values), values[0], values[-1])
        for q, v in ((0.1, got[g].q10), (0.95, got[g].q95)):
            assert abs(sum(x <= v for x in values) / len(values) - q) < sketches.RANK_ERROR + 1 / len(values)
    assert (got["c"].q10, got["c"].q95) == (7.0, 7.0)
    assert sketches.merged_quantiles(hourly.limit(0), ["g"], {"q": 0.5}).collect() == []


def test_merge_reads_no_rows(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 5).alias("hour"), F.col("id").cast("double").alias("v"))
    sketches.quantile_sketches(df, "v", ["hour"]).write.parquet(str(tmp_path / "hourly"))
    merged = sketches.merged_quantiles(spark.read.parquet(str(tmp_path / "hourly")), [F.lit(1).alias("all")], {"m": 0.5})
    assert all("hourly" in f for f in merged.inputFiles())
    assert merged.first().m == pytest.approx(500, abs=10)


@pytest.mark.parametrize("exact", [True, False])
def test_rolling_distinct(spark, exact):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), datetime(2024, 1, 1) + timedelta(days=rng.randrange(20), hours=3), rng.choice([*range(12), None]))
            for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, date timestamp, v int")
    got = {(r.k, r.date): r.distinct for r in sketches.rolling_distinct(df, "v", ["k"], width=5, exact=exact).collect()}
    days = {(k, d.date()) for k, d, _ in rows}
    assert got == {(k, d): len({v for x, t, v in rows if x == k and v is not None and d - timedelta(days=4) <= t.date() <= d})
                   for k, d in days}


def test_counters_of_a_load_come_from_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, -2.0), (2, 3.0), (None, None)], "product_id int, sales double")
    checks = quality.sales_checks(df, reject_null=True)
    assert sorted(map(tuple, quality.write_counted(df, checks, str(tmp_path / "out")).collect()), key=str) == sorted(
        map(tuple, quality.count_checks(df, checks).collect()), key=str)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    empty = quality.write_counted(df.limit(0), checks, str(tmp_path / "none")).collect()
    assert {r.rows for r in empty} == {0}


def test_bucketed_store_is_not_shuffled(spark, tmp_path):
    rows = [(i % 50, f"s{i % 3}", datetime(2024, 1, 1) + timedelta(days=i % 9), float(i)) for i in range(900)] + [(None, "x", None, 1.0)]
    store = spark.createDataFrame(rows, "k int, s string, at timestamp, v double")
    entities = spark.createDataFrame([(i, f"e{i}") for i in range(45, 60)] + [(45, "again"), (None, "none")], "k int, e string")
    held = BucketedStore.write(store, "shelf_bucketed", ["k"], "at", 4, str(tmp_path / "b"))
    try:
        found = held.online(entities, ["v", "absent"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # the entities'
        assert "SelectedBucketsCount: 4 out of 4" in plan
        want = online_features(entities, store, ["k"], "at", ["v", "absent"])
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    finally:
        held.drop(spark)


def test_horizon_training_labels(spark):
    rows = [(k, datetime(2024, 1, d), float(10 * k + d)) for k in (1, 2) for d in (1, 2, 4, 8)]
    df = spark.createDataFrame(rows, "k int, date timestamp, quantity double")
    got = sorted((r.k, r.horizon, r.date, r.last_quantity, r.label) for r in horizon_training(df, ["k"], days=4).collect())
    want = [(k, b - a, date(2024, 1, b), 10.0 * k + a, 10.0 * k + b)
            for k in (1, 2) for a in (1, 2, 4, 8) for b in (1, 2, 4, 8) if 0 < b - a <= 4]
    assert got == sorted(want)


def test_horizon_training_shuffles_rows_once(spark):
    rows = [(k, datetime(2024, 1, 1) + timedelta(days=3 * d), 1.0) for k in (1, None) for d in range(40)]
    df = spark.createDataFrame([*rows, (1, None, 5.0)], "k int, date timestamp, quantity double")
    training = horizon_training(df, ["k"], days=30)
    plan = training._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan  # no copy per horizon is shuffled
    assert training.count() == sum(min(10, 39 - d) for d in range(40))


def test_streamed_gauge_equals_the_batch(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    rows = [(i, begin + timedelta(minutes=7 * i), None if i % 11 == 0 else 60.0 * (i % 50)) for i in range(400)] + [(999, None, 1.0)]
    schema = "id int, ts timestamp, latency_s double"
    for p in range(4):
        spark.createDataFrame(rows[100 * p:100 * p + 100 + (p == 3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = running_gauge(run_totals(jobs.gauge_changes(stream, lateness="2 days"), "gauge", ["at"]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, active_requests(log).collect()))


def test_stored_tables_leave_no_shuffle_files_and_can_be_dropped(spark, tmp_path):
    """Shuffles of a stored table go with its write; a dropped table's folder goes, and no other one."""
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffles():
        return {f.name for d in folders for f in Path(d).glob("*/shuffle_*.data")}

    before = shuffles()
    wanted = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    table = store_table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "clean")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == wanted
    deadline = time.time() + 20
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffles() - before
    assert table.count() == 7
    other = str(tmp_path / "mine")
    spark.range(3).write.parquet(other)
    folder = Path(table.inputFiles()[0].split(":", 1)[1].replace("//", "/").replace("//", "/")).parent
    assert folder.exists()
    drop_table(table)
    drop_table(spark.read.parquet(other))
    assert not folder.exists() and Path(other).exists()
