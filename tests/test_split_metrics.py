import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import metrics
from shelfcast.operators.horizon import horizon_frame
from shelfcast.operators.split import time_split

DAY = datetime(2024, 1, 1)


def dated(spark, days):
    rows = [(None if d is None else DAY + timedelta(days=d), i) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "date timestamp, id int").repartition(4)


def sizes(df):
    return {r.split: r["count"] for r in df.groupBy("split").count().collect()}


@pytest.mark.parametrize("n,expected", [
    (200, (140, 30, 30)), (10, (7, 1, 2)), (3, (2, 0, 1)), (1, (0, 0, 1)), (7, (4, 1, 2))])
def test_sizes(spark, n, expected):
    got = sizes(time_split(dated(spark, range(n))))
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == expected


@pytest.mark.parametrize("seed", range(4))
def test_split_equals_a_sort(spark, seed):
    rng = random.Random(seed)
    days = [None if rng.random() < 0.05 else rng.randint(0, 12) for _ in range(157)]
    got = {r.id: r.split for r in time_split(dated(spark, days), tie_break=["id"]).collect()}
    order = sorted(range(157), key=lambda i: (days[i] is None, days[i] or 0, i))
    first, second = int(157 * 0.7), int(157 * 0.7) + int(157 * 0.15)
    expected = {i: "train" if p < first else "val" if p < second else "test" for p, i in enumerate(order)}
    assert got == expected


def test_copies_across_a_cut_are_counted_exactly(spark):
    df = spark.range(1000).select(F.lit("2024-01-01").cast("timestamp").alias("date"), F.lit(1).alias("x"))
    assert sizes(time_split(df, strict=False)) == {"train": 700, "val": 150, "test": 150}
    mixed = dated(spark, [0] * 50 + [1] * 30 + [2] * 20).drop("id")
    got = time_split(mixed, strict=False)
    assert sizes(got) == {"train": 70, "val": 15, "test": 15}
    assert got.filter("split = 'train'").agg(F.max(F.dayofmonth("date"))).first()[0] == 2


def test_the_frame_is_not_shuffled(spark):
    plan = time_split(dated(spark, range(20)).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and "Window" not in plan


def test_empty_frame(spark):
    assert time_split(dated(spark, range(3)).limit(0)).count() == 0


def test_regression_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 2.0), ("a", 5.0, 6.0), ("b", 2.0, 2.0), ("b", 2.0, 2.0),
                                ("c", 2.0, 3.0), ("c", 2.0, 1.0), ("d", None, 1.0)],
                               "split string, y double, p double")
    got = {r.split: r for r in metrics.regression_metrics(df, "y", "p").collect()}
    assert got["a"].mse == pytest.approx(2 / 3) and got["a"].mae == pytest.approx(2 / 3)
    assert got["a"].r2 == pytest.approx(1 - 2 / 8)
    assert (got["b"].r2, got["c"].r2) == (1.0, 0.0) and "d" not in got
    long = metrics.long_metrics(metrics.regression_metrics(df, "y", "p"), F.lit("run")).collect()
    assert len(long) == 9 and {r.metric for r in long} == {"mse", "mae", "r2"}


def test_kpis(spark):
    df = spark.createDataFrame([(7, 10.0, 9.5), (7, 0.0, 1.0), (30, 10.0, 20.0)], "h int, y double, p double")
    got = {r.h: r for r in metrics.forecast_kpis(df, "y", "p", "h", scale=10.0).collect()}
    assert got[7].mape == pytest.approx(5) and got[7].accuracy_ok and got[7].mape_ok
    assert got[7].rmse == pytest.approx(math.sqrt((0.25 + 1) / 2) / 10) and got[7].rmse_ok
    assert got[30].accuracy == 0 and not got[30].mape_ok and got[30].accuracy_ok is None


def test_psi(spark):
    base = spark.createDataFrame([(float(i % 10),) for i in range(100)], "v double")
    edges = metrics.quantile_edges(base, "v", 5)
    assert len(edges) == 4
    same = base.withColumn("day", F.lit("same"))
    moved = base.withColumn("v", F.lit(9.0)).withColumn("day", F.lit("moved"))
    got = {r.day: r.psi for r in
           metrics.population_stability(base, same.unionByName(moved), "v", edges, ["day"]).collect()}
    assert got["same"] == pytest.approx(0) and got["moved"] > 1
    p, q = [1e-4] * 4 + [1.0], [0.2] * 5
    assert got["moved"] == pytest.approx(sum((a - b) * math.log(a / b) for a, b in zip(p, q, strict=True)))


def test_degradation(spark):
    rows = [(DAY + timedelta(days=d), 10.0, 10.0 - e) for d, e in ((0, 1.0), (1, 1.0), (7, 1.04), (14, 1.2))]
    df = spark.createDataFrame(rows, "date timestamp, y double, p double")
    got = metrics.weekly_degradation(df, "y", "p", "date", 1.0).orderBy("week").collect()
    assert [(r.n, r.retrain) for r in got] == [(2, False), (1, False), (1, True)]


def test_horizon(spark):
    rows = [(DAY, "a", "x", 1.0), (DAY + timedelta(days=4), "a", "x", 2.0), (DAY, "b", "y", 3.0)]
    df = spark.createDataFrame(rows, "date timestamp, product_id string, store_id string, quantity double")
    got = horizon_frame(df, ["product_id", "store_id"], days=3).orderBy("product_id", "horizon").collect()
    assert len(got) == 6  # observed pairs only
    assert [str(r.date) for r in got[:3]] == ["2024-01-06", "2024-01-07", "2024-01-08"]
    assert (got[0].last_quantity, got[0].days_since_last, got[3].days_since_last) == (2.0, 1, 5)


def test_service_kpis(spark):
    rows = [(DAY + timedelta(milliseconds=i), "e", 0.01 * (i + 1)) for i in range(20)]
    log = spark.createDataFrame(rows, "ts timestamp, endpoint string, latency_s double")
    r = metrics.service_kpis(log, "ts", "latency_s", ["endpoint"]).first()
    assert (r.requests, r.peak_per_second, r.p95) == (20, 20, 0.19) and not r.latency_ok and not r.throughput_ok
