import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import quota, requestlog

START = datetime(2024, 1, 1)
SCHEMA = "id int, ts timestamp, client string, method string, endpoint string, status string, latency_s double"


def log(spark, rows):
    full = [(i, START + timedelta(seconds=s), c, "POST", "/p", status, latency)
            for i, (s, c, status, latency) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def test_counts_and_compat_label(spark):
    df = log(spark, [(0, "a", "200", 0.1), (1, "a", "400", 0.1), (2, "b", "500", 0.1)])
    labels = {r.status: r.requests for r in requestlog.request_counts(df, compat=True).collect()}
    assert labels == {"200": 1, "401": 1, "500": 1}
    assert {r.status for r in requestlog.request_counts(df).collect()} == {"200", "400", "500"}


def test_latency_buckets_are_cumulative(spark):
    df = log(spark, [(0, "a", "200", 0.02), (1, "a", "200", 0.05), (2, "a", "200", 3.0), (3, "a", "500", 9.0)])
    r = requestlog.latency_histogram(df, buckets=(0.01, 0.05, 5.0)).first()
    assert (r.le_0_01, r.le_0_05, r.le_5, r.latency_count) == (0, 2, 3, 3)
    assert r.latency_sum == pytest.approx(3.07) and r.latency_p95 == 3.0


def test_active_requests_over_midnight(spark):
    df = log(spark, [(86_390, "a", "200", 20.0), (86_395, "a", "200", 1.0), (86_405, "a", "200", 2.0)])
    got = {(r.at - START).total_seconds(): r.active for r in requestlog.active_requests(df).collect()}
    assert got == {86_390: 1, 86_395: 2, 86_396: 1, 86_405: 2, 86_407: 1, 86_410: 0}


def test_aligned_quota(spark):
    df = log(spark, [(s, "a", "200", 0.0) for s in (10, 50, 59, 61)])
    usage = {r.requests: (r.remaining, r.rejected) for r in requestlog.quota_usage(df, 2, 60).collect()}
    assert usage == {3: (0, 1), 1: (1, 0)}
    rows = requestlog.quota_aligned(df, ["ts", "id"], 2, 60).orderBy("id").collect()
    assert [(r.n, r.remaining, r.over_limit) for r in rows] == [(1, 1, False), (2, 0, False), (3, 0, True), (1, 1, False)]


@pytest.mark.parametrize("max_rows", [1000, 5])
def test_numbers_in_hot_windows(spark, max_rows):
    df = log(spark, [(i % 13, "ab"[i % 3 == 0], "200", 0.0) for i in range(60)] + [(1, None, "200", 0.0)] * 9)
    df = df.withColumn("window_start", F.lit(START))
    got = requestlog.number_in_window(df.repartition(3), ["ts", "id"], 4, max_rows).collect()
    for client in ("a", "b", None):
        rows = sorted((r for r in got if r.client == client), key=lambda r: (r.ts, r.id))
        assert [r.n for r in rows] == list(range(1, len(rows) + 1))
        assert [r.over_limit for r in rows] == [i > 4 for i in range(1, len(rows) + 1)]
    late = df.withColumn("window_start", F.when(F.col("client") == "a", F.col("window_start")))
    kept = requestlog.number_in_window(late, ["ts", "id"], 4, max_rows).collect()
    assert len(kept) == 69 and all((r.n is None) == (r.client != "a") for r in kept)


def walk(rows, width):
    """Window start per (client, second), one request after the other."""
    out, opened = {}, {}
    for s, c in sorted(rows):
        if c not in opened or s >= opened[c] + width:
            opened[c] = s
        out[c, s] = opened[c]
    return out


@pytest.mark.parametrize("seed,max_rows,fan_in", [
    (0, 10**6, 64), (1, 50, 64), (2, 10, 2), (3, 5, 2), (4, 3, 3), (5, 1, 2)])
def test_anchored_windows_equal_a_walk(spark, seed, max_rows, fan_in):
    rng = random.Random(seed)
    rows, now = [], 0
    for _ in range(150):  # a busy client, with bursts and pauses
        now += rng.choice([0, 1, 5, 20, 59, 60, 61, 300])
        rows.append((now, "busy"))
    rows += [(rng.randint(0, now), rng.choice("xyz")) for _ in range(40)]
    rows += [(7, None), (8, None), (70, None)]
    df = log(spark, [(s, c, "200", 0.0) for s, c in rows]).repartition(4)
    expected = walk([(s, c or "unknown") for s, c in rows], 60)
    got = quota.anchored_windows(df, 60, max_rows, fan_in).collect()
    assert len(got) == len(rows)
    for r in got:
        s = (r.ts - START).total_seconds()
        assert (r.window_start - START).total_seconds() == expected[r.client or "unknown", s]


def test_dense_client_over_many_levels(spark):
    rows = [(i * 7, "c") for i in range(400)]
    got = quota.quota_anchored(log(spark, [(s, c, "200", 0.0) for s, c in rows]), ["ts", "id"], 5, 60, max_rows=4)
    expected = walk(rows, 60)
    assert all((r.window_start - START).total_seconds() == expected["c", (r.ts - START).total_seconds()]
               for r in got.collect())
    assert got.filter("over_limit").count() == got.filter("n > 5").count() > 0


def test_requests_without_time_have_no_window(spark):
    df = log(spark, [(0, "a", "200", 0.0)]).withColumn("ts", F.lit(None).cast("timestamp"))
    assert quota.anchored_windows(df, 60).first().window_start is None


def test_remaining_quota(spark):
    df = log(spark, [(0, "a", "200", 0.0), (30, "a", "200", 0.0), (0, "b", "200", 0.0), (300, "c", "200", 0.0)])
    windows = quota.anchored_windows(df, 60)
    got = {r.client: (r.remaining, (r.reset_at - START).total_seconds())
           for r in quota.remaining_quota(df, windows, "2024-01-01 00:00:40", 3, 60).collect()}
    assert got == {"a": (1, 60), "b": (2, 60), "c": (3, 100)}


def test_many_blocks_are_not_handed_to_python_one_by_one(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("one call of Python per block")

    monkeypatch.setattr("pyspark.sql.pandas.group_ops.PandasGroupedOpsMixin.applyInPandas", refuse)
    rows = [(s, f"c{s % 7}", "200", 0.0) for s in range(0, 3000, 3)]
    whole = quota.anchored_windows(log(spark, rows), 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # blocks reach over batches
    try:
        blocks = quota.anchored_windows(log(spark, rows), 60, max_rows=11, fan_in=2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, blocks)) == sorted(map(str, whole.collect()))
