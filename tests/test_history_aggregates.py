import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.operators.aggregates import add_group_statistics, add_past_statistics, group_statistics
from shelfcast.operators.history import add_history_features
from shelfcast.operators.skew import chunk_hot_groups, join_per_key, row_positions

SCHEMA = "product_id string, n int, quantity double, price double, store_id string"


def series(seed=7, sizes=(("a", 60), ("b", 9), ("c", 1), (None, 30))):
    rng = random.Random(seed)
    rows = []
    for key, size in sizes:
        for i in range(size):
            q = None if rng.random() < 0.1 else float(rng.randint(1, 50))
            rows.append((key, i, q, float(rng.randint(10, 90)), f"s{rng.randint(0, 3)}"))
    rng.shuffle(rows)
    return rows


def brute(rows, lags, windows, min_periods=None):
    """Expected lag and rolling values by (key, n)."""
    out = {}
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(r[0], []).append(r)
    for key, group in groups.items():
        for i, r in enumerate(group):
            res = {}
            for k in lags:
                res[f"quantity_lag_{k}"] = group[i - k][2] if key is not None and i >= k else None
            for w in windows:
                frame = [x[2] for x in group[max(0, i - w + 1): i + 1] if x[2] is not None]
                enough = key is not None and len(frame) >= (w if min_periods is None else min_periods)
                res[f"quantity_roll_mean_{w}"] = statistics.fmean(frame) if enough and frame else None
                res[f"quantity_roll_std_{w}"] = statistics.stdev(frame) if enough and len(frame) > 1 else None
                res[f"quantity_roll_min_{w}"] = min(frame) if enough and frame else None
                res[f"quantity_roll_max_{w}"] = max(frame) if enough and frame else None
            out[key, r[1]] = res
    return out


def check(df, expected):
    rows = df.collect()
    assert len(rows) == len(expected)
    for r in rows:
        for name, value in expected[r.product_id, r.n].items():
            assert r[name] == (pytest.approx(value, abs=1e-9) if value is not None else None), (r, name)


@pytest.mark.parametrize("max_rows", [None, 1_000_000, 20, 7, 5])
@pytest.mark.parametrize("strict", [True, False])
def test_lags_and_windows_equal_brute_force(spark, max_rows, strict):
    rows = series()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = add_history_features(df, ["product_id"], ["n"], lags=(1, 3), windows=(2, 5), price=None,
                               max_rows=max_rows, strict=strict)
    check(got, brute(rows, (1, 3), (2, 5)))


def test_min_periods(spark):
    rows = series(3)
    got = add_history_features(spark.createDataFrame(rows, SCHEMA), ["product_id"], ["n"], lags=(), windows=(4,),
                               price=None, min_periods=1)
    check(got, brute(rows, (), (4,), min_periods=1))


def test_price_gets_the_first_three_lags(spark):
    df = spark.createDataFrame(series(), SCHEMA)
    names = add_history_features(df, ["product_id"], ["n"], windows=(2,)).columns
    assert [c for c in names if c.startswith("price_lag")] == ["price_lag_1", "price_lag_7", "price_lag_14"]
    assert "price_roll_mean_2" in names and not [c for c in names if c.startswith("_")]
    every = add_history_features(df, ["product_id"], ["n"], windows=(), price_lags=(1, 7, 14, 30)).columns
    assert "price_lag_30" in every
    without = add_history_features(df.drop("price"), ["product_id"], ["n"], windows=(2,)).columns
    assert not [c for c in without if c.startswith("price")]


def test_several_keys(spark):
    rows = [("a", 1, 1.0, 1.0, "x"), ("a", 2, 2.0, 1.0, "y"), ("a", 3, 3.0, 1.0, "x")]
    got = add_history_features(spark.createDataFrame(rows, SCHEMA), ["product_id", "store_id"], ["n"], lags=(1,),
                               windows=(2,), price=None).collect()
    assert {r.n: r.quantity_lag_1 for r in got} == {1: None, 2: None, 3: 1.0}
    assert {r.n: r.quantity_roll_mean_2 for r in got} == {1: None, 2: None, 3: 2.0}


@pytest.mark.parametrize("strict", [True, False])
def test_positions_are_dense_per_group(spark, strict):
    rows = [("a", i // 4, 1.0, 1.0, "s") for i in range(200)] if not strict else [
        ("a", i, 1.0, 1.0, "s") for i in range(200)]
    rows += [("b", i, 1.0, 1.0, "s") for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = row_positions(df, ["product_id"], ["n"], strict).collect()
    a = sorted((r._pos, r.n) for r in got if r.product_id == "a")
    assert [p for p, _ in a] == list(range(200)) and [n for _, n in a] == sorted(n for _, n in a)
    assert sorted(r._pos for r in got if r.product_id == "b") == [0, 1, 2]


def test_only_hot_groups_are_cut(spark):
    df = spark.createDataFrame(series(), SCHEMA)
    assert chunk_hot_groups(df, ["product_id"], ["n"], 60) is None
    chunked = chunk_hot_groups(df, ["product_id"], ["n"], 25)
    sizes = {(r.product_id, r._chunk): r["count"] for r in
             chunked.rows.groupBy("product_id", "_chunk").count().collect()}
    assert sizes == {("a", 0): 25, ("a", 1): 25, ("a", 2): 10, ("b", 0): 9, ("c", 0): 1}
    assert chunked.unkeyed.count() == 30


def test_copies_of_one_row_spread_over_partitions(spark):
    df = spark.range(4000).select(F.lit("a").alias("product_id"), F.lit(1).alias("n"))
    placed = row_positions(df, ["product_id"], ["n"], strict=False)
    assert placed.agg(F.min("_pos"), F.max("_pos"), F.count_distinct("_pos")).first()[:] == (0, 3999, 4000)


def test_group_statistics(spark):
    rows = [("a", 1, 2.0, 10.0, "x"), ("a", 2, 4.0, None, "y"), ("a", 3, None, 20.0, "x"), ("b", 1, None, 5.0, "x"),
            (None, 1, 9.0, 9.0, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    stats = {r.product_id: r for r in group_statistics(df, ["product_id"]).collect()}
    a, b = stats["a"], stats["b"]
    assert (a.quantity_mean, a.quantity_sum, a.quantity_count, a.store_id_nunique) == (3.0, 6.0, 2, 2)
    assert a.quantity_std == pytest.approx(2**0.5) and a.price_max == 20.0
    assert (b.quantity_sum, b.quantity_count, b.quantity_std, b.price_std) == (0.0, 0, None, None)
    joined = add_group_statistics(df, ["product_id"]).collect()
    assert len(joined) == 5 and [r.quantity_mean for r in joined if r.product_id is None] == [None]
    assert "price_mean" not in group_statistics(df.drop("price"), ["product_id"]).columns
    assert "store_id_nunique" not in group_statistics(df.drop("store_id"), ["product_id"]).columns


@pytest.mark.parametrize("limit", [0, 10**9])
def test_join_per_key_with_and_without_broadcast(spark, limit):
    left = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("a", 1), ("c", 2)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = join_per_key(left, right, ["k"], limit=limit)
        assert sorted((r.k or "", r.v or 0) for r in joined.collect()) == [("", 0), ("a", 1), ("a", 1), ("b", 0)]
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("BroadcastHashJoin" in plan) == (limit > 0)


@pytest.mark.parametrize("max_rows", [None, 1000, 9])
def test_past_statistics_do_not_see_the_present(spark, max_rows):
    rows = series(11)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.product_id, r.n): r for r in
           add_past_statistics(df, ["product_id"], ["n"], max_rows=max_rows).collect()}
    assert len(got) == len(rows)
    for key, n, *_ in rows:
        past = [r[2] for r in rows if r[0] == key and r[1] < n and r[2] is not None]
        r = got[key, n]
        if key is None:
            assert r.quantity_count is None and r.quantity_mean is None
            continue
        assert r.quantity_count == len(past) and r.quantity_sum == sum(past)
        assert r.quantity_mean == (pytest.approx(statistics.fmean(past)) if past else None)
        assert r.quantity_std == (pytest.approx(statistics.stdev(past)) if len(past) > 1 else None)
        assert (r.quantity_min, r.quantity_max) == ((min(past), max(past)) if past else (None, None))


def test_dates_as_order(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(days=i), float(i)) for i in (0, 3, 10)]
    df = spark.createDataFrame(rows, "product_id string, date timestamp, quantity double")
    got = add_history_features(df, ["product_id"], ["date"], lags=(1,), windows=()).orderBy("date").collect()
    assert [r.quantity_lag_1 for r in got] == [None, 0.0, 3.0]  # rows, not days
