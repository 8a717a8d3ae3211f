import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.models import score as scoring
from shelfcast.operators import lookup as lookup_module
from shelfcast.operators import skew
from shelfcast.operators.lookup import historical_features, online_features

DAY = datetime(2024, 1, 1)
STORE = "product_id string, store_id string, ts timestamp, f1 double, f2 double"


def store(spark):
    return spark.createDataFrame([
        ("p1", "s1", DAY, 1.0, 10.0), ("p1", "s1", DAY + timedelta(days=2), 2.0, None),
        ("p2", "s1", DAY, 5.0, 50.0), (None, "s1", DAY, 9.0, 90.0)], STORE)


def entities(spark, rows):
    return spark.createDataFrame(rows, "product_id string, store_id string, note string")


def test_online_lookup_keeps_duplicates_and_defaults(spark):
    rows = [("p1", "s1", "a"), ("p1", "s1", "b"), ("zz", "s1", "c"), (None, "s1", "d")]
    got = online_features(entities(spark, rows), store(spark), ["product_id", "store_id"], "ts", ["f1", "f2", "f9"])
    by = {r.note: (r.f1, r.f2, r.f9) for r in got.collect()}
    assert by == {"a": (2.0, 0.0, 0.0), "b": (2.0, 0.0, 0.0), "c": (0.0, 0.0, 0.0), "d": (0.0, 0.0, 0.0)}
    assert got.columns == ["product_id", "store_id", "note", "f1", "f2", "f9"]


def test_online_lookup_of_nothing(spark):
    empty = entities(spark, [("p1", "s1", "a")]).limit(0)
    assert online_features(empty, store(spark), ["product_id"], "ts", ["f1"]).count() == 0


def test_online_lookup_with_unicode_keys(spark):
    s = spark.createDataFrame([("café-产品", "s", DAY, 3.0, 4.0)], STORE)
    got = online_features(entities(spark, [("café-产品", "s", "n")]), s, ["product_id"], "ts", ["f1"])
    assert got.first().f1 == 3.0


def test_point_in_time(spark):
    rows = [("p1", 0, "same time"), ("p1", 1, "between"), ("p1", 5, "after"), ("p1", -1, "before"), (None, 5, "no key"),
            ("p1", None, "no time")]
    e = spark.createDataFrame([(k, None if d is None else DAY + timedelta(days=d), n) for k, d, n in rows],
                              "product_id string, at timestamp, note string")
    got = historical_features(e, store(spark), ["product_id"], "at", "ts", ["f1", "f2"], default=None)
    assert {r.note: (r.f1, r.f2) for r in got.collect()} == {
        "same time": (1.0, 10.0), "between": (1.0, 10.0), "after": (2.0, None), "before": (None, None),
        "no key": (None, None), "no time": (None, None)}
    assert got.columns == ["product_id", "at", "note", "f1", "f2"]


@pytest.mark.parametrize("max_rows", [10**6, 40, 10, 3])
def test_point_in_time_equals_brute_force(spark, max_rows):
    rng = random.Random(max_rows)
    facts = [(rng.choice("aab"), rng.randint(0, 300)) for _ in range(60)]
    facts = sorted(set(facts))
    asks = [(rng.choice(["a", "a", "b", "c", None]), rng.randint(0, 300), i) for i in range(120)]
    s = spark.createDataFrame([(k, DAY + timedelta(hours=h), float(h)) for k, h in facts], "k string, ts timestamp, f double")
    e = spark.createDataFrame([(k, DAY + timedelta(hours=h), i) for k, h, i in asks], "k string, at timestamp, i int")
    got = {r.i: r.f for r in
           historical_features(e, s, ["k"], "at", "ts", ["f"], default=-1.0, max_rows=max_rows).collect()}
    for k, h, i in asks:
        assert got[i] == max([float(x) for key, x in facts if key == k and x <= h], default=-1.0)


def test_band_inverts_for_negative_predictions(spark):
    df = spark.createDataFrame([(100.0,), (-100.0,), (0.0,)], "p double")
    got = [tuple(r) for r in df.select(*scoring.confidence_band(F.col("p")).values()).collect()]
    assert got == [(85.0, pytest.approx(115.0)), (-85.0, pytest.approx(-115.0)), (0.0, 0.0)]


def request_text(**fields):
    return json.dumps(fields)


@pytest.mark.parametrize("text,reason", [
    (request_text(product_id="p", store_id="s", date="2024-01-01", features={"a": 1, "b": 2.5}), None),
    (request_text(product_id="p", store_id="s", date="2024-01-01"), None),
    (request_text(product_id="p", store_id="s", date="2024-01-01", features={}), None),
    (request_text(product_id="p", store_id="s", date="2024-01-01", features={"a": "1.5"}), None),
    (request_text(product_id="p", store_id="s", date="2024-01-01", features={"a": "high"}), "features must be numbers"),
    (request_text(product_id="p", store_id="s", date="2024-01-01", features=[1]), "features must be numbers"),
    (request_text(store_id="s", date="2024-01-01"), "product_id is missing or not text"),
    (request_text(product_id=3, store_id="s", date="2024-01-01"), "product_id is missing or not text"),
    (request_text(product_id="p", date="2024-01-01"), "store_id is missing or not text"),
    ("{broken", "not JSON"),
])
def test_request_parsing(spark, text, reason):
    parsed = scoring.parse_requests(spark.createDataFrame([(1, text)], "n int, value string"))
    row = parsed.first()
    assert row.reason == reason
    good, bad = scoring.split_rejects(parsed)
    assert (good.count(), bad.count()) == ((1, 0) if reason is None else (0, 1))


def test_request_values_are_kept(spark):
    text = request_text(product_id="p", store_id="s", date="2024-01-01", features={"a": 1, "b": 2.5})
    row = scoring.parse_requests(spark.createDataFrame([(text,)], "value string")).first()
    assert (row.product_id, row.store_id, row.date, row.features) == ("p", "s", "2024-01-01", {"a": 1.0, "b": 2.5})


def test_request_scoring(spark):
    requests = spark.createDataFrame(
        [("p1", "s1", "2024-01-01", {"f1": 7.0}), ("zz", "s1", "2024-01-01", {})], scoring.REQUEST_SCHEMA)
    scorer = scoring.linear_scorer({"f1": 2.0}, 1.0)
    plain = scoring.score_requests(requests, store(spark), scorer, ["f1"], "3", ("product_id",), ts="ts")
    assert tuple(plain.columns[:7]) == scoring.RESPONSE_COLUMNS
    rows = {r.product_id: r for r in plain.collect()}
    assert rows["p1"].predicted_quantity == 5.0 and rows["p1"].confidence_lower == 4.25
    assert rows["zz"].predicted_quantity == 1.0 and rows["zz"].model_version == "3"
    assert len({r.request_id for r in rows.values()}) == 2 and rows["p1"].timestamp is not None
    own = scoring.score_requests(requests, store(spark), scorer, ["f1"], "3", ("product_id",), ts="ts",
                                 use_request_features=True)
    assert {r.product_id: r.predicted_quantity for r in own.collect()} == {"p1": 15.0, "zz": 1.0}


def test_lookup_bounds_the_rows_of_a_task(spark, monkeypatch):
    """The partitions of the ordered window grow with the rows, also where the session has few."""
    rows = [(i % 50, datetime(2024, 1, 1) + timedelta(hours=i), float(i)) for i in range(400)]
    store = spark.createDataFrame(rows, "k int, at timestamp, v double")
    entities = spark.createDataFrame([(k, t + timedelta(minutes=30), i) for i, (k, t, _) in enumerate(rows)],
                                     "k int, ts timestamp, id int")
    usual = historical_features(entities, store, ["k"], "ts", "at", ["v"])
    monkeypatch.setattr(lookup_module, "spread", lambda df, n, by: skew.spread(df, n, by, task_rows=40))
    got = historical_features(entities, store, ["k"], "ts", "at", ["v"])
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == usual.columns == ["k", "ts", "id", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, usual.collect())) and got.filter("v = id").count() == 400


def test_chunked_lookup_computes_its_input_once(spark, monkeypatch):
    rows = [(i % 3, datetime(2024, 1, 1) + timedelta(hours=i), float(i)) for i in range(90)]
    store = spark.createDataFrame(rows, "k int, at timestamp, v double")
    seen = []
    cut = lookup_module.chunk_hot_groups

    def watched(df, *args, **options):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df, *args, **options)

    monkeypatch.setattr(lookup_module, "chunk_hot_groups", watched)
    got = historical_features(store.drop("v"), store, ["k"], "at", "at", ["v"], max_rows=7)
    assert "Union" not in seen[0] and seen[0].count("Relation") == 1  # sizes, cold and hot rows read one stored table
    assert sorted(map(tuple, got.select("k", "at", "v").collect())) == sorted(rows)
