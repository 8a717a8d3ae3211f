import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shelfcast.models import score as scoring
from shelfcast.operators import quota
from shelfcast.operators.requestlog import request_counts
from shelfcast.operators.skew import join_stream_per_key
from shelfcast.sources import files, kafka
from shelfcast.streaming import jobs
from shelfcast.streaming.run import run_by_batch, run_to_table, run_totals

START = datetime(2024, 1, 1)
LOG = "event_id bigint, ts timestamp, client string, method string, endpoint string, status string, latency_s double"


def requests(spark, n, seed=0, first=0):
    rng = random.Random(seed)
    rows = [(first + i, START + timedelta(seconds=37 * (first + i)), rng.choice("aab"), "POST", "/p", "200", 0.1)
            for i in range(n)]
    return spark.createDataFrame(rows, LOG).coalesce(1)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_files_are_ingested_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(10).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema

    def run():
        return run_to_table(files.stream_prefix(spark, src, schema), "x", out, mark).count()

    assert (run(), run()) == (10, 10)
    spark.range(5).coalesce(1).write.mode("append").parquet(src)
    assert run() == 15
    assert spark.read.parquet(out).select("_source_file").distinct().count() == 2


def test_duplicates_are_dropped_across_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for seed in (1, 2):
        requests(spark, 30, seed).write.mode("append").parquet(src)
    got = run_to_table(jobs.dedupe_stream(stream(spark, src, requests(spark, 1).schema), ["event_id"]), "dedupe")
    assert got.count() == 30


def test_windows_close_behind_the_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    requests(spark, 500).write.parquet(src)
    counts = run_to_table(jobs.windowed_counts(stream(spark, src, requests(spark, 1).schema), "1 hour"), "counts")
    batch = request_counts(requests(spark, 500), "1 hour")
    last = START + timedelta(seconds=37 * 499) - timedelta(hours=1)
    expected = {r.window.start: r.requests for r in batch.collect() if r.window.end <= last}
    assert {r.window.start: r.requests for r in counts.collect()} == expected and len(expected) == 4


def test_running_totals_equal_the_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(3):
        requests(spark, 20, i).write.mode("append").parquet(src)
    totals = run_totals(request_counts(stream(spark, src, requests(spark, 1).schema)), "totals",
                        ["method", "endpoint", "status"])
    assert [r.requests for r in totals.collect()] == [60]


def test_anchored_quota_carries_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(3):
        requests(spark, 40, i, first=40 * i).write.mode("append").parquet(src)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = run_to_table(jobs.anchored_quota_stream(
            stream(spark, src, requests(spark, 1).schema), "event_id", 2, 600), "quota")
    finally:
        spark.conf.set(key, before)
    whole = quota.quota_anchored(spark.read.parquet(src), ["ts", "event_id"], 2, 600)
    expected = {r.event_id: (r.n, r.over_limit) for r in whole.collect()}
    assert {r.request_id: (r.n, r.over_limit) for r in got.collect()} == expected


def test_decode_and_score_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    good = '{"product_id": "p1", "store_id": "s", "date": "2024-01-01", "features": {"f": 2}}'
    rows = [(good, 0, 1), ('{"store_id": "s"}', 0, 2)]
    spark.createDataFrame(rows, "value string, partition int, offset bigint").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    store = spark.createDataFrame([("p1", START, 4.0)], "product_id string, date timestamp, f double")
    parsed = scoring.parse_requests(stream(spark, src, schema))
    accepted, rejects = scoring.split_rejects(parsed)
    scored = scoring.score_requests(accepted, store, scoring.linear_scorer({"f": 1.0}), ["f"], "1",
                                    ("product_id",), use_request_features=True)
    rows = run_to_table(scored, "scored").collect()
    assert [(r.product_id, r.predicted_quantity, r.offset) for r in rows] == [("p1", 2.0, 1)]
    assert [r.offset for r in run_to_table(rejects, "rejects").collect()] == [2]
    fields = scoring.REQUEST_SCHEMA
    decoded = run_to_table(kafka.decode_messages(stream(spark, src, schema), fields), "decoded").orderBy("_offset")
    assert [r.product_id for r in decoded.collect()] == ["p1", None]


def test_stream_join_without_broadcast(spark, tmp_path):
    src = str(tmp_path / "in")
    requests(spark, 50).write.parquet(src)
    table = spark.createDataFrame([("a", 1), ("c", 3)], "client string, v int")
    joined = join_stream_per_key(stream(spark, src, requests(spark, 1).schema), table, 2, ["client"], limit=0)
    rows = run_to_table(joined, "joined").collect()
    assert len(rows) == 50 and all(r.v == (1 if r.client == "a" else None) for r in rows)
    assert "_salt" not in joined.columns


def test_a_large_table_is_not_copied_for_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    requests(spark, 50).write.parquet(src)
    table = spark.createDataFrame([(c, 1) for c in "abcdefgh"], "client string, v int")
    schema = requests(spark, 1).schema
    for salts, copies in ((None, 0), (4, 1)):
        joined = join_stream_per_key(stream(spark, src, schema), table, 8, ["client"], salts, limit=0)
        assert joined._jdf.queryExecution().analyzed().toString().count("Generate explode") == copies
        assert run_to_table(joined, "joined").filter("v = 1").count() == 50


def test_corrupt_files_can_be_skipped(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(5).coalesce(1).write.parquet(str(src))
    (src / "bad.parquet").write_bytes(b"PAR1 this is no parquet file")
    df = files.stream_prefix(spark, str(src), spark.range(1).schema, skip_corrupt=True)
    assert run_to_table(df, "skip").count() == 5


def test_batches_are_handed_over(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    requests(spark, 7).write.parquet(src)
    run_by_batch(stream(spark, src, requests(spark, 1).schema),
                 lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out), str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == 7
