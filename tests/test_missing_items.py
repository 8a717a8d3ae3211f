"""Wide categories, upserted views, isolated files, exactly-once ledgers and quota state that ends."""

import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.operators.encode import SparseOneHot, split_by_width
from shelfcast.sources import sinks
from shelfcast.sources.collect import collect_sources
from shelfcast.sources.isolate import list_files, read_isolated
from shelfcast.streaming import jobs
from shelfcast.streaming.exactly_once import LedgerSink, run_once_per_id


def test_sparse_one_hot(spark, tmp_path):
    rows = [(i, f"name {i % 1200:04d}" if i % 7 else None, "ab"[i % 2]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, name string, flag string")
    assert split_by_width(df, ["flag", "name"]) == (["flag"], ["name"])
    model = SparseOneHot.fit(df, ["name", "flag"])
    names = sorted({n for _, n, _ in rows if n})
    place = {**{n: i for i, n in enumerate(names)}, None: len(names)}
    assert model.size == len(names) + 3
    got = {r.id: (r.one_hot_indices, r.one_hot_values) for r in model.transform(df).collect()}
    assert got == {i: ([place[n], len(names) + 1 + "ab".index(f)], [1.0, 1.0]) for i, n, f in rows}
    new = spark.createDataFrame([(1, "unseen", "b"), (2, "unseen", "z")], "id int, name string, flag string")
    assert {r.id: r.one_hot_indices for r in model.transform(new).collect()} == {1: [model.size - 1], 2: []}
    model.save(str(tmp_path / "codes"))
    vector = SparseOneHot.load(spark, str(tmp_path / "codes"), ["name", "flag"]).vectors(df.limit(1)).first()["one_hot"]
    assert vector.size == model.size and list(vector.values) == [1.0, 1.0]


def live(spark, path, **options):
    return sorted((r.k, r.v) for r in sinks.read_live_view(spark, path, "a", **options).collect())


def test_upsert_keeps_one_row_per_key(spark, tmp_path):
    path = str(tmp_path / "view")

    def write(rows, day, hour=0):
        df = spark.createDataFrame(rows, "k int, v string")
        sinks.upsert_feature_view(df, path, "a", ["k"], F.lit(datetime(2024, 1, day, hour)), newest_by=["v"], buckets=4)

    write([(i, "old") for i in range(20)], 1)
    write([(i, "new") for i in range(10, 30)] + [(10, "newer")], 2)
    want = [(i, "old") for i in range(10)] + [(10, "newer")] + [(i, "new") for i in range(11, 30)]
    assert live(spark, path, ttl=None) == want
    write([(i, "last") for i in range(10)], 3)  # empties the folders of the first day
    assert live(spark, path, ttl=None) == [(i, "last") for i in range(10)] + want[10:]
    assert not list((tmp_path / "view").rglob("_date=2024-01-01/*/*.parquet"))
    write([(0, "too late")], 1, 5)  # an older row never replaces a newer one
    assert live(spark, path, ttl=None)[0] == (0, "last")
    other = spark.createDataFrame([(0, "b")], "k int, v string")
    sinks.upsert_feature_view(other, path, "b", ["k"], F.lit(datetime(2024, 1, 1)))
    assert len(live(spark, path, ttl=None)) == 30


def test_expired_dates_are_pruned(spark, tmp_path):
    path = str(tmp_path / "view")
    for day in (1, 2, 3):
        df = spark.createDataFrame([(day, "x")], "k int, v string")
        sinks.upsert_feature_view(df, path, "a", ["k"], F.lit(datetime(2024, 1, day, 12)))
    rows = sinks.read_live_view(spark, path, "a", ttl=3600, now=datetime(2024, 1, 3, 12, 30))
    assert [r.k for r in rows.collect()] == [3]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_date" in plan.split("PartitionFilters")[1].split("]")[0]
    scans = rows._jdf.queryExecution().executedPlan().collectLeaves()
    assert scans.head().metrics().apply("numFiles").value() == 1


@pytest.fixture
def folder(spark, tmp_path):
    where = tmp_path / "in"
    spark.range(1000).withColumn("v", F.col("id") * 2).repartition(4).write.parquet(str(where))
    whole = sorted(where.glob("*.parquet"))
    (where / "cut.parquet").write_bytes(whole[0].read_bytes()[:-20])
    (where / "other.parquet").write_bytes(b"PAR1 no table PAR1")
    (where / "empty.parquet").write_bytes(b"")  # holds no rows, which is no error
    return where


def test_broken_files_cost_their_own_rows_only(spark, folder):
    schema = spark.range(1).withColumn("v", F.lit(1).cast("long")).schema
    rows, errors = read_isolated(spark, list_files(spark, str(folder), "*.parquet"), schema)
    assert sorted(r.id for r in rows.collect()) == list(range(1000))
    assert rows.select("_source_file").distinct().count() == 4
    assert [r.file.rsplit("/", 1)[1] for r in errors.orderBy("file").collect()] == ["cut.parquet", "other.parquet"]
    assert all(r.error for r in errors.collect())
    rows, errors = read_isolated(spark, [], schema)
    assert (rows.count(), errors.count(), rows.columns) == (0, 0, ["id", "v", "_source_file"])


def test_malformed_csv_is_isolated(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("5,six\n")
    rows, errors = read_isolated(spark, list_files(spark, str(tmp_path)), spark.createDataFrame([], "a int, b int").schema, "csv")
    assert sorted((r.a, r.b) for r in rows.collect()) == [(1, 2), (3, 4)] and errors.count() == 1


def test_union_survives_files_that_break_while_read(spark, folder, tmp_path):
    spark.range(3).withColumn("v", F.lit(0).cast("long")).write.parquet(str(tmp_path / "fine"))
    schema = spark.read.parquet(str(tmp_path / "fine")).schema
    union, failed = collect_sources(spark, [
        {"type": "s3", "name": "broken", "bucket": str(tmp_path), "prefix": "in", "schema": schema},
        {"type": "s3", "name": "fine", "bucket": str(tmp_path), "prefix": "fine"},
        {"type": "later", "name": "late"},
    ], readers={"later": lambda s, c: s.range(5).select(F.raise_error(F.lit("too late")).cast("long").alias("id"))},
        isolate=True)
    assert {r._source: r["count"] for r in union.groupBy("_source").count().collect()} == {"broken": 1000, "fine": 3}
    assert sorted(r.source for r in failed.collect()) == ["broken", "broken", "late"]


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["rows", "ledger", "commit"])
def test_each_id_once_after_a_failure(spark, tmp_path, step):
    source, root = tmp_path / "in", str(tmp_path / "out")
    for i in range(3):  # ids overlap between and within files
        rows = [(x, i) for x in range(10 * i, 10 * i + 15)] + [(10 * i, i)]
        spark.createDataFrame(rows, "id int, part int").coalesce(1).write.mode("append").parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))

    def die(name, batch):
        if (name, batch) == (step, 1):
            raise Killed(name)

    with pytest.raises(Exception, match="Killed"):
        run_once_per_id(stream, LedgerSink(root, "id", after=die))
    sink = LedgerSink(root, "id")
    run_once_per_id(stream, sink)
    assert sorted(r.id for r in sink.rows(spark, schema).collect()) == list(range(35))
    assert sorted(int(r.id) for r in sink.ledger(spark).collect()) == list(range(35))
    sink.compact(spark)
    assert sorted(int(r.id) for r in sink.ledger(spark).collect()) == list(range(35))
    spark.createDataFrame([(3, 9), (99, 9)], "id int, part int").write.mode("append").parquet(str(source))
    run_once_per_id(stream, sink)
    assert sorted(r.id for r in sink.rows(spark, schema).collect()) == [*range(35), 99]


def test_quota_state_ends_with_its_window(spark, tmp_path):
    from shelfcast.plans.queries import ROCKS, ROCKS_KEY

    begin, rows = datetime(2024, 1, 1), []
    for part in range(4):  # each part two hours later, with clients of its own
        for c in range(5):
            rows += [(part * 100 + c * 10 + i, begin + timedelta(hours=2 * part, minutes=5 * i), f"c{part}-{c}") for i in range(4)]
    rows.append((999, begin + timedelta(days=2), "last"))
    for i, some in enumerate([rows[20 * p:20 * p + 20] for p in range(5)]):
        spark.createDataFrame(some, "id bigint, ts timestamp, client string").coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    schema = spark.createDataFrame([], "id bigint, ts timestamp, client string").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(
        str(tmp_path / "in"))
    spark.conf.set(ROCKS_KEY, ROCKS)
    try:
        query = (
            jobs.anchored_quota_stream(stream, "id", 2, 3600, lateness="1 minute").writeStream.format("parquet")
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
            .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.unset(ROCKS_KEY)
    got = {r.request_id: (r.n, r.over_limit) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {**{i: ((i % 10) + 1, (i % 10) + 1 > 2) for i, _, _ in rows if i != 999}, 999: (1, False)}
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(totals) < 60 and totals[-1] <= 6  # of 21 clients only the last one's window is open
