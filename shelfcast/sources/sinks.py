"""Tables written by the jobs: feature views, run logs, validation history."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.incremental import latest_per_key
from shelfcast.operators.quality import ValidationResult, result_frame
from shelfcast.session import store_table

# Fixed value: lifetime of stored feature rows in seconds.
TTL_SECONDS = 3600


def write_feature_view(df: DataFrame, path: str, view: str, written_at: Column | None = None) -> None:
    """Append rows to a view; each view is a partition of the table."""
    stamped = df.withColumns({
        "_view": F.lit(view),
        "_written_at": F.current_timestamp() if written_at is None else written_at,
    })
    stamped.write.mode("append").partitionBy("_view").parquet(path)


def read_feature_view(
    spark: SparkSession, path: str, view: str, ttl: int | None = TTL_SECONDS, now: datetime | None = None
) -> DataFrame:
    """Rows of a view that have not expired."""
    rows = spark.read.parquet(path).filter(F.col("_view") == view)
    if ttl is None:
        return rows.drop("_view")
    at = F.current_timestamp() if now is None else F.lit(now)
    return rows.filter(F.col("_written_at") > at - F.make_dt_interval(secs=F.lit(ttl))).drop("_view")


# Key buckets of a view with one live row per key.
BUCKETS = 16


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _drop_partitions(spark: SparkSession, folders: Sequence[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def upsert_feature_view(
    df: DataFrame, path: str, view: str, keys: Sequence[str], written_at: Column | None = None,
    newest_by: Sequence[str] = (), buckets: int = BUCKETS,
) -> None:
    """Write rows to a view that holds one live row per key: the last written one.

    The view is partitioned by write date and key bucket. Rows equal in key within ``df`` are settled by write
    time and ``newest_by``. Only partitions that gain or lose a row are overwritten, dynamically: those of the new
    rows, and those of older dates from which a key moves; the others are not even read beyond their keys. The
    new content is stored before anything is replaced, so an upsert that fails half-way can be run again. One
    writer at a time.
    """
    spark = df.sparkSession
    at = F.current_timestamp() if written_at is None else written_at
    stamped = df.withColumn("_written_at", at.cast("timestamp"))
    newest = latest_per_key(stamped, list(keys), ["_written_at", *newest_by])
    place = {"_view": F.lit(view), "_date": F.to_date("_written_at"), "_bucket": _bucket(keys, buckets)}
    new = store_table(newest.withColumns(place), "upsert-rows")
    where, parts = f"{path.rstrip('/')}/_view={view}", ["_date", "_bucket"]
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        new.write.partitionBy("_view", *parts).mode("append").parquet(path)
        return
    old = spark.read.parquet(path).filter(F.col("_view") == view).select(*new.columns)
    arriving = new.select(*keys, F.col("_bucket"), F.col("_written_at").alias("_arriving"))
    # A row that was written later than the arriving one stays.
    matched = store_table(old.join(arriving, [*keys, "_bucket"]).select(
        *keys, *parts, (F.col("_arriving") >= F.col("_written_at")).alias("_gone")), "upsert-matches")
    lasting = new.join(matched.filter("not _gone").select(*keys, "_bucket"), [*keys, "_bucket"], "left_anti")
    gone = matched.filter("_gone").select(*keys, *parts)
    touched = store_table(gone.select(*parts).unionByName(lasting.select(*parts)).distinct(), "upsert-partitions")
    # A partition's number is a date and a bucket: as many rows as the view has folders, at most.
    kept = old.join(F.broadcast(touched), parts, "left_semi").join(gone, [*keys, *parts], "left_anti")
    merged = store_table(kept.unionByName(lasting.select(*kept.columns)), "upsert-merged")
    emptied = touched.join(merged.select(*parts).distinct(), parts, "left_anti").collect()
    merged.write.partitionBy("_view", *parts).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    _drop_partitions(spark, [f"{where}/_date={r['_date']}/_bucket={r['_bucket']}" for r in emptied])


def read_live_view(
    spark: SparkSession, path: str, view: str, ttl: int | None = TTL_SECONDS, now: datetime | None = None
) -> DataFrame:
    """Live rows of an upserted view that have not expired; folders of expired dates are not opened."""
    rows = spark.read.parquet(path).filter(F.col("_view") == view)
    if ttl is not None:
        # The bound is a literal, so that the dates of folders are compared when the plan is made.
        oldest = F.lit((now or datetime.now(timezone.utc).replace(tzinfo=None)) - timedelta(seconds=ttl)).cast("timestamp")
        rows = rows.filter((F.col("_date") >= F.to_date(oldest)) & (F.col("_written_at") > oldest))
    return rows.drop("_view", "_date", "_bucket")


def log_run(
    spark: SparkSession, root: str, run_id: str, params: dict[str, object], metrics: DataFrame
) -> None:
    """Append parameters and long-format metrics of a run."""
    rows = [(run_id, k, str(v)) for k, v in params.items()]
    spark.createDataFrame(rows, "run_id string, name string, value string").write.mode("append").parquet(
        f"{root}/runs")
    metrics.write.mode("append").parquet(f"{root}/run_metrics")


def append_results(
    spark: SparkSession, path: str, results: Sequence[tuple[str, ValidationResult]], at: datetime | None = None
) -> None:
    stamp = F.current_timestamp() if at is None else F.lit(at)
    result_frame(spark, results).withColumn("stored_at", stamp).write.mode("append").parquet(path)


def newest_results(spark: SparkSession, path: str, n: int) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.col("stored_at").desc()).limit(n)
