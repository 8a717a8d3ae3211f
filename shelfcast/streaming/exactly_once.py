"""Streams that write rows and a ledger of ids together, once each, whatever fails in between."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.incremental import unseen
from shelfcast.streaming.run import run_by_batch


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@dataclass(frozen=True)
class LedgerSink:
    """Folders below ``root``: ``rows``, ``ledger`` and ``commits``, each with a folder per batch.

    A batch writes its unseen rows, then their ids, then its commit, each by overwriting its own folder. A
    batch that is repeated after a failure, which has the same number, therefore replaces what its first try
    left. Readers and later batches see committed batches only. Ids are compared as text, a row without an id
    is always new.
    """

    root: str
    id_col: str
    newest_by: str | None = None
    # Called after each step with its name and the batch number; a test raises there.
    after: Callable[[str, int], None] | None = None

    def _step(self, name: str, batch: int) -> None:
        if self.after:
            self.after(name, batch)

    def _committed(self, spark: SparkSession, below: int | None = None) -> DataFrame:
        if not _exists(spark, f"{self.root}/commits"):
            return spark.createDataFrame([], "batch long")
        done = spark.read.schema("rows long, batch long").parquet(f"{self.root}/commits").select("batch")
        return done if below is None else done.filter(F.col("batch") < below)

    def ledger(self, spark: SparkSession, below: int | None = None) -> DataFrame:
        """``id, batch`` of all committed batches (before the number ``below``)."""
        done = self._committed(spark, below)
        if not _exists(spark, f"{self.root}/ledger"):
            return spark.createDataFrame([], "id string, batch long")
        ids = spark.read.schema("id string, batch long").parquet(f"{self.root}/ledger")
        return ids.join(F.broadcast(done), "batch", "left_semi")  # one row per batch

    def rows(self, spark: SparkSession, schema) -> DataFrame:
        """All rows of committed batches."""
        found = spark.read.schema(schema.add("batch", "long")).parquet(f"{self.root}/rows")
        return found.join(F.broadcast(self._committed(spark)), "batch", "left_semi").drop("batch")

    def write(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not self._committed(spark).filter(F.col("batch") == number).isEmpty():
            return  # its offsets alone were lost
        new = unseen(batch, self.ledger(spark, number), self.id_col, dedupe_within_batch=True, newest_by=self.newest_by)
        stored, ids = f"{self.root}/rows/batch={number}", f"{self.root}/ledger/batch={number}"
        new.write.mode("overwrite").parquet(stored)
        self._step("rows", number)
        # The ids are those of the stored rows, so both folders agree even if the batch is computed anew.
        written = spark.read.schema(batch.schema).parquet(stored)
        written.select(F.col(self.id_col).cast("string").alias("id")).filter("id is not null").write.mode(
            "overwrite").parquet(ids)
        self._step("ledger", number)
        written.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(
            f"{self.root}/commits/batch={number}")
        self._step("commit", number)

    def compact(self, spark: SparkSession, keep: Column | None = None, order: Sequence[str] = ("batch",)) -> None:
        """Put the ledger of all committed batches into the folder of the last one, so that a long-running load
        opens few files. ``keep`` leaves out ids that the source can no longer send."""
        from shelfcast.session import store_table

        last = self._committed(spark).agg(F.max("batch")).first()[0]
        if last is None:
            return
        ids = self.ledger(spark)
        all_ids = store_table((ids.filter(keep) if keep is not None else ids).select("id").distinct(), "ledger")
        all_ids.write.mode("overwrite").parquet(f"{self.root}/ledger/batch={last}")
        done = [r["batch"] for r in self._committed(spark, last).collect()]  # one row per batch
        for number in done:  # a crash here leaves ids twice, which changes nothing
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/ledger/batch={number}")
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run_once_per_id(stream: DataFrame, sink: LedgerSink, checkpoint: str | None = None) -> None:
    """Run a stream to the end of its input. Start it again after a failure: each id is then written once."""
    run_by_batch(stream, sink.write, checkpoint or f"{sink.root}/checkpoint")
