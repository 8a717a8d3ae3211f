"""Run a stream to the end of its input and read back what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from shelfcast.session import scratch_path


def drain(writer: DataStreamWriter, path: str, checkpoint: str) -> None:
    """Process everything that is there, exactly once per checkpoint, then stop."""
    query = (
        writer.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_to_table(stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Append a stream to a Parquet table and return the table.

    Giving the same ``path`` and ``checkpoint`` again continues where the last run stopped.
    """
    spark: SparkSession = stream.sparkSession
    base = scratch_path(spark, label)
    target = path or f"{base}/data"
    drain(stream.writeStream.outputMode("append"), target, checkpoint or f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(target)


def run_by_batch(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every micro-batch to ``each``; a batch repeated after a failure has the same id."""
    query = (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_totals(stream: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Final state of an aggregation with the given keys, windows that are still open included.

    Each batch writes the rows that changed; the last batch that wrote a group holds its total.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/data")
    values = F.struct(*[c for c in stream.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("v")).select(*keys, "v.*")
