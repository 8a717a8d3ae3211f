"""Message topics: reading and decoding. The Kafka connector jar must be on the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def topic_stream(
    spark: SparkSession, servers: str, topic: str, batch_size: int | None = None, group: str | None = None
) -> DataFrame:
    """A topic from its earliest offset. Offsets are committed through the query's checkpoint.

    ``batch_size`` bounds the messages of a micro-batch; by default it takes all there are.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    reader = reader.option("maxOffsetsPerTrigger", batch_size) if batch_size else reader
    return (reader.option("kafka.group.id", group) if group else reader).load()


def topic_batch(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """All messages a topic holds now."""
    return (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )


def _is_record(value: Column) -> Column:
    """Whether a text is a JSON object, whatever the types of its fields."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))


def decode_messages(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON values as columns plus ``_partition`` and ``_offset``; a field of another type is null.

    Null values and texts that are no JSON object are dropped; ``rejected_messages`` lists them. Works on
    batches and streams.
    """
    text = F.col("value").cast("string")
    decoded = messages.filter(_is_record(text)).select(
        F.from_json(text, schema, {"mode": "PERMISSIVE"}).alias("r"),
        F.col("partition").alias("_partition"), F.col("offset").alias("_offset"))
    return decoded.select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields], "_partition", "_offset")


def rejected_messages(messages: DataFrame) -> DataFrame:
    """``value, reason, _partition, _offset`` of the messages that do not decode."""
    text = F.col("value").cast("string")
    reason = F.when(text.isNull(), "no value").when(F.try_parse_json(text).isNull(), "not JSON").otherwise("no object")
    return messages.filter(~_is_record(text)).select(
        text.alias("value"), reason.alias("reason"),
        F.col("partition").alias("_partition"), F.col("offset").alias("_offset"))
