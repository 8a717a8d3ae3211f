"""Contiguous shards of near-equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import running_totals, text_bytes, text_crc32

ROW_OVERHEAD = 8


def row_size(text: Column) -> Column:
    """Bytes a row takes: its text and a fixed overhead; a null text has no bytes."""
    return text_bytes(text) + F.lit(ROW_OVERHEAD)


def assign_shards(rows: DataFrame, order: list[str], size: str, shards: int) -> DataFrame:
    """Add ``shard`` (0-based) and ``slot`` (0-based place in the shard) to narrow ``rows``.

    Rows are taken in the order of ``order``, nulls first. The row whose middle byte lies in the k-th of
    ``shards`` equal parts of all bytes goes to shard k, so shards are contiguous, and each differs from
    the equal share by at most one row's size. Rows equal in ``order`` are told apart by ``size``; rows
    equal in both are interchangeable. A single row larger than a share leaves some shards empty. An
    empty table gives an empty result. Sizes must be positive.
    """
    marked = rows.withColumn("_one", F.lit(1).cast("bigint"))
    placed, totals = running_totals(marked, [*order, size], {"_before": size, "_rank": "_one"})
    wide = "decimal(38,0)"
    middle = (F.col("_before").cast("decimal(20,0)") * F.lit(2 * shards) + F.col(size) * F.lit(shards)).cast(wide)
    shard = F.floor(middle / F.lit(2 * max(totals["_before"], 1)).cast("decimal(20,0)")).cast("int")
    sharded = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)))
    first = F.broadcast(sharded.groupBy("shard").agg(F.min("_rank").alias("_first")))  # one row per shard
    return sharded.join(first, "shard").select(
        *rows.columns, "shard", (F.col("_rank") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place of each document: key, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Texts are read once and never shuffled. Null texts count as empty; null keys come first; repeated
    keys are ordered by checksum, then size. Other columns are ignored, whatever their names.
    """
    narrow = docs.select(
        F.col(key).alias("key"), row_size(F.col(text)).alias("size"), text_crc32(F.col(text)).alias("text_crc32"))
    return assign_shards(narrow, ["key", "text_crc32"], "size", shards).withColumnRenamed("key", key)


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the documents as Parquet folders ``shard=k``, sorted by key.

    Shards are contiguous in (key, checksum, size), so the first row of each shard tells where a document
    belongs: the texts are joined with nothing and shuffled once. Rows equal to the first row of a shard
    all go to that shard.
    """
    placed = shard_documents(docs, shards, key, text)
    parts = [key, "text_crc32", "size"]
    firsts = placed.groupBy("shard").agg(F.min(F.struct(*parts)).alias("first")).orderBy("shard")
    own = F.struct(F.col(key), text_crc32(F.col(text)), row_size(F.col(text)))
    shard = F.lit(0)
    for row in firsts.collect():  # at most ``shards`` rows
        cut = F.struct(*[F.lit(row["first"][c]).cast(placed.schema[c].dataType) for c in parts])
        shard = F.when(own >= cut, F.lit(row["shard"])).otherwise(shard)
    docs.withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions("shard", key).write.partitionBy(
        "shard").parquet(path)
