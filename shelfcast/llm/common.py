"""Definitions that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import store_table

# A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
# Rows of a narrow table that one range of a global order holds.
RANGE_ROWS = 1_000_000


def count_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; of no bytes for null."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def running_totals(
    rows: DataFrame, order: list[str], sums: dict[str, str]
) -> tuple[DataFrame, dict[str, int]]:
    """Add, for each ``{new: column}``, the sum of the integer column over all earlier rows of a global order.

    Also returns the sum over all rows for each new column (0 for an empty table).

    The (narrow) rows are stored, range-partitioned and sorted. Per-partition totals, as many rows as
    partitions, give each partition its offset; the rest is a running sum inside partitions. No task
    holds more than one range, and rows that tie in ``order`` are spread by their stored number, so a
    key may hold any share of the rows. Rows equal in ``order`` must be interchangeable to the caller.
    """
    spark = rows.sparkSession
    stored = store_table(rows.withColumn("_tie", F.monotonically_increasing_id()), "totals-input")
    by = [*order, "_tie"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored.count() // RANGE_ROWS))
    placed = store_table(
        stored.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()),
        "totals-ranges")
    per_range = placed.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_offset_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()]).first()
    # One row per range: the bound of the broadcast is the number of partitions.
    placed = placed.join(F.broadcast(offsets), "_range").select(
        *rows.columns,
        *[(F.col(f"_offset_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()])
    return placed, {n: int(whole[n]) for n in sums}
