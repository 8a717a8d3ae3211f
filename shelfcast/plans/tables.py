"""The given tables seen as sales rows and as a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sales row per line item. The line item's own columns settle ties in date order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("date"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("store_id"),
        F.col("l_quantity").alias("quantity"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        "l_orderkey", "l_linenumber", "l_extendedprice",
    )


ROW_ORDER = ("l_orderkey", "l_linenumber", "l_extendedprice", "quantity")


def sales_daily(spark: SparkSession, sf_dir: str, key: str = "product_id") -> DataFrame:
    """One row per product (or store) and day, so that date order within a key is strict."""
    rows = sales_rows(spark, sf_dir)
    amount = F.sum("l_extendedprice")
    return rows.groupBy(key, "date").agg(
        F.sum("quantity").alias("quantity"), F.try_divide(amount, F.sum("quantity")).alias("price"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log."""
    return request_columns(table(spark, sf_dir, "events"))


def request_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("client"),
        F.lit("POST").alias("method"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
        (F.col("value") / 1000).alias("latency_s"),
    )
