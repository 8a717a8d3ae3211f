"""Rows to forecast: every key for each of the next days, with the last known history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.operators.skew import any_null

# Fixed value: stated forecast horizon in days.
HORIZON_DAYS = 30


def horizon_frame(
    df: DataFrame, keys: Sequence[str], date_col: str = "date", known: Sequence[str] = ("quantity",),
    days: int = HORIZON_DAYS,
) -> DataFrame:
    """``days`` future rows per observed key combination, starting after the last date of the data.

    Each row carries the key's last known values and its age, so a model can score every horizon
    directly. Only combinations that occur are expanded, never a product of the key columns.
    """
    last_day = df.agg(F.max(F.to_date(date_col)).alias("d")).first()["d"]
    values = F.struct(date_col, *known)
    last = df.groupBy(*keys).agg(F.max_by(values, values).alias("last"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(days))).alias("horizon")
    return last.select(*keys, "last", steps).select(
        *keys,
        "horizon",
        F.date_add(F.lit(last_day), F.col("horizon")).alias(date_col),
        *[F.col(f"last.{c}").alias(f"last_{c}") for c in known],
        F.datediff(F.date_add(F.lit(last_day), F.col("horizon")), F.col(f"last.{date_col}")).alias("days_since_last"),
    )


def horizon_training(
    df: DataFrame, keys: Sequence[str], date_col: str = "date", target: str = "quantity",
    known: Sequence[str] = ("quantity",), days: int = HORIZON_DAYS,
) -> DataFrame:
    """Rows to fit a model of all horizons on: for each row and horizon, its known values and the target that
    many days later.

    The input has one row per key and day. A row is kept for the horizons whose day the key has, so gaps give no
    labels. Each row collects the at most ``days`` targets after it from a window of its key: rows are shuffled
    once, not once per horizon.
    """
    dated = df.withColumn("_day", F.to_date(date_col))
    dated = dated.filter(~any_null([*keys, "_day"]))
    following = Window.partitionBy(*keys).orderBy(F.unix_date("_day")).rangeBetween(1, days)
    targets = F.collect_list(F.struct(F.col("_day").alias("day"), F.col(target).alias("label"))).over(following)
    rows = dated.select(*keys, "_day", *[F.col(c).alias(f"last_{c}") for c in known], targets.alias("_targets"))
    joined = rows.withColumn("_target", F.explode("_targets")).select(
        *keys, *[f"last_{c}" for c in known], F.col("_target.day").alias("_target_day"),
        F.col("_target.label").alias("label"), F.date_diff("_target.day", "_day").alias("horizon"))
    return joined.select(*keys, "horizon", F.col("_target_day").alias(date_col),
                         *[f"last_{c}" for c in known], F.col("horizon").alias("days_since_last"), "label")
