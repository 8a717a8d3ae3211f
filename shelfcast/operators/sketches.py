"""Summaries that are stored per period and merged, so that longer periods do not read the rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size of a quantile sketch: the rank error is about 1.33 % at 200 and falls nearly as 1 / k.
QUANTILE_K = 1600
RANK_ERROR = 0.005
# Registers of a distinct sketch, as a power of two: the relative standard error is 1.04 / 2 ** (bits / 2).
DISTINCT_BITS = 14


def quantile_sketches(df: DataFrame, value: str, by: Sequence[Column | str], k: int = QUANTILE_K) -> DataFrame:
    """One mergeable quantile sketch per group: ``sketch, n, least, most`` of the values that are not null."""
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(
        F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"),
        F.min(v).alias("least"), F.max(v).alias("most"))


def merged_quantiles(
    sketches: DataFrame, by: Sequence[Column | str], quantiles: dict[str, float], k: int = QUANTILE_K
) -> DataFrame:
    """Quantiles of coarser groups from the sketches of finer ones; no row of the input is read."""
    merged = sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("_merged"), F.sum("n").alias("n"),
        F.min("least").alias("least"), F.max("most").alias("most"))
    return merged.select(
        "*", *[F.kll_sketch_get_quantile_double("_merged", F.lit(float(q))).alias(n) for n, q in quantiles.items()]
    ).drop("_merged")


def distinct_sketches(
    df: DataFrame, value: str, keys: Sequence[str], date_col: str = "date", bits: int = DISTINCT_BITS
) -> DataFrame:
    """One mergeable sketch of distinct values per key and day."""
    return df.groupBy(*keys, F.to_date(date_col).alias(date_col)).agg(
        F.hll_sketch_agg(F.col(value).cast("string"), F.lit(bits)).alias("sketch"))


def _covered(days: DataFrame, keys: Sequence[str], date_col: str, width: int) -> DataFrame:
    """Each row for each of the ``width`` days whose window it lies in, of those days that the key has."""
    own = days.select(*keys, date_col).distinct()
    spread = days.withColumn(date_col, F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.date_add(F.col(date_col), i))))
    return spread.join(own, [*keys, date_col], "left_semi")


def rolling_distinct(
    df: DataFrame, value: str, keys: Sequence[str], date_col: str = "date", width: int = 7, exact: bool = False,
    bits: int = DISTINCT_BITS, name: str = "distinct",
) -> DataFrame:
    """Distinct values of each key in the ``width`` days that end with each of its days.

    Windows allow no distinct counts. By default each day's sketch is made once and merged into the days whose
    window holds it, so the work grows with days, not rows. ``exact`` spreads the distinct (key, day, value)
    rows instead and counts them.
    """
    keys = list(keys)
    if exact:
        rows = df.select(*keys, F.to_date(date_col).alias(date_col), F.col(value).alias("_value")).distinct()
        # A value counts for a window once: its days of one window fall together before they are counted.
        spread = _covered(rows, keys, date_col, width).distinct()
        return spread.groupBy(*keys, date_col).agg(F.count("_value").alias(name))
    days = distinct_sketches(df, value, keys, date_col, bits)
    return _covered(days, keys, date_col, width).groupBy(*keys, date_col).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))
