"""Missing-value handling and arithmetic on target and price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    """Number columns; booleans are not numbers here."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make missing values uniform: NaN compares as largest in Spark, null does not compare."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def relative_change(change: Column, base: Column) -> Column:
    return F.try_divide(change, base + 1) * 100


def add_interactions(df: DataFrame, target: str = "quantity", price: str = "price") -> DataFrame:
    """Revenue, logarithms and the change against the previous row, as far as the inputs exist.

    ``log1p`` of -1 or less is null.
    """
    added: dict[str, Column] = {}
    if target in df.columns and price in df.columns:
        revenue = F.col(target) * F.col(price)
        added["revenue"] = revenue
        added["log_quantity"] = F.log1p(target)
        added["log_price"] = F.log1p(price)
        added["log_revenue"] = F.log1p(revenue)
    if "quantity_lag_1" in df.columns:
        previous = F.col("quantity_lag_1")
        change = F.col(target) - previous
        added["quantity_change"] = change
        added["quantity_change_pct"] = relative_change(change, previous)
    return df.withColumns(added) if added else df
