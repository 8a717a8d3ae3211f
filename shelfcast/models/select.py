"""Feature selection by importance, recursive elimination, or correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Imputer
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from shelfcast.models.train import FEATURES, LABEL, assembler, importance_frame, in_fixed_order
from shelfcast.session import checkpoint_root, materialise, store_table

# Number of features kept, forest size and seed.
NUM_FEATURES = 50
TREES = 100
SEED = 42
# Depth of the selection forests: the deepest that MLlib grows.
DEPTH = 30
METHODS = ("importance", "rfe", "correlation")


def impute_means(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing values replaced by the column mean."""
    doubles = df.withColumns({f: F.col(f).cast("double") for f in features})
    return Imputer(strategy="mean", inputCols=list(features), outputCols=list(features)).fit(doubles).transform(doubles)


def _importances(df: DataFrame, features: list[str], trees: int, depth: int) -> DataFrame:
    vectors = assembler(features).transform(df).select(FEATURES, LABEL).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        forest = RandomForestRegressor(featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, maxDepth=depth, seed=SEED)
        return importance_frame(forest.fit(vectors), features)
    finally:
        vectors.unpersist()


def _labelled(df: DataFrame, features: Sequence[str], target: str, fit_rows: int | None = None) -> DataFrame:
    """Stored matrix in a fixed row order, since seeded bagging depends on it."""
    rows = store_table(df.filter(F.col(target).isNotNull()).select(
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
        F.col(target).cast("double").alias(LABEL)), "selection-rows")
    if fit_rows:
        share = min(1.0, fit_rows / max(1, rows.count()))
        rows = rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    return materialise(in_fixed_order(rows, [LABEL, *features]))


def select_by_importance(
    df: DataFrame, features: Sequence[str], target: str, k: int = NUM_FEATURES, trees: int = TREES, depth: int = DEPTH,
    fit_rows: int | None = None,
) -> DataFrame:
    """The ``k`` features with the highest forest importance, ranked."""
    checkpoint_root(df.sparkSession)
    table = _importances(_labelled(df, features, target, fit_rows), list(features), trees, depth)
    rank = F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature"))  # one row per feature
    return table.withColumn("rank", rank).filter(F.col("rank") <= k)


def eliminate_features(
    df: DataFrame, features: Sequence[str], target: str, k: int = NUM_FEATURES, step: int = 1,
    trees: int = TREES, depth: int = DEPTH, fit_rows: int | None = None,
) -> list[str]:
    """Drop the ``step`` weakest features per round until ``k`` are left, in the original order.

    The matrix is stored once and read by all rounds; ``fit_rows`` bounds its rows, drawn by a hash.
    """
    checkpoint_root(df.sparkSession)
    left = list(features)
    matrix = _labelled(df, left, target, fit_rows)
    while len(left) > k:
        rows = _importances(matrix, left, trees, depth).collect()  # one row per feature
        weakest = sorted(rows, key=lambda r: (r["importance"], -left.index(r["feature"])))
        gone = {r["feature"] for r in weakest[: min(step, len(left) - k)]}
        left = [f for f in left if f not in gone]
    return left


def correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``(feature, abs_corr)`` for all features in one aggregation; null for constant columns.

    Each pair uses the rows where both values are present.
    """
    def value(c: str) -> Column:
        number = F.col(c).cast("double")
        return F.when(~F.isnan(number), number)

    exprs: list[Column] = []
    for i, f in enumerate(features):
        x, y = value(f), value(target)
        both = x.isNotNull() & y.isNotNull()
        px, py = F.when(both, x), F.when(both, y)
        exprs.append(F.abs(F.try_divide(
            F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))).alias(f"c{i}"))
    row = df.agg(*exprs)
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("abs_corr"))
                      for i, f in enumerate(features)])
    return row.select(F.explode(items).alias("x")).select("x.*")


def select_by_correlation(df: DataFrame, features: Sequence[str], target: str, k: int = NUM_FEATURES) -> DataFrame:
    order = Window.orderBy(F.col("abs_corr").desc_nulls_last(), "feature")  # one row per feature
    ranked = correlations(df, features, target).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def select_features(
    df: DataFrame, features: Sequence[str], target: str, method: str = "importance", k: int = NUM_FEATURES,
    impute: bool = False, strict: bool = False, **options,
) -> list[str]:
    """Selected feature names. Any other method name means correlation, or raises with ``strict``."""
    if strict and method not in METHODS:
        raise ValueError(f"Unsupported selection method: {method}")
    data = impute_means(df, features) if impute else df
    if method == "rfe":
        return eliminate_features(data, features, target, k, **options)
    if method == "importance":
        table = select_by_importance(data, features, target, k, **options)
    else:
        table = select_by_correlation(data, features, target, k)
    return [r["feature"] for r in table.orderBy("rank").collect()]  # at most k names
