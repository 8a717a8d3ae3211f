"""Forecast error by split, horizon or week, and drift of a value between periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.operators.skew import broadcast_if_small
from shelfcast.session import materialise

# Stated quality bounds.
MAX_RMSE = 0.15
MAX_MAPE = 10.0
MIN_ACCURACY = 90.0
ACCURACY_HORIZON = 7
MAX_DEGRADATION = 0.05
MAX_P95_SECONDS = 0.1
MIN_PER_SECOND = 500


def regression_metrics(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ("split",)
) -> DataFrame:
    """``mse, mae, r2`` and row count per group, in one combinable aggregation.

    A constant target has r2 1 if every prediction is right, else 0. The total sum of squares comes
    from ``var_pop``, which does not lose digits on large values.
    """
    error = F.col(actual) - F.col(predicted)
    known = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    sums = df.filter(known).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(actual).alias("_var"),
    )
    constant = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("_var") == 0, constant).otherwise(1 - F.try_divide("mse", "_var"))
    return sums.withColumn("r2", r2).drop("_var")


def long_metrics(metrics: DataFrame, run_id: Column, split: str = "split") -> DataFrame:
    """``(run_id, split, metric, value)`` rows."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mse", "mae", "r2")])
    return metrics.select(run_id.alias("run_id"), split, F.explode(values).alias("m")).select(
        "run_id", F.col(split).alias("split"), "m.metric", "m.value")


def forecast_kpis(
    df: DataFrame, actual: str, predicted: str, horizon: str, scale: float = 1.0, max_rmse: float = MAX_RMSE
) -> DataFrame:
    """RMSE on the scaled target, MAPE without zero actuals, and accuracy, against the stated bounds."""
    error = F.col(actual) - F.col(predicted)
    share = F.abs(F.try_divide(error, F.col(actual)))
    kpis = df.filter(error.isNotNull()).groupBy(horizon).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sqrt(F.avg(error * error)) / F.lit(scale)).alias("rmse"),
        (F.avg(share) * 100).alias("mape"),
    )
    accuracy = F.greatest(F.lit(0.0), 100 - F.col("mape"))
    return kpis.withColumns({
        "accuracy": accuracy,
        "rmse_ok": F.col("rmse") < max_rmse,
        "mape_ok": F.col("mape") < MAX_MAPE,
        "accuracy_ok": F.when(F.col(horizon) == ACCURACY_HORIZON, accuracy > MIN_ACCURACY),
    })


def weekly_degradation(
    df: DataFrame, actual: str, predicted: str, date_col: str, baseline_mae: float | None, limit: float = MAX_DEGRADATION
) -> DataFrame:
    """MAE per week against a baseline, with a flag for weeks that call for retraining.

    Without a baseline, or with one of 0, there is no change to speak of: both are null.
    """
    base = F.lit(baseline_mae).cast("double")
    week = F.date_trunc("week", F.col(date_col))
    weekly = regression_metrics(df.withColumn("week", F.to_date(week)), actual, predicted, ["week"])
    change = F.try_divide(F.col("mae") - base, base)
    return weekly.select("week", "n", "mae", change.alias("degradation"),
                         (change > limit).alias("retrain"))


def quantile_edges(df: DataFrame, column: str, buckets: int = 10, accuracy: int = 10000) -> list[float]:
    """Inner bucket edges of a baseline from a mergeable quantile sketch."""
    cuts = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(column, cuts, accuracy).alias("edges")).first()
    return sorted(set(row["edges"] or []))


def population_stability(
    baseline: DataFrame,
    current: DataFrame,
    column: str,
    edges: Sequence[float],
    by: Sequence[str],
    floor: float = 1e-4,
) -> DataFrame:
    """PSI of ``column`` per group of ``current`` against the baseline.

    Both sides shrink to bucket counts before anything is joined. An empty bucket counts as
    ``floor`` so that the logarithm exists.
    """
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + F.when(F.col(column) > e, 1).otherwise(0)
    buckets = len(edges) + 1
    ids = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")

    expected = baseline.filter(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy()  # at most `buckets` rows
    expected = materialise(expected.withColumn("share", F.col("n") / F.sum("n").over(total)))
    counts = current.filter(F.col(column).isNotNull()).groupBy(*by, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = counts.groupBy(*by).agg(F.sum("n").alias("rows")).select(*by, "rows", ids)
    filled = grid.join(counts, [*by, "bucket"], "left")
    filled = filled.join(
        broadcast_if_small(expected.select("bucket", F.col("share").alias("_base")), buckets), "bucket", "left")
    a = F.greatest(F.coalesce(F.col("n"), F.lit(0)) / F.col("rows"), F.lit(floor))
    b = F.greatest(F.coalesce(F.col("_base"), F.lit(0.0)), F.lit(floor))
    return filled.groupBy(*by).agg(F.max("rows").alias("rows"), F.sum((a - b) * F.log(a / b)).alias("psi"))


def service_kpis(log: DataFrame, ts: str, latency: str, by: Sequence[str]) -> DataFrame:
    """P95 latency and the busiest second of a request log, against the stated bounds."""
    per_second = log.groupBy(*by, F.date_trunc("second", F.col(ts)).alias("_second")).agg(
        F.count(F.lit(1)).alias("_n"))
    peaks = per_second.groupBy(*by).agg(F.max("_n").alias("peak_per_second"))
    latencies = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.percentile_approx(latency, 0.95, 10000).alias("p95"))
    return latencies.join(peaks, list(by)).withColumns({
        "latency_ok": F.col("p95") < MAX_P95_SECONDS,
        "throughput_ok": F.col("peak_per_second") > MIN_PER_SECOND,
    })
