"""Summaries of a request log: ``ts, client, method, endpoint, status, latency_s``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.operators.skew import MAX_GROUP_ROWS, number_rows

# Quota per client and window, and the name of requests without a client.
UNKNOWN_CLIENT = "unknown"
LIMIT = 100
WINDOW_SECONDS = 60
# Latency bucket bounds in seconds.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def status_label(status: Column, compat: bool = False) -> Column:
    """``compat`` labels every client error 401, as a single shared counter label."""
    return F.when(status.between("400", "499"), "401").otherwise(status) if compat else status


def request_counts(log: DataFrame, window: str | None = None, compat: bool = False) -> DataFrame:
    """Requests by method, endpoint and status, per time window if one is given; batch or streaming."""
    by: list[Column | str] = ["method", "endpoint", status_label(F.col("status"), compat).alias("status")]
    if window:
        by = [F.window("ts", window).alias("window"), *by]
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"))


def bucket_name(bound: float) -> str:
    return "le_" + f"{bound:g}".replace(".", "_")


def latency_histogram(log: DataFrame, buckets: Sequence[float] = LATENCY_BUCKETS, success: str = "200") -> DataFrame:
    """Cumulative buckets, sum and count of successful requests by method and endpoint."""
    ok = log.filter(F.col("status") == success)
    return ok.groupBy("method", "endpoint").agg(
        *[F.count_if(F.col("latency_s") <= b).alias(bucket_name(b)) for b in buckets],
        F.sum("latency_s").alias("latency_sum"),
        F.count("latency_s").alias("latency_count"),
        F.percentile_approx("latency_s", 0.95, 10000).alias("latency_p95"),
    )


def request_edges(log: DataFrame, grain: str = "second") -> DataFrame:
    """``at, change``: one more open request at each start, one less at each end; batch or streaming.

    A request without a latency has started and not ended; one without a time is left out.
    """
    end = F.timestamp_add("MICROSECOND", F.round(F.col("latency_s") * 1_000_000).cast("bigint"), F.col("ts"))
    edge = F.explode(F.array(
        F.struct(F.col("ts").alias("at"), F.lit(1).alias("change")),
        F.struct(end.alias("at"), F.lit(-1).alias("change")),
    )).alias("e")
    edges = log.filter(F.col("ts").isNotNull()).select(edge).filter("e.at is not null")
    return edges.select(F.date_trunc(grain, "e.at").alias("at"), "e.change")


def running_gauge(changes: DataFrame) -> DataFrame:
    """``at, change, active`` from the change at each time.

    The running sum goes over days (one row each) and inside each day, so no task sees the whole time line.
    """
    changes = changes.withColumn("day", F.to_date("at"))
    days = changes.groupBy("day").agg(F.sum("change").alias("change"))
    before_day = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("day", F.coalesce(F.sum("change").over(before_day), F.lit(0)).alias("before"))
    in_day = Window.partitionBy("day").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = changes.withColumn("running", F.sum("change").over(in_day))
    return running.join(days, "day").select("at", "change", (F.col("before") + F.col("running")).alias("active"))


def active_requests(log: DataFrame, grain: str = "second") -> DataFrame:
    """Open requests after each second in which one starts or ends; starts and ends first shrink to one change
    per second."""
    return running_gauge(request_edges(log, grain).groupBy("at").agg(F.sum("change").alias("change")))


def quota_usage(log: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Requests per client and aligned window, with the remaining quota; batch or streaming."""
    counts = log.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "client").agg(
        F.count(F.lit(1)).alias("requests"))
    used = F.col("requests")
    return counts.select(
        "client", F.col("w.start").alias("window_start"), "requests",
        F.greatest(F.lit(0), limit - used).alias("remaining"),
        F.greatest(F.lit(0), used - limit).alias("rejected"),
    )


def number_in_window(
    log: DataFrame, order: Sequence[str], limit: int = LIMIT, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Rank of each request in its client's ``window_start``, what it leaves, and if it is over the limit.

    ``order`` is a strict order of requests. Requests without a client share one quota.
    """
    shared = log.withColumn("_client", F.coalesce(F.col("client").cast("string"), F.lit(UNKNOWN_CLIENT)))
    numbered = number_rows(shared, ["_client", "window_start"], order, max_rows=max_rows)
    return numbered.drop("_client").withColumns({
        "remaining": F.greatest(F.lit(0), limit - F.col("n")),
        "over_limit": F.col("n") > limit,
    })


def quota_aligned(
    log: DataFrame, order: Sequence[str], limit: int = LIMIT, seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """Quota state of every request in windows aligned to the clock."""
    start = F.window("ts", f"{seconds} seconds")["start"]
    return number_in_window(log.withColumn("window_start", start), order, limit)
