"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.calendar import add_seasonal_features, add_time_features, parse_dates
from shelfcast.functions.numeric import add_interactions, numeric_columns
from shelfcast.models import score as scoring
from shelfcast.models.select import eliminate_features, select_by_correlation, select_by_importance
from shelfcast.models.store import load_model, production_versions, save_model
from shelfcast.models.train import Trainer, metrics_table
from shelfcast.operators import incremental, lookup, metrics, quality, quota, requestlog, sketches
from shelfcast.operators.aggregates import add_group_statistics, add_past_statistics, group_statistics
from shelfcast.operators.encode import (
    LabelCodes,
    OneHot,
    SparseOneHot,
    StandardScale,
    align_columns,
    prepare_matrix,
)
from shelfcast.operators.history import add_history_features
from shelfcast.operators.horizon import horizon_frame, horizon_training
from shelfcast.operators.split import time_split
from shelfcast.plans.features import FeatureConfig, fit_features, unscaled_features
from shelfcast.plans.tables import (
    ROW_ORDER,
    request_columns,
    requests,
    sales_daily,
    sales_rows,
    table,
)
from shelfcast.session import materialise, scratch_path, store_table
from shelfcast.sources import collect, files, kafka, sinks
from shelfcast.sources.isolate import list_files, read_isolated
from shelfcast.streaming import jobs
from shelfcast.streaming.exactly_once import LedgerSink, run_once_per_id
from shelfcast.streaming.run import run_to_table, run_totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Calendar inside the range of the sales dates.
SALES_HOLIDAYS = ("1996-12-25", "1998-07-04", "2000-01-01", "2001-11-22")
# The request log is sparse, so its quota windows are a day long with a small limit.
DAY_SECONDS = 86_400
DAY_LIMIT = 3
# A low cut so that the chunked path runs on the test tables.
SMALL_GROUP = 200
# About the most rows that a fit sees in selection, importances and horizons; training and batch scoring fit on all.
FIT_ROWS = 20_000
MODEL_FEATURES = ("quantity_lag_1", "quantity_lag_7", "quantity_roll_mean_7", "price")
SCORE_WEIGHTS = {"quantity": 0.5, "price": 0.01}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def shown(df: DataFrame, places: int = 4) -> DataFrame:
    """Comparable output: rounded numbers, dates as text, flags as 0/1.

    Rounding is spelled out because engines settle decimal ties of ``round`` differently.
    """
    def form(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.floor(c * 10.0**places + 0.5) / 10.0**places
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        return c.alias(f.name)

    return df.select(*[form(f) for f in df.schema.fields])


def daily_history(
    spark: SparkSession, d: str, lags=(), windows=(), statistics=(), price: str | None = None, **options
) -> DataFrame:
    return add_history_features(
        sales_daily(spark, d), ["product_id"], ["date"], price=price, lags=lags, windows=windows,
        statistics=statistics, max_rows=None, **options)


# --- calendar ---------------------------------------------------------------------------------


@query
def time_features(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("date"))
    return shown(add_time_features(orders, holidays=SALES_HOLIDAYS).drop("date"))


@query
def holiday_distance(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "ts")
    return add_time_features(events, "ts").select("event_id", "days_until_holiday", "weeks_until_holiday")


@query
def seasonal(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("date"))
    return shown(add_seasonal_features(orders).drop("date"))


# --- lags and rolling windows -----------------------------------------------------------------


@query
def lag_features(spark: SparkSession, d: str) -> DataFrame:
    return shown(daily_history(spark, d, lags=(1, 7, 14, 30)).drop("price"))


@query
def price_lags(spark: SparkSession, d: str) -> DataFrame:
    return shown(daily_history(spark, d, lags=(1, 7, 14, 30), price="price"))


@query
def price_lags_all(spark: SparkSession, d: str) -> DataFrame:
    rows = daily_history(spark, d, lags=(1, 7, 14, 30), price="price", price_lags=(1, 7, 14, 30))
    return shown(rows.select("product_id", "date", "price_lag_1", "price_lag_7", "price_lag_14", "price_lag_30"))


@query
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return shown(daily_history(spark, d, windows=(7, 14, 30), statistics=("mean",)).drop("price"))


@query
def rolling_std(spark: SparkSession, d: str) -> DataFrame:
    return shown(daily_history(spark, d, windows=(7, 14, 30), statistics=("std",)).drop("price"))


@query
def rolling_min_max(spark: SparkSession, d: str) -> DataFrame:
    return shown(daily_history(spark, d, windows=(7, 14, 30), statistics=("min", "max")).drop("price"))


@query
def rolling_price(spark: SparkSession, d: str) -> DataFrame:
    return shown(daily_history(spark, d, windows=(7, 14, 30), price="price"))


@query
def rolling_min_periods(spark: SparkSession, d: str) -> DataFrame:
    return shown(daily_history(spark, d, windows=(7, 14), statistics=("mean", "std", "min", "max"), min_periods=1)
                 .drop("price"))


def _store_history(spark: SparkSession, d: str, **options) -> DataFrame:
    rows = add_history_features(
        sales_rows(spark, d), ["store_id"], ["date", "product_id", *ROW_ORDER], price=None, lags=(1, 30),
        windows=(90,), **options)
    return shown(rows.drop("price", "l_extendedprice"))


@query
def store_rows_history(spark: SparkSession, d: str) -> DataFrame:
    return _store_history(spark, d, strict=False)


@query
def store_rows_history_chunked(spark: SparkSession, d: str) -> DataFrame:
    return _store_history(spark, d, strict=False, max_rows=SMALL_GROUP)


@query
def product_store_history(spark: SparkSession, d: str) -> DataFrame:
    rows = add_history_features(
        sales_rows(spark, d), ["product_id", "store_id"], ["date", *ROW_ORDER], price=None, lags=(1,), windows=(2,),
        statistics=("mean",), strict=False)
    return shown(rows.drop("price", "l_extendedprice"))


# --- group statistics and interactions --------------------------------------------------------


@query
def group_aggregates(spark: SparkSession, d: str) -> DataFrame:
    rows = sales_rows(spark, d).select("product_id", "date", "quantity", "price")
    return shown(add_group_statistics(rows, ["product_id"]), 3)


@query
def store_nunique(spark: SparkSession, d: str) -> DataFrame:
    rows = sales_rows(spark, d).select("product_id", "store_id", "quantity")
    stats = group_statistics(rows, ["product_id"])
    return shown(stats.select("product_id", "quantity_sum", "quantity_count", "store_id_nunique"))


def _past(spark: SparkSession, d: str, max_rows: int | None) -> DataFrame:
    rows = sales_rows(spark, d).drop("price")
    past = add_past_statistics(
        rows, ["store_id"], ["date", "product_id", *ROW_ORDER], max_rows=max_rows, strict=False)
    return shown(past.drop("l_extendedprice"), 3)


@query
def past_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return _past(spark, d, 1_000_000)


@query
def past_aggregates_chunked(spark: SparkSession, d: str) -> DataFrame:
    return _past(spark, d, SMALL_GROUP)


@query
def interactions(spark: SparkSession, d: str) -> DataFrame:
    rows = sales_rows(spark, d).select("l_orderkey", "l_linenumber", "quantity", "price")
    return shown(add_interactions(rows))


@query
def quantity_change(spark: SparkSession, d: str) -> DataFrame:
    rows = add_interactions(daily_history(spark, d, lags=(1,)))
    return shown(rows.select("product_id", "date", "quantity_change", "quantity_change_pct"))


@query
def daily_features(spark: SparkSession, d: str) -> DataFrame:
    """Calendar, lag, rolling, group, interaction and seasonal features of daily product sales."""
    daily = sales_daily(spark, d)
    config = FeatureConfig(
        lags=(1, 7, 14), windows=(7, 14), holidays=SALES_HOLIDAYS, max_group_rows=None)
    return shown(add_seasonal_features(unscaled_features(daily, config)), 3)


@query
def scaled_features(spark: SparkSession, d: str) -> DataFrame:
    """The fitted chain with encoding and scaling."""
    rows = sales_rows(spark, d).groupBy("product_id", "date").agg(
        F.sum("quantity").alias("quantity"),
        F.try_divide(F.sum("l_extendedprice"), F.sum("quantity")).alias("price"))
    graded = rows.withColumn("size", F.when(F.col("quantity") > 25, "large").otherwise("small"))
    config = FeatureConfig(lags=(1, 7), windows=(7,), holidays=SALES_HOLIDAYS, max_group_rows=None)
    _, features = fit_features(graded, config)
    return shown(features.select(
        "product_id", "date", "quantity", "price", "quantity_lag_1", "quantity_roll_mean_7", "quantity_mean",
        "is_weekend", "size_large", "size_small", "log_quantity", "quantity_change", "month_sin"), 3)


# --- encoding and scaling ---------------------------------------------------------------------


@query
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return OneHot.fit(orders, ["o_orderstatus", "o_orderpriority"]).transform(orders)


@query
def one_hot_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Names and segments of customers: as many categories as customers, as indices and values."""
    rows = table(spark, d, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    out = SparseOneHot.fit(rows, ["c_name", "c_mktsegment"]).transform(rows)
    return out.select("c_custkey", *[F.array_join(f"one_hot_{x}", ",").alias(x) for x in ("indices", "values")])


@query
def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        F.lit(1.0).alias("constant"))
    return shown(StandardScale.fit(rows, ["l_orderkey", "l_linenumber"]).transform(rows))


@query
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return LabelCodes.fit(part, ["p_brand", "p_type"]).transform(part)


@query
def label_encode_unseen(spark: SparkSession, d: str) -> DataFrame:
    """Codes fitted on part types, applied to market segments: shared words keep a code, others get 0."""
    part = table(spark, d, "part").select(F.col("p_name").alias("name"))
    names = table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("name"))
    both = names.unionByName(table(spark, d, "part").select(
        (-1 - F.col("p_partkey")).alias("c_custkey"), F.col("p_name").alias("name")))
    return LabelCodes.fit(part, ["name"]).transform(both)


@query
def align(spark: SparkSession, d: str) -> DataFrame:
    matrix = prepare_matrix(table(spark, d, "lineitem"), "l_shipdate")
    return shown(align_columns(matrix, ["l_tax", "l_quantity", "not_there", "l_orderkey"]))


# --- selection, split, error, drift -----------------------------------------------------------


@query
def correlation_select(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("constant", F.lit(1.0))
    names = ["l_extendedprice", "l_discount", "l_tax", "l_linenumber", "constant"]
    return shown(select_by_correlation(rows, names, "l_quantity", 4))


@query
def time_split_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = sales_rows(spark, d).drop("price")
    split = time_split(rows, tie_break=["product_id", "store_id", *ROW_ORDER])
    return shown(split.select("l_orderkey", "l_linenumber", "product_id", "date", "split"))


def _naive(spark: SparkSession, d: str, lag: int = 7) -> DataFrame:
    return daily_history(spark, d, lags=(lag,)).withColumnRenamed(f"quantity_lag_{lag}", "forecast")


@query
def split_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = time_split(store_table(_naive(spark, d), "naive"), tie_break=["product_id"])
    return shown(metrics.regression_metrics(rows, "quantity", "forecast"))


@query
def naive_forecast_kpis(spark: SparkSession, d: str) -> DataFrame:
    rows = daily_history(spark, d, lags=(1, 7, 14, 30))
    steps = F.explode(F.array(*[
        F.struct(F.lit(k).alias("horizon"), F.col(f"quantity_lag_{k}").alias("forecast")) for k in (1, 7, 14, 30)]))
    long = rows.select("quantity", steps.alias("s")).select("quantity", "s.*")
    return shown(metrics.forecast_kpis(long, "quantity", "forecast", "horizon", scale=50.0))


@query
def drift_psi(spark: SparkSession, d: str) -> DataFrame:
    rows = sales_rows(spark, d)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    baseline, current = rows.filter(F.col("date") < cut), rows.filter(F.col("date") >= cut)
    edges = metrics.quantile_edges(baseline, "quantity")
    days = current.withColumn("day", F.to_date("date"))
    return shown(metrics.population_stability(baseline, days, "quantity", edges, ["day"]))


@query
def weekly_degradation(spark: SparkSession, d: str) -> DataFrame:
    rows = _naive(spark, d)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    error = F.abs(F.col("quantity") - F.col("forecast"))
    baseline = rows.filter(F.col("date") < cut).agg(F.avg(error)).first()[0]
    later = rows.filter(F.col("date") >= cut)
    return shown(metrics.weekly_degradation(later, "quantity", "forecast", "date", baseline))


@query
def horizon(spark: SparkSession, d: str) -> DataFrame:
    return shown(horizon_frame(sales_daily(spark, d), ["product_id"], known=("quantity", "price")))


@query
def horizon_scores(spark: SparkSession, d: str) -> DataFrame:
    frame = horizon_frame(sales_daily(spark, d, "store_id"), ["store_id"], known=("quantity", "price"))
    scorer = scoring.linear_scorer({"last_quantity": 0.5, "last_price": 0.01})
    scored = scorer(frame)
    return shown(scored.withColumns(scoring.confidence_band(F.col("prediction"))).select(
        "store_id", "horizon", "date", "prediction", "confidence_lower", "confidence_upper"))


@query
def horizon_labels(spark: SparkSession, d: str) -> DataFrame:
    """Rows and labels of each horizon that a model of all horizons is fitted on."""
    rows = horizon_training(sales_daily(spark, d, "store_id"), ["store_id"], known=("quantity", "price"))
    return shown(rows.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").alias("labels"), F.sum("last_quantity").alias("last")), 2)


@query
def horizon_model(spark: SparkSession, d: str) -> DataFrame:
    """All horizons of each store scored by a saved and loaded model: whether the score is the model's own."""
    daily = store_table(sales_daily(spark, d, "store_id"), "store-days")
    training = horizon_training(daily, ["store_id"], known=("quantity", "price"))
    trainer = Trainer("random_forest", target="label", tie_break=("store_id", "horizon"), fit_rows=FIT_ROWS,
                      hyperparameters={"n_estimators": 10, "max_depth": 5})
    # A tenth of the days, drawn by their date, is enough to fit the bounded number of rows.
    trained = trainer.train(training.filter(F.xxhash64("date") % 10 == 0))
    path = scratch_path(spark, "horizon-model")
    save_model(trained, path)
    frame = store_table(horizon_frame(daily, ["store_id"], known=("quantity", "price")), "horizon-frame")
    scored = scoring.model_scorer(load_model(spark, path))(frame).select("store_id", "horizon", "date", "prediction")
    own = trained.predict(frame).select("store_id", "horizon", F.col("prediction").alias("own"))
    same = (F.abs(F.col("prediction") - F.col("own")) < 1e-9).cast("int")
    return shown(scored.join(own, ["store_id", "horizon"]).select("store_id", "horizon", "date", same.alias("same")))


# --- validation -------------------------------------------------------------------------------

CUSTOMER_RULES = [
    {"type": "sales"},
    {"type": "range", "column": "sales", "min": 0, "max": 5000},
    {"type": "schema", "schema": {"required": ["segment", "email"], "types": {"segment": "float"}}},
    {"type": "data_type", "types": {"product_id": "int", "name": "str"}},
    {"type": "unheard_of"},
]


def _accounts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("product_id"), F.col("c_acctbal").alias("sales"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


@query
def quality_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _accounts(spark, d)
    return quality.count_checks(rows, quality.configured_checks(rows, CUSTOMER_RULES))


@query
def quality_result(spark: SparkSession, d: str) -> DataFrame:
    result = quality.validate(_accounts(spark, d), CUSTOMER_RULES)
    frame = quality.result_frame(spark, [("load", result)])
    return frame.select("stage", F.col("is_valid").cast("int").alias("is_valid"),
                        F.explode("errors").alias("error"), F.col("metadata")["row_count"].alias("row_count"))


@query
def quality_history(spark: SparkSession, d: str) -> DataFrame:
    """Results of three tables stored, and the newest two read back."""
    path = scratch_path(spark, "quality")
    for i, name in enumerate(("orders", "lineitem", "customer")):
        result = quality.run_checks(table(spark, d, name), [])
        sinks.append_results(spark, path, [(name, result)], datetime(2024, 1, 1 + i))
    newest = sinks.newest_results(spark, path, 2)
    return newest.select("stage", F.col("metadata")["row_count"].alias("row_count"))


@query
def quality_counts_at_load(spark: SparkSession, d: str) -> DataFrame:
    """The same counters, gathered while the rows are written."""
    rows = _accounts(spark, d)
    checks = quality.configured_checks(rows, CUSTOMER_RULES)
    return quality.write_counted(rows, checks, scratch_path(spark, "loaded"))


@query
def tagged_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _accounts(spark, d)
    checks = quality.sales_checks(rows, ("product_id", "sales")) + quality.range_checks(rows, "sales", 0, 5000)
    tagged = quality.tag_rows(rows, checks)
    return tagged.select("product_id", F.array_join("_errors", ",").alias("broken"))


@query
def forecast_quality(spark: SparkSession, d: str) -> DataFrame:
    forecasts = table(spark, d, "customer").select(
        F.col("c_custkey").alias("product_id"), F.col("c_acctbal").alias("predicted_demand"))
    return quality.count_checks(forecasts, quality.forecast_checks(forecasts, reject_null=True))


@query
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = daily_history(spark, d, lags=(1, 7)).select("product_id", "quantity", "quantity_lag_1", "quantity_lag_7")
    return shown(quality.null_profile(rows))


# --- incremental loads ------------------------------------------------------------------------


@query
def incremental_antijoin(spark: SparkSession, d: str) -> DataFrame:
    ledger = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return shown(incremental.unseen(table(spark, d, "orders"), ledger, "o_orderkey"))


@query
def incremental_dedupe(spark: SparkSession, d: str) -> DataFrame:
    ledger = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    batch = sales_rows(spark, d).drop("price")
    return shown(incremental.unseen(batch, ledger, "l_orderkey", dedupe_within_batch=True, newest_by="date"))


@query
def high_water_mark(spark: SparkSession, d: str) -> DataFrame:
    return shown(incremental.high_water_mark(sales_rows(spark, d), ["store_id"]))


@query
def high_water_mark_merge(spark: SparkSession, d: str) -> DataFrame:
    """Marks of orders and line items per order; a mark never moves back."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    earlier = incremental.high_water_mark(orders, ["l_orderkey"], "o_orderdate")
    return shown(incremental.high_water_mark(sales_rows(spark, d), ["l_orderkey"], previous=earlier))


@query
def default_window(spark: SparkSession, d: str) -> DataFrame:
    end = F.lit("2000-06-30").cast("timestamp_ntz")
    return shown(incremental.since_mark(sales_rows(spark, d).drop("price"), None, end=end))


@query
def ledger_trim(spark: SparkSession, d: str) -> DataFrame:
    ledger = table(spark, d, "events").select("event_id", "ts")
    return incremental.trim_ledger(ledger, "ts", above=5000, keep=2500, tie_break=["event_id"]).select("event_id")


@query
def ledger_update(spark: SparkSession, d: str) -> DataFrame:
    """Ledger of orders extended by the order ids of line items."""
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit(0).cast("bigint").alias("seq"))
    return incremental.mark_seen(orders, table(spark, d, "lineitem"), "l_orderkey", F.col("l_orderkey") + 1)


# --- feature lookup and scoring ---------------------------------------------------------------


@query
def bucketed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The newest features of all parts from a store in buckets of the product."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), "p_brand")
    name = f"daily_store_{uuid.uuid4().hex}"
    store = lookup.BucketedStore.write(
        sales_daily(spark, d), name, ["product_id"], "date", 8, scratch_path(spark, "bucketed"))
    found = store_table(store.online(parts, ["quantity", "price", "stock"]), "looked-up")
    store.drop(spark)
    return shown(found)


@query
def online_lookup(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), "p_brand")
    store = sales_daily(spark, d)
    return shown(lookup.online_features(parts, store, ["product_id"], "date", ["quantity", "price", "stock"]))


def _order_times(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("product_id"), "l_orderkey", "l_linenumber")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return lines.join(orders, "l_orderkey")


def _point_in_time(spark: SparkSession, d: str, **options) -> DataFrame:
    entities = _order_times(spark, d)
    found = lookup.historical_features(
        entities, sales_daily(spark, d), ["product_id"], "o_orderdate", "date", ["quantity", "price"], **options)
    return shown(found)


@query
def point_in_time_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _point_in_time(spark, d)


@query
def point_in_time_lookup_chunked(spark: SparkSession, d: str) -> DataFrame:
    return _point_in_time(spark, d, max_rows=25)


@query
def confidence_band(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("prediction"))
    return shown(rows.withColumns(scoring.confidence_band(F.col("prediction"))))


@query
def registry_latest(spark: SparkSession, d: str) -> DataFrame:
    registry = table(spark, d, "part").select(
        F.col("p_type").alias("model_name"), F.col("p_partkey").alias("version"),
        F.when(F.col("p_size") > 25, "Production").otherwise("Staging").alias("stage"),
        F.concat(F.lit("models/"), F.col("p_partkey")).alias("path"))
    return production_versions(registry)


def _requests(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("l_partkey").cast("string").alias("product_id"), F.col("l_suppkey").cast("string").alias("store_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.create_map(F.lit("price"), F.col("l_tax") * 100).alias("features"),
        "l_orderkey", "l_linenumber")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Daily sales of each product in each store."""
    return sales_rows(spark, d).groupBy("product_id", "store_id", "date").agg(
        F.sum("quantity").alias("quantity"),
        F.try_divide(F.sum("l_extendedprice"), F.sum("quantity")).alias("price"))


def _responses(spark: SparkSession, d: str, lines: DataFrame, own: bool) -> DataFrame:
    return scoring.score_requests(
        _requests(lines), _stored(spark, d), scoring.linear_scorer(SCORE_WEIGHTS), list(SCORE_WEIGHTS), "1.0.0",
        use_request_features=own, stamp=False)


@query
def request_scoring(spark: SparkSession, d: str) -> DataFrame:
    return shown(_responses(spark, d, table(spark, d, "lineitem"), own=False))


@query
def request_scoring_overrides(spark: SparkSession, d: str) -> DataFrame:
    return shown(_responses(spark, d, table(spark, d, "lineitem"), own=True))


@query
def request_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Stamped responses, reduced to what does not change between runs."""
    stamped = scoring.score_requests(
        _requests(table(spark, d, "lineitem")), _stored(spark, d), scoring.linear_scorer(SCORE_WEIGHTS),
        list(SCORE_WEIGHTS), "1.0.0")
    return stamped.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("responses"), F.count_distinct("request_id").alias("ids"),
        F.count("timestamp").alias("stamped"))


def _request_texts(spark: SparkSession, d: str) -> DataFrame:
    """Requests as JSON text: returned lines lack the product, and open ones carry text as a value."""
    lines = table(spark, d, "lineitem")
    returned, opened = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    body = F.struct(
        F.when(~returned, F.col("l_partkey").cast("string")).alias("product_id"),
        F.col("l_suppkey").cast("string").alias("store_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.struct(F.col("l_tax").alias("tax"), F.when(opened, "high").alias("level")).alias("features"))
    return lines.select("l_orderkey", "l_linenumber", F.to_json(body).alias("value"))


@query
def request_parsing(spark: SparkSession, d: str) -> DataFrame:
    parsed = scoring.parse_requests(_request_texts(spark, d))
    good = F.col("reason").isNull()
    fields = [F.when(good, F.col(c)).alias(c) for c in ("product_id", "store_id", "date")]
    return shown(parsed.select(
        "l_orderkey", "l_linenumber", *fields, F.when(good, F.col("features")["tax"]).alias("tax"), "reason"))


# --- request log ------------------------------------------------------------------------------


@query
def request_counts(spark: SparkSession, d: str) -> DataFrame:
    return requestlog.request_counts(requests(spark, d))


@query
def request_counts_hourly(spark: SparkSession, d: str) -> DataFrame:
    counts = requestlog.request_counts(requests(spark, d), "1 hour", compat=True)
    return shown(counts.withColumn("hour", F.col("window.start")).drop("window"))


@query
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return shown(requestlog.latency_histogram(requests(spark, d)))


@query
def active_requests(spark: SparkSession, d: str) -> DataFrame:
    slow = requests(spark, d).withColumn("latency_s", F.col("latency_s") * 10_000)
    return shown(requestlog.active_requests(slow))


@query
def quota_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return shown(requestlog.quota_usage(requests(spark, d), DAY_LIMIT, DAY_SECONDS))


@query
def quota_aligned(spark: SparkSession, d: str) -> DataFrame:
    log = requestlog.quota_aligned(requests(spark, d), ["ts", "event_id"], DAY_LIMIT, DAY_SECONDS)
    return shown(log.select("event_id", "client", "window_start", "n", "remaining", "over_limit"))


def _anchored(spark: SparkSession, d: str, limit: int, seconds: int, **options) -> DataFrame:
    windows = quota.anchored_windows(requests(spark, d), seconds, **options)
    log = requestlog.number_in_window(windows, ["ts", "event_id"], limit)
    return shown(log.select("event_id", "client", "window_start", "n", "remaining", "over_limit"))


@query
def quota_anchored(spark: SparkSession, d: str) -> DataFrame:
    return _anchored(spark, d, DAY_LIMIT, DAY_SECONDS)


@query
def quota_anchored_chunked(spark: SparkSession, d: str) -> DataFrame:
    """Every client counts as busy: its time line is cut into blocks, composed over several levels."""
    return _anchored(spark, d, 2, 6 * 3600, max_rows=25, fan_in=2)


@query
def quota_remaining(spark: SparkSession, d: str) -> DataFrame:
    log = requests(spark, d)
    windows = quota.anchored_windows(log, DAY_SECONDS)
    return shown(quota.remaining_quota(log, windows, "2024-01-15 12:00:00", DAY_LIMIT, DAY_SECONDS))


@query
def daily_latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and 95th percentile per endpoint and day, merged from sketches stored per hour: whether the rank of
    each among the day's requests is within the stated error."""
    log = requests(spark, d).withColumn("hour", F.date_trunc("hour", "ts"))
    hourly = store_table(sketches.quantile_sketches(log, "latency_s", ["endpoint", "hour"]), "hourly")
    daily = sketches.merged_quantiles(
        hourly.withColumn("day", F.to_date("hour")), ["endpoint", "day"], {"p50": 0.5, "p95": 0.95})
    rows = log.select("endpoint", F.to_date("ts").alias("day"), "latency_s").join(daily, ["endpoint", "day"])
    shares = [("p50", 0.5), ("p95", 0.95)]
    ranks = rows.groupBy("endpoint", "day", "n", "least", "most").agg(*[
        F.count_if(c).alias(f"{name}_{p}") for p, _ in shares
        for name, c in (("below", F.col("latency_s") < F.col(p)), ("upto", F.col("latency_s") <= F.col(p)))])
    # A value has all the ranks of its ties; a quantile of n values is right within one value.
    slack = F.lit(sketches.RANK_ERROR) + 1 / F.col("n")
    return shown(ranks.select("endpoint", "day", "n", "least", "most", *[
        ((F.col(f"below_{p}") / F.col("n") <= q + slack) & (F.col(f"upto_{p}") / F.col("n") >= q - slack)).cast(
            "int").alias(f"{p}_in_bound") for p, q in shares]), 6)


@query
def rolling_distinct_exact(spark: SparkSession, d: str) -> DataFrame:
    """Different stores that sold each product in the seven days up to each of its days."""
    return shown(sketches.rolling_distinct(sales_rows(spark, d), "store_id", ["product_id"], exact=True))


@query
def rolling_distinct_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Different products sold in the seven days up to each day, from one sketch per day: whether the estimate is
    within four standard errors of the exact number."""
    rows = table(spark, d, "lineitem").select("l_linestatus", "l_partkey", F.col("l_shipdate").alias("date"))
    exact = sketches.rolling_distinct(rows, "l_partkey", ["l_linestatus"], exact=True, name="products")
    about = sketches.rolling_distinct(rows, "l_partkey", ["l_linestatus"], name="estimate")
    bound = 4 * 1.04 / 2 ** (sketches.DISTINCT_BITS / 2)
    near = (F.abs(F.col("estimate") - F.col("products")) <= bound * F.col("products") + 1).cast("int")
    return shown(exact.join(about, ["l_linestatus", "date"]).withColumn("in_bound", near).drop("estimate"))


@query
def service_kpis(spark: SparkSession, d: str) -> DataFrame:
    return shown(metrics.service_kpis(requests(spark, d), "ts", "latency_s", ["endpoint"]))


# --- sources and sinks ------------------------------------------------------------------------


@query
def source_union(spark: SparkSession, d: str) -> DataFrame:
    root, scale = os.path.split(d.rstrip("/"))
    union, _ = collect.collect_sources(spark, [
        {"type": "s3", "name": "prefix", "bucket": d, "prefix": "customer.parquet"},
        {"type": "s3", "name": "broken", "bucket": d, "prefix": "no_such_folder"},
        {"type": "huggingface", "name": "shards", "root": root, "dataset": scale, "split": "supplier.parquet"},
        {"type": "carrier_pigeon", "name": "unknown"},
    ])
    return union.drop("_ingestion_timestamp").withColumn(
        "_source_file", F.element_at(F.split("_source_file", "/"), -1))


@query
def message_decode(spark: SparkSession, d: str) -> DataFrame:
    """Event properties as topic messages; those of errors arrive cut off, those of views empty."""
    props = F.col("props")
    broken = F.when(F.col("event_type") == "error", F.substring(props, 1, 4)).when(
        F.col("event_type") != "view", props)
    messages = table(spark, d, "events").select(
        broken.alias("value"), (F.col("user_id") % 8).cast("int").alias("partition"),
        F.col("event_id").alias("offset"))
    return kafka.decode_messages(messages, T.StructType([T.StructField("k", T.LongType())]))


@query
def date_parsing(spark: SparkSession, d: str) -> DataFrame:
    text = table(spark, d, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.concat("o_orderpriority", F.date_format("o_orderdate", "yyyy")).alias("created_at"))
    return shown(parse_dates(text))


@query
def csv_source(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    customers = table(spark, d, "customer")
    customers.write.option("header", True).csv(path)
    return files.read_csv(spark, path, customers.schema)


@query
def json_source(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "json")
    customers = table(spark, d, "customer")
    customers.write.json(path)
    return files.read_json(spark, path, customers.schema, lines=True)


@query
def new_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of the folder that the ledger does not hold yet; a table stored as a folder is one entry."""
    listing = files.list_entries(spark, d)
    ledger = listing.select("path").filter(F.col("path").startswith("part"))
    return incremental.new_files(listing, ledger)


@query
def feature_view(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "views")
    stats = group_statistics(sales_rows(spark, d), ["product_id"], price=None, store=None)
    old, fresh = datetime(2024, 1, 1), datetime(2024, 1, 1, 2)
    sinks.write_feature_view(stats, path, "products", F.lit(fresh))
    stores = group_statistics(sales_rows(spark, d), ["store_id"], price=None, store=None)
    sinks.write_feature_view(stores.withColumnRenamed("store_id", "product_id"), path, "products", F.lit(old))
    rows = sinks.read_feature_view(spark, path, "products", now=datetime(2024, 1, 1, 2, 30))
    return shown(rows.drop("_written_at"))


@query
def feature_view_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Newest order of each customer, written in two overlapping parts; a third part has expired."""
    path = scratch_path(spark, "live")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    cut, later = F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz")
    early, late = orders.filter(F.col("o_orderdate") < cut), orders.filter(F.col("o_orderdate") >= later)
    order = ["o_orderdate", "o_orderkey", "o_totalprice"]
    old = early.withColumn("o_custkey", -1 - F.col("o_custkey"))
    for part, at in ((old, datetime(2024, 1, 1)), (early, datetime(2024, 1, 3, 23)), (late, datetime(2024, 1, 4, 1))):
        sinks.upsert_feature_view(part, path, "orders", ["o_custkey"], F.lit(at), newest_by=order)
    rows = sinks.read_live_view(spark, path, "orders", ttl=4 * 3600, now=datetime(2024, 1, 4, 2))
    return shown(rows.drop("_written_at"))


@query
def isolated_files(spark: SparkSession, d: str) -> DataFrame:
    """Customers from several files, one of which is no table, and how many files were left out."""
    path = scratch_path(spark, "mixed")
    customers = table(spark, d, "customer")
    customers.repartition(4, "c_custkey").write.parquet(path)
    customers.select(F.to_json(F.struct("*"))).coalesce(1).write.mode("append").text(path)
    rows, broken = read_isolated(spark, list_files(spark, path), customers.schema)
    return rows.drop("_source_file").withColumn("left_out", F.lit(broken.count()))


# --- streams ----------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query
def stream_file_ingest(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "orders").schema
    stream = files.stream_prefix(spark, d, schema, glob="orders.parquet")
    rows = run_to_table(stream, "ingest").drop("_ingestion_timestamp")
    return shown(rows.withColumn("_source_file", F.element_at(F.split("_source_file", "/"), -1)))


@query
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "lineitem").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    unique = jobs.dedupe_stream(lines, ["l_orderkey"], "l_shipdate", "3650 days")
    return run_to_table(unique.select("l_orderkey"), "dedup")


@query
def stream_request_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = jobs.windowed_counts(request_columns(_event_stream(spark, d)), "1 hour")
    flat = counts.withColumn("hour", F.col("window.start")).drop("window")
    return shown(run_totals(flat, "counts", ["method", "endpoint", "status", "hour"]))


@query
def stream_active_requests(spark: SparkSession, d: str) -> DataFrame:
    """The gauge of open requests from changes kept as state, over several batches in time order."""
    log = request_columns(_in_time_order(spark, d)).withColumn("latency_s", F.col("latency_s") * 10_000)
    changes = run_totals(jobs.gauge_changes(log, lateness="30 days"), "gauge", ["at"])
    return shown(requestlog.running_gauge(changes))


@query
def stream_quota(spark: SparkSession, d: str) -> DataFrame:
    usage = jobs.windowed_quota(request_columns(_event_stream(spark, d)), DAY_LIMIT, DAY_SECONDS)
    return shown(run_totals(usage, "quota", ["client", "window_start"]))


ROCKS_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _anchored_stream(spark: SparkSession, events: DataFrame, **options) -> DataFrame:
    before = spark.conf.get(ROCKS_KEY, None)
    spark.conf.set(ROCKS_KEY, ROCKS)
    try:
        log = request_columns(events)
        rows = run_to_table(jobs.anchored_quota_stream(log, "event_id", DAY_LIMIT, DAY_SECONDS, **options), "anchored")
    finally:
        spark.conf.unset(ROCKS_KEY) if before is None else spark.conf.set(ROCKS_KEY, before)
    return shown(rows.withColumnRenamed("request_id", "event_id"))


@query
def stream_quota_anchored(spark: SparkSession, d: str) -> DataFrame:
    return _anchored_stream(spark, _event_stream(spark, d))


def _in_time_order(spark: SparkSession, d: str, parts: int = 4) -> DataFrame:
    """Events as a stream of files, each later than the one before, a batch each."""
    path = scratch_path(spark, "events")
    events = table(spark, d, "events")
    edges = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(
        F.min("t").alias("a"), F.max("t").alias("b")).first()
    at = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(edges["a"])) * parts
    part = F.floor(at / F.lit(max(1, edges["b"] - edges["a"] + 1)))
    # Files are read by age, and one write after the other makes the age follow the time.
    for i in range(parts):
        events.filter(part == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def stream_quota_expiring(spark: SparkSession, d: str) -> DataFrame:
    """The same windows over several batches, with state that ends when its window has ended."""
    return _anchored_stream(spark, _in_time_order(spark, d), lateness="1 hour")


@query
def stream_once_per_id(spark: SparkSession, d: str) -> DataFrame:
    """Order keys of line items in several batches, one of them killed between its rows and its ledger."""
    path, root = scratch_path(spark, "lines"), scratch_path(spark, "once")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    lines.repartition(4, "l_shipdate").write.parquet(path)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(path)

    def stop(step: str, batch: int) -> None:
        if (step, batch) == ("rows", 1):
            raise InterruptedError("killed on purpose")

    with contextlib.suppress(StreamingQueryException):
        run_once_per_id(stream, LedgerSink(root, "l_orderkey", after=stop))
    sink = LedgerSink(root, "l_orderkey")
    run_once_per_id(stream, sink)
    held = sink.ledger(spark).select(F.col("id").cast("long").alias("l_orderkey"), F.lit(1).alias("in_ledger"))
    return sink.rows(spark, lines.schema).select("l_orderkey").join(held, "l_orderkey", "full")


@query
def stream_scoring(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "lineitem").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    return shown(run_to_table(_responses(spark, d, lines, own=False), "scored"))


# --- models -----------------------------------------------------------------------------------


def _training_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = daily_history(spark, d, lags=(1, 7), windows=(7,), statistics=("mean",))
    return rows.select("product_id", "date", "quantity", *MODEL_FEATURES)


def _train(spark: SparkSession, d: str, model_type: str) -> DataFrame:
    """Rows per part, whether the fit explains its own part, and what the run log holds."""
    path = scratch_path(spark, "runs")
    trained = Trainer(model_type, tie_break=("product_id",), log_root=path).train(_training_rows(spark, d))
    logged = spark.read.parquet(f"{path}/run_metrics").filter(F.col("run_id") == trained.run_id)
    explains = F.when(F.col("split") == "train", (F.col("r2") > 0).cast("int"))
    rows = trained.metrics.select("split", F.col("n").alias("rows"), explains.alias("explains"))
    return rows.join(logged.groupBy("split").agg(F.count(F.lit(1)).alias("logged")), "split")


@query
def train_gbt(spark: SparkSession, d: str) -> DataFrame:
    return _train(spark, d, "gradient_boosting")


@query
def train_rf(spark: SparkSession, d: str) -> DataFrame:
    return _train(spark, d, "random_forest")


@query
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """Every feature with a share of an importance of one."""
    trainer = Trainer("random_forest", tie_break=("product_id",), fit_rows=FIT_ROWS)
    rows = trainer.train(_training_rows(spark, d)).importances()
    total = F.round(F.sum("importance").over(Window.partitionBy()), 6)
    return rows.select("feature", (F.col("importance") >= 0).cast("int").alias("valid"), total.alias("total"))


# An amount is quantity times price; the other columns say nothing about it.
AMOUNT_FEATURES = ("l_discount", "l_quantity", "l_tax", "price", "l_linenumber", "l_partkey", "l_suppkey")
# The size of the forests that selection grows here; their rows are those of a fit.
SELECT_FOREST = {"trees": 20, "depth": 8, "fit_rows": FIT_ROWS}


def _amounts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("price", F.try_divide("l_extendedprice", "l_quantity"))
    return lines.select("l_extendedprice", *AMOUNT_FEATURES)


@query
def importance_select(spark: SparkSession, d: str) -> DataFrame:
    """The two features of seven that an amount depends on, the stronger first."""
    rows = select_by_importance(_amounts(spark, d), AMOUNT_FEATURES, "l_extendedprice", 2, **SELECT_FOREST)
    return rows.select("rank", "feature")


@query
def rfe_select(spark: SparkSession, d: str) -> DataFrame:
    """The two features left when the weakest go one by one, with their place in the original order."""
    rows = _amounts(spark, d)
    names = eliminate_features(rows, AMOUNT_FEATURES, "l_extendedprice", 2, **SELECT_FOREST)
    return spark.createDataFrame(list(enumerate(names, start=1)), "place int, feature string")


@query
def batch_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Train, save, load and score every row with the loaded model: whether it predicts what the trained one does,
    the band as a share of the prediction, and whether all predictions err less than the mean would."""
    rows = store_table(_training_rows(spark, d), "scoring-rows")
    trained = Trainer("random_forest", tie_break=("product_id",)).train(rows)
    path = scratch_path(spark, "model")
    save_model(trained, path)
    loaded = load_model(spark, path)
    filled = rows.na.fill(0.0, [c for c in numeric_columns(rows) if c in MODEL_FEATURES])
    scored = store_table(scoring.score(filled, loaded), "scored")
    # Both predictions of a row stand beside each other; a join would shuffle all rows twice.
    own = trained.predict(scored.withColumnRenamed("prediction", "loaded")).withColumnsRenamed(
        {"prediction": "own", "loaded": "prediction"})

    def equal(name: str, value: Column) -> Column:
        return (F.abs(F.col(name) - value) < 1e-9).cast("int").alias(name)

    error = scored.agg((F.avg((F.col("quantity") - F.col("prediction")) ** 2) < F.var_pop("quantity")).cast("int")).first()[0]
    return shown(own.select(
        "product_id", "date", equal("prediction", F.col("own")),
        equal("confidence_lower", 0.85 * F.col("prediction")), equal("confidence_upper", 1.15 * F.col("prediction")),
        F.lit(error).alias("better_than_mean")))
