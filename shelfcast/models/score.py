"""Scoring of frames and of prediction requests, batch or streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.models.train import PREDICTION, TrainedModel
from shelfcast.operators.lookup import latest_features
from shelfcast.operators.skew import broadcast_if_small, join_stream_per_key
from shelfcast.session import materialise

# The band around a prediction.
LOWER, UPPER = 0.85, 1.15

REQUEST_SCHEMA = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("store_id", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
])
RESPONSE_COLUMNS = ("request_id", "product_id", "predicted_quantity", "confidence_lower", "confidence_upper",
                    "model_version", "timestamp")

Scorer = Callable[[DataFrame], DataFrame]


def confidence_band(prediction: Column) -> dict[str, Column]:
    """Fixed share below and above; the bounds swap for a negative prediction."""
    return {"confidence_lower": prediction * LOWER, "confidence_upper": prediction * UPPER}


def score(df: DataFrame, trained: TrainedModel) -> DataFrame:
    """Rows with ``prediction`` and its band. Features absent from the frame raise ``ValueError``.

    A model without a feature list scores the ``features`` vector of the frame as it is.
    """
    if not trained.features:
        scored = trained.model.transform(df)
        return scored.withColumns(confidence_band(F.col(PREDICTION)))
    missing = [f for f in trained.features if f not in df.columns]
    if missing:
        raise ValueError(f"Missing features: {missing}")
    numbers = {f"_f{i}": F.col(f).cast("double") for i, f in enumerate(trained.features)}
    scored = trained.with_prediction(df.withColumns(numbers), list(numbers)).drop(*numbers)
    return scored.withColumns(confidence_band(F.col(PREDICTION)))


def linear_scorer(weights: dict[str, float], intercept: float = 0.0) -> Scorer:
    """A fixed linear model, for a deterministic run of the request path."""
    def run(df: DataFrame) -> DataFrame:
        total = F.lit(intercept)
        for name, weight in weights.items():
            total = total + F.col(name) * F.lit(weight)
        return df.withColumn(PREDICTION, total)

    return run


def model_scorer(trained: TrainedModel) -> Scorer:
    return lambda df: score(df, trained).drop("confidence_lower", "confidence_upper")


def parse_requests(raw: DataFrame, column: str = "value") -> DataFrame:
    """Request columns from JSON text, and the ``reason`` of those that must be rejected.

    A request needs ``product_id``, ``store_id`` and ``date`` as text; ``features`` may be absent and
    otherwise maps names to numbers. Works on streams; see :func:`split_rejects`.
    """
    texts = ("product_id", "store_id", "date")
    kept = [c for c in raw.columns if c != column]
    parts = raw.withColumn("_json", F.try_parse_json(column)).select(
        *kept,
        F.col("_json").isNull().alias("_unreadable"),
        *[F.try_variant_get("_json", f"$.{name}", "variant").alias(name) for name in (*texts, "features")],
    )
    values = F.col("features").try_cast("map<string,string>")
    read = parts.select(
        *kept,
        "_unreadable",
        *[F.when(F.schema_of_variant(f) == "STRING", F.col(f).try_cast("string")).alias(f) for f in texts],
        F.col("features").isNotNull().alias("_given"),
        F.transform_values(values, lambda _, v: v.try_cast("double")).alias("features"),
    )
    reason = F.when(F.col("_unreadable"), "not JSON")
    for f in texts:
        reason = reason.when(F.col(f).isNull(), f"{f} is missing or not text")
    no_numbers = F.col("features").isNull() | F.exists(F.map_values("features"), lambda v: v.isNull())
    reason = reason.when(F.col("_given") & no_numbers, "features must be numbers")
    empty = F.create_map().cast("map<string,double>")
    return read.withColumns({"features": F.coalesce("features", empty), "reason": reason}).drop(
        "_unreadable", "_given")


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted requests and the table of rejects."""
    rejected = F.col("reason").isNotNull()
    return parsed.filter(~rejected).drop("reason"), parsed.filter(rejected)


def score_requests(
    requests: DataFrame,
    store: DataFrame,
    scorer: Scorer,
    features: Sequence[str],
    model_version: str,
    keys: Sequence[str] = ("product_id", "store_id"),
    ts: str = "date",
    use_request_features: bool = False,
    stamp: bool = True,
) -> DataFrame:
    """Response rows for requests: latest features of the product in the store, prediction, band and stamps.

    The request side may be a stream; the store side is reduced to one row per entity, counted, and
    broadcast when small. Unknown entities get 0 for every feature. ``use_request_features`` lets the values
    sent with a request replace the stored ones.
    """
    features = list(features)
    known = latest_features(store.withColumns({k: F.col(k).cast("string") for k in keys}), keys, ts, features)
    table = materialise(known.select(*keys, F.struct(*features).alias("_stored")))
    n = table.count()
    if requests.isStreaming:
        rows = join_stream_per_key(requests, table, n, keys)
    else:
        rows = requests.join(broadcast_if_small(table, n), list(keys), "left")

    def value(f: str) -> Column:
        stored = F.coalesce(F.col(f"_stored.{f}").cast("double"), F.lit(0.0))
        return F.coalesce(F.col("features")[f], stored) if use_request_features else stored

    matrix = rows.withColumns({f"_x_{f}": value(f) for f in features}).drop("_stored")
    renamed = matrix.withColumn("_request", F.struct(*requests.columns)).select(
        "_request", *[F.col(f"_x_{f}").alias(f) for f in features])
    scored = scorer(renamed)
    band = confidence_band(F.col(PREDICTION))
    extra = [c for c in requests.columns if c not in ("product_id", "features")]
    out = scored.select(
        F.col("_request.product_id").alias("product_id"),
        F.col(PREDICTION).alias("predicted_quantity"),
        *[c.alias(name) for name, c in band.items()],
        F.lit(model_version).alias("model_version"),
        *[F.col(f"_request.{c}").alias(c) for c in extra],
    )
    if not stamp:
        return out
    return out.withColumns({"request_id": F.expr("uuid()"), "timestamp": F.current_timestamp()}).select(
        *RESPONSE_COLUMNS, *[c for c in extra if c not in RESPONSE_COLUMNS])
