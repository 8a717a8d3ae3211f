"""Training of tree ensembles on a labelled frame."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from shelfcast.functions.numeric import numeric_columns, string_columns
from shelfcast.models.forest import Forest, forest_of, forest_prediction
from shelfcast.operators.encode import LabelCodes
from shelfcast.operators.metrics import long_metrics, regression_metrics
from shelfcast.operators.split import time_split
from shelfcast.session import checkpoint_root, materialise, store_table
from shelfcast.sources.sinks import log_run

log = logging.getLogger(__name__)

# Rows of a partition of a training matrix.
PARTITION_ROWS = 1_000_000
FIT_PARTITIONS = 8

# Hyperparameters used where none are given.
DEFAULTS: dict[str, dict[str, Any]] = {
    "xgboost": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6, "random_state": 42},
    "random_forest": {"n_estimators": 100, "max_depth": 10, "random_state": 42},
    "gradient_boosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 5, "random_state": 42},
}
FEATURES, LABEL, PREDICTION = "features", "label", "prediction"


def make_estimator(model_type: str, hyperparameters: dict[str, Any] | None = None, prefer_xgboost: bool = True):
    """Estimator for a model type; ``xgboost`` uses its Spark estimator where installed, else MLlib GBT."""
    if model_type not in DEFAULTS:
        raise ValueError(f"Unsupported model type: {model_type}")
    p = {**DEFAULTS[model_type], **(hyperparameters or {})}
    if model_type == "random_forest":
        return RandomForestRegressor(
            featuresCol=FEATURES, labelCol=LABEL, numTrees=p["n_estimators"], maxDepth=p["max_depth"],
            seed=p["random_state"], checkpointInterval=10)
    if model_type == "xgboost" and prefer_xgboost:
        try:
            from xgboost.spark import SparkXGBRegressor

            return SparkXGBRegressor(features_col=FEATURES, label_col=LABEL, **p)
        except ImportError:
            log.info("xgboost is not installed; training MLlib gradient-boosted trees")
    return GBTRegressor(
        featuresCol=FEATURES, labelCol=LABEL, maxIter=p["n_estimators"], stepSize=p["learning_rate"],
        maxDepth=p["max_depth"], seed=p["random_state"], checkpointInterval=10)


def in_fixed_order(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """The rows in partitions and an order that depend on nothing but their values.

    Seeded bagging draws per partition, so a fit repeats only if the same rows share a partition in the same
    order, whatever files they were read from. Rows equal in all columns are interchangeable.
    """
    parts = max(FIT_PARTITIONS, -(-matrix.count() // PARTITION_ROWS))
    return matrix.repartition(parts, F.xxhash64(*columns)).sortWithinPartitions(*columns)


def assembler(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol=FEATURES, handleInvalid="keep")


@dataclass
class TrainedModel:
    """A fitted model with its ordered features and label dictionaries."""

    model: Model | PipelineModel
    features: list[str]
    codes: LabelCodes | None = None
    metrics: DataFrame | None = None
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows with ``prediction``, encoded and aligned as in training; the input columns stay."""
        carried = F.struct(*df.columns).alias("_row")
        with_row = df.select("*", carried)
        encoded = self.codes.transform(with_row) if self.codes else with_row
        matrix = encoded.select(
            "_row",
            *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in encoded.columns
              else F.lit(0.0).alias(c) for c in self.features])
        return self.with_prediction(matrix, self.features).select("_row.*", PREDICTION)

    @cached_property
    def forest(self) -> Forest | None:
        return forest_of(self.model)

    def with_prediction(self, df: DataFrame, inputs: list[str]) -> DataFrame:
        """``df`` with ``prediction`` from its columns ``inputs``, which stand for the features in order."""
        if self.forest is None or not inputs:
            return self.model.transform(assembler(inputs).transform(df)).drop(FEATURES)
        return df.withColumn(PREDICTION, forest_prediction(self.forest, [F.col(c) for c in inputs]))

    def importances(self) -> DataFrame:
        """``(feature, importance)``: tree importances or absolute coefficients, one row per feature."""
        return importance_frame(self.model, self.features)


def importance_frame(model: Model, features: list[str]) -> DataFrame:
    """One row per input of a fitted tree ensemble or linear model."""
    scores = getattr(model, "featureImportances", None)
    scores = model.coefficients if scores is None else scores
    return SparkSession.active().createDataFrame(
        [(name, abs(float(scores[i]))) for i, name in enumerate(features)], "feature string, importance double")


@dataclass
class Trainer:
    model_type: str = "xgboost"
    target: str = "quantity"
    date_col: str = "date"
    hyperparameters: dict[str, Any] = field(default_factory=dict)
    tie_break: tuple[str, ...] = ()
    log_root: str | None = None
    fit_rows: int | None = None  # about the most rows that are fitted on, drawn by a hash; None takes all

    def train(self, df: DataFrame, strict: bool = False) -> TrainedModel:
        """Split by date, fit on the first part, evaluate on all three.

        The label stays a column of the frame and is never a feature. The labelled rows are stored once,
        so that splitting does not compute them again, and so is the part that is fitted on, which every
        boosting round reads. Only fitting is bounded by ``fit_rows``, and only those rows are shuffled into a
        fixed order; split and evaluation see all rows. ``log_root`` names a folder for the run log; a log
        that cannot be written is a warning.
        """
        spark = df.sparkSession
        checkpoint_root(spark)  # boosting cuts its lineage there
        make_estimator(self.model_type, self.hyperparameters)  # reject an unknown type before any job
        labelled = store_table(df.filter(F.col(self.target).isNotNull()), "training-rows")
        if self.date_col in df.columns:
            labelled = time_split(labelled, self.date_col, self.tie_break, strict=strict)
        else:
            undated = labelled.withColumn("_undated", F.lit(None).cast("date"))
            labelled = time_split(undated, "_undated", df.columns, strict=strict).drop("_undated")
        strings = [c for c in string_columns(labelled) if c not in ("split", self.date_col)]
        codes = LabelCodes.fit(labelled, strings) if strings else None
        keep = F.struct("split", F.col(self.target).cast("double").alias(LABEL)).alias("_keep")
        encoded = labelled.select("*", keep)
        encoded = codes.transform(encoded.drop("split")) if codes else encoded.drop("split")
        features = [c for c in numeric_columns(encoded) if c != self.target]
        matrix = encoded.select(
            "_keep.split", f"_keep.{LABEL}",
            *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
        matrix = store_table(matrix, "matrix") if codes else matrix
        train_rows = matrix.filter(F.col("split") == "train")
        if self.fit_rows:
            share = min(1.0, self.fit_rows / max(1, train_rows.count()))
            draw = F.pmod(F.xxhash64(LABEL, *features), F.lit(1_000_000))
            train_rows = train_rows.filter(draw < F.lit(int(share * 1_000_000)))
        ordered = in_fixed_order(train_rows, ["split", LABEL, *features])
        vectors = materialise(assembler(features).transform(ordered).select(LABEL, FEATURES))
        vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
        estimator = make_estimator(self.model_type, self.hyperparameters)
        try:
            trained = TrainedModel(estimator.fit(vectors), features, codes)
        finally:
            vectors.unpersist()
        trained.metrics = regression_metrics(trained.with_prediction(matrix, features), LABEL, PREDICTION)
        if self.log_root:
            params = {"model_type": self.model_type, **DEFAULTS[self.model_type], **self.hyperparameters,
                      "features": features}
            trained.metrics = materialise(trained.metrics)  # the log and the caller read them
            try:
                log_run(spark, self.log_root, trained.run_id, params, metrics_table(trained))
            except Exception as problem:  # the model is there; only its record is not
                log.warning("run %s was not logged: %s", trained.run_id, problem)
        return trained


def metrics_table(trained: TrainedModel) -> DataFrame:
    return long_metrics(trained.metrics, F.lit(trained.run_id))

