"""Saved models and the registry that names the one in production."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shelfcast.models.train import TrainedModel
from shelfcast.operators.encode import LabelCodes

log = logging.getLogger(__name__)

PRODUCTION = "Production"


def save_model(trained: TrainedModel, path: str) -> None:
    """Model, ordered feature names and label dictionaries below one folder."""
    spark = SparkSession.active()
    PipelineModel([trained.model]).write().overwrite().save(f"{path}/model")
    columns = list(trained.codes.columns) if trained.codes else []
    meta = json.dumps({"features": trained.features, "run_id": trained.run_id, "code_columns": columns})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    if trained.codes:
        trained.codes.table.write.mode("overwrite").parquet(f"{path}/codes")


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    """Load a saved model; a missing one raises ``FileNotFoundError``, missing dictionaries do not."""
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    except AnalysisException as problem:
        raise FileNotFoundError(f"Model not found at {path}") from problem
    codes = None
    if meta["code_columns"]:
        try:
            codes = LabelCodes(spark.read.parquet(f"{path}/codes"), tuple(meta["code_columns"]))
        except AnalysisException:
            log.warning("no label dictionaries at %s", path)
    model = PipelineModel.load(f"{path}/model").stages[0]
    return TrainedModel(model, meta["features"], codes, run_id=meta["run_id"])


def production_versions(registry: DataFrame, by: Sequence[str] = ("model_name",), stage: str = PRODUCTION) -> DataFrame:
    """Newest version in the stage, per model name. Versions given as text compare as numbers, others follow as text."""
    rest = [c for c in registry.columns if c not in by]
    text = F.col("version").cast("string")
    newest = F.max_by(F.struct(*rest), F.struct(text.try_cast("decimal(38,9)"), text)).alias("r")
    return registry.filter(F.col("stage") == stage).groupBy(*by).agg(newest).select(*by, "r.*")


def load_production(registry: DataFrame, model_name: str) -> TrainedModel | None:
    """The production model of that name; None (with a warning) if there is none."""
    row = production_versions(registry.filter(F.col("model_name") == model_name)).first()
    if row is None:
        log.warning("No production model found for %s", model_name)
        return None
    return load_model(registry.sparkSession, row["path"])
