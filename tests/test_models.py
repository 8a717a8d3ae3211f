import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.models import forest as forest_module
from shelfcast.models import score as scoring
from shelfcast.models import train as train_module
from shelfcast.models.select import (
    correlations,
    impute_means,
    select_by_correlation,
    select_features,
)
from shelfcast.models.store import load_model, load_production, production_versions, save_model
from shelfcast.models.train import DEFAULTS, Trainer, assembler, make_estimator, metrics_table

SMALL = {"n_estimators": 4, "max_depth": 3}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(200):
        f = [rng.gauss(0, 1) for _ in range(4)]
        data.append((datetime(2024, 1, 1) + timedelta(days=i), rng.choice("ABC"), *f, 2 * f[0] + 3 * f[1] + rng.gauss(0, .1)))
    return spark.createDataFrame(
        data, "date timestamp, product_id string, f1 double, f2 double, f3 double, f4 double, quantity double").cache()


@pytest.fixture(scope="module")
def forest(rows):
    return Trainer("random_forest", hyperparameters={"n_estimators": 10, "max_depth": 5}).train(rows)


@pytest.mark.parametrize("kind", ["xgboost", "random_forest", "gradient_boosting"])
def test_training(rows, kind):
    trained = Trainer(kind, hyperparameters=SMALL).train(rows)
    got = {r.split: r for r in trained.metrics.collect()}
    assert {s: r.n for s, r in got.items()} == {"train": 140, "val": 30, "test": 30}
    assert trained.features == ["product_id", "f1", "f2", "f3", "f4"]  # neither date nor label
    assert got["train"].r2 > got["test"].r2 > -1 and got["train"].mse > 0
    assert metrics_table(trained).count() == 9


def test_defaults_and_unknown_type(rows):
    e = make_estimator("random_forest")
    assert (e.getNumTrees(), e.getMaxDepth(), e.getSeed()) == (100, 10, 42)
    g = make_estimator("gradient_boosting", {"max_depth": 3})
    assert (g.getMaxIter(), g.getStepSize(), g.getMaxDepth()) == (100, 0.1, 3) and DEFAULTS["xgboost"]["max_depth"] == 6
    with pytest.raises(ValueError, match="Unsupported model type: magic"):
        Trainer("magic").train(rows)


def test_training_repeats_with_a_seed(rows, forest):
    again = Trainer("random_forest", hyperparameters={"n_estimators": 10, "max_depth": 5}).train(rows)
    a, b = ({r.split: r.mse for r in t.metrics.collect()} for t in (forest, again))
    assert a == pytest.approx(b)


def test_importances(forest):
    table = {r.feature: r.importance for r in forest.importances().collect()}
    assert list(table) == forest.features and sum(table.values()) == pytest.approx(1)
    assert max(table, key=table.get) == "f2"


def test_predict_encodes_aligns_and_keeps_columns(spark, forest):
    new = spark.createDataFrame([("A", 1.0, 1.0), ("new", 1.0, 1.0), (None, 1.0, 1.0)],
                                "product_id string, f1 double, f2 double")
    got = forest.predict(new)
    assert got.columns == ["product_id", "f1", "f2", "prediction"] and got.count() == 3
    by = {r.product_id: r.prediction for r in got.collect()}
    assert by["new"] == by["A"]  # unseen shares code 0


def test_save_and_load(spark, rows, forest, tmp_path):
    path = str(tmp_path / "model")
    save_model(forest, path)
    loaded = load_model(spark, path)
    assert loaded.features == forest.features and loaded.run_id == forest.run_id
    a, b = ([round(r.prediction, 5) for r in m.predict(rows).orderBy("date").collect()] for m in (forest, loaded))
    assert a == b
    with pytest.raises(FileNotFoundError, match="Model not found"):
        load_model(spark, str(tmp_path / "none"))


def test_registry(spark, forest, tmp_path):
    path = str(tmp_path / "registered")
    save_model(forest, path)
    registry = spark.createDataFrame(
        [("m", 1, "Production", "old"), ("m", 2, "Production", path), ("m", 3, "Staging", "new"), ("k", 1, "None", "x")],
        "model_name string, version int, stage string, path string")
    assert [(r.model_name, r.version, r.path) for r in production_versions(registry).collect()] == [("m", 2, path)]
    assert load_production(registry, "m").features == forest.features
    assert load_production(registry, "k") is None


def test_scoring(spark, rows, forest):
    numbers = rows.withColumn("product_id", F.lit(1.0))
    r = scoring.score(numbers, forest).first()
    assert r.confidence_lower == pytest.approx(r.prediction * 0.85)
    with pytest.raises(ValueError, match="Missing features"):
        scoring.score(rows.select("f1"), forest)
    scored = scoring.model_scorer(forest)(numbers)
    assert "prediction" in scored.columns and "confidence_lower" not in scored.columns


def test_scoring_without_a_feature_list(rows, forest):
    from shelfcast.models.train import TrainedModel, assembler

    vectors = assembler(forest.features).transform(rows.withColumn("product_id", F.lit(1.0)))
    assert scoring.score(vectors, TrainedModel(forest.model, [])).count() == 200


FEATURES = ["f1", "f2", "f3", "f4"]


@pytest.mark.parametrize("method", ["importance", "rfe", "correlation", "anything"])
def test_selection_finds_the_two_that_matter(rows, method):
    options = {"trees": 10, "depth": 5} if method in ("importance", "rfe") else {}
    chosen = select_features(rows, FEATURES, "quantity", method, 2, **options)
    assert set(chosen) == {"f1", "f2"}
    if method == "rfe":
        assert chosen == ["f1", "f2"]  # original order


def test_unknown_method_raises_when_strict(rows):
    with pytest.raises(ValueError, match="Unsupported selection method: anything"):
        select_features(rows, FEATURES, "quantity", "anything", strict=True)


def test_correlations(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0, 2.0), (2.0, 5.0, None, 4.0), (3.0, 5.0, 4.0, 6.0), (4.0, 5.0, -1.0, float("nan"))],
                               "a double, constant double, c double, y double")
    got = {r.feature: r.abs_corr for r in correlations(df, ["a", "constant", "c"], "y").collect()}
    assert got["a"] == pytest.approx(1) and got["constant"] is None and got["c"] == pytest.approx(1)
    ranked = select_by_correlation(df, ["constant", "a"], "y", 2).orderBy("rank").collect()
    assert [r.feature for r in ranked] == ["a", "constant"]


def test_mean_imputation(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 2), (3.0, None)], "a double, b int")
    assert sorted((r.a, r.b) for r in impute_means(df, ["a", "b"]).collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 1.5)]


@pytest.mark.parametrize("kind", ["random_forest", "gradient_boosting"])
def test_trees_over_arrays_predict_what_mllib_does(spark, rows, kind):
    trained = Trainer(kind, hyperparameters={"n_estimators": 7, "max_depth": 6}).train(rows)
    edges = [(float(x), float(y), z, 0.0, 0.0) for x, y in zip(trained.forest.thresholds[1:], trained.forest.thresholds[:0:-1])
             for z in (None, float("nan"), -1.5)]
    names = [f"_{c}" for c in trained.features]
    odd = spark.createDataFrame(edges, ", ".join(f"{c} double" for c in names))
    got = trained.with_prediction(odd, names).select("prediction").collect()
    want = trained.model.transform(assembler(names).transform(odd)).select("prediction").collect()
    assert len(got) == len(edges) and len({r.prediction for r in got}) > 5
    assert [r.prediction for r in got] == pytest.approx([r.prediction for r in want], rel=1e-12)


def test_very_deep_trees_are_left_to_mllib(rows):
    trained = Trainer("random_forest", hyperparameters={"n_estimators": 1, "max_depth": 3}).train(rows)
    assert trained.forest.leaves[0].size == 8
    deep = [(0, float(i)) for i in range(14)]
    assert forest_module._depth([*deep, *[1.0] * 15]) == 14 > forest_module.MAX_DEPTH


def test_only_fitted_rows_are_put_in_order(spark, rows, monkeypatch):
    ordered = []
    whole = train_module.in_fixed_order
    monkeypatch.setattr(train_module, "in_fixed_order", lambda m, c: ordered.append(m.count()) or whole(m, c))
    numbers = rows.drop("product_id")
    trained = Trainer("random_forest", hyperparameters=SMALL, fit_rows=50).train(numbers)
    assert 20 < ordered[0] < 90 and trained.metrics.agg(F.sum("n")).first()[0] == 200
