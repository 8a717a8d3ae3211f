"""Training queries fit on every row of their training part."""

from datetime import date, timedelta

import pytest

from shelfcast.models import train as train_module
from shelfcast.plans import queries

ROWS = 300


@pytest.fixture
def fitted(spark, tmp_path, monkeypatch):
    """Runs a query on line items of its own and returns its rows and how many rows it fitted on."""
    lines = [(i // 3, i % 3, i % 7, 1, float(i % 11 + 1), (i % 11 + 1) * (2.0 + i % 5), date(2024, 1, 1) + timedelta(days=i))
             for i in range(ROWS)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                          "l_extendedprice double, l_shipdate date").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(queries, "FIT_ROWS", 30)
    for kind in ("random_forest", "gradient_boosting"):
        monkeypatch.setitem(train_module.DEFAULTS, kind, {
            **train_module.DEFAULTS[kind], "n_estimators": 3, "max_depth": 3})
    seen = []
    whole = train_module.in_fixed_order
    monkeypatch.setattr(train_module, "in_fixed_order", lambda m, c: seen.append(m.count()) or whole(m, c))

    def run(name):
        return queries.QUERIES[name](spark, str(tmp_path)).collect(), seen

    return run


def test_batch_scoring_fits_on_all_training_rows(fitted):
    rows, seen = fitted("batch_scoring")
    assert len(rows) == ROWS and seen == [ROWS * 7 // 10]


@pytest.mark.parametrize("name", ["train_gbt", "train_rf"])
def test_training_fits_on_all_training_rows(fitted, name):
    rows, seen = fitted(name)
    parts = {r.split: r.rows for r in rows}
    assert parts == {"train": 210, "val": 45, "test": 45} and seen == [parts["train"]]
