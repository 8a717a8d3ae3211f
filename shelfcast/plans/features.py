"""The whole feature chain: fit on one frame, transform that frame or others."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from shelfcast.functions.calendar import HOLIDAYS, add_seasonal_features, add_time_features, parse_dates
from shelfcast.functions.numeric import add_interactions, nan_to_null
from shelfcast.operators.aggregates import add_past_statistics, group_statistics
from shelfcast.operators.encode import OneHot, StandardScale, categorical_columns
from shelfcast.operators.history import LAGS, WINDOWS, add_history_features
from shelfcast.operators.skew import MAX_GROUP_ROWS, join_per_key
from shelfcast.session import store_table


# Columns of the stored features that one narrow aggregation of the scale fit reads.
COLUMNS_PER_SCAN = 12


@dataclass(frozen=True)
class FeatureConfig:
    group_by: tuple[str, ...] = ("product_id",)
    target: str = "quantity"
    date_col: str = "date"
    time_features: bool = True
    lags: tuple[int, ...] = LAGS
    windows: tuple[int, ...] = WINDOWS
    tie_break: tuple[str, ...] = ()
    strict_order: bool = True
    # None: groups are bounded, as one row per key and day is; no size check is made.
    max_group_rows: int | None = MAX_GROUP_ROWS
    holidays: tuple[str, ...] = HOLIDAYS
    # Variants.
    min_periods: int | None = None
    price_lags: tuple[int, ...] | None = None
    as_of: bool = False
    categorical: tuple[str, ...] | None = None
    scale_exclude: tuple[str, ...] = ()
    seasonal_first: bool = False
    scale: bool = True


def unscaled_features(df: DataFrame, config: FeatureConfig) -> DataFrame:
    """Calendar, lag, rolling, group and interaction features."""
    c = config
    rows = nan_to_null(parse_dates(df, [c.date_col]))
    if c.time_features:
        rows = add_time_features(rows, c.date_col, c.holidays)
    order = [x for x in (c.date_col, *c.tie_break) if x in rows.columns]
    rows = add_history_features(
        rows, c.group_by, order, c.target, lags=c.lags, windows=c.windows, price_lags=c.price_lags,
        min_periods=c.min_periods, max_rows=c.max_group_rows, strict=c.strict_order)
    if c.as_of:
        rows = add_past_statistics(
            rows, c.group_by, order, c.target, max_rows=c.max_group_rows, strict=c.strict_order)
    else:
        # The statistics need only raw columns: computed from the input, not from the wide frame.
        rows = join_per_key(rows, group_statistics(nan_to_null(df), c.group_by, c.target), c.group_by)
    return add_interactions(rows, c.target)


@dataclass(frozen=True)
class FeatureModel:
    """Fitted categories and scales; immutable, and stored as JSON."""

    config: FeatureConfig
    one_hot: OneHot
    scale: StandardScale

    def transform(self, df: DataFrame) -> DataFrame:
        return self.finish(unscaled_features(df, self.config))

    def finish(self, features: DataFrame) -> DataFrame:
        """Encode and scale frames that :func:`unscaled_features` made."""
        c = self.config
        rows = add_seasonal_features(features, c.date_col) if c.seasonal_first else features
        rows = self.scale.transform(self.one_hot.transform(rows))
        return rows if c.seasonal_first else add_seasonal_features(rows, c.date_col)

    def to_json(self) -> str:
        return json.dumps({
            "config": asdict(self.config), "one_hot": self.one_hot.to_json(), "scale": self.scale.to_json()})

    @staticmethod
    def from_json(text: str) -> FeatureModel:
        parts = json.loads(text)
        config = {k: tuple(v) if isinstance(v, list) else v for k, v in parts["config"].items()}
        return FeatureModel(
            FeatureConfig(**config), OneHot.from_json(parts["one_hot"]), StandardScale.from_json(parts["scale"]))


def fit_features(df: DataFrame, config: FeatureConfig | None = None) -> tuple[FeatureModel, DataFrame]:
    """Fit categories and scales, and return the model with the features of ``df`` itself.

    The unscaled features are stored once: the two small fits and the result all read them, so the
    window shuffle does not run again.
    """
    c = config or FeatureConfig()
    features = store_table(unscaled_features(df, c), "features")
    model = fit_on_features(features, c)
    return model, model.finish(features)


def fit_on_features(features: DataFrame, c: FeatureConfig) -> FeatureModel:
    fixed: Sequence[str] = (*c.group_by, c.date_col)
    columns = list(c.categorical) if c.categorical is not None else categorical_columns(features, fixed)
    one_hot = OneHot.fit(features, [x for x in columns if x in features.columns])
    rows = features
    if c.seasonal_first:
        rows = add_seasonal_features(rows, c.date_col)
    encoded = one_hot.transform(rows)
    if not c.scale:
        return FeatureModel(c, one_hot, StandardScale({}))
    scale = StandardScale.fit(encoded, (*c.group_by, *c.scale_exclude), COLUMNS_PER_SCAN)
    return FeatureModel(c, one_hot, scale)
