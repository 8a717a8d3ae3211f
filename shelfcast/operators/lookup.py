"""Feature lookup per entity: the latest values, or the values known at a point in time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.operators.incremental import latest_per_key
from shelfcast.operators.skew import (
    CHUNK,
    MAX_GROUP_ROWS,
    POSITION,
    any_null,
    broadcast_if_small,
    chunk_hot_groups,
    join_per_key,
    spread,
)
from shelfcast.session import materialise, store_table

DEFAULT_VALUE = 0.0
STORE_BUCKETS = 32


def latest_features(store: DataFrame, keys: Sequence[str], ts: str, features: Sequence[str]) -> DataFrame:
    """Newest row per entity; equal times are settled by the feature values."""
    present = [f for f in features if f in store.columns]
    rows = store.filter(~any_null(keys)).select(*keys, ts, *present)
    return latest_per_key(rows, keys, [ts]).select(*keys, *present)


def _or_default(df: DataFrame, features: Sequence[str], default: float) -> dict[str, Column]:
    return {f: F.coalesce(F.col(f), F.lit(default)) if f in df.columns else F.lit(default) for f in features}


def online_features(
    entities: DataFrame, store: DataFrame, keys: Sequence[str], ts: str, features: Sequence[str],
    default: float = DEFAULT_VALUE,
) -> DataFrame:
    """One row per entity row with the latest features; duplicates stay, unknown entities get the default."""
    rows = entities.drop(*[f for f in features if f in entities.columns])
    joined = join_per_key(rows, latest_features(store, keys, ts, features), keys)
    return joined.select(*rows.columns, *[c.alias(f) for f, c in _or_default(joined, features, default).items()])


@dataclass(frozen=True)
class BucketedStore:
    """A feature table stored in buckets of its entity, each sorted by entity and time.

    Joins and newest-row aggregations on the entity read the buckets as they are: only the other side is
    shuffled, to as many partitions.
    """

    name: str
    keys: tuple[str, ...]
    ts: str
    buckets: int

    @staticmethod
    def write(
        store: DataFrame, name: str, keys: Sequence[str], ts: str, buckets: int = STORE_BUCKETS, path: str | None = None
    ) -> BucketedStore:
        """Store ``store`` as the table ``name``, at ``path`` if given; rows without an entity are left out.

        Rows go to their bucket before they are written, so that there is one file per bucket and task.
        """
        rows = store.filter(~any_null(keys)).repartition(buckets, *keys)
        writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys, ts)
        (writer.option("path", path) if path else writer).saveAsTable(name)
        return BucketedStore(name, tuple(keys), ts, buckets)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def latest(self, spark: SparkSession, features: Sequence[str]) -> DataFrame:
        return latest_features(self.rows(spark), self.keys, self.ts, features)

    def online(self, entities: DataFrame, features: Sequence[str], default: float = DEFAULT_VALUE) -> DataFrame:
        """What :func:`online_features` gives, without a shuffle of the store."""
        rows = entities.drop(*[f for f in features if f in entities.columns])
        latest = self.latest(entities.sparkSession, features).hint("merge")
        joined = rows.join(latest, list(self.keys), "left")
        return joined.select(*rows.columns, *[c.alias(f) for f, c in _or_default(joined, features, default).items()])

    def drop(self, spark: SparkSession) -> None:
        spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")


def historical_features(
    entities: DataFrame,
    store: DataFrame,
    keys: Sequence[str],
    entity_ts: str,
    store_ts: str,
    features: Sequence[str],
    default: float | None = DEFAULT_VALUE,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Features of each entity row as they were known at its time (last store row at or before it).

    Both sides are unioned and ordered by time, so every request sees the last store row above it:
    one shuffle, no range join. Entities with more than ``max_rows`` rows are cut into chunks; the
    last store row before a chunk is carried in from a summary with one row per chunk.
    """
    features = list(features)
    stored, payload = "_stored", "_request"
    values = F.struct(*[F.col(f) for f in features])
    side = "_side"  # store rows come first at equal times
    kept = [c for c in entities.columns if c not in features]
    # Keys and time stand in their own columns already, unless both sides have to agree on another type.
    own = {k: k for k in keys if entities.schema[k].dataType == store.schema[k].dataType and k in kept}
    if entities.schema[entity_ts].dataType == store.schema[store_ts].dataType:
        own[entity_ts] = "_ts"
    carried = [F.lit(True).alias("_is"), *[F.col(c) for c in kept if c not in own]]
    left = entities.select(
        *keys, F.col(entity_ts).alias("_ts"), F.lit(1).alias(side), F.struct(*carried).alias(payload))
    right = store.filter(~any_null(keys) & F.col(store_ts).isNotNull()).select(
        *keys, F.col(store_ts).alias("_ts"), F.lit(0).alias(side), values.alias(stored))
    # Stored, because group sizes and rows would each compute both sides again.
    both = store_table(left.unionByName(right, allowMissingColumns=True), "history")
    n = both.count()
    parts, order = list(keys), ["_ts", side, stored]
    chunked = chunk_hot_groups(both, keys, order, max_rows, strict=False)
    rows = both if chunked is None else chunked.rows
    if chunked is not None:
        parts, order = [*parts, CHUNK], [*order, POSITION]
    so_far = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = spread(rows, n, parts).withColumn("_found", F.last(stored, ignorenulls=True).over(so_far))
    if chunked is not None:
        carry = _last_before_chunk(rows, list(keys), stored)
        seen = seen.join(broadcast_if_small(carry, carry.count()), [*keys, CHUNK], "left")
        seen = seen.withColumn("_found", F.coalesce("_found", "_carried"))
    known = ~any_null(keys) & F.col("_ts").isNotNull()
    whole = list(dict.fromkeys([*own.values(), payload]))
    out = seen.filter(F.col(side) == 1).select(*whole, F.when(known, F.col("_found")).alias("_found"))
    if chunked is not None and chunked.unkeyed is not None:
        unkeyed = chunked.unkeyed.filter(F.col(side) == 1)
        out = out.unionByName(unkeyed.select(*whole), allowMissingColumns=True)

    def value(f: str) -> Column:
        c = F.col(f"_found.{f}")
        return (c if default is None else F.coalesce(c, F.lit(default))).alias(f)

    return out.select(*[F.col(own.get(c, f"{payload}.{c}")).alias(c) for c in kept], *[value(f) for f in features])


def _last_before_chunk(rows: DataFrame, keys: list[str], stored: str) -> DataFrame:
    last = rows.filter(F.col(stored).isNotNull()).groupBy(*keys, CHUNK).agg(
        F.max_by(stored, POSITION).alias("_last"))
    chunks = rows.select(*keys, CHUNK).distinct().join(last, [*keys, CHUNK], "left")
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("_last", ignorenulls=True).over(earlier)
    return materialise(chunks.select(*keys, CHUNK, carried.alias("_carried")).filter(F.col("_carried").isNotNull()))
