"""Group statistics attached to every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.operators.skew import (
    CHUNK,
    MAX_GROUP_ROWS,
    any_null,
    broadcast_if_small,
    chunk_hot_groups,
    join_per_key,
)
from shelfcast.session import materialise


def group_statistics(
    df: DataFrame,
    keys: Sequence[str],
    target: str = "quantity",
    price: str | None = "price",
    store: str | None = "store_id",
    approximate_stores: bool = False,
) -> DataFrame:
    """One row per group. Columns are named ``<column>_<statistic>``; absent inputs are left out."""

    def moments(c: str) -> list[Column]:
        return [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
                F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]

    exprs = [
        *moments(target),
        F.coalesce(F.sum(target), F.lit(0)).alias(f"{target}_sum"),
        F.count(target).alias(f"{target}_count"),
    ]
    if price in df.columns:
        exprs += moments(price)
    stats = df.filter(~any_null(keys)).groupBy(*keys)
    if store not in df.columns or store in keys:
        return stats.agg(*exprs)
    distinct = F.approx_count_distinct(store) if approximate_stores else F.count_distinct(store)
    return stats.agg(*exprs, distinct.alias(f"{store}_nunique"))


def add_group_statistics(df: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """Whole-history statistics of the group on every row; null keys match nothing."""
    return join_per_key(df, group_statistics(df, keys, **options), keys)


def add_past_statistics(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    target: str = "quantity",
    max_rows: int | None = MAX_GROUP_ROWS,
    strict: bool = True,
) -> DataFrame:
    """The target's group statistics over earlier rows only, so a row does not see its future."""
    keys, order = list(keys), list(order)
    chunked = None if max_rows is None else chunk_hot_groups(df, keys, order, max_rows, strict)
    if chunked is None:
        rows, parts, ties = df, keys, order
    else:
        rows, parts, ties = chunked.rows, [*keys, CHUNK], [*order, "_pos"]
    past = Window.partitionBy(*parts).orderBy(*ties).rowsBetween(Window.unboundedPreceding, -1)
    # Deviations from the group mean keep the sum of squares small.
    centre = join_per_key(
        rows, df.filter(~any_null(keys)).groupBy(*keys).agg(F.avg(target).alias("_centre")), keys
    )
    value = F.col(target)
    deviation = value - F.col("_centre")

    def parts_of(over=None) -> dict[str, Column]:
        exprs = {"_n": F.count(value), "_t": F.sum(value), "_s": F.sum(deviation), "_q": F.sum(deviation * deviation),
                 "_lo": F.min(value), "_hi": F.max(value)}
        return {k: (e.over(over) if over is not None else e) for k, e in exprs.items()}

    seen = centre.withColumns(parts_of(past))
    if chunked is not None:
        seen = _add_earlier_chunks(seen, centre, keys, parts_of())
    n, s, q = F.col("_n"), F.coalesce(F.col("_s"), F.lit(0.0)), F.coalesce(F.col("_q"), F.lit(0.0))
    total = F.coalesce(F.col("_t"), F.lit(0.0))
    spread = F.greatest(q - s * F.try_divide(s, n), F.lit(0.0))
    known = ~any_null(keys)
    added = {
        f"{target}_mean": F.try_divide(total, n),
        f"{target}_std": F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1))),
        f"{target}_min": F.col("_lo"),
        f"{target}_max": F.col("_hi"),
        f"{target}_sum": total,
        f"{target}_count": n,
    }
    out = seen.select(*df.columns, *[F.when(known, c).alias(name) for name, c in added.items()])
    if chunked is not None and chunked.unkeyed is not None:
        types = {f.name: f.dataType for f in out.schema.fields}
        out = out.unionByName(
            chunked.unkeyed.withColumns({name: F.lit(None).cast(types[name]) for name in added})
        )
    return out


def _add_earlier_chunks(seen: DataFrame, rows: DataFrame, keys: list[str], exprs: dict[str, Column]) -> DataFrame:
    """Fold the totals of a group's earlier chunks into the running totals of each row."""
    totals = rows.groupBy(*keys, CHUNK).agg(*[e.alias(k) for k, e in exprs.items()])
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(totals.select(
        *keys, CHUNK,
        F.sum("_n").over(earlier).alias("_n0"), F.sum("_t").over(earlier).alias("_t0"),
        F.sum("_s").over(earlier).alias("_s0"), F.sum("_q").over(earlier).alias("_q0"),
        F.min("_lo").over(earlier).alias("_lo0"), F.max("_hi").over(earlier).alias("_hi0"),
    ).filter(F.col(CHUNK) > 0))
    joined = seen.join(broadcast_if_small(before, before.count()), [*keys, CHUNK], "left")

    def added(now: str) -> Column:
        zero = F.lit(0)
        return F.coalesce(F.col(now), zero) + F.coalesce(F.col(f"{now}0"), zero)

    return joined.withColumns({
        "_n": added("_n"), "_t": added("_t"), "_s": added("_s"), "_q": added("_q"),
        "_lo": F.least("_lo", "_lo0"), "_hi": F.greatest("_hi", "_hi0"),
    })
