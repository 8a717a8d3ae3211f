"""Joins and ordered windows that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.session import materialise, store_table

# A side is broadcast only up to this many estimated bytes; beyond it the join shuffles and
# adaptive execution splits skewed partitions.
BROADCAST_BYTES = 64 * 1024 * 1024
# Groups above this many rows are cut into chunks before an ordered window runs over them.
MAX_GROUP_ROWS = 1_000_000

# Rows that a task of an ordered window sorts at a time.
TASK_ROWS = 500_000
# Settings under which adaptive execution splits skewed keys of a stateless stream, and the copies of a table elsewhere.
STREAM_SPLITS = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
                 "spark.sql.adaptive.streaming.stateless.enabled")
STREAM_SALTS = 16

CHUNK, POSITION, OWN = "_chunk", "_pos", "_own"


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns], F.lit(False))


FIXED_BYTES = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "double": 8, "float": 4, "date": 4,
               "timestamp": 8, "timestamp_ntz": 8, "void": 0}


def _fixed_bytes(kind: T.DataType) -> int | None:
    """Width of a value of a type; None where values differ in length."""
    if isinstance(kind, T.StructType):
        widths = [_fixed_bytes(f.dataType) for f in kind.fields]
        return None if None in widths else 8 + sum(widths)
    if isinstance(kind, T.DecimalType):
        return 16
    return FIXED_BYTES.get(kind.simpleString())


def table_bytes(df: DataFrame, rows: int) -> int:
    """Size of a (stored) table of known row count: fixed widths by type, all others by the length of their values."""
    widths = {f.name: _fixed_bytes(f.dataType) for f in df.schema.fields}
    size = rows * (16 + sum(w for w in widths.values() if w is not None))
    varying = [F.col(f"`{n}`") for n, w in widths.items() if w is None]
    if varying and rows and size <= BROADCAST_BYTES:
        size += df.agg(F.sum(F.length(F.to_json(F.struct(*varying))).cast("bigint"))).first()[0] or 0
    return size


def broadcast_if_small(side: DataFrame, rows: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a side of known row count for broadcast when its measured size fits the limit."""
    return F.broadcast(side) if table_bytes(side, rows) <= limit else side


def join_per_key(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Join rows to a table with at most one row per key.

    ``right`` is an aggregate, far smaller than its input: it is materialised once, counted, and
    broadcast when small, so the wide left side is not shuffled. A larger one is shuffle-joined,
    where adaptive execution splits the left partitions of hot keys.
    """
    table = materialise(right)
    return left.join(broadcast_if_small(table, table.count(), limit), list(keys), how)


def row_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], strict: bool = True) -> DataFrame:
    """Add ``_pos``, the 0-based rank of each row in its group, without a task per group.

    The rows are stored once, because finding the ranges reads them twice. They are range-partitioned
    on keys and order, so a group of any size spreads over many partitions; a second table fixes the
    ranges. The row count of each (group, partition) then turns partition-local numbers into group
    positions. ``strict=False`` allows rows that tie in ``order``: their number in the stored table
    settles the order, and splits a long run of copies over several ranges.
    """
    spark = df.sparkSession
    by = [*keys, *order]
    source = store_table(df, "ranked")
    if not strict:
        source = source.withColumn("_arrival", F.monotonically_increasing_id())
        by = [*by, "_arrival"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = store_table(
        source.repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .select(*df.columns, F.monotonically_increasing_id().alias("_mid")), "placed"
    ).withColumn("_part", F.shiftright(F.col("_mid"), 33))
    runs = placed.groupBy(*keys, "_part").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    )
    on = reduce(
        lambda a, b: a & b,
        [F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "_part"]],
    )
    joined = placed.alias("p").join(broadcast_if_small(offsets, offsets.count()).alias("o"), on)
    position = F.col("p._mid") - F.col("o._first") + F.col("o._before")
    return joined.select(*[F.col(f"p.{c}") for c in df.columns], position.alias(POSITION))


@dataclass(frozen=True)
class Chunked:
    """Rows with ``_chunk`` and ``_pos``, such that no (group, chunk) is larger than the limit."""

    rows: DataFrame
    unkeyed: DataFrame | None  # rows of a hot null-key group, kept out of the windows


def chunk_hot_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    max_rows: int = MAX_GROUP_ROWS,
    strict: bool = True,
) -> Chunked | None:
    """Cut groups above ``max_rows`` rows into runs of that many rows; None if there are none.

    The sizes come from a map-side combined count that reads only the key columns. There are at
    most ``rows / max_rows`` hot groups.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    hot = materialise(sizes.select(*keys))
    found = hot.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(any_null(keys)).alias("without_key")
    ).first()
    if not found["groups"]:
        return None
    unkeyed = df.filter(any_null(keys)) if found["without_key"] else None
    keyed = df.filter(~any_null(keys)) if found["without_key"] else df
    marks = broadcast_if_small(hot.filter(~any_null(keys)).withColumn("_hot", F.lit(True)), found["groups"])
    flagged = keyed.join(marks, keys, "left").select(*df.columns, "_hot")
    cold = flagged.filter(F.col("_hot").isNull()).drop("_hot")
    cold = cold.withColumns({POSITION: F.lit(None).cast("bigint"), CHUNK: F.lit(0).cast("bigint")})
    large = row_positions(flagged.filter("_hot").drop("_hot"), keys, order, strict)
    large = large.withColumn(CHUNK, F.floor(F.col(POSITION) / max_rows))
    return Chunked(cold.unionByName(large), unkeyed)


def spread(df: DataFrame, rows: int, by: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Shuffle ``df`` for a window over ``by`` such that a task gets about ``task_rows`` rows, whatever their number.

    A table that the session's partitions hold within that bound is left to adaptive execution.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    needed = -(-rows // task_rows)
    return df.repartition(needed, *by) if needed > usual else df


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n",
    max_rows: int = MAX_GROUP_ROWS, strict: bool = True,
) -> DataFrame:
    """Add the 1-based rank of each row in its group; null for rows with a null key."""
    keys, order = list(keys), list(order)
    chunked = chunk_hot_groups(df, keys, order, max_rows, strict)
    if chunked is None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(name, F.when(~any_null(keys), rank))
    # Hot groups already have positions; the window only numbers the others.
    rank = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order, POSITION))
    n = F.coalesce((F.col(POSITION) + 1).cast("int"), F.when(~any_null(keys), rank))
    out = chunked.rows.withColumn(name, n).select(*df.columns, name)
    if chunked.unkeyed is not None:
        out = out.unionByName(chunked.unkeyed.withColumn(name, F.lit(None).cast("int")))
    return out


def _is_on(spark: SparkSession, setting: str) -> bool:
    """Whether this Spark has a setting and it is on; a default given to ``get`` would hide Spark's own."""
    try:
        return spark.conf.get(setting) == "true"
    except PySparkException:
        return False


def join_stream_per_key(
    stream: DataFrame, table: DataFrame, rows: int, keys: Sequence[str], salts: int | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join of stream rows to a static table of known size with one row per key.

    A table too large to broadcast is shuffled. Where adaptive execution serves stateless streams, it splits the
    skewed keys of the stream. Elsewhere, or if ``salts`` asks for it (a stream with state), each entity has
    ``salts`` copies and the stream rows spread over them by hash, which shuffles the table as many times.
    """
    keys = list(keys)
    if table_bytes(table, rows) <= limit:
        return stream.join(F.broadcast(table), keys, "left")
    if salts is None:
        salts = 1 if all(_is_on(stream.sparkSession, name) for name in STREAM_SPLITS) else STREAM_SALTS
    if salts == 1:
        return stream.join(table, keys, "left")
    hashable = [f.name for f in stream.schema.fields if "map<" not in f.dataType.simpleString()]
    salted = stream.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def over_row_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    add_columns: Callable[[DataFrame, WindowSpec], DataFrame],
    lookback: int,
    results: dict[str, Column],
    max_rows: int | None = MAX_GROUP_ROWS,
    strict: bool = True,
) -> DataFrame:
    """Add ``results`` that depend on at most ``lookback`` earlier rows of the group.

    ``add_columns`` adds the window columns that ``results`` are made of; all of them use the given
    window, so one shuffle and one sort serve them. Hot groups are cut into chunks, and the last
    ``lookback`` rows of a chunk are repeated at the head of the next one, so every frame is whole.
    ``max_rows=None`` states that groups are bounded (one row per key and day) and skips the check.
    Rows with a null key get null results.
    """
    keys, order = list(keys), list(order)
    chunked = None
    if max_rows is not None:
        max_rows = max(max_rows, lookback, 1)
        chunked = chunk_hot_groups(df, keys, order, max_rows, strict)

    def finished(rows: DataFrame) -> DataFrame:
        return rows.select(*df.columns, *[F.when(~any_null(keys), c).alias(n) for n, c in results.items()])

    if chunked is None:
        return finished(add_columns(df, Window.partitionBy(*keys).orderBy(*order)))

    # Cold groups have no position and sit in chunk 0 alone.
    tail = F.col(POSITION) % max_rows >= max_rows - lookback
    targets = F.when(tail, F.array(F.col(CHUNK), F.col(CHUNK) + 1)).otherwise(F.array(F.col(CHUNK)))
    rows = (
        chunked.rows.withColumn("_home", F.col(CHUNK))
        .withColumn(CHUNK, F.explode(targets))
        .withColumn(OWN, F.col(CHUNK) == F.col("_home"))
    )
    spec = Window.partitionBy(*keys, CHUNK).orderBy(*order, POSITION)
    out = finished(add_columns(rows, spec).filter(OWN))
    if chunked.unkeyed is not None:
        empty = {f.name: F.lit(None).cast(f.dataType) for f in out.schema.fields if f.name not in df.columns}
        out = out.unionByName(chunked.unkeyed.withColumns(empty))
    return out
