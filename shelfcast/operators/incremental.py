"""Incremental loads: high-water marks, ledgers of seen ids, and deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.skew import row_positions

# The ledger is cut to KEEP_IDS entries once it holds more than MAX_IDS.
MAX_IDS = 100_000
KEEP_IDS = 50_000
# Default window when there is no high-water mark yet.
DEFAULT_DAYS = 7


def high_water_mark(
    df: DataFrame, keys: Sequence[str] = (), date_col: str = "date", previous: DataFrame | None = None
) -> DataFrame:
    """Latest date per key, never earlier than the previous mark. Unreadable dates are ignored."""
    value = F.col(date_col)
    if df.schema[date_col].dataType.simpleString() == "string":
        value = F.try_to_timestamp(value)
    marks = df.groupBy(*keys).agg(F.max(value).alias("last_processed"))
    if previous is None:
        return marks
    both = marks.unionByName(previous.select(*marks.columns))
    return both.groupBy(*keys).agg(F.max("last_processed").alias("last_processed"))


def since_mark(
    df: DataFrame, mark: Column | None, date_col: str = "date", end: Column | None = None, days: int = DEFAULT_DAYS
) -> DataFrame:
    """Rows from the mark, or from ``days`` before ``end``, up to and including ``end`` (now)."""
    upper = F.current_timestamp() if end is None else end
    earliest = upper - F.expr(f"interval {days} days")
    start = earliest if mark is None else F.coalesce(mark, earliest)
    return df.filter((F.col(date_col) >= start) & (F.col(date_col) <= upper))


def unseen(
    df: DataFrame,
    ledger: DataFrame,
    id_col: str = "id",
    ledger_col: str = "id",
    dedupe_within_batch: bool = False,
    newest_by: str | None = None,
) -> DataFrame:
    """Rows whose id is not in the ledger. Ids are compared as text, so numbers match too.

    The ledger may be large: it is shuffled on the id unless Spark finds it small. Equal ids in a
    batch all pass unless ``dedupe_within_batch``; then one row per id stays, the latest by
    ``newest_by`` if given. The choice is an aggregation, combined before the shuffle.
    """
    text = "_id_text"
    seen = ledger.select(F.col(ledger_col).cast("string").alias(text)).filter(F.col(text).isNotNull()).distinct()
    rows = df.withColumn(text, F.col(id_col).cast("string")).join(seen, text, "left_anti")
    if not dedupe_within_batch:
        return rows.drop(text)
    whole = F.struct(*df.columns)
    # Maps have no order; rows that hold one are ordered by their JSON text.
    order = F.to_json(whole) if "map<" in df.schema.simpleString() else whole
    rank = order if newest_by is None else F.struct(F.col(newest_by), order)
    picked = rows.filter(F.col(text).isNotNull()).groupBy(text).agg(F.max_by(whole, rank).alias("r"))
    without_id = rows.filter(F.col(text).isNull()).drop(text)
    return picked.select("r.*").unionByName(without_id)


def trim_ledger(
    ledger: DataFrame, seq_col: str, above: int = MAX_IDS, keep: int = KEEP_IDS, tie_break: Sequence[str] = ()
) -> DataFrame:
    """The newest ``keep`` entries if there are more than ``above``, else all of them.

    No load calls this: ids that are cut off would be loaded again if they came back. Ledgers grow until
    their owner trims them, behind the mark below which the source sends nothing.

    Positions come from a range-partitioned sort, so the ledger never meets in one task.
    """
    total = ledger.count()
    if total <= above:
        return ledger
    placed = row_positions(ledger, [], [seq_col, *tie_break])
    return placed.filter(F.col("_pos") >= total - keep).select(*ledger.columns)


def new_files(listing: DataFrame, ledger: DataFrame, key: str = "path", suffix: str = ".parquet") -> DataFrame:
    """Listed files with the suffix that the ledger does not hold."""
    return listing.filter(F.col(key).endswith(suffix)).join(ledger.select(key).distinct(), key, "left_anti")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by ``order``, as an aggregation that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("r")
    return df.groupBy(*keys).agg(picked).select(*keys, "r.*")


def mark_seen(ledger: DataFrame, batch: DataFrame, id_col: str, seq: Column) -> DataFrame:
    """Ledger extended by the ids of a batch; an id that is already there keeps its entry."""
    added = batch.select(F.col(id_col).cast("string").alias("id"), seq.alias("seq")).filter(F.col("id").isNotNull())
    both = ledger.select("id", "seq").unionByName(added)
    return both.groupBy("id").agg(F.min("seq").alias("seq"))
