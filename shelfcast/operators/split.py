"""Exact train / validation / test split in date order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.operators.skew import POSITION, row_positions
from shelfcast.session import materialise

# Shares of the train and validation parts; the rest is the test part.
TRAIN_SHARE = 0.7
VALIDATION_SHARE = 0.15


def time_split(
    df: DataFrame,
    date_col: str = "date",
    tie_break: Sequence[str] = (),
    train: float = TRAIN_SHARE,
    validation: float = VALIDATION_SHARE,
    strict: bool = False,
) -> DataFrame:
    """Add ``split``: the first ``int(train·n)`` rows by date, the next ``int(validation·n)``, the rest.

    Rows per day tell which day holds each cut; only the rows of those one or two days are ranked, over
    many partitions, to find the row at the cut. Every row is then labelled by comparing it with the
    two cut rows, so the frame itself is neither sorted nor shuffled. Rows without a date come last.
    Rows that tie at a cut are told apart by their position, so the shares are always exact; ``strict``
    states that date and ``tie_break`` are a strict order and saves that work. The frame is read several
    times: store one that is costly to compute.
    """
    day = F.to_date(date_col)
    days = materialise(df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")))
    n = days.agg(F.sum("n")).first()[0] or 0
    first, second = int(n * train), int(n * train) + int(n * validation)

    def part(position: int) -> str:
        return "train" if position < first else "val" if position < second else "test"

    cuts = [c for c in dict.fromkeys((first, second)) if 0 < c < n]
    if not cuts:
        return df.withColumn("split", F.lit(part(0)))

    # One row per calendar day, so a running sum in one task is fine.
    running = Window.orderBy(F.col("day").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    placed = days.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    holds = _any(F.col("before").between(c - F.col("n") + 1, c) for c in cuts)
    cut_days = [(F.lit(r["day"]).cast("date"), r["before"]) for r in placed.filter(holds).collect()]  # at most two
    order = [date_col, *tie_break]
    rows = df.filter(_any(day.eqNullSafe(d) for d, _ in cut_days)).select(day.alias("_day"), *order)
    before = F.coalesce(*[F.when(F.col("_day").eqNullSafe(d), b) for d, b in cut_days])
    ranked = row_positions(rows, ["_day"], order, strict).withColumn("_rank", before + F.col(POSITION))
    texts = [F.col(c).cast("string").alias(c) for c in order]
    found = {r["_rank"]: r for r in ranked.filter(F.col("_rank").isin(cuts)).select("_rank", *texts).collect()}

    types = {f.name: f.dataType for f in df.schema.fields}

    def at(c: int, name: str) -> Column:
        return F.lit(found[c][name]).cast(types[name])

    def labelled(rows: DataFrame, reached: Callable[[int], Column]) -> DataFrame:
        out = F.lit(part(0))
        for c in cuts:
            out = F.when(reached(c), part(c)).otherwise(out)
        return rows.withColumn("split", out)

    here = F.struct(F.col(date_col).isNull(), *order)  # rows without a date come last

    def from_cut_row(c: int) -> Column:
        return here >= F.struct(F.lit(found[c][date_col] is None), *[at(c, x).alias(x) for x in order])

    if strict:
        return labelled(df, from_cut_row)
    # Without a strict order several rows may equal the cut row, some of them before the cut.
    same = {c: reduce(and_, [F.col(x).eqNullSafe(at(c, x)) for x in order]) for c in cuts}
    starts = {c: ranked.filter(same[c]).agg(F.min("_rank")).first()[0] for c in cuts}
    if all(starts[c] == c for c in cuts):
        return labelled(df, from_cut_row)
    copies = _any(same.values())
    start = F.coalesce(*[F.when(same[c], starts[c]) for c in cuts])
    numbered = row_positions(df.filter(copies), order, [], strict=False)
    tied = labelled(numbered, lambda c: start + F.col(POSITION) >= c)
    return labelled(df.filter(~copies), from_cut_row).unionByName(tied.drop(POSITION))


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)
