"""Lags and rolling statistics over the previous rows of a group.

A window frame of N rows costs Spark N updates per row and statistic. Here the state of a long frame
(count, sum, squared deviations, minimum, maximum) is put together from the states of shorter frames
that end some rows earlier, each fetched by one ``lag``: 14 rows are 7 and 7, 90 are 30, 30 and 30.
The work per row then grows with the number of pieces, not with N, and nothing is ever subtracted, so
no digits are lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from shelfcast.operators.skew import MAX_GROUP_ROWS, over_row_history

# Default lags and windows, in rows.
LAGS = (1, 7, 14, 30)
WINDOWS = (7, 14, 30, 90)

# Parts of a frame's state that each statistic needs.
PARTS = {"mean": ("n", "sum"), "std": ("n", "sum", "dev"), "min": ("n", "lo"), "max": ("n", "hi")}
MAX_PIECES = 8

Pieces = list[tuple[int, int]]  # (frame size, rows earlier)


def frame_plan(sizes: Sequence[int]) -> list[tuple[int, Pieces]]:
    """How to build each frame from smaller ones, adding helper sizes where a step would be long."""
    plan: list[tuple[int, Pieces]] = []
    have = [1]

    def add(size: int) -> None:
        pieces: Pieces = []
        at = 0
        while at < size:
            piece = max(h for h in have if h <= size - at)
            pieces.append((piece, at))
            at += piece
        plan.append((size, pieces))
        have.append(size)

    for size in sorted(set(sizes)):
        while size > MAX_PIECES * have[-1]:
            add(MAX_PIECES * have[-1])
        if size > 1 and size not in have:
            add(size)
    return plan


def _name(column: str, part: str, size: int) -> str:
    return f"_{column}_{part}_{size}"


def _single_rows(rows: DataFrame, parts: dict[str, set[str]]) -> DataFrame:
    """State of the frames of one row."""
    states: dict[str, Column] = {}
    for column, needed in parts.items():
        value = F.col(column)
        base = {"n": F.when(value.isNull(), 0).otherwise(1), "sum": F.coalesce(value.cast("double"), F.lit(0.0)),
                "dev": F.lit(0.0), "lo": value, "hi": value}
        states |= {_name(column, part, 1): base[part] for part in sorted(needed)}
    return rows.withColumns(states)


def _longer_frames(
    rows: DataFrame, spec: WindowSpec, size: int, pieces: Pieces, parts: dict[str, set[str]]
) -> DataFrame:
    """State of the frames of ``size`` rows from the states of their pieces."""
    fetched: dict[str, Column] = {}

    def piece(column: str, part: str, frame: int, offset: int) -> Column:
        name = _name(column, part, frame)
        if offset == 0:
            return F.col(name)
        earlier = f"{name}_before_{offset}"
        nothing = {"n": 0, "sum": 0.0, "dev": 0.0}.get(part)
        fetched[earlier] = F.lag(name, offset, nothing).over(spec)
        return F.col(earlier)

    totals: dict[str, Column] = {}
    deviations: dict[str, Column] = {}
    for column, needed in parts.items():
        states = {part: [piece(column, part, f, o) for f, o in pieces] for part in sorted(needed)}
        for part, columns in states.items():
            if part in ("n", "sum"):
                totals[_name(column, part, size)] = sum(columns[1:], columns[0])
            elif part in ("lo", "hi"):
                pick = F.least if part == "lo" else F.greatest
                totals[_name(column, part, size)] = pick(*columns)
        if "dev" in needed:
            # Squares around the pieces' own means, plus those of the pieces' means around the whole one.
            mean = F.try_divide(F.col(_name(column, "sum", size)), F.col(_name(column, "n", size)))
            within = states["dev"]
            between = [F.coalesce(n * F.pow(F.try_divide(s, n) - mean, F.lit(2)), F.lit(0.0))
                       for n, s in zip(states["n"], states["sum"], strict=True)]
            deviations[_name(column, "dev", size)] = sum([*within[1:], *between], within[0])
    out = rows.withColumns(fetched).withColumns(totals)
    return (out.withColumns(deviations) if deviations else out).drop(*fetched)


def _statistic(column: str, statistic: str, size: int, min_periods: int | None) -> Column:
    def part(name: str) -> Column:
        return F.col(_name(column, name, size))

    value = {
        "mean": lambda: F.try_divide(part("sum"), part("n")),
        "std": lambda: F.when(part("n") > 1, F.sqrt(F.try_divide(part("dev"), part("n") - 1))),
        "min": lambda: part("lo"),
        "max": lambda: part("hi"),
    }[statistic]()
    return F.when(part("n") >= (size if min_periods is None else min_periods), value)


def add_history_features(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    target: str = "quantity",
    price: str | None = "price",
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    price_lags: Sequence[int] | None = None,
    min_periods: int | None = None,
    statistics: Sequence[str] = ("mean", "std", "min", "max"),
    max_rows: int | None = MAX_GROUP_ROWS,
    strict: bool = True,
) -> DataFrame:
    """Lags and rolling statistics in one shuffle.

    Lag k is the k-th previous row of the group. Price, if present, gets the first three lags unless
    ``price_lags`` says otherwise, and rolling means. A rolling statistic is null until its window
    holds N values, or ``min_periods`` of them. ``order`` is the date and the columns that settle
    ties; ``strict=False`` allows remaining ties, whose order is then arbitrary.
    """
    price = price if price in df.columns else None
    lagged = {f"{target}_lag_{k}": (target, k) for k in lags}
    if price is not None:
        chosen = lags[:3] if price_lags is None else price_lags
        lagged |= {f"{price}_lag_{k}": (price, k) for k in chosen}

    parts: dict[str, set[str]] = {}
    rolled: dict[str, Column] = {}
    for size in windows:
        wanted = [(target, s) for s in statistics] + ([(price, "mean")] if price is not None else [])
        for column, statistic in wanted:
            parts.setdefault(column, set()).update(PARTS[statistic])
            rolled[f"{column}_roll_{statistic}_{size}"] = _statistic(column, statistic, size, min_periods)

    def add_columns(rows: DataFrame, spec: WindowSpec) -> DataFrame:
        out = rows.withColumns({name: F.lag(c, k).over(spec) for name, (c, k) in lagged.items()}) if lagged else rows
        if parts:
            out = _single_rows(out, parts)
            for size, pieces in frame_plan(windows):
                out = _longer_frames(out, spec, size, pieces, parts)
        return out

    reach = max([0, *(k for _, k in lagged.values()), *(w - 1 for w in windows)])
    results = {name: F.col(name) for name in lagged} | rolled
    return over_row_history(df, keys, order, add_columns, reach, results, max_rows, strict)
