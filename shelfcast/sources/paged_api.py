"""Paged HTTP-style sales source as a Spark data source.

The fetch function is handed in, so the reader works for any client library:
``fetch(start_date, end_date, limit, offset) -> {"data": [record, ...], "has_more": bool}``.
"""

from __future__ import annotations

import base64
import logging
import time
from collections.abc import Callable, Iterator, Sequence
from datetime import date, datetime, timedelta
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

log = logging.getLogger(__name__)

# Page size, attempts and wait bounds in seconds.
PAGE_SIZE = 1000
ATTEMPTS = 3
MIN_WAIT = 2.0
MAX_WAIT = 30.0
RETRIED = (ConnectionError, TimeoutError)

Fetch = Callable[[str, str, int, int], dict[str, Any]]


class Pages(InputPartition):
    """Every ``stripes``-th page of one date slice, from page ``first`` on."""

    def __init__(self, start: str, end: str, first: int, stripes: int):
        super().__init__((start, end, first, stripes))
        self.start, self.end, self.first, self.stripes = start, end, first, stripes


def fetch_with_retry(fetch: Fetch, *args: Any, wait: float = MIN_WAIT, sleep=time.sleep) -> dict[str, Any]:
    """Repeat on connection errors and time-outs, with exponentially growing waits."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return fetch(*args)
        except RETRIED:
            if attempt == ATTEMPTS:
                raise
            sleep(min(MAX_WAIT, wait * 2 ** (attempt - 1)))
    raise AssertionError("unreachable")


def date_slices(start: date, end: date, days: int) -> list[tuple[str, str]]:
    """Inclusive slices of at most ``days`` days."""
    slices = []
    while start <= end:
        last = min(end, start + timedelta(days=days - 1))
        slices.append((start.isoformat(), last.isoformat()))
        start = last + timedelta(days=1)
    return slices


def _converter(kind: T.DataType) -> Callable[[Any], Any]:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return lambda v: datetime.fromisoformat(v) if isinstance(v, str) else v
    if isinstance(kind, T.DateType):
        return lambda v: date.fromisoformat(v[:10]) if isinstance(v, str) else v
    if isinstance(kind, T.StringType):
        return lambda v: v if v is None else str(v)
    if isinstance(kind, T.DoubleType):
        return lambda v: v if v is None else float(v)
    return lambda v: v


class PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema = schema
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        start, end = (date.fromisoformat(self.options[k]) for k in ("startdate", "enddate"))
        stripes = int(self.options.get("stripes", "1"))
        slices = date_slices(start, end, int(self.options.get("slicedays", "1")))
        return [Pages(a, b, i, stripes) for a, b in slices for i in range(stripes)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        fetch: Fetch = cloudpickle.loads(base64.b64decode(self.options["fetch"]))
        size = int(self.options.get("pagesize", str(PAGE_SIZE)))
        strict = self.options.get("failonerror", "true").lower() == "true"
        wait = float(self.options.get("wait", str(MIN_WAIT)))
        converters = [(f.name, _converter(f.dataType)) for f in self.schema.fields]
        page, more = partition.first, True
        while more:
            try:
                body = fetch_with_retry(fetch, partition.start, partition.end, size, page * size, wait=wait)
                records = [tuple(to(r.get(name)) for name, to in converters) for r in body.get("data", [])]
            except Exception as problem:
                if strict:
                    raise
                log.error("pages from %s stopped: %s", partition.start, problem)
                return  # pages already read are kept
            yield from records
            more = bool(body.get("has_more", False))
            page += partition.stripes


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> T.StructType:
        raise ValueError("the paged source needs a schema")

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(schema, {k.lower(): v for k, v in self.options.items()})


def read_pages(
    spark: SparkSession,
    fetch: Fetch,
    schema: T.StructType,
    start: date,
    end: date,
    page_size: int = PAGE_SIZE,
    slice_days: int = 1,
    stripes: int = 1,
    fail_on_error: bool = True,
    wait: float = MIN_WAIT,
) -> DataFrame:
    """Records between two dates, one task per date slice and stripe.

    A task reads its slice page by page. ``stripes`` lets several tasks share the pages of a slice
    that holds many records. With ``fail_on_error=False`` a broken slice keeps the pages read so far.
    """
    spark.dataSource.register(PagedSource)
    return (
        spark.read.format("paged_api")
        .schema(schema)
        .option("fetch", base64.b64encode(cloudpickle.dumps(fetch)).decode())
        .option("startDate", start.isoformat())
        .option("endDate", end.isoformat())
        .option("pageSize", page_size)
        .option("sliceDays", slice_days)
        .option("stripes", stripes)
        .option("failOnError", str(fail_on_error).lower())
        .option("wait", wait)
        .load()
    )


def default_dates(last_processed: datetime | None, now: datetime, days: int = 7) -> tuple[date, date]:
    """From the last processed time, or ``days`` back, until now."""
    return (last_processed or now - timedelta(days=days)).date(), now.date()
