"""Union of configured sources; one that fails does not stop the others."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.calendar import parse_dates
from shelfcast.session import store_table
from shelfcast.sources import files, kafka, paged_api
from shelfcast.sources.isolate import list_files, read_isolated

log = logging.getLogger(__name__)

Reader = Callable[[SparkSession, dict[str, Any]], DataFrame]
ERROR_SCHEMA = "source string, type string, error string"


def _api(spark: SparkSession, c: dict[str, Any]) -> DataFrame:
    options = {k: c[k] for k in ("page_size", "slice_days", "stripes", "fail_on_error", "wait") if k in c}
    return paged_api.read_pages(spark, c["fetch"], c["schema"], c["start"], c["end"], **options)


def _kafka(spark: SparkSession, c: dict[str, Any]) -> DataFrame:
    return kafka.decode_messages(kafka.topic_batch(spark, c["bootstrap_servers"], c["topic"]), c["schema"])


def _dataset(spark: SparkSession, c: dict[str, Any]) -> DataFrame:
    return files.read_split(spark, c["root"], c["dataset"], c.get("split", "train"), c.get("format", "parquet"))


def _prefix(spark: SparkSession, c: dict[str, Any]) -> DataFrame:
    return files.read_prefix(spark, f"{c['bucket'].rstrip('/')}/{c['prefix'].lstrip('/')}", c.get("schema"))


# Source type names of the configuration.
READERS: dict[str, Reader] = {"api": _api, "kafka": _kafka, "huggingface": _dataset, "s3": _prefix}


def collect_sources(
    spark: SparkSession,
    sources: list[dict[str, Any]],
    strict: bool = False,
    readers: dict[str, Reader] | None = None,
    isolate: bool = False,
) -> tuple[DataFrame | None, DataFrame]:
    """All sources by name under a ``_source`` column, and a table of the ones that failed.

    Building a frame resolves its files and schema, so a missing path or bad setting is caught here.
    Sources of an unknown type are skipped, or raise with ``strict``.

    With ``isolate`` each source is read and stored here, so that one that fails while it is read is listed and
    does not fail the union. File sources with a schema then lose only the files that cannot be read, each a
    row of the table of failures.
    """
    known = {**READERS, **(readers or {})}
    frames: list[DataFrame] = []
    failed: list[tuple[str, str, str]] = []
    for source in sources:
        kind, name = source.get("type", ""), source.get("name", "")
        if kind not in known:
            if strict:
                raise ValueError(f"Unknown source type: {kind}")
            continue
        try:
            if isolate and kind == "s3" and source.get("schema") is not None:
                folder = f"{source['bucket'].rstrip('/')}/{source['prefix'].lstrip('/')}"
                rows, broken = read_isolated(
                    spark, list_files(spark, folder, source.get("glob", "*.parquet")), source["schema"])
                failed += [(name, kind, f"{r['file']}: {r['error']}") for r in broken.collect()]
                rows = rows.withColumn("_ingestion_timestamp", F.current_timestamp())
            else:
                rows = known[kind](spark, source)
                rows = store_table(rows, f"source-{name}") if isolate else rows
            frames.append(parse_dates(rows).withColumn("_source", F.lit(name)))
        except Exception as problem:
            log.error("source %s failed: %s", name, problem)
            failed.append((name, kind, str(problem).split("\n")[0]))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None
    return union, spark.createDataFrame(failed, ERROR_SCHEMA)
