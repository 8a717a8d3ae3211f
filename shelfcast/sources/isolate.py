"""Reading many files so that one that cannot be read costs its own rows only."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.session import store_table

log = logging.getLogger(__name__)

ERROR_SCHEMA = "file string, error string"
# Error conditions of Spark's readers that speak of a file's content; all others end the load.
UNREADABLE = ("FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "MALFORMED_RECORD_IN_PARSING", "CANNOT_MERGE_SCHEMAS",
              "UNABLE_TO_INFER_SCHEMA", "is not a Parquet file", "MALFORMED_CSV_RECORD")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> list[str]:
    """Names of the files below a folder; their content is not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return sorted(r["path"] for r in found.select("path").collect())


def _speaks_of_a_file(problem: Exception) -> bool:
    text = str(problem)
    condition = problem.getCondition() if isinstance(problem, PySparkException) else None
    return any(u in (condition or "") or u in text for u in UNREADABLE)


def read_isolated(
    spark: SparkSession, files: Sequence[str], schema: T.StructType, fmt: str = "parquet",
    options: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows of all files that can be read whole, with their ``_source_file``, and a table ``(file, error)`` of
    the others.

    The rows are stored while they are read, which is when a broken file shows. As long as nothing breaks there
    is one job. Where a set of files fails it is halved until the broken file stands alone, so b broken ones among n
    cost about b log n jobs, and what was read whole is not read again. Text formats fail on malformed records
    instead of dropping them. A file of no bytes has no rows. Errors that are not about a file, such as a lost cluster, are raised.
    """
    strict = {"mode": "FAILFAST", **(options or {})} if fmt in ("csv", "json") else dict(options or {})
    strict["ignoreCorruptFiles"] = strict["ignoreMissingFiles"] = "false"
    good: list[DataFrame] = []
    broken: list[tuple[str, str]] = []

    def attempt(some: Sequence[str]) -> None:
        try:
            rows = spark.read.schema(schema).format(fmt).options(**strict).load(list(some))
            good.append(store_table(rows.withColumn("_source_file", F.col("_metadata.file_path")), "isolated"))
        except (PySparkException, Py4JJavaError) as problem:
            if not _speaks_of_a_file(problem):
                raise
            if len(some) == 1:
                log.error("%s cannot be read: %s", some[0], problem)
                broken.append((some[0], str(problem).split("\n")[0]))
                return
            attempt(some[: len(some) // 2])
            attempt(some[len(some) // 2:])

    if files:
        attempt(list(files))
    empty = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_source_file", T.StringType())]))
    rows = reduce(DataFrame.unionByName, good) if good else empty
    return rows, spark.createDataFrame(broken, ERROR_SCHEMA)
