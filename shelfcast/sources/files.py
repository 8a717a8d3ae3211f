"""File readers: JSON, CSV, Parquet below a prefix, and sharded datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Canonical sales row.
SALES_SCHEMA = T.StructType([
    T.StructField("date", T.TimestampType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("store_id", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
])


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """An object or a list of objects per file; ``lines`` reads one object per line, which splits."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred, which reads the file twice."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def with_provenance(df: DataFrame) -> DataFrame:
    """Source file and load time of each row."""
    return df.withColumns({
        "_source_file": F.col("_metadata.file_path"),
        "_ingestion_timestamp": F.current_timestamp(),
    })


def read_prefix(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All Parquet files below a prefix, with provenance columns."""
    reader = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    return with_provenance((reader.schema(schema) if schema else reader).parquet(path))


def list_entries(spark: SparkSession, path: str) -> DataFrame:
    """``path``: names of the files and folders directly below a folder that hold any file.

    A table may be one file or a folder of part files; either way it is one entry.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.substring_index(F.expr(f"substr(path, {len(root.rstrip('/')) + 2})"), "/", 1)
    return found.select(below.alias("path")).distinct()


def read_split(spark: SparkSession, root: str, dataset: str, split: str = "train", fmt: str = "parquet") -> DataFrame:
    """One split of a sharded dataset laid out as ``root/dataset/split/*``."""
    return spark.read.format(fmt).load(f"{root.rstrip('/')}/{dataset}/{split}")


def stream_prefix(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    files_per_batch: int | None = None,
    glob: str = "*.parquet",
    skip_corrupt: bool = False,
) -> DataFrame:
    """Parquet files below a prefix as a stream: each file is read once, remembered by the checkpoint.

    With ``skip_corrupt`` a file that cannot be read is logged and left out, and the others go on.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if skip_corrupt:
        reader = reader.option("ignoreCorruptFiles", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_provenance(reader.parquet(path))
