"""Session set-up and the shared folder that materialised tables go to."""

from __future__ import annotations

import atexit
import contextlib
import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


log = logging.getLogger(__name__)


def build_session(app: str = "shelfcast", master: str = "local[*]", partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.files.openCostInBytes", str(1 << 20))  # small tables still use all threads
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Generated methods above this size are never compiled by the JVM; wide projections then run
        # faster as many small methods.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Call sites of single column expressions cost more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """Checkpoint folder of this session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting
    gets a temporary folder; a machine-local folder on a cluster would be lost with the machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured and configured.startswith("file:") and not sc.master.startswith("local"):
        log.warning("%s must be a mount that the driver and all executors share", configured)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="shelfcast-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_folders: set[str] = set()


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Delete this application's tables when the driver ends; a driver that is killed leaves them behind."""
    if folder in _folders:
        return
    _folders.add(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        with contextlib.suppress(Exception):
            path.getFileSystem(hadoop).delete(path, True)

    atexit.register(remove)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused folder of this application below the checkpoint folder, deleted when the driver ends."""
    folder = f"{checkpoint_root(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    _remove_at_exit(spark, folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute a narrow or small ``df`` once and read it from reliable storage from then on."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


# Shuffle files of a query go when it ends; else they stay on disk until the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store_table(df: DataFrame, label: str) -> DataFrame:
    """Write a wide ``df`` once as compressed columns; later reads load only the columns they need.

    The shuffle files of the write are removed with its end: all that reads the table reads what was written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Delete a table of ``store_table`` that nothing reads any more; others are left alone."""
    spark = table.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        if any(f"{known}/".split(":", 1)[-1].lstrip("/") in folder for known in _folders):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
