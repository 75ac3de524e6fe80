"""Session settings shared by tests, the bench and interactive use."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "corpuslab", master: str | None = None, **overrides: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    ``master`` is left to spark-submit unless given. Keyword overrides use
    ``__`` for the dots of a setting name.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in overrides.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local"):
        ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application.

    Workers that find the package on their own path use the same code either way.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="corpuslab-")
    archive = shutil.make_archive(
        os.path.join(folder, "corpuslab"), "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors are one process, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="corpuslab-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{os.urandom(6).hex()}")


def fixed_table(spark: SparkSession, **columns: tuple[pa.DataType, list]) -> DataFrame:
    """A small table of known values; it arrives as a local relation of known size."""
    return spark.createDataFrame(
        pa.table({name: pa.array(values, kind) for name, (kind, values) in columns.items()}))


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Jobs that run inside send their rows to Python in batches of about ``size`` bytes.

    Spark bounds a batch by 10,000 rows and 64 MB, which texts fill: the executor and its worker
    both hold it, and the executor twice while it grows. Settings of the session that are smaller
    stay; rows are the same, since no operator here depends on where a batch ends.
    """
    key, jvm = "spark.sql.execution.arrow.maxBytesPerBatch", spark.sparkContext._jvm
    size_of = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = spark.conf.get(key, None)
    if before is None or not 0 < size_of(before) <= size_of(size):
        spark.conf.set(key, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def sorted_limits(spark: SparkSession) -> Iterator[None]:
    """Queries that order and limit inside are sorted by ranges, of which the driver takes the first.

    Otherwise each task sends it as many rows as the limit, to be merged there.
    """
    key = "spark.sql.execution.topKSortFallbackThreshold"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an expensive table once to the shared folder and go on from the files.

    For tables that later steps read more than once; survives lost executors, and a
    reader of two columns reads two columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
