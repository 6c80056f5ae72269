"""Tables that a query writes for itself, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and the session is one process, a temporary folder of it."""
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    found = spark.conf.get("spark.checkpoint.dir", None) or _folders.get(app)
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = _folders[app] = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    return found.rstrip("/")


def _own_path(spark: SparkSession, name: str) -> str:
    """A new path there, which goes when the application ends."""
    path = f"{shared_folder(spark)}/palimpsest-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that tasks write themselves; it goes when the application ends."""
    return _own_path(spark, name)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a write goes with its end.  Else it stays on the disks until the driver happens to collect garbage, beside the table and all that is made of it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def gone(spark: SparkSession, path: str) -> None:
    """Take away a ``folder`` that nothing will read again, before the application ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet, written once and read back."""
    path = _own_path(df.sparkSession, name)
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` in buckets of ``column``: a filter on it reads one bucket, and joins on it need no shuffle."""
    spark = df.sparkSession
    table, n = f"palimpsest_{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _shuffles_go(spark):
        df.repartition(n, column).write.option("path", _own_path(spark, name)).bucketBy(n, column).sortBy(column).saveAsTable(table)
    return spark.table(table)


def files_of(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, size, time of change) of the files that ``df`` reads: what is kept of them is outdated when this differs."""
    spark, out = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python at most ``rows`` at a time; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
