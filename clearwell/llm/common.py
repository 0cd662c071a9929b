"""What the operators of this package share: tables, scratch folders, Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch; with texts of some hundred KB a batch stays under some hundred MB.
BATCH_ROWS = 512
#: Rows of a batch of a few numbers each.
NARROW_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings that bound the memory of Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")


@contextmanager
def batch_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Rows of an Arrow batch for the jobs that run inside; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the checkpoint directory set in the session.

    Without either, a session on one machine uses its warehouse; elsewhere that is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    given = context._jsc.sc().getCheckpointDir()
    if folder is None and given.isDefined():
        folder = given.get()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.scratch"
    if given.isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives lost executors.  It goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    on_exit(spark, path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {os.path.dirname(f) for f in df.inputFiles()}
    for folder in folders:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not when the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give the memory that a worker has freed back to the system; workers are used again by tasks of other kinds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """run, with trim() when a task ends."""

    @functools.wraps(run)
    def trimmed(batches: Iterable) -> Iterator:
        yield from run(batches)
        trim()

    return trimmed


class Memo(dict):
    """A dict that computes what it lacks and stops growing at a bound."""

    def __init__(self, make: Callable, bound: int):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.bound:
            self[key] = value
        return value
