"""Stores of what was taken out: content by its hash, originals by their key, with an age at which they go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TTL_DAYS = 7


def append_reveals(rows: DataFrame, path: str, content: str = "content") -> None:
    """Append (sha256, content, written_at, day) for the distinct contents of rows; writing one again does no harm."""
    out = rows.select(F.col(content).alias("content")).where("content IS NOT NULL").distinct()
    out.select(F.sha2("content", 256).alias("sha256"), "content", F.current_timestamp().alias("written_at"), F.current_date().alias("day")).write.mode("append").partitionBy("day").parquet(path)


def read_reveals(spark: SparkSession, path: str, days: int = TTL_DAYS) -> DataFrame:
    """(sha256, content) not older than days, each once; old days are never read."""
    young = spark.read.parquet(path).where(F.col("day") >= F.date_sub(F.current_date(), days))
    return young.groupBy("sha256").agg(F.min("content").alias("content"))


def lookup(keys: DataFrame, store: DataFrame, key: str = "sha256") -> DataFrame:
    """keys with content, null where the store has none."""
    return keys.join(store, key, "left")


def sweep(spark: SparkSession, path: str, days: int = TTL_DAYS) -> list[str]:
    """Delete the days of a store that are too old to be read; their names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = spark.range(1).select(F.date_sub(F.current_date(), days).cast("string")).first()[0]
    old = [f.getPath() for f in system.listStatus(where) if f.getPath().getName().startswith("day=") and f.getPath().getName()[4:] < last]
    for folder in old:
        system.delete(folder, True)
    return sorted(folder.getName() for folder in old)
