"""Work for all cores where a table comes in too few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df, dealt anew by hash where its scan has fewer tasks than half the cores; large tables stay as they are.

    A file of one row group is one task, however many cores there are.  That is
    so for small tables only, so what is shuffled here is little.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df.rdd.getNumPartitions() <= cores:
        return df.repartition(cores, *by)
    return df
