"""Input that arrives in fewer partitions than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def over_cores(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it has fewer partitions (one small file, say). Tables of any size have more, and are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
