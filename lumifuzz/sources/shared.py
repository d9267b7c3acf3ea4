"""Tables written to the folder that driver and executors share, to cut a plan's lineage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir. Where that is unset, a local one, which is refused unless all executors run on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str:
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    return f"file://{tempfile.gettempdir()}/lumifuzz-checkpoints"


def reads(df: DataFrame, *made: DataFrame) -> DataFrame:
    """df, which is read from what cut() wrote for these, so that the caller can give that back when df itself has been written."""
    df._lumifuzz_reads = made
    return df


def cut(df: DataFrame, name: str, last: bool = False) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and a lost executor loses nothing. last: df is not read any more after this, so what it was read from is deleted."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    if last:
        drop(*getattr(df, "_lumifuzz_reads", ()))
    out = spark.read.schema(df.schema).parquet(path)
    out._lumifuzz_folder = path
    return out


def drop(*made: DataFrame) -> None:
    """Deletes what cut() wrote for these, once nothing reads it any more."""
    for df in made:
        delete(df.sparkSession, df._lumifuzz_folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """As many as a shuffle has, for small rows that make many: asked for by number, so that they are not put together by their size before that."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
