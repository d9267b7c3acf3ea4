"""Rule bases over streams: stateless scoring, and windowed counts of winners behind a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumifuzz.operators.rules import RuleBase


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of a batch table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score(stream: DataFrame, base: RuleBase, names: bool = False) -> DataFrame:
    """The same projection as for a batch: no state."""
    return base.predict(stream, names)


def winner_counts(stream: DataFrame, base: RuleBase, time: str, window: str = "1 day", late: str = "1 hour", by: Sequence[str] = ()) -> DataFrame:
    """window_start, winner, n and strength (mean highest firing strength) in event time; rows later than the watermark are left out, and windows leave the state once it has passed them."""
    made = base.explain(stream.withColumn(time, F.col(time).cast("timestamp"))).withWatermark(time, late)
    counted = made.groupBy(F.window(time, window).alias("_w"), "winner", *by).agg(F.count("*").alias("n"), F.avg("strength").alias("strength"))
    return counted.select(F.col("_w.start").alias("window_start"), "winner", *by, "n", "strength")
