"""Incremental counting as an extension: batches of reads or counts that arrive as files are added by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(stream: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Sums by key over all that has arrived; write in complete or update mode."""
    return stream.groupBy(*keys).agg(F.sum(measure).alias(measure))


def windowed_counts(stream: DataFrame, time: str, keys: list[str], length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"))


def merge_into(path: str, keys: list[str], measure: str):
    """A foreachBatch sink that keeps each batch as its own folder of partial sums, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(*keys).agg(F.sum(measure).alias(measure)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def merged(spark, path: str, keys: list[str], measure: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum(measure).alias(measure))
