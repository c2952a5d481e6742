"""Batches that come one after the other, as streams of files.

The hourly runs of a batch pipeline become micro-batches: new files are found by the source, what was seen is
kept by the state, and tables change by a merge in each batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import merge


def new_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Stream of rows of JSON files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def first_sightings(stream: DataFrame, key: str, ts: str, delay: str = "7 days") -> DataFrame:
    """Rows of keys not seen within the delay; the state forgets older ones."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def weekly_counts(stream: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """Counts by tumbling week (epoch weeks moved to begin on Monday), each given once when the week is over."""
    from pyspark.sql import functions as F

    return stream.withWatermark(ts, delay).groupBy(F.window(ts, "7 days", startTime="4 days").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("week"), "n")


def merge_into(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, once: bool = True, change: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Upsert each batch into a table of versions under path: batch n reads version n - 1 and writes version n, so that a
    batch that is tried again gives the same table."""

    def apply(batch: DataFrame, n: int) -> None:
        spark, new = batch.sparkSession, change(batch)
        if n:
            new = merge.upsert(spark.read.parquet(f"{path}/v={n - 1}"), new, keys, order)
        else:
            new = merge.upsert(new.limit(0), new, keys, order)
        new.write.mode("overwrite").parquet(f"{path}/v={n}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
