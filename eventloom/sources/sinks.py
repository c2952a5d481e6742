"""Sinks.  A job's commit makes each of them atomic; none passes rows through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import select


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def run_log(df: DataFrame, path: str) -> None:
    """Append metrics rows."""
    df.write.mode("append").option("header", False).csv(path)


def windows(df: DataFrame, ts: str, as_of: Column, path: str, days: dict[str, int | None]) -> None:
    """One JSON table for each trailing window."""
    for name, part in select.slices(df, ts, as_of, days).items():
        part.write.mode("overwrite").json(f"{path}/triplets_{name}")


def dated(df: DataFrame, path: str, run_date: str) -> None:
    """A run's changes in a partition of their own."""
    df.withColumn("run_date", F.lit(run_date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").json(path)
