"""Streaming forms: the same column functions on streams, and windowed aggregates with late data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, with the schema they have now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, ts: str, width: str, late: str, by: Sequence[str], **aggregates: Column) -> DataFrame:
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, width), *by)
    return _plain(grouped.agg(*(a.alias(n) for n, a in aggregates.items())))


def sliding(events: DataFrame, ts: str, width: str, step: str, late: str, by: Sequence[str], **aggregates: Column) -> DataFrame:
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, width, step), *by)
    return _plain(grouped.agg(*(a.alias(n) for n, a in aggregates.items())))


def sessions(events: DataFrame, ts: str, gap: str, late: str, by: Sequence[str], **aggregates: Column) -> DataFrame:
    grouped = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("window"), *by)
    return _plain(grouped.agg(*(a.alias(n) for n, a in aggregates.items())))


def _plain(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(c for c in df.columns if c != "window"))
