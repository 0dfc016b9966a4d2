"""Tumbling event-time windows and their stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martflow import codes


def event_time(df: DataFrame, name: str) -> Column:
    """A text time as a timestamp; a timestamp as it is, so that it keeps its watermark."""
    col = F.col(name)
    if not isinstance(df.schema[name].dataType, T.TimestampType):
        col = col.cast("timestamp")
    return col.alias(name)


def tumble(df: DataFrame, time: str, *keys: str, size: str = codes.WINDOW) -> GroupedData:
    """Rows grouped by window and keys, on batch and streaming data alike."""
    return df.groupBy(F.window(time, size).alias("window"), *keys)


def stamped(df: DataFrame) -> DataFrame:
    """Window start and end; the day is that of the window's start."""
    return df.select(
        F.col("window.start").alias("stt"),
        F.col("window.end").alias("edt"),
        F.to_date("window.start").alias("cur_date"),
        *[c for c in df.columns if c != "window"],
    )


def distinct_per_window(
    df: DataFrame, time: str, value: str, out: str, *keys: str, only: Column | None = None
) -> DataFrame:
    """Exact distinct count per window (of rows where `only` holds), in two groupings.

    The first grouping carries the value in its key, so a busy window is spread over all
    tasks; both groupings also run in append-mode streams.
    """
    counted = F.col(value) if only is None else F.when(only, F.col(value))
    once = tumble(df.withColumn("_value", counted), time, *keys, "_value").agg(F.count("*"))
    return stamped(once.groupBy("window", *keys).agg(F.count("_value").alias(out)))
