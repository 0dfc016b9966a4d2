"""Raw JSON lines to typed records: change logs, behaviour logs, configuration changes.

Parsing never raises: a broken line yields NULL fields plus its text in `_broken`, and the
validity filters drop it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martflow import codes
from martflow.functions.scalar import not_blank

CHANGE = (
    "`table` STRING, `database` STRING, `type` STRING, ts STRING,"
    " data MAP<STRING,STRING>, old MAP<STRING,STRING>"
)
BEHAVIOUR = (
    "common MAP<STRING,STRING>, ts BIGINT, start MAP<STRING,STRING>,"
    " page MAP<STRING,STRING>, displays ARRAY<MAP<STRING,STRING>>,"
    " actions ARRAY<MAP<STRING,STRING>>, err MAP<STRING,STRING>"
)
_ROUTE = (
    "STRUCT<source_table STRING, source_type STRING, sink_table STRING, sink_type STRING,"
    " sink_family STRING, sink_columns STRING, sink_row_key STRING>"
)
CONFIG = f"op STRING, ts BIGINT, before {_ROUTE}, after {_ROUTE}"
LINES = T.StructType([T.StructField("value", T.StringType())])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text records of a folder; absent values are skipped."""
    return spark.read.text(path).where("value IS NOT NULL")


def read_line_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same as a stream, oldest files first."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .text(path)
        .where("value IS NOT NULL")
    )


def parse_json(lines: DataFrame, schema: str, line: str = "value") -> DataFrame:
    """Declared fields of a JSON text column beside the other columns of the input.

    The record is unpacked by a generator, so that a filter on its fields stays above it and
    a line is parsed once; pushed below, the filter would parse it again for each field.
    """
    rest = [c for c in lines.columns if c != line]
    parsed = F.from_json(
        line, f"{schema}, _broken STRING", {"columnNameOfCorruptRecord": "_broken"}
    )
    return lines.select(*rest, F.inline(F.array(parsed)))


def change_log(lines: DataFrame) -> DataFrame:
    """Change records with event time: table, database, type, ts, data, old, et."""
    return (
        parse_json(lines, CHANGE)
        .withColumn("ts", F.col("ts").try_cast("bigint"))
        .withColumn("et", F.timestamp_seconds("ts"))
    )


def valid_changes(
    changes: DataFrame,
    ops: Iterable[str] = codes.DIM_OPS,
    database: str = codes.DATABASE,
) -> DataFrame:
    """Whole records of the business database with a known operation and some data."""
    keep = (
        (F.col("database") == database)
        & not_blank(F.col("table"))
        & F.col("type").isin(*ops)
        & F.col("ts").isNotNull()
        & (F.size("data") > 0)
    )
    if "_broken" in changes.columns:
        keep = keep & F.col("_broken").isNull()
    return changes.where(keep).drop("_broken")


def behaviour_log(lines: DataFrame) -> DataFrame:
    return parse_json(lines, BEHAVIOUR)


def valid_behaviour(logs: DataFrame) -> DataFrame:
    """Records that carry at least one non-empty part."""

    def filled(name: str) -> Column:
        return F.coalesce(F.size(name) > 0, F.lit(False))

    keep = (
        filled("start") | filled("page") | filled("err") | filled("displays") | filled("actions")
    )
    if "_broken" in logs.columns:
        keep = keep & F.col("_broken").isNull()
    return logs.where(keep).drop("_broken")


def config_log(lines: DataFrame) -> DataFrame:
    return parse_json(lines, CONFIG).where(F.col("_broken").isNull()).drop("_broken")
