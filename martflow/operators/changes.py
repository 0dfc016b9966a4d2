"""Selections over the change log and shapes of the behaviour log."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martflow import codes
from martflow.functions.scalar import merge


def _value(rows: DataFrame, side: str, name: str) -> Column:
    return F.col(side)[name] if side in rows.columns else F.col(f"{side}_{name}")


def d(rows: DataFrame, name: str) -> Column:
    """Current value of a business column, of a map `data` or a column `data_name`."""
    return _value(rows, "data", name)


def o(rows: DataFrame, name: str) -> Column:
    """Value before the change; NULL where the column did not change."""
    return _value(rows, "old", name)


Log = DataFrame | Mapping[str, DataFrame]


def rows_of(log: Log, table: str, *ops: str) -> DataFrame:
    """Changes of one table from a mixed log, or from a log kept by table."""
    rows = log.where(F.col("table") == table) if isinstance(log, DataFrame) else log[table]
    return rows.where((F.col("database") == codes.DATABASE) & F.col("type").isin(*ops))


def fields(changes: DataFrame, *names: str, **more: Column) -> DataFrame:
    """Business columns by name, more columns by expression, then ts, et and seq."""
    return changes.select(
        *[d(changes, n).alias(n) for n in names],
        *[c.alias(n) for n, c in more.items()],
        "ts", "et", "seq",
    )


def moved(changes: DataFrame, column: str, before: str, after: str) -> DataFrame:
    """Updates that took a column from one value to another."""
    return changes.where((o(changes, column) == before) & (d(changes, column) == after))


def changed_to(changes: DataFrame, column: str, after: str) -> DataFrame:
    """Updates that changed a column, whatever it was, to a value."""
    return changes.where(o(changes, column).isNotNull() & (d(changes, column) == after))


def increase(changes: DataFrame, column: str, out: str) -> DataFrame:
    """Inserts and growing updates, with the growth as an integer."""
    new, old = d(changes, column).cast("bigint"), o(changes, column).cast("bigint")
    grown = (F.col("type") == "insert") | ((F.col("type") == "update") & (new > old))
    return changes.where(grown).withColumn(out, new - F.coalesce(old, F.lit(0)))


# --- behaviour log --------------------------------------------------------------------


def _head() -> Column:
    return merge(F.col("common"), F.create_map(F.lit("ts"), F.col("ts").cast("string")))


def flatten(logs: DataFrame, *parts: str) -> DataFrame:
    """common + ts + parts as one map `record`; a later part wins. Needs the first part."""
    record = merge(_head(), *[F.col(p) for p in parts])
    return logs.where(F.col(parts[0]).isNotNull()).select("seq", record.alias("record"))


def explode_part(logs: DataFrame, part: str) -> DataFrame:
    """One row per shown item or action of a page; actions keep their own time."""
    page = merge(_head(), F.col("page"))
    rows = logs.where("page IS NOT NULL AND start IS NULL").select(
        "seq", page.alias("_page"), F.posexplode(part).alias("pos", "_item")
    )
    maps = [F.col("_item"), F.col("_page")]
    if part == "actions":
        maps.append(F.create_map(F.lit("ts"), F.col("_item")["ts"]))
    record = merge(*maps)
    return rows.select("seq", "pos", record.alias("record"))
