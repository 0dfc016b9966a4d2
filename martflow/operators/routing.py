"""Configuration-driven routing and dimension upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martflow.functions.scalar import keep_keys, kept_keys, merge, plain_op
from martflow.operators.first import latest_version


def parse_config(changes: DataFrame) -> DataFrame:
    """Route of each configuration change: the old row of a delete, else the new one."""
    route = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    rest = [c for c in ("ts", "seq") if c in changes.columns]
    return changes.select(*rest, "op", route.alias("_route")).select(*rest, "op", "_route.*")


def active_config(
    changes: DataFrame, sink_type: str, keys: Sequence[str] = ("source_table",)
) -> DataFrame:
    """Routes in force: the latest change per key, unless that removed it."""
    routes = parse_config(changes).where(F.col("sink_type") == sink_type)
    return latest_version(routes, list(keys), ["ts", "seq"]).where("op <> 'd'")


def in_force(changes: DataFrame, sink_type: str) -> DataFrame:
    """Routes with the span of time each was in force: from its change, until the next one of its table.

    `since` is in the span, `until` (null: still in force) is not; of changes at one time the last one counts. A removed
    route leaves a gap. The configuration is small beside what it routes: a table's versions are sorted in one task.
    """
    routes = parse_config(changes).where(F.col("sink_type") == sink_type)
    after = F.lead("ts").over(Window.partitionBy("source_table").orderBy("ts", "seq"))
    spans = routes.withColumn("until", after).where("op <> 'd' AND (until IS NULL OR until > ts)")
    return spans.withColumnRenamed("ts", "since").drop("op", "seq")


def route_as_of(changes: DataFrame, spans: DataFrame, normalise: bool = True) -> DataFrame:
    """Changes joined with the route in force at their own time, wanted operations only.

    Spark broadcasts the spans below its threshold, and else splits tables with many changes.
    """
    op = plain_op(F.col("type")) if normalise else F.col("type")
    rules = rules_of(spans, "since", "until")
    now = (F.col("ts") >= F.col("since")) & (F.col("until").isNull() | (F.col("ts") < F.col("until")))
    routed = changes.withColumn("op_type", op).join(rules, (F.col("table") == F.col("source_table")) & now)
    return routed.where(wanted_op()).drop("since", "until", "_ops")


def epochs(changes: DataFrame) -> DataFrame:
    """Dimensions that exist, with the time their present life began: sink_table, born.

    Creating a dimension leaves what is there; changing or removing its route drops its rows, and it
    exists unless the last change removed it.
    """
    routes = parse_config(changes).where(F.col("sink_type") == "DIM")
    found = routes.groupBy("sink_table").agg(
        F.max(F.when(F.col("op").isin("u", "d"), F.struct("ts", "seq"))).alias("_drop"),
        F.max_by("op", F.struct("ts", "seq")).alias("_last"),
    )
    return found.where("_last <> 'd'").select("sink_table", F.coalesce("_drop.ts", F.lit(-(2**63))).alias("born"))


def living(rows: DataFrame, lives: DataFrame) -> DataFrame:
    """Dimension changes of the present life of their dimension."""
    lives = lives.withColumnRenamed("sink_table", "_sink")
    found = rows.join(lives, (F.col("sink_table") == F.col("_sink")) & (F.col("ts") >= F.col("born")))
    return found.drop("_sink", "born")


def rules_of(routes: DataFrame, *more: str) -> DataFrame:
    """What a change needs of its route; lists are parted here, once a route and not for every change."""
    return routes.select(
        "source_table", "source_type", "sink_table", "sink_columns", "sink_row_key", *more,
        F.split("source_type", ",").alias("_ops"), kept_keys(F.col("sink_columns")).alias("_kept"),
    )


def wanted_op():
    """Whether a route takes the operation of a change: ALL, or a comma list naming it."""
    return (F.col("source_type") == "ALL") | F.array_contains("_ops", F.col("op_type"))


def route(changes: DataFrame, config: DataFrame, normalise: bool = True) -> DataFrame:
    """Changes joined with the route of their table, wanted operations only.

    `normalise` turns a snapshot row into an insert; a fact router leaves operations as is.
    """
    op = plain_op(F.col("type")) if normalise else F.col("type")
    return (
        changes.withColumn("op_type", op)
        .join(rules_of(config), F.col("table") == F.col("source_table"))
        .where(wanted_op())
        .drop("_ops")
    )


def prune(routed: DataFrame) -> DataFrame:
    """Only the configured columns of each record, plus its operation; `row_key` is the value of the key among them.

    The key is found without the pruned record, which a filter on it would otherwise make once more for every change.
    """
    marked = merge(F.col("data"), F.create_map(F.lit("op_type"), F.col("op_type")))
    key = F.col("sink_row_key")
    own = F.when(key == "op_type", F.col("op_type")).otherwise(F.element_at("data", key))
    row_key = F.when(F.array_contains("_kept", key), own)
    return routed.withColumns({"data": keep_keys(marked, F.col("_kept")), "row_key": row_key}).drop("_kept")


def dimension_changes(routed: DataFrame) -> DataFrame:
    """sink_table, row key, operation, record and order of each dimension change that `prune` gives."""
    return routed.select(
        "sink_table",
        "row_key",
        "op_type",
        "data",
        "ts",
        "seq",
    ).where("row_key IS NOT NULL")


def compact(changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Current rows: the latest change per key, deleted keys left out."""
    return current(latest_version(changes, list(keys), list(order)))


def apply_changes(
    table: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "seq")
) -> DataFrame:
    """A dimension after a set of changes, which may be earlier than what the table holds.

    The table keeps the latest change of each key by the same order as `compact`, deletions as
    markers, so that a change overtaken by one stays overtaken; `current` gives the rows.
    """
    return latest_version(table.unionByName(changes), list(keys), list(order))


def current(table: DataFrame) -> DataFrame:
    """Rows of a dimension that keeps markers."""
    return table.where("op_type <> 'delete'")
