"""The warehouse jobs as streams, on the state that Spark keeps.

* "First time" rules are aggregations that hold the earliest row of a key (`firsts`): whatever order rows
  arrive in, the sink's latest state is the earliest row so far. Where a key lives for a day, the
  watermark takes its state away.
* Joins of two streams have watermarks on both sides and a stated span, after which a row is let go;
  `unmatched` gives what found no partner within it.
* Windows over joined or deduplicated rows are chained groupings, each result given once, when it is closed.

State is dealt out by key; aggregations add up in the map tasks first, so a hot key is one row a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martflow import codes
from martflow.operators import routing
from martflow.operators.changes import Log
from martflow.operators.joins import interval_join
from martflow.operators.windows import stamped, tumble
from martflow.plans import dwd, dws
from martflow.sources import ods
from martflow.streaming.arrivals import ticking
from martflow.streaming.sinks import Batch, write_part

#: How far behind the latest row another may come.
DELAY = "1 day"


# --- first times ----------------------------------------------------------------------


def firsts(rows: DataFrame, keys: Sequence[str], day: str | None = None, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """The earliest row of each key so far; with `day`, an event time, of each key and `_day`."""
    kept = [c for c in rows.columns if c not in keys]
    by = [F.window(day, "1 day").alias("_window"), *keys] if day else list(keys)
    found = rows.groupBy(*by).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("_first"))
    return found.select(*keys, *([F.to_date("_window.start").alias("_day")] if day else []), "_first.*")


def views(page: DataFrame) -> DataFrame:
    """Views and time per window and dimensions; of devices with a mark that may be wrong, also per device."""
    sums = tumble(page.withColumn("mid", F.when(F.col("is_new") == "1", F.col("mid"))), "et", "mid", *dws.TRAFFIC).agg(
        F.count("*").alias("pv"), F.sum("during_time").alias("dur"))
    start = F.col("window.start")
    return sums.select(start.alias("et"), F.unix_millis(start).alias("ts"), "mid", *dws.TRAFFIC, "pv", "dur")


# --- joins ----------------------------------------------------------------------------


def _span(days: int) -> Column:
    return F.expr(f"INTERVAL {days} DAYS")


def refunds(log: Log, clock: DataFrame, days: int, how: str = "inner") -> DataFrame:
    """Granted refunds with the order that was set to refunded, at most so many days apart, whichever comes first.

    An outer join gives a refund without such an order once the watermarks have passed the span.
    """
    left = ticking(dwd.granted_refunds(log), clock, "et", DELAY)
    orders = dwd.refunded_orders(log, "et").withColumnRenamed("et", "_order_et")
    right = ticking(orders, clock, "_order_et", DELAY)
    near = F.col("et").between(F.col("_order_et") - _span(days), F.col("_order_et") + _span(days))
    return left.join(right, (F.col("order_id") == F.col("_order")) & near, how).drop("_order_et")


def refund_payments(log: Log, clock: DataFrame, days: int, how: str = "inner") -> DataFrame:
    """Finished refund payments with the refunded lines of their order, within so many days of each other."""
    lines = refunds(log, clock, days).select(
        "_order", "sku_id", "refund_amount", F.col("et").alias("_line_et"))
    paid = ticking(dwd.refund_payments(log), clock, "et", DELAY)
    near = F.col("et").between(F.col("_line_et") - _span(days), F.col("_line_et") + _span(days))
    return paid.join(lines, (F.col("order_id") == F.col("_order")) & near, how)


def lines_of(log: Log, clock: DataFrame, time: str = "et") -> DataFrame:
    """All versions of order lines, with a watermark."""
    rows = dwd.detail_rows(log).withColumn("create_time", F.col("create_time").cast("timestamp"))
    return ticking(rows, clock, time, DELAY)


def placed_lines(log: Log, clock: DataFrame, how: str = "inner", time: str = "et") -> DataFrame:
    """Order lines with their order, which is placed within a minute before or after."""
    orders = dwd.placed_orders(log, "et").withColumnRenamed("et", "_order_et")
    orders = ticking(orders, clock, "_order_et", DELAY)
    minute = F.expr("INTERVAL 1 MINUTE")
    near = F.col(time).between(F.col("_order_et") - minute, F.col("_order_et") + minute)
    return lines_of(log, clock, time).join(orders, (F.col("order_id") == F.col("_order")) & near, how).drop("_order_et")


def line_parts(log: Log, clock: DataFrame) -> DataFrame:
    """What is known of order lines, as rows of an upsert table by line and part.

    A line is there as soon as it comes, without its order; the outer join then gives it anew with the
    order, or without when none came. Coupon and activity name the line, so they need no join.
    """
    parts = dwd.order_detail_parts(log)

    def part(rows: DataFrame, name: str, version: str, **known: str | Column) -> DataFrame:
        cols = {c: F.lit(None).cast("string") for c in (*dwd.DETAIL, *dwd.DETAIL_MORE)}
        cols |= {c: F.col(v) if isinstance(v, str) else v for c, v in known.items()}
        time = [F.col(c) if c in rows.columns else F.lit(None).cast(k) for c, k in (("ts", "bigint"), ("et", "timestamp"))]
        return rows.select(
            *[v.alias(c) for c, v in cols.items()], *[t.alias(c) for t, c in zip(time, ("ts", "et"))],
            F.col(version).alias("seq"), F.lit(name).alias("part"))

    own = {c: c for c in dwd.DETAIL}
    joined = placed_lines(log, clock, "leftOuter")
    return (
        part(parts["detail"], "line", "seq", **own)
        .unionByName(part(joined, "order", "seq", id="id", user_id="user_id", province_id="province_id"))
        .unionByName(part(parts["coupon"], "coupon", "_cd_seq", id="_cd", coupon_id="coupon_id", coupon_use_id="coupon_use_id"))
        .unionByName(part(
            parts["activity"], "activity", "_ad_seq", id="_ad", activity_id="activity_id", activity_rule_id="activity_rule_id"))
    )


LINE_KEYS, LINE_ORDER = ("id", "part"), ("seq",)


def merged_lines(parts: DataFrame) -> DataFrame:
    """Order lines from the current rows of their parts; parts of lines not yet there wait."""
    groups = {
        "line": [*dwd.DETAIL[1:], "ts", "et", "seq"], "order": ["user_id", "province_id"],
        "coupon": ["coupon_id", "coupon_use_id"], "activity": ["activity_id", "activity_rule_id"],
    }
    found = parts.groupBy("id").agg(*[
        F.max(F.when(F.col("part") == name, F.struct(*columns))).alias(f"_{name}") for name, columns in groups.items()])
    return found.where("_line IS NOT NULL").select("id", *[F.col(f"_{n}.{c}").alias(c) for n, cs in groups.items() for c in cs])


def cancelled_lines(log: Log, clock: DataFrame) -> DataFrame:
    """Lines of orders cancelled within a day."""
    cancelled = dwd.cancelled_orders(log).withColumnRenamed("et", "_cancel_et")
    cancelled = ticking(cancelled, clock, "_cancel_et", DELAY)
    lines = lines_of(log, clock).select("id", "order_id", "seq", "et")
    near = F.col("et").between(F.col("_cancel_et") - _span(1), F.col("_cancel_et"))
    return cancelled.join(lines, (F.col("_order") == F.col("order_id")) & near).select("id", "cancel_time", "ts", "seq")


def paid_lines(log: Log, clock: DataFrame, how: str = "inner") -> DataFrame:
    """Payments with the lines of their order in the half hour before, whichever comes first; `leftSemi`: payments that have such lines, once."""
    paid = ticking(dwd.payments(log), clock, "et", DELAY)
    lines = lines_of(log, clock).select(
        F.col("id").alias("detail_id"), F.col("order_id").alias("_order"), F.col("et").alias("_line_et"), F.col("seq").alias("_line_seq"))
    half = F.expr(f"INTERVAL {codes.PAY_WITHIN_SECONDS} SECONDS")
    near = F.col("_line_et").between(F.col("et") - half, F.col("et"))
    return paid.join(lines, (F.col("order_id") == F.col("_order")) & near, how).drop("_order", "_line_et")


def paid_views(
    paid: DataFrame, seen: DataFrame, on: dict[str, str], paid_time: str, seen_time: str, delay: str
) -> DataFrame:
    """Interval join of two streams; state is dropped half an hour behind the watermark."""
    return interval_join(
        paid.withWatermark(paid_time, delay), seen.withWatermark(seen_time, delay),
        on, paid_time, seen_time, codes.PAY_WITHIN_SECONDS,
    )


# --- windows over facts ---------------------------------------------------------------


def sku_amounts(log: Log, clock: DataFrame) -> DataFrame:
    """Amounts per window and sku: the first version of each line, then its window."""
    lines = lines_of(log, clock, "create_time")
    kept = ["sku_id", "sku_num", "split_total_amount", "split_activity_amount", "split_coupon_amount"]
    once = tumble(lines, "create_time", "id").agg(F.min_by(F.struct(*kept), "seq").alias("_first"))
    return dws.sku_sums(once.select(F.window_time("window").alias("create_time"), "id", "_first.*"), "create_time")


def province_amounts(log: Log, clock: DataFrame) -> DataFrame:
    """Orders and amount per window and province: a join of streams, then three groupings."""
    lines = placed_lines(log, clock, time="create_time")
    return dws.province_amounts(lines.select("id", "order_id", "split_total_amount", "create_time", "province_id"))


def refund_windows(log: Log, clock: DataFrame, flat_sku: DataFrame, days: int) -> DataFrame:
    return dws.refund(refunds(log, clock, days).select("et", "user_id", "sku_id"), flat_sku)


# --- routing --------------------------------------------------------------------------


def dimensions(out: str, config: Callable[[DataFrame], DataFrame]) -> Batch:
    """Dimension changes by the routes in force when the batch runs.

    `config(batch)` gives the routing change log and is read anew for every batch. The
    table keeps changes per destination; `current_dimensions` gives the rows.
    """

    def batch(changes: DataFrame, batch_id: int) -> None:
        routes = routing.active_config(config(changes), "DIM")
        write_part(dwd.dimension_log(changes, routes), out, batch_id, "sink_table")

    return batch


def routed_as_of(config: str, out: str, record: Column | None = None) -> Batch:
    """Routing changes and business changes of one stream: each change by the route in force at its time.

    `record` makes a change's map of the stream's columns; without it `data` is that map.

    A batch adds its routing changes to a table, and its business changes find their routes in what that holds
    then; a change must not come before the routes of its time, which the slices and a topic's order see to.
    """

    data = F.col("data") if record is None else record

    def batch(rows: DataFrame, batch_id: int) -> None:
        write_part(rows.where("op IS NOT NULL").select("seq", "ts", "op", "before", "after"), config, batch_id)
        known = rows.sparkSession.read.parquet(config).where(F.col("batch_id") <= batch_id)
        changes = rows.where("op IS NULL").select("table", "database", "type", "ts", data.alias("data"), "seq")
        write_part(routing.dimension_changes(dwd.routed_as_of(changes, known)), out, batch_id)

    return batch


def upserted(changes: DataFrame) -> DataFrame:
    """Valid changes as rows of an upsert table by table and id; a delete is a tombstone."""
    valid = ods.valid_changes(changes, codes.DIM_OPS)
    return valid.select(
        "table", F.col("data")["id"].alias("id"), F.col("data")["name"].alias("name"), "ts", "seq",
        (F.col("type") == "delete").alias("deleted"))


def open_lines(log: Log, clock: DataFrame) -> DataFrame:
    """Order lines as they come, and tombstones for those whose order is cancelled."""
    gone = cancelled_lines(log, clock).select("id", "seq", F.lit(True).alias("deleted"))
    return dwd.detail_rows(log).drop("ts", "et").withColumn("deleted", F.lit(False)).unionByName(gone, allowMissingColumns=True)


def current_dimensions(log: DataFrame, routes: DataFrame) -> DataFrame:
    """Rows of all dimensions still configured; retired ones are gone."""
    alive = log.join(routes.select("sink_table").distinct(), "sink_table", "left_semi")
    return routing.compact(alive, ["sink_table", "row_key"])


def routed_facts(out: str, config: Callable[[DataFrame], DataFrame]) -> Batch:
    """Configured facts, one folder per destination."""

    def batch(changes: DataFrame, batch_id: int) -> None:
        routes = routing.active_config(config(changes), "DWD")
        write_part(dwd.routed_facts(changes, routes), out, batch_id, "sink_table")

    return batch


def validated(lines: DataFrame) -> DataFrame:
    """Raw change lines to valid changes, on a stream as in batch."""
    return ods.valid_changes(ods.change_log(lines))
