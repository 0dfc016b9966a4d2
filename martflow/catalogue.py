"""Every query by name: `catalogue()[name](warehouse)` is a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martflow import codes
from martflow.functions.scalar import merge, ratio, two_places
from martflow.functions.words import lexicon_words, words
from martflow.operators import changes as c
from martflow.operators import first, routing
from martflow.operators.joins import full_outer, interval_join, window_join, with_sku
from martflow.operators.windows import distinct_per_window, stamped, tumble
from martflow.plans import ads, dwd, dws
from martflow.plans.warehouse import Warehouse
from martflow.session import scratch
from martflow.sources import ods, replay
from martflow.sources.store import refresh, stored_days, stored_windows, write_months
from martflow.streaming.queries import QUERIES as STREAMS

Query = Callable[[Warehouse], DataFrame]


def present(df: DataFrame) -> DataFrame:
    """Plain column types for a result set: text dates, BIGINT, DOUBLE."""

    def plain(field: T.StructField) -> Column:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("bigint")
        elif isinstance(kind, T.DecimalType):
            col = col.cast("double")
        return col.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def _value(name: str) -> Column:
    return F.col("data")[name].alias(name)


def _keys(data: str = "data") -> Column:
    return F.array_join(F.array_sort(F.map_keys(data)), ",").alias("columns")


# --- validity, selection, shape -------------------------------------------------------


def _valid_changes(ops: tuple[str, ...]) -> Query:
    def query(w: Warehouse) -> DataFrame:
        valid = ods.valid_changes(ods.change_log(replay.change_lines(w.tables)), ops)
        return valid.select("seq", "table", "type", "ts", _value("id"), _value("user_id"))

    return query


def p3(w: Warehouse) -> DataFrame:
    return ods.valid_behaviour(ods.behaviour_log(replay.behaviour_lines(w.tables))).select(
        "seq", "ts", F.col("common")["mid"].alias("mid")
    )


def p5(w: Warehouse) -> DataFrame:
    rows = c.moved(c.rows_of(w.log, "order_info", "update"), "order_status",
                   codes.ORDER_PLACED, codes.ORDER_CANCELLED)
    return c.fields(rows, "id", "operate_time").drop("et")


def p6(w: Warehouse) -> DataFrame:
    return dwd.refunded_orders(w.log).withColumnRenamed("_order", "id")


def p7(w: Warehouse) -> DataFrame:
    return w.cart_add.select("id", "sku_num")


def p11(w: Warehouse) -> DataFrame:
    pruned = routing.prune(routing.route(w.routed_log, w.fact_config, normalise=False))
    return pruned.select("sink_table", _value("id"), _keys())


def p14(w: Warehouse) -> DataFrame:
    logs = ods.behaviour_log(replay.behaviour_lines(w.tables))
    r = F.col("record")
    return c.flatten(logs, "err", "start", "page").select(
        "seq", r["mid"].alias("mid"), r["ts"].cast("bigint").alias("ts"),
        r["entry"].alias("entry"), r["error_code"].alias("error_code"), _keys("record"),
    )


def d1_one_pass(w: Warehouse) -> DataFrame:
    """All five facts: the lines are read and parsed once, and written by kind; first days come from what is written."""
    spark, path = w.tables.spark, f"{scratch(w.tables.spark)}/facts-{uuid4().hex}"
    facts = dwd.split_once(dwd.device_logs(replay.behaviour_lines(w.tables)))
    facts.write.partitionBy("kind").parquet(path)
    rows = spark.read.schema(facts.schema).parquet(path)
    fixed = first.correct_new(rows, first.first_days(rows))
    record = merge(F.col("record"), F.create_map(F.lit("is_new"), F.col("is_new")))
    return fixed.select("kind", "seq", "pos", "mid", record["ts"].cast("bigint").alias("ts"), record["is_new"].alias("is_new"))


def t13(w: Warehouse) -> DataFrame:
    return _record(dwd.split_log(replay.behaviour_lines(w.tables))["action"],
                   "action_id", "page_id", "is_new", pos=True)


# --- joins ----------------------------------------------------------------------------


def j1(w: Warehouse) -> DataFrame:
    return w.detail_versions.select("id", "seq", "order_id", *dwd.DETAIL_MORE)


def j2(w: Warehouse) -> DataFrame:
    both = dwd.granted_refunds(w.log).join(
        dwd.refunded_orders(w.log), F.col("order_id") == F.col("_order"))
    return both.select("id", "seq", "order_id", "sku_id", "province_id")


def j3(w: Warehouse) -> DataFrame:
    return dwd.cancel_detail(w.log, first.latest_version(w.detail_lines, ["id"])).select(
        "id", "order_id", "seq", "cancel_time")


def j4(w: Warehouse) -> DataFrame:
    return dwd.refund_payment(w.log, w.refund, w.dictionary).select(
        "id", "order_id", "sku_id", "refund_amount", "out_trade_no")


def j5(w: Warehouse) -> DataFrame:
    rows = replay.traffic(w.tables)
    paid = rows.where("event_type = 'purchase'").select(
        F.col("seq").alias("pay_seq"), F.col("uid").alias("pay_uid"), F.col("et").alias("pay_et"))
    seen = rows.where("event_type = 'view'").select(
        F.col("seq").alias("view_seq"), F.col("uid").alias("view_uid"), F.col("et").alias("view_et"))
    return interval_join(
        paid, seen, {"pay_uid": "view_uid"}, "pay_et", "view_et", codes.PAY_WITHIN_SECONDS
    ).select("pay_uid", "pay_seq", "view_seq")


def j6(w: Warehouse) -> DataFrame:
    return dwd.comment_info(w.log, w.dictionary).select("id", "appraise", "appraise_name")


def j7(w: Warehouse) -> DataFrame:
    named = dwd.named(dwd.payments(w.log), w.dictionary,
                      payment_status_name="payment_status", payment_type_name="payment_type")
    return named.select("id", "payment_status", "payment_status_name", "payment_type", "payment_type_name")


def j9(w: Warehouse) -> DataFrame:
    rows = with_sku(dwd.granted_refunds(w.log).select("id", "seq", "sku_id"), w.flat_sku)
    return rows.select("id", "seq", "sku_id", "trademark_name", "category3_name",
                       "category2_name", "category1_name")


def j11(w: Warehouse) -> DataFrame:
    return routing.route(w.routed_log, w.fact_config, normalise=False).select(
        "sink_table", "table", "op_type", _value("id"), "seq")


def j12(w: Warehouse) -> DataFrame:
    rows = replay.traffic(w.tables)
    views = stamped(tumble(rows.where("event_type = 'view'"), "et").agg(F.count("*").alias("views")))
    clicks = stamped(tumble(rows.where("event_type = 'click'"), "et").agg(F.count("*").alias("clicks")))
    return window_join(views, clicks)


def j13(w: Warehouse) -> DataFrame:
    paid = dwd.payments(w.log).groupBy("user_id").agg(
        F.sum(F.col("total_amount").cast("decimal(16,2)")).alias("paid_amount"))
    carts = w.cart_add.groupBy("user_id").agg(F.sum("sku_num").alias("cart_num"))
    return full_outer(paid, carts, ["user_id"], [])


def j14(w: Warehouse) -> DataFrame:
    return words(replay.searches(w.tables).select("seq", "item"), "item")


def x1(w: Warehouse) -> DataFrame:
    items = replay.searches(w.tables).select("seq", "item")
    return lexicon_words(items, "item", replay.lexicon(w.tables))


# --- aggregations ---------------------------------------------------------------------


def a1(w: Warehouse) -> DataFrame:
    return stamped(tumble(replay.traffic(w.tables), "et").agg(F.count("*").alias("n")))


def a2(w: Warehouse) -> DataFrame:
    return stamped(tumble(replay.traffic(w.tables), "et", "event_type").agg(F.count("*").alias("n")))


def a3(w: Warehouse) -> DataFrame:
    return distinct_per_window(replay.traffic(w.tables), "et", "uid", "users")


def a4(w: Warehouse) -> DataFrame:
    return distinct_per_window(replay.traffic(w.tables), "et", "uid", "buyers",
                               only=F.col("event_type") == "purchase")


def a8(w: Warehouse) -> DataFrame:
    refunds = dwd.granted_refunds(w.log)
    return stamped(tumble(refunds, "et", "sku_id", "user_id").agg(F.count("*").alias("refund_count")))


def a9(w: Warehouse) -> DataFrame:
    return stamped(tumble(w.raw_page, "et").agg(
        F.sum("during_time").alias("dur_sum"), F.count("*").alias("pv_ct")))


def a10(w: Warehouse) -> DataFrame:
    day = F.to_date("et").alias("cur_date")
    return w.raw_page.groupBy(day, "ch").agg(F.sum("during_time").alias("dur_sum"))


def a11(w: Warehouse) -> DataFrame:
    new = F.sum(F.when(F.col("is_new") == "1", F.col("during_time")).otherwise(0))
    return w.raw_page.groupBy(F.hour("et").alias("hr")).agg(new.alias("new_dur"))


def a12(w: Warehouse) -> DataFrame:
    rate = two_places(ratio(F.sum("during_time"), F.count("*")))
    return w.raw_page.groupBy("ch").agg(rate.alias("dur_per_page"))


def a13(w: Warehouse) -> DataFrame:
    return w.detail_lines.agg(
        F.sum(F.col("split_total_amount").cast("decimal(16,2)")).alias("order_amount"))


# --- first times ----------------------------------------------------------------------


def _picked(pick) -> Query:
    return lambda w: pick(w.detail_lines, ["id"]).select("id", "seq", "sku_id", "split_total_amount")


def _running(job, *keys: str) -> Query:
    def query(w: Warehouse) -> DataFrame:
        rows = replay.traffic(w.tables).select("seq", "uid", "et", "during_time", F.to_date("et").alias("day"))
        return job(rows, list(keys), "et", "during_time", "least_so_far").select("seq", "uid", "least_so_far")

    return query


def w5(w: Warehouse) -> DataFrame:
    return first.fix_first_visit(replay.traffic(w.tables)).select("seq", "mid", "is_new")


def w6(w: Warehouse) -> DataFrame:
    return first.daily_unique(w.raw_page.select("seq", "mid", "ts"))


def w7(w: Warehouse) -> DataFrame:
    return first.session_first(w.raw_page.select("seq", "sid", "ts"))


def w8(w: Warehouse) -> DataFrame:
    return first.back_flow(dws.logins(w.raw_page).select("seq", "uid", "ts"))


def w9(w: Warehouse) -> DataFrame:
    return first.page_unique(w.raw_page.select("seq", "mid", "page_id", "ts"))


def w10(w: Warehouse) -> DataFrame:
    paid = dwd.payments(w.log).select("seq", "user_id", (F.col("ts") * 1000).alias("ts"))
    return first.first_payment(paid)


# --- routing and dimensions -----------------------------------------------------------


def m1(w: Warehouse) -> DataFrame:
    return routing.parse_config(replay.config_changes(w.tables)).select(
        "seq", "op", "source_table", "sink_type", "sink_table")


def m2(w: Warehouse) -> DataFrame:
    return routing.active_config(replay.config_changes(w.tables), "DIM").select(
        "source_table", "seq", "op", "source_type")


def m3(w: Warehouse) -> DataFrame:
    routed = routing.route(w.routed_log, w.fact_config, normalise=False)
    return routed.groupBy("sink_table", "source_type", "op_type").agg(F.count("*").alias("n"))


def _order_states(w: Warehouse) -> DataFrame:
    return w.tables("orders").select(
        F.col("o_custkey").alias("row_key"), replay.seconds("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderstatus") == "F", "delete").otherwise("update").alias("op_type"))


def m4(w: Warehouse) -> DataFrame:
    return routing.compact(_order_states(w), ["row_key"]).select("row_key", "seq", "price")


def m4_increment(w: Warehouse) -> DataFrame:
    """The same dimension, built from three parts of its changes that arrive in the wrong order."""
    states = _order_states(w)
    part = F.pmod(F.xxhash64("seq"), F.lit(3))
    table = first.latest_version(states.where(part == 0), ["row_key"], ["ts", "seq"])
    for k in (1, 2):
        table = routing.apply_changes(table, states.where(part == k), ["row_key"])
    return routing.current(table).select("row_key", "seq", "price")


def t11(w: Warehouse) -> DataFrame:
    rows = dwd.routed_as_of(replay.routed_changes(w.tables), replay.route_log(w.tables))
    return rows.select("sink_table", "op_type", "ts", "seq", _value("id"), _value("name"))


def m5(w: Warehouse) -> DataFrame:
    rows = dwd.living_dimensions(replay.routed_changes(w.tables), replay.route_log(w.tables))
    return rows.select("sink_table", "row_key", "op_type", "ts", "seq", _value("name"))


def d0(w: Warehouse) -> DataFrame:
    changes = dwd.dimension_log(replay.dimension_changes(w.tables), w.dimension_config)
    rows = routing.compact(changes, ["sink_table", "row_key"])
    return rows.select("sink_table", "row_key", _value("name"), "op_type", _keys())


def d9(w: Warehouse) -> DataFrame:
    return dwd.routed_facts(w.routed_log, w.fact_config).select(
        "sink_table", _value("id"), _value("op_type"), "ts", "seq", _keys())


# --- facts ----------------------------------------------------------------------------


def _record(df: DataFrame, *names: str, pos: bool = False) -> DataFrame:
    r = F.col("record")
    return df.select(
        "seq", *(["pos"] if pos else []), r["mid"].alias("mid"),
        r["ts"].cast("bigint").alias("ts"), *[r[n].alias(n) for n in names])


def _log_part(part: str, *names: str, pos: bool = False) -> Query:
    return lambda w: _record(
        dwd.split_log(replay.behaviour_lines(w.tables))[part], *names, pos=pos)


def _fact(make: Callable[[Warehouse], DataFrame], *without: str) -> Query:
    return lambda w: make(w).drop("et", *without)


def _windows(name: str) -> Query:
    return lambda w: w.windows[name]


def _report(name: str) -> Query:
    return lambda w: ads.REPORTS[name](w.windows)


def _stored_report(name: str, *tables: str, day: str | None = None, whole: bool = True) -> Query:
    """A report from stored daily sums: loaded up to a month, then the months from there on written anew, as changes would."""

    def query(w: Warehouse) -> DataFrame:
        spark, path = w.tables.spark, f"{scratch(w.tables.spark)}/daily-{uuid4().hex}"
        # The windows are made once; both loads read their months of them.
        write_months(w.windows, f"{path}/windows", tables)
        windows = stored_windows(spark, f"{path}/windows", tables)
        refresh(windows, f"{path}/days", tables, F.col("month") < 199807)
        refresh(windows, f"{path}/days", tables, F.col("month") >= 199806)
        stored = stored_days(spark, f"{path}/days", tables)
        return ads.REPORTS[name](stored) if whole else ads.for_day(ads.REPORTS[name], stored, day)

    return query


def catalogue() -> dict[str, Query]:
    found: dict[str, Query] = {
        "p1_valid_change_log": _valid_changes(codes.DIM_OPS),
        "p2_valid_fact_changes": _valid_changes(codes.FACT_OPS),
        "p3_valid_behaviour_log": p3,
        "p5_status_transition": p5,
        "p6_column_changed": p6,
        "p7_cart_delta": p7,
        "p11_column_prune": p11,
        "p14_flatten": p14,
        "j1_left_chain": j1,
        "j2_inner_updates": j2,
        "j3_latest_version_join": j3,
        "j4_refund_fanout": j4,
        "j5_interval_join": j5,
        "j6_lookup": j6,
        "j7_double_lookup": j7,
        "j8_snowflake": lambda w: w.flat_sku,
        "j9_enrich": j9,
        "j11_route": j11,
        "j12_window_join": j12,
        "j13_full_outer": j13,
        "j14_explode_words": j14,
        "x1_lexicon_words": x1,
        "a1_window_count": a1,
        "a2_window_key_count": a2,
        "a3_window_distinct": a3,
        "a4_conditional_distinct": a4,
        "a5_sku_amount": lambda w: dws.sku_amounts(w.detail_lines),
        "a6_two_level": lambda w: dws.province_amounts(w.detail_versions),
        "a7_traffic_reduce": lambda w: dws.traffic(w.raw_page),
        "a8_refund_reduce": a8,
        "a9_global_window": a9,
        "a10_daily_rollup": a10,
        "a11_conditional_sum": a11,
        "a12_ratio": a12,
        "a13_global_sum": a13,
        "w1_first_version": _picked(first.first_version),
        "w2_latest_version": _picked(first.latest_version),
        "w3_first_of_day": _running(first.first_of_day, "uid", "day"),
        "w4_first_ever": _running(first.first_ever, "uid"),
        "w5_first_visit_fix": w5,
        "w6_daily_unique": w6,
        "w7_session_first": w7,
        "w8_backflow": w8,
        "w9_page_unique": w9,
        "w10_first_payment": w10,
        "m1_config_parse": m1,
        "m2_active_config": m2,
        "m3_op_filter": m3,
        "m4_dim_compaction": m4,
        "m4_dim_increment": m4_increment,
        "t11_route_as_of": t11,
        "m5_dimension_life": m5,
        "t13_explode_actions": t13,
        "d0_dimensions": d0,
        "d1_start": _log_part("start", "is_new", "entry", "loading_time"),
        "d1_page": _log_part("page", "is_new", "sid", "page_id", "last_page_id", "during_time"),
        "d1_display": _log_part("display", "is_new", "item", "page_id", pos=True),
        "d1_action": _log_part("action", "is_new", "action_id", "page_id", pos=True),
        "d1_one_pass": d1_one_pass,
        "d1_err": _log_part("err", "is_new", "error_code", "entry"),
        "d2_comment_info": _fact(lambda w: dwd.comment_info(w.log, w.dictionary)),
        "d3_cart_add": _fact(lambda w: w.cart_add),
        "d4_order_detail": _fact(lambda w: w.order_detail),
        "d5_cancel_detail": _fact(lambda w: dwd.cancel_detail(w.log, w.order_detail)),
        "d6_pay_detail": _fact(lambda w: w.pay_detail),
        "d7_refund": _fact(lambda w: w.refund),
        "d8_refund_payment": _fact(
            lambda w: dwd.refund_payment(w.log, w.refund, w.dictionary)),
        "d9_routed_facts": d9,
        "g1_keyword": _windows("keyword"),
        "g2_traffic": _windows("traffic"),
        "g3_home_detail": _windows("home_detail"),
        "g4_user_login": _windows("user_login"),
        "g5_user_register": _windows("user_register"),
        "g6_cart_add_uu": _windows("cart_add_uu"),
        "g7_payment_suc": _windows("payment_suc"),
        "g8_order": _windows("order"),
        "g9_sku_order": _windows("sku_order"),
        "g10_province_order": _windows("province_order"),
        "g11_refund": _windows("refund"),
    }
    found.update({
        "s16_stored_r9": _stored_report("r9", "home_detail", "cart_add_uu", "order", "payment_suc"),
        "s16_stored_r16": _stored_report("r16", "province_order", "order", "refund"),
        "f22_report_of_a_day": _stored_report("r18", "province_order", day="19980315", whole=False),
        "f22_report_of_today": _stored_report("r10", "order", "payment_suc", whole=False),
    })
    found.update({name: _report(name) for name in ads.REPORTS})
    found.update(STREAMS)
    return found
