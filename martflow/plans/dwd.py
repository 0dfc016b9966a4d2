"""Detail facts from the change log and the behaviour log.

Each function takes a typed change log, mixed or by table, and returns one fact
with its business columns as text, `ts` in epoch seconds, `et` and `seq`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martflow import codes
from martflow.functions.scalar import merge, plain_op
from martflow.operators import changes as c
from martflow.operators import routing
from martflow.operators.first import fix_first_visit, latest_values, latest_version
from martflow.operators.joins import interval_join, lookup
from martflow.sources import ods

# Columns of an order line, its own and those joined to it.
DETAIL = (
    "id", "order_id", "sku_id", "sku_num", "split_total_amount", "split_activity_amount",
    "split_coupon_amount", "create_time",
)
DETAIL_MORE = (
    "user_id", "province_id", "coupon_id", "coupon_use_id", "activity_id", "activity_rule_id",
)


_FACTS = "array<struct<kind:string,pos:int,record:map<string,string>>>"


def named(df: DataFrame, dictionary: DataFrame, **codes_of: str) -> DataFrame:
    """Names of dictionary codes: `named(df, dic, payment_type_name="payment_type")`."""
    for out, code in codes_of.items():
        df = lookup(df, dictionary, code, {out: "dic_name"})
    return df


# --- behaviour log --------------------------------------------------------------------


def split_log(
    lines: DataFrame, fix: Callable[[DataFrame], DataFrame] = fix_first_visit
) -> dict[str, DataFrame]:
    """The five traffic facts of raw behaviour lines, each (seq, [pos,] record MAP).

    A record with a start part is a start, otherwise it is a page; either may carry an error.
    `fix` corrects is_new per mid.
    """
    fixed = fix(device_logs(lines))
    common = merge(F.col("common"), F.create_map(F.lit("is_new"), F.col("is_new")))
    logs = fixed.withColumn("common", common).drop("mid", "is_new")
    return {
        "start": c.flatten(logs, "start"),
        "page": c.flatten(logs.where("start IS NULL"), "page"),
        "display": c.explode_part(logs, "displays"),
        "action": c.explode_part(logs, "actions"),
        "err": c.flatten(logs, "err", "start", "page"),
    }


def device_logs(lines: DataFrame) -> DataFrame:
    """Valid behaviour records with device and mark beside their parts."""
    logs = ods.valid_behaviour(ods.behaviour_log(lines))
    return logs.withColumn("mid", F.col("common")["mid"]).withColumn("is_new", F.col("common")["is_new"])


def split_once(logs: DataFrame) -> DataFrame:
    """All five facts in one pass: kind, seq, pos, mid, ts, is_new, record (its own mark still in it).

    A record gives all its facts in one generator, so it is read and parsed once, whatever is asked for.
    """
    head = merge(F.col("common"), F.create_map(F.lit("ts"), F.col("ts").cast("string")))
    page = F.col("page").isNotNull() & F.col("start").isNull()

    def fact(kind: str, when: Column, *parts: str) -> Column:
        one = F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("pos"), merge(head, *[F.col(p) for p in parts]).alias("record"))
        return F.when(when, F.array(one)).otherwise(F.array().cast(_FACTS))

    def items(kind: str, part: str, *more) -> Column:
        of = lambda x, k: F.struct(
            F.lit(kind).alias("kind"), k.alias("pos"), merge(x, merge(head, F.col("page")), *[m(x) for m in more]).alias("record"))
        return F.when(page & F.col(part).isNotNull(), F.transform(part, of)).otherwise(F.array().cast(_FACTS))

    own_time = lambda x: F.create_map(F.lit("ts"), x["ts"])
    facts = F.concat(
        fact("start", F.col("start").isNotNull(), "start"), fact("page", page, "page"),
        items("display", "displays"), items("action", "actions", own_time),
        fact("err", F.col("err").isNotNull(), "err", "start", "page"),
    )
    return logs.select("seq", "mid", "is_new", "ts", F.inline(facts)).select("kind", "seq", "pos", "mid", "ts", "is_new", "record")


# --- interaction, cart ----------------------------------------------------------------


def comment_info(log: c.Log, dictionary: DataFrame) -> DataFrame:
    rows = c.fields(
        c.rows_of(log, "comment_info", "insert"),
        "id", "user_id", "sku_id", "spu_id", "order_id", "appraise", "comment_txt", "create_time",
    )
    return named(rows, dictionary, appraise_name="appraise")


def cart_add(log: c.Log) -> DataFrame:
    rows = c.increase(c.rows_of(log, "cart_info", "insert", "update"), "sku_num", "_grown")
    return c.fields(
        rows, "id", "user_id", "sku_id", "cart_price", "sku_name", sku_num=F.col("_grown")
    )


# --- orders ---------------------------------------------------------------------------


def detail_rows(log: c.Log) -> DataFrame:
    """Rows of the order line table, repeated versions included."""
    return c.fields(c.rows_of(log, "order_detail", "insert"), *DETAIL)


def placed_orders(log: c.Log, *more: str) -> DataFrame:
    """Orders as they are placed: `_order`, its user and province, and more columns as named."""
    rows = c.fields(c.rows_of(log, "order_info", "insert"), "id", "user_id", "province_id")
    return rows.select(F.col("id").alias("_order"), "user_id", "province_id", *more)


def order_detail_parts(log: c.Log, keep_time: bool = False) -> dict[str, DataFrame]:
    """The four tables behind an order line, before they are joined; `keep_time`: with their event times."""
    time = ["et"] if keep_time else []

    def inserted(table: str, *names: str) -> DataFrame:
        return c.fields(c.rows_of(log, table, "insert"), *names)

    coupons = inserted("order_detail_coupon", "order_detail_id", "coupon_id", "coupon_use_id")
    activities = inserted(
        "order_detail_activity", "order_detail_id", "activity_id", "activity_rule_id")
    return {
        "detail": detail_rows(log),
        "order": placed_orders(log, *time),
        "coupon": coupons.select(
            F.col("order_detail_id").alias("_cd"), "coupon_id", "coupon_use_id",
            F.col("seq").alias("_cd_seq"), *time),
        "activity": activities.select(
            F.col("order_detail_id").alias("_ad"), "activity_id", "activity_rule_id",
            F.col("seq").alias("_ad_seq"), *time),
    }


def join_order_detail(parts: dict[str, DataFrame]) -> DataFrame:
    """Order lines with order, coupon and activity, where there are any."""
    return with_order(join_line_parts(parts), parts["order"]).select(*DETAIL, *DETAIL_MORE, "ts", "et", "seq")


def join_line_parts(parts: dict[str, DataFrame]) -> DataFrame:
    """Order lines with coupon and activity, where there are any.

    Coupon and activity are reduced to the latest row of a line first, so no line is
    multiplied; they arrive partitioned by line id, as the lines themselves are.
    """
    coupon = latest_values(parts["coupon"], ["_cd"], "_cd_seq", ["coupon_id", "coupon_use_id"])
    activity = latest_values(
        parts["activity"], ["_ad"], "_ad_seq", ["activity_id", "activity_rule_id"]
    )
    detail = parts["detail"]
    return (
        detail.join(coupon, detail.id == coupon._cd, "left")
        .join(activity, F.col("id") == F.col("_ad"), "left")
        .drop("_cd", "_ad")
    )


def with_order(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Rows that name an order with what it adds, where there is one."""
    return rows.join(orders, F.col("order_id") == F.col("_order"), "left").drop("_order")


def order_detail(log: c.Log) -> DataFrame:
    """One row per order line: the last state an upsert by line id would leave."""
    parts = order_detail_parts(log)
    parts["detail"] = latest_version(parts["detail"], ["id"])
    return join_order_detail(parts)


def cancelled_orders(log: c.Log) -> DataFrame:
    moved = c.moved(
        c.rows_of(log, "order_info", "update"),
        "order_status", codes.ORDER_PLACED, codes.ORDER_CANCELLED,
    )
    return c.fields(moved, "id", "operate_time").select(
        F.col("id").alias("_order"), F.col("operate_time").alias("cancel_time"), "ts", "et"
    )


def cancel_detail(log: c.Log, lines: DataFrame) -> DataFrame:
    """Every line of a cancelled order; `lines` holds the latest version of each."""
    return of_cancelled(cancelled_orders(log), lines)


def of_cancelled(cancelled: DataFrame, lines: DataFrame) -> DataFrame:
    return cancelled.join(lines.drop("ts", "et"), F.col("_order") == F.col("order_id")).drop("_order")


def payments(log: c.Log) -> DataFrame:
    moved = c.moved(
        c.rows_of(log, "payment_info", "update"),
        "payment_status", codes.PAYMENT_OPEN, codes.PAYMENT_DONE,
    )
    return c.fields(
        moved, "id", "user_id", "order_id", "trade_no", "total_amount", "payment_status",
        "payment_type", "callback_time",
    )


def paid_lines(log: c.Log, lines: DataFrame) -> DataFrame:
    """Lines paid within half an hour of their order, one row per payment and line.

    `lines` holds the latest version of each line.
    """
    return paid_with(payments(log), lines)


def paid_with(paid: DataFrame, lines: DataFrame) -> DataFrame:
    mine = lines.select(
        F.col("id").alias("detail_id"), F.col("order_id").alias("_order"),
        *[x for x in (*DETAIL, *DETAIL_MORE) if x in lines.columns and x not in ("id", "order_id", "user_id")],
        F.col("et").alias("_line_et"),
    )
    return interval_join(
        paid, mine, {"order_id": "_order"}, "et", "_line_et", codes.PAY_WITHIN_SECONDS
    ).drop("_order", "_line_et")


def pay_detail(log: c.Log, dictionary: DataFrame) -> DataFrame:
    """Paid lines with the names of status and type, one row per payment and line.

    A payment and its lines name the same order, so the order joins the payments, which are fewer and narrower
    than the lines, before the lines do.
    """
    parts = order_detail_parts(log)
    parts["detail"] = latest_version(parts["detail"], ["id"])
    paid = payments(log)
    rows = paid_with(with_order(paid, parts["order"].drop("user_id")), join_line_parts(parts))
    more = [x for x in (*DETAIL, *DETAIL_MORE) if x not in ("id", "order_id", "user_id")]
    return named(
        rows.select(*paid.columns, "detail_id", *more), dictionary,
        payment_status_name="payment_status", payment_type_name="payment_type",
    )


def granted_refunds(log: c.Log) -> DataFrame:
    moved = c.moved(
        c.rows_of(log, "order_refund_info", "update"),
        "refund_status", codes.REFUND_ASKED, codes.REFUND_GRANTED,
    )
    return c.fields(
        moved, "id", "user_id", "order_id", "sku_id", "refund_type", "refund_num",
        "refund_amount", "refund_reason_type", "refund_reason_txt", "operate_time",
    )


def refunded_orders(log: c.Log, *more: str) -> DataFrame:
    rows = c.changed_to(
        c.rows_of(log, "order_info", "update"), "order_status", codes.ORDER_REFUNDED
    )
    return c.fields(rows, "id", "province_id").select(F.col("id").alias("_order"), "province_id", *more)


def refund(log: c.Log, dictionary: DataFrame) -> DataFrame:
    """Granted refunds of orders that were set to refunded."""
    both = granted_refunds(log).join(
        refunded_orders(log), F.col("order_id") == F.col("_order")
    ).drop("_order")
    return named(
        both, dictionary,
        refund_type_name="refund_type", refund_reason_type_name="refund_reason_type",
    )


def refund_payments(log: c.Log) -> DataFrame:
    """Finished refund payments."""
    rows = c.changed_to(
        c.rows_of(log, "refund_payment", "update"), "refund_status", codes.PAYMENT_DONE
    )
    return c.fields(
        rows, "id", "order_id", "out_trade_no", "refund_status", "payment_type", "trade_no",
        "callback_time",
    )


def refund_payment(log: c.Log, refunds: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Finished refund payments, one row per refunded line of their order."""
    lines = refunds.select(
        F.col("order_id").alias("_order"), "user_id", "sku_id", "refund_type", "refund_num",
        "refund_amount", "refund_reason_type", "refund_reason_txt", "province_id",
        "refund_type_name", "refund_reason_type_name",
    )
    both = refund_payments(log).join(lines, F.col("order_id") == F.col("_order")).drop("_order")
    return named(
        both, dictionary, refund_status_name="refund_status", payment_type_name="payment_type"
    )


# --- configured facts -----------------------------------------------------------------


def routed_facts(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Changes of configured tables with their destination and configured columns."""
    valid = ods.valid_changes(changes, codes.FACT_OPS)
    routed = routing.prune(routing.route(valid, config, normalise=False))
    return routed.select("sink_table", "data", "ts", "seq")


def routed_as_of(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Changes with the destination and columns that were configured when they came."""
    valid = ods.valid_changes(changes, codes.DIM_OPS)
    return routing.prune(routing.route_as_of(valid, routing.in_force(config, "DIM")))


def living_dimensions(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Current rows of the dimensions that exist: sink_table, row_key, op_type, data, ts, seq."""
    rows = routing.dimension_changes(routed_as_of(changes, config))
    return routing.compact(routing.living(rows, routing.epochs(config)), ["sink_table", "row_key"])


def dimension_log(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Changes of configured dimension tables, ready to be compacted or applied."""
    valid = ods.valid_changes(changes, codes.DIM_OPS)
    return routing.dimension_changes(routing.prune(routing.route(valid, config)))


def register(log: c.Log) -> DataFrame:
    rows = c.rows_of(log, "user_info", "insert")
    return rows.select(
        c.d(rows, "id").alias("user_id"),
        c.d(rows, "create_time").cast("timestamp").alias("create_time"),
        plain_op(F.col("type")).alias("op_type"), "seq",
    )
