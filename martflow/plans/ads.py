"""Dashboard reports over the window tables.

A report groups by `by`: ["cur_date"] gives every day, [] the one day the tables were cut to
(see `for_day`; a day without data then gives NULL sums instead of no row). The tables are
partitioned by cur_date, so a day reads its partition only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martflow import codes
from martflow.functions.scalar import percent, ratio, safe_average, two_places
from martflow.operators.joins import full_outer

Dws = Mapping[str, DataFrame]
ALL_DAYS = ("cur_date",)


def for_day(report: Callable[..., DataFrame], dws: Dws, day: str | date | None = None) -> DataFrame:
    """A report of one day; today when no day is given. Text days are yyyyMMdd or ISO."""
    if day is None or day == "":
        day = datetime.now(timezone.utc).date()
    if isinstance(day, str):
        day = datetime.strptime(day.replace("-", ""), "%Y%m%d").date()
    cut = {name: df.where(F.col("cur_date") == F.lit(day)) for name, df in dws.items()}
    return report(cut, by=[])


def _sums(df: DataFrame, keys: Sequence[str], **measures: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(src).alias(out) for out, src in measures.items()])


def _ordered(df: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    return df.orderBy(*by, F.col(metric).desc())


def _labelled(by: Sequence[str], value: str, *tables: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """UNION ALL of labelled measures; the measures of one table come from one aggregation."""
    parts = []
    for df, measures in tables:
        sums = df.groupBy(*by).agg(
            *[m.cast("bigint").alias(f"_{i}") for i, m in enumerate(measures.values())]
        )
        pairs = ", ".join(f"'{label}', _{i}" for i, label in enumerate(measures))
        parts.append(sums.select(*by, F.expr(f"stack({len(measures)}, {pairs}) AS (name, {value})")))
    return reduce(DataFrame.unionByName, parts)


# --- traffic --------------------------------------------------------------------------


def r1(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    rows = dws["traffic"].where("ch IS NOT NULL")
    return _ordered(_sums(rows, [*by, "ch"], uv_ct="uv_ct"), by, "uv_ct")


def r2(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    return _ordered(_sums(dws["traffic"], [*by, "ch"], sv_ct="sv_ct"), by, "sv_ct")


def r3(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    rate = two_places(ratio(F.sum("pv_ct"), F.sum("sv_ct")))
    rows = dws["traffic"].groupBy(*by, "ch").agg(rate.alias("pv_per_session"))
    return _ordered(rows, by, "pv_per_session")


def r4(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    rate = two_places(ratio(F.sum("dur_sum"), F.sum("sv_ct")) / 1000)
    rows = dws["traffic"].groupBy(*by, "ch").agg(rate.alias("dur_per_session"))
    return _ordered(rows, by, "dur_per_session")


def r5(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    new = F.sum(F.when(F.col("is_new") == "1", F.col("uv_ct")).otherwise(0))
    return dws["traffic"].groupBy(*by, F.hour("stt").alias("hr")).agg(
        F.sum("uv_ct").alias("uv_ct"), F.sum("pv_ct").alias("pv_ct"), new.alias("new_uv_ct")
    )


def r6(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    rows = _sums(
        dws["traffic"], [*by, "is_new"],
        uv_ct="uv_ct", pv_ct="pv_ct", sv_ct="sv_ct", dur_sum="dur_sum",
    )
    return rows.select(
        "*",
        safe_average(F.col("dur_sum"), F.col("sv_ct"), 1000).alias("avg_dur_sum"),
        safe_average(F.col("pv_ct"), F.col("sv_ct")).alias("avg_pv_ct"),
    )


def r6b(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    """r6 turned: one row per measure, one column for new and one for old visitors."""
    measures = ("uv_ct", "pv_ct", "avg_dur_sum", "avg_pv_ct")
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in measures)
    long = r6(dws, by).select(
        *by, "is_new", F.expr(f"stack({len(measures)}, {pairs}) AS (type, value)")
    )
    turned = long.groupBy(*by, "type").pivot("is_new", ["1", "0"]).agg(F.first("value"))
    return turned.withColumnsRenamed({"1": "new_visitors", "0": "old_visitors"})


def r7(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    rows = _sums(dws["keyword"], [*by, "keyword"], value="keyword_count")
    return rows.withColumnRenamed("keyword", "name")


# --- users ----------------------------------------------------------------------------


def r8(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    return _labelled(
        by, "num",
        (dws["user_login"],
         {codes.BACK_USERS: F.sum("back_ct"), codes.ACTIVE_USERS: F.sum("uu_ct")}),
    )


def r9(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    return _labelled(
        by, "value",
        (dws["home_detail"],
         {"home": F.sum("home_uv_ct"), "good_detail": F.sum("good_detail_uv_ct")}),
        (dws["cart_add_uu"], {"cart": F.sum("cart_add_uu_ct")}),
        (dws["order"], {"trade": F.sum("order_unique_user_count")}),
        (dws["payment_suc"], {"payment": F.sum("payment_suc_unique_user_count")}),
    )


def r10(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    return _labelled(
        by, "num",
        (dws["order"], {"order": F.sum("order_new_user_count")}),
        (dws["payment_suc"], {"payment": F.sum("payment_suc_new_user_count")}),
    )


# --- goods ----------------------------------------------------------------------------


def _refunds(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Refunds and distinct users, the users counted from one row per key and user."""
    users = rows.groupBy(*keys, "user_id").agg(F.sum("refund_count").alias("_n"))
    return users.groupBy(*keys).agg(
        F.sum("_n").alias("refund_count"), F.count("user_id").alias("refund_uu_count")
    )


def _goods(dws: Dws, by: Sequence[str], ids: list[str], names: list[str]) -> DataFrame:
    sold = dws["sku_order"].withColumns({i: F.col(i).cast("string") for i in ids})
    amount = _sums(sold, [*by, *ids, *names], order_amount="order_amount")
    refunds = _refunds(dws["refund"], [*by, *ids, *names])
    return full_outer(amount, refunds, [*by, *ids], names).select(
        *by, *ids, *names, "order_amount", "refund_count", "refund_uu_count"
    )


def r11(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    return _goods(dws, by, ["trademark_id"], ["trademark_name"])


def r12(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    rows = _sums(dws["sku_order"], [*by, "trademark_id", "trademark_name"], value="order_amount")
    return rows.select(*by, F.col("trademark_name").alias("name"), "value")


def r13(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    levels = ("category1", "category2", "category3")
    return _goods(dws, by, [f"{x}_id" for x in levels], [f"{x}_name" for x in levels])


def r14(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    rows = _sums(dws["sku_order"], [*by, "spu_id", "spu_name"], order_amount="order_amount")
    return rows.select(*by, "spu_name", "order_amount")


# --- trade ----------------------------------------------------------------------------


def r15(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    total = two_places(F.sum("order_amount").cast("double"))
    return dws["province_order"].groupBy(*by).agg(total.alias("order_total_amount"))


def r16(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    per_user = dws["refund"].groupBy(*by, "user_id").agg(F.sum("refund_count").alias("_n"))
    return _labelled(
        by, "num",
        (dws["province_order"], {codes.ORDERS: F.sum("order_count")}),
        (dws["order"], {codes.ORDER_USERS: F.sum("order_unique_user_count")}),
        (per_user, {codes.REFUNDS: F.sum("_n"), codes.REFUND_USERS: F.count("user_id")}),
    )


def _by_province(dws: Dws, by: Sequence[str], measure: str) -> DataFrame:
    rows = _sums(dws["province_order"], [*by, "province_id", "province_name"], value=measure)
    return rows.select(*by, F.col("province_name").alias("name"), "value")


def r17(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    return _by_province(dws, by, "order_count")


def r18(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    return _by_province(dws, by, "order_amount")


def _reduction(dws: Dws, by: Sequence[str], measure: str) -> DataFrame:
    rate = ratio(F.sum(measure), F.sum("original_amount"))
    return dws["sku_order"].groupBy(*by).agg(percent(rate).alias("rate"))


def r19(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    return _reduction(dws, by, "activity_reduce_amount")


def r20(dws: Dws, by: Sequence[str] = ALL_DAYS) -> DataFrame:
    return _reduction(dws, by, "coupon_reduce_amount")


REPORTS: dict[str, Callable[..., DataFrame]] = {
    "r1": r1, "r2": r2, "r3": r3, "r4": r4, "r5": r5, "r6": r6, "r6b_pivot": r6b, "r7": r7,
    "r8": r8, "r9": r9, "r10": r10, "r11": r11, "r12": r12, "r13": r13, "r14": r14, "r15": r15,
    "r16": r16, "r17": r17, "r18": r18, "r19": r19, "r20": r20,
}
