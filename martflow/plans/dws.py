"""Five-second window tables. Every function maps DataFrames to a DataFrame.

Output: stt, edt (timestamps), cur_date (date), the dimensions and the measures.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martflow import codes
from martflow.functions.scalar import count_if, money, not_blank, total
from martflow.functions.words import words
from martflow.operators import first
from martflow.operators.joins import lookup, with_sku
from martflow.operators.windows import distinct_per_window, event_time, stamped, tumble

TRAFFIC = ("vc", "ch", "ar", "is_new")
TRAFFIC_ROW = ("et", "ts", "mid", *TRAFFIC)


# --- traffic --------------------------------------------------------------------------


def search_words(page: DataFrame) -> DataFrame:
    """Words of the items searched from the home or the search page: et, word."""
    searched = page.where(
        F.col("last_page_id").isin(codes.HOME, codes.SEARCH)
        & (F.col("item_type") == codes.KEYWORD)
        & F.col("item").isNotNull()
    )
    return words(searched.select("et", "item"), "item")


def count_words(found: DataFrame) -> DataFrame:
    counted = tumble(found, "et", "word").agg(F.count("*").alias("keyword_count"))
    return stamped(counted).withColumnRenamed("word", "keyword")


def keyword(page: DataFrame) -> DataFrame:
    return count_words(search_words(page))


def traffic_parts(page: DataFrame) -> DataFrame:
    """What each record adds to the traffic table: et, dimensions, device, uv, sv, pv, dur.

    Views and time come from all records, visitors and sessions only from the first record
    of a device's day and of a session, which are pruned before any shuffle. The parts are
    summed afterwards, so no step sorts all records of one device.
    """
    visits = page.select(*TRAFFIC_ROW, "seq")
    sessions = page.select(*TRAFFIC_ROW, "sid", "seq")
    return reduce(DataFrame.unionByName, [
        traffic_part(page, pv=F.lit(1), dur=F.col("during_time")),
        traffic_part(first.first_version(visits, ["mid", first.day_of()], ["ts", "seq"]), uv=F.lit(1)),
        traffic_part(first.first_version(sessions, ["sid"], ["ts", "seq"]), sv=F.lit(1)),
    ])


def traffic_part(rows: DataFrame, **adds: Column) -> DataFrame:
    """Rows with what each adds to the sums named."""
    return rows.select(
        *TRAFFIC_ROW, *[F.coalesce(adds.get(n, F.lit(0)), F.lit(0)).cast("bigint").alias(n) for n in ("uv", "sv", "pv", "dur")]
    )


def traffic(page: DataFrame, first_days: DataFrame | None = None) -> DataFrame:
    """Traffic sums; with `first_days` after the first-visit correction of is_new.

    The correction is one join over all parts, as it changes a dimension only.
    """
    parts = traffic_parts(page)
    return traffic_sums(parts if first_days is None else first.correct_new(parts, first_days))


def traffic_sums(parts: DataFrame) -> DataFrame:
    sums = tumble(parts, "et", *TRAFFIC).agg(
        F.sum("uv").alias("uv_ct"), F.sum("sv").alias("sv_ct"),
        F.sum("pv").alias("pv_ct"), F.sum("dur").alias("dur_sum"),
    )
    return stamped(sums)


def home_detail(page: DataFrame) -> DataFrame:
    return home_detail_of(first.page_unique(home_or_detail(page).select("mid", "page_id", "ts", "et", "seq")))


def home_or_detail(page: DataFrame) -> DataFrame:
    return page.where(F.col("page_id").isin(codes.HOME, codes.DETAIL))


def home_detail_of(firsts: DataFrame) -> DataFrame:
    """The same from the first record of each device, page and day."""
    return stamped(tumble(firsts, "et").agg(
        count_if(F.col("page_id") == codes.HOME).alias("home_uv_ct"),
        count_if(F.col("page_id") == codes.DETAIL).alias("good_detail_uv_ct"),
    ))


def logins(page: DataFrame) -> DataFrame:
    last = F.col("last_page_id")
    return page.where(not_blank(F.col("uid")) & (last.isNull() | (last == codes.LOGIN)))


def user_login(page: DataFrame) -> DataFrame:
    return user_login_of(first.back_flow(logins(page).select("uid", "ts", "et", "seq")))


def user_login_of(days: DataFrame) -> DataFrame:
    return stamped(tumble(days, "et").agg(
        F.sum("back_ct").alias("back_ct"), F.sum("uu_ct").alias("uu_ct")
    ))


# --- users, cart, payment -------------------------------------------------------------


def user_register(register: DataFrame) -> DataFrame:
    return stamped(tumble(register, "create_time").agg(F.count("*").alias("register_ct")))


def cart_add_uu(cart: DataFrame) -> DataFrame:
    return distinct_per_window(cart, "et", "user_id", "cart_add_uu_ct")


def payment_suc(paid: DataFrame) -> DataFrame:
    rows = paid.select("user_id", "et", F.unix_millis("et").alias("ts"), "seq")
    return payment_suc_of(first.first_payment(rows))


def payment_suc_of(days: DataFrame) -> DataFrame:
    return stamped(tumble(days, "et").agg(
        F.sum("unique_ct").alias("payment_suc_unique_user_count"),
        F.sum("new_ct").alias("payment_suc_new_user_count"),
    ))


# --- orders ---------------------------------------------------------------------------


def order(detail: DataFrame) -> DataFrame:
    """Users whose line is their first of the day, and their first ever, per window.

    A line counts when its order time equals the running minimum at its event time, which
    is the case exactly when the minimum of its moment does; so moments stand for lines.
    """
    rows = (
        detail.where("user_id IS NOT NULL")
        .select("user_id", "et", event_time(detail, "create_time"))
        .groupBy("user_id", F.to_date("create_time").alias("_created"), "et")
        .agg(F.min("create_time").alias("create_time"))
    )
    # Event times are whole seconds, so a day of a user is a window of bounded size.
    rows = first.running_min(rows, ["user_id", "_created"], "et", "create_time", "_today")
    rows = first.least_ever(rows, ["user_id"], "et", "create_time", "_ever")
    users = tumble(rows, "et", "user_id").agg(
        F.max((F.col("create_time") == F.col("_today")).cast("bigint")).alias("today"),
        F.max((F.col("create_time") == F.col("_ever")).cast("bigint")).alias("ever"),
    )
    return stamped(users.groupBy("window").agg(
        F.sum("today").alias("order_unique_user_count"), F.sum("ever").alias("order_new_user_count")
    ))


def sku_amounts(detail: DataFrame) -> DataFrame:
    """Amounts per window and sku over the first version of each line."""
    rows = detail.select(
        "id", "sku_id", event_time(detail, "create_time"), "sku_num",
        "split_total_amount", "split_activity_amount", "split_coupon_amount", "seq",
    )
    return sku_sums(first.first_version(rows, ["id"]), "create_time")


def sku_sums(lines: DataFrame, time: str) -> DataFrame:
    """Amounts per window and sku of lines that are there once."""
    return stamped(tumble(lines, time, "sku_id").agg(
        F.sum(F.col("sku_num").cast("bigint")).alias("sku_num"),
        F.sum(money(F.col("split_activity_amount"))).alias("activity_reduce_amount"),
        F.sum(money(F.col("split_coupon_amount"))).alias("coupon_reduce_amount"),
        F.sum(money(F.col("split_total_amount"))).alias("order_amount"),
    ))


def sku_order(detail: DataFrame, flat_sku: DataFrame) -> DataFrame:
    return sku_order_of(sku_amounts(detail), flat_sku)


def sku_order_of(amounts: DataFrame, flat_sku: DataFrame) -> DataFrame:
    rows = with_sku(amounts, flat_sku)
    return rows.select(
        "stt", "edt", "cur_date",
        F.col("trademark_id").cast("bigint").alias("trademark_id"), "trademark_name",
        F.col("category1_id").cast("bigint").alias("category1_id"), "category1_name",
        F.col("category2_id").cast("bigint").alias("category2_id"), "category2_name",
        F.col("category3_id").cast("bigint").alias("category3_id"), "category3_name",
        F.col("sku_id").cast("bigint").alias("sku_id"), "sku_name",
        F.col("spu_id").cast("bigint").alias("spu_id"), "spu_name",
        total(F.col("sku_num") * money(F.col("price"))).alias("original_amount"),
        *[total(F.col(x)).alias(x)
          for x in ("activity_reduce_amount", "coupon_reduce_amount", "order_amount")],
    )


def province_amounts(detail: DataFrame) -> DataFrame:
    """Orders and amount per window and province; versions of a line are averaged first."""
    rows = detail.where("province_id IS NOT NULL").select(
        "id", "province_id", "order_id", money(F.col("split_total_amount")).alias("amount"),
        event_time(detail, "create_time"),
    )
    lines = tumble(rows, "create_time", "id", "province_id", "order_id").agg(
        F.avg("amount").alias("amount")
    )
    orders = lines.groupBy("window", "province_id", "order_id").agg(F.sum("amount").alias("amount"))
    return stamped(orders.groupBy("window", "province_id").agg(
        F.count("order_id").alias("order_count"), F.sum("amount").alias("order_amount")
    ))


def province_order(detail: DataFrame, province: DataFrame) -> DataFrame:
    return province_order_of(province_amounts(detail), province)


def province_order_of(amounts: DataFrame, province: DataFrame) -> DataFrame:
    rows = lookup(amounts, province, "province_id", {"province_name": "name"})
    return rows.select(
        "stt", "edt", "cur_date", F.col("province_id").cast("bigint").alias("province_id"),
        "province_name", "order_count", total(F.col("order_amount")).alias("order_amount"),
    )


# The grouping of the refund table.
REFUND_KEYS = (
    "trademark_id", "trademark_name", "category1_id", "category1_name", "category2_id",
    "category2_name", "category3_id", "category3_name", "user_id",
)


def refund(refunds: DataFrame, flat_sku: DataFrame) -> DataFrame:
    rows = with_sku(refunds.select("et", "user_id", "sku_id"), flat_sku)
    return stamped(tumble(rows, "et", *REFUND_KEYS).agg(F.count("*").alias("refund_count")))
