"""The given tables replayed as the streams and dimensions of the retail warehouse.

A change comes in two shapes. `Changes` gives the rows of one table with a column per value,
so Spark reads only what a job uses. `change_log` gives the mixed log with text maps, as
needed where the columns are configured.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martflow import codes
from martflow.functions.scalar import money, text_map
from martflow.functions.words import words
from martflow.sources.tables import Tables

DAY = 86400
STAMP = "yyyy-MM-dd HH:mm:ss"


def seconds(ts: str) -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def detail_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber")


def arrival() -> Column:
    """Arrival number of a line item: ship day, then price in cents."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    cents = (money(F.col("l_extendedprice")) * 100).cast("bigint")
    return day.cast("bigint") * 1_000_000_000 + cents


def amounts() -> dict[str, Column]:
    price = money(F.col("l_extendedprice"))
    discount = F.col("l_discount").cast("decimal(4,2)")
    tax = F.col("l_tax").cast("decimal(4,2)")
    return {
        "split_total_amount": money(price * (1 - discount)),
        "split_activity_amount": money(price * discount),
        "split_coupon_amount": money(price * tax),
    }


def _by_priority(values: list[str]) -> Column:
    """One code per order priority 1..5."""
    level = F.substring("o_orderpriority", 1, 1)
    pairs = [x for i, v in enumerate(values, 1) for x in (F.lit(str(i)), F.lit(v))]
    return F.element_at(F.create_map(*pairs), level)


Cols = Mapping[str, Column]


@dataclass(frozen=True)
class Branch:
    """Rows of a table as one kind of change; `old` holds NULL where nothing changed."""

    rows: DataFrame
    table: str
    op: str
    ts: Column
    seq: Column
    data: Cols
    old: Cols | None = None

    def as_columns(self, data: list[str], old: list[str]) -> DataFrame:
        """Columns data_x and old_x; NULL for a name this kind of change lacks."""

        def side(prefix: str, names: list[str], known: Cols) -> list[Column]:
            absent = F.lit(None)
            return [known.get(n, absent).cast("string").alias(f"{prefix}_{n}") for n in names]

        return self.rows.select(
            F.lit(self.table).alias("table"),
            F.lit(codes.DATABASE).alias("database"),
            F.lit(self.op).alias("type"),
            self.ts.cast("bigint").alias("ts"),
            self.seq.cast("bigint").alias("seq"),
            F.timestamp_seconds(self.ts).alias("et"),
            *side("data", data, self.data),
            *side("old", old, self.old or {}),
        )

    def as_maps(self) -> DataFrame:
        data = text_map(**{n: F.col(f"data_{n}") for n in self.data})
        if self.old is None:
            old = F.lit(None).cast("map<string,string>")
        else:
            old = F.map_filter(
                text_map(**{n: F.col(f"old_{n}") for n in self.old}), lambda _, v: v.isNotNull()
            )
        return self.as_columns(list(self.data), list(self.old or {})).select(
            "table", "database", "type", "ts", data.alias("data"), old.alias("old"), "seq", "et"
        )


def _placed(t: Tables) -> DataFrame:
    """Orders with the province of their customer.

    One row per customer, stated so that Spark drops the join where no province is asked for.
    """
    customer = t.whole("customer").groupBy("c_custkey").agg(F.max("c_nationkey").alias("c_nationkey"))
    orders = t("orders")
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "left")


def _lines_of_orders(t: Tables) -> DataFrame:
    orders = t.whole("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    items = t("lineitem")
    return items.join(orders, items.l_orderkey == orders.o_orderkey)


def _order_info(t: Tables) -> list[Branch]:
    placed, orders = _placed(t), t("orders")
    key, day = F.col("o_orderkey"), seconds("o_orderdate")
    insert = Branch(
        placed, "order_info", "insert", day, key,
        dict(id=key, user_id=F.col("o_custkey"), province_id=F.col("c_nationkey"),
                 order_status=F.lit(codes.ORDER_PLACED)),
    )
    cancel = Branch(
        orders.where("o_orderstatus = 'O'"), "order_info", "update", day + 600, key,
        dict(id=key, operate_time=F.date_format(F.timestamp_seconds(day + 600), STAMP),
                 order_status=F.lit(codes.ORDER_CANCELLED)),
        dict(order_status=F.lit(codes.ORDER_PLACED)),
    )
    # Refunded orders; where the status was already set the update changed another column.
    refunded = Branch(
        placed.where("o_orderstatus <> 'O'"), "order_info", "update", day + DAY, key,
        dict(id=key, province_id=F.col("c_nationkey"), order_status=F.lit(codes.ORDER_REFUNDED)),
        dict(order_status=F.when(F.col("o_orderstatus") == "F", "1002"),
             operate_time=F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate"))),
    )
    return [insert, cancel, refunded]


def _order_detail(t: Tables) -> list[Branch]:
    ts = seconds("o_orderdate") + F.col("l_linenumber")
    return [Branch(
        _lines_of_orders(t), "order_detail", "insert", ts, arrival(),
        dict(id=detail_id(), order_id=F.col("l_orderkey"), sku_id=F.col("l_partkey"),
                 sku_num=F.col("l_quantity").cast("int"), **amounts(),
                 create_time=F.date_format("o_orderdate", STAMP)),
    )]


def _order_detail_coupon(t: Tables) -> list[Branch]:
    return [Branch(
        t("lineitem").where("l_tax > 0.04"), "order_detail_coupon", "insert",
        seconds("l_shipdate"), arrival(),
        dict(order_detail_id=detail_id(), coupon_id=F.col("l_suppkey"),
                 coupon_use_id=F.col("l_orderkey")),
    )]


def _order_detail_activity(t: Tables) -> list[Branch]:
    return [Branch(
        t("lineitem").where("l_discount > 0.05"), "order_detail_activity", "insert",
        seconds("l_shipdate"), arrival(),
        dict(order_detail_id=detail_id(), activity_id=F.col("l_suppkey"),
                 activity_rule_id=F.col("l_partkey")),
    )]


def _payment_info(t: Tables) -> list[Branch]:
    key = F.col("o_orderkey")
    ts = seconds("o_orderdate") + F.floor(money(F.col("o_totalprice")) / 200).cast("bigint")
    return [Branch(
        t("orders"), "payment_info", "update", ts, key,
        dict(id=key, user_id=F.col("o_custkey"), order_id=key,
                 trade_no=F.concat(F.lit("T"), key.cast("string")),
                 total_amount=money(F.col("o_totalprice")),
                 payment_status=F.when(F.col("o_orderstatus") == "P", codes.PAYMENT_OPEN)
                 .otherwise(codes.PAYMENT_DONE),
                 payment_type=_by_priority(["1101", "1102", "1103", "1104", "1199"]),
                 callback_time=F.date_format(F.timestamp_seconds(ts), STAMP)),
        dict(payment_status=F.when(F.col("o_orderstatus") == "P", "1600")
                 .otherwise(codes.PAYMENT_OPEN)),
    )]


def _order_refund_info(t: Tables) -> list[Branch]:
    return [Branch(
        _lines_of_orders(t), "order_refund_info", "update", seconds("l_shipdate"), arrival(),
        dict(id=detail_id(), user_id=F.col("o_custkey"), order_id=F.col("l_orderkey"),
                 sku_id=F.col("l_partkey"),
                 refund_type=F.when(F.col("l_linestatus") == "F", "1501").otherwise("1502"),
                 refund_num=F.col("l_quantity").cast("int"),
                 refund_amount=money(F.col("l_extendedprice")),
                 refund_reason_type=_by_priority(["1301", "1302", "1303", "1304", "1399"]),
                 refund_reason_txt=F.col("l_linestatus"),
                 operate_time=F.date_format("l_shipdate", STAMP),
                 refund_status=F.when(F.col("l_returnflag") == "R", codes.REFUND_GRANTED)
                 .otherwise("0705")),
        dict(refund_status=F.lit(codes.REFUND_ASKED)),
    )]


def _refund_payment(t: Tables) -> list[Branch]:
    key, ts = F.col("o_orderkey"), seconds("o_orderdate") + 2 * DAY
    return [Branch(
        t("orders"), "refund_payment", "update", ts, key,
        dict(id=key, order_id=key, out_trade_no=F.concat(F.lit("O"), key.cast("string")),
                 refund_status=F.when(F.col("o_orderstatus") == "O", codes.PAYMENT_OPEN)
                 .otherwise(codes.PAYMENT_DONE),
                 payment_type=_by_priority(["1101", "1102", "1103", "1104", "1199"]),
                 trade_no=F.concat(F.lit("T"), key.cast("string")),
                 callback_time=F.date_format(F.timestamp_seconds(ts), STAMP)),
        dict(refund_status=F.when(F.col("o_orderstatus") == "F", codes.PAYMENT_OPEN),
             callback_time=F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))),
    )]


def _cart_info(t: Tables) -> list[Branch]:
    def branch(kind: str, op: str) -> Branch:
        rows = events(t).where(F.col("event_type") == kind)
        old = None if op == "insert" else dict(sku_num=F.floor("amount"))
        return Branch(
            rows, "cart_info", op, F.floor(F.col("ts") / 1000), F.col("seq"),
            dict(id=F.col("seq"), user_id=F.col("user_id"), sku_id=F.col("k"),
                     cart_price=F.col("amount"), sku_name=F.concat_ws("_", F.lit("sku"), "k"),
                     sku_num=F.col("k")),
            old,
        )

    return [branch("view", "insert"), branch("click", "update")]


def _comment_info(t: Tables) -> list[Branch]:
    code = F.concat(F.lit("120"), F.least(F.col("turn") + 1, F.lit(4)).cast("string"))
    ts = F.lit(1_704_067_200) + F.col("conv_id")
    return [Branch(
        t("conversations").where("role = 'user'"), "comment_info", "insert",
        ts, F.col("conv_id") * 1000 + F.col("turn"),
        dict(id=F.concat_ws("-", "conv_id", "turn"), user_id=F.col("conv_id"),
                 sku_id=F.col("turn"), spu_id=F.col("turn"), order_id=F.col("conv_id"),
                 appraise=code, comment_txt=F.col("text"),
                 create_time=F.date_format(F.timestamp_seconds(ts), STAMP)),
    )]


def _user_info(t: Tables) -> list[Branch]:
    rows = events(t).where("event_type = 'signup'")
    return [Branch(
        rows, "user_info", "insert", F.floor(F.col("ts") / 1000), F.col("seq"),
        dict(id=F.col("user_id"), name=F.concat_ws("_", F.lit("user"), "user_id"),
                 level=F.col("k"),
                 create_time=F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd HH:mm:ss.SSS")),
    )]


_BRANCHES = {
    "order_info": _order_info,
    "order_detail": _order_detail,
    "order_detail_coupon": _order_detail_coupon,
    "order_detail_activity": _order_detail_activity,
    "payment_info": _payment_info,
    "order_refund_info": _order_refund_info,
    "refund_payment": _refund_payment,
    "cart_info": _cart_info,
    "comment_info": _comment_info,
    "user_info": _user_info,
}


def change_log(t: Tables, *names: str) -> DataFrame:
    """The mixed change log of the business database, or of the named tables only."""
    parts = [branch.as_maps() for name in names or _BRANCHES for branch in _BRANCHES[name](t)]
    return reduce(DataFrame.unionByName, parts)


class Changes(Mapping[str, DataFrame]):
    """Change rows by table, each planned when asked for."""

    def __init__(self, t: Tables) -> None:
        self._tables = t

    def __getitem__(self, name: str) -> DataFrame:
        branches = _BRANCHES[name](self._tables)
        data = list(dict.fromkeys(c for b in branches for c in b.data))
        old = list(dict.fromkeys(c for b in branches for c in (b.old or {})))
        return reduce(DataFrame.unionByName, [b.as_columns(data, old) for b in branches])

    def __iter__(self) -> Iterator[str]:
        return iter(_BRANCHES)

    def __len__(self) -> int:
        return len(_BRANCHES)


def change_lines(t: Tables) -> DataFrame:
    """Orders as raw change lines, some of them unusable: (seq, value).

    Priority 1: another database; 2: snapshot rows; 3: cut off; 4: no data; 5: plain inserts.
    """
    data = F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    level = F.substring("o_orderpriority", 1, 1)
    line = F.to_json(F.struct(
        F.when(level == "1", "other").otherwise(codes.DATABASE).alias("database"),
        F.lit("order_info").alias("table"),
        F.when(level == "2", "bootstrap-insert").otherwise("insert").alias("type"),
        seconds("o_orderdate").alias("ts"),
        F.when(level != "4", data).alias("data"),
    ))
    cut = F.expr("substring(line, 1, length(line) - 1)")
    return (
        t("orders").select("o_orderkey", level.alias("level"), line.alias("line"))
        .select(F.col("o_orderkey").alias("seq"),
                F.when(F.col("level") == "3", cut).otherwise(F.col("line")).alias("value"))
    )


def events(t: Tables) -> DataFrame:
    """Events with their counter: seq, user_id, event_type, ts (ms), k, amount."""
    return t("events").select(
        F.col("event_id").alias("seq"),
        "user_id",
        "event_type",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        money(F.col("value")).alias("amount"),
    )


def _common(ev: DataFrame) -> dict[str, Column]:
    user = F.col("user_id").cast("string")
    day = F.date_format(F.timestamp_millis("ts"), "yyyyMMdd")
    return {
        "mid": F.concat(F.lit("mid_"), user),
        "uid": user,
        "sid": F.concat_ws("-", user, day),
        "vc": F.concat(F.lit("v"), F.floor(F.col("k") / 25).cast("string")),
        "ch": F.col("event_type"),
        "ar": F.concat(F.lit("area_"), F.length(user).cast("string")),
        "is_new": F.when(F.col("k") >= 50, "1").otherwise("0"),
    }


def _page_id() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "view", codes.HOME).when(kind == "click", codes.DETAIL)
        .when(kind == "signup", codes.LOGIN).when(kind == "purchase", "payment")
    )


def _last_page() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "signup", codes.LOGIN).when(kind == "click", codes.HOME)
        .when(kind == "view", codes.SEARCH).when(kind == "purchase", "cart")
    )


def during_time() -> Column:
    return (F.col("amount") * 1000).cast("bigint")


def traffic(t: Tables) -> DataFrame:
    """All behaviour records, flat and typed; error records have no page."""
    ev = events(t)
    return ev.select(
        "seq", "ts", F.timestamp_millis("ts").alias("et"), "event_type",
        *[c.alias(n) for n, c in _common(ev).items()],
        _page_id().alias("page_id"), _last_page().alias("last_page_id"),
        during_time().alias("during_time"),
    )


def behaviour_lines(t: Tables) -> DataFrame:
    """The same records as raw behaviour lines: (seq, value).

    Errors are a failing start, views show two items, clicks carry one action, purchases two items
    and two actions; clicks with a counter from 90 on carry an error too; sign-ups with a counter of
    0 are cut off.
    """
    ev = events(t)
    kind, k = F.col("event_type"), F.col("k")

    def shown(n: int) -> Column:
        return F.struct((k + n).cast("string").alias("item"), F.lit(n).alias("pos"))

    def action(n: int) -> Column:
        return F.struct(F.lit(f"a{n}").alias("action_id"), (F.col("ts") + 1000 * n).alias("ts"))

    line = F.to_json(F.struct(
        F.struct(*[c.alias(n) for n, c in _common(ev).items()]).alias("common"),
        F.col("ts"),
        F.when(kind == "error", F.struct(F.lit("icon").alias("entry"), k.alias("loading_time")))
        .alias("start"),
        F.when(kind != "error", F.struct(
            _page_id().alias("page_id"), _last_page().alias("last_page_id"),
            during_time().alias("during_time"))).alias("page"),
        F.when(kind.isin("view", "purchase"), F.array(shown(0), shown(1))).alias("displays"),
        F.when(kind == "click", F.array(action(1)))
        .when(kind == "purchase", F.array(action(1), action(2))).alias("actions"),
        F.when((kind == "error") | (kind == "click") & (k >= 90), F.struct(k.alias("error_code"))).alias("err"),
    ))
    cut = F.expr("substring(line, 1, length(line) - 1)")
    broken = (kind == "signup") & (k == 0)
    return (
        ev.select("seq", broken.alias("broken"), line.alias("line"))
        .select("seq", F.when(F.col("broken"), cut).otherwise(F.col("line")).alias("value"))
    )


def searches(t: Tables) -> DataFrame:
    """Documents as searched items: whole text, one second apart."""
    lang = F.col("lang")
    return t("documents").select(
        F.col("doc_id").alias("seq"),
        F.col("text").alias("item"),
        F.when(lang == "es", "tag").otherwise(codes.KEYWORD).alias("item_type"),
        F.when(lang == "en", codes.HOME).when(lang == "de", "category")
        .otherwise(codes.SEARCH).alias("last_page_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")).alias("et"),
    )


def lexicon(t: Tables) -> DataFrame:
    """Words of the sku names: (word)."""
    return words(t("part").select("p_name"), "p_name").distinct()


def config_changes(t: Tables) -> DataFrame:
    """Orders as changes of a routing table, one route per customer."""
    route = F.struct(
        F.concat_ws("_", F.lit("table"), "o_custkey").alias("source_table"),
        F.col("o_orderpriority").alias("source_type"),
        F.concat_ws("_", F.lit("dim"), "o_custkey").alias("sink_table"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "DWD").otherwise("DIM")
        .alias("sink_type"),
        F.lit("info").alias("sink_family"),
        F.lit("id,name").alias("sink_columns"),
        F.lit("id").alias("sink_row_key"),
    )
    op = F.when(F.col("o_orderstatus") == "O", "c").when(F.col("o_orderstatus") == "P", "u").otherwise("d")
    return t("orders").select(
        F.col("o_orderkey").alias("seq"),
        seconds("o_orderdate").alias("ts"),
        op.alias("op"),
        F.when(op != "c", route).alias("before"),
        F.when(op != "d", route).alias("after"),
    )


def route_log(t: Tables) -> DataFrame:
    """Orders as the life of routes, one dimension per customer: created, changed and removed as orders come."""
    level = F.substring("o_orderpriority", 1, 1)
    wanted = F.when(level == "1", "ALL").when(level == "2", "insert").when(level == "3", "update,delete").otherwise("insert,update")
    route = F.struct(
        F.concat_ws("_", F.lit("table"), "o_custkey").alias("source_table"), wanted.alias("source_type"),
        F.concat_ws("_", F.lit("dim"), "o_custkey").alias("sink_table"), F.lit("DIM").alias("sink_type"),
        F.lit("info").alias("sink_family"), F.when(level < "4", "id,name").otherwise("id").alias("sink_columns"),
        F.lit("id").alias("sink_row_key"),
    )
    op = F.when(F.col("o_orderstatus") == "O", "c").when(F.col("o_orderstatus") == "P", "u").otherwise("d")
    return t("orders").select(
        F.col("o_orderkey").alias("seq"), seconds("o_orderdate").alias("ts"), op.alias("op"),
        F.when(op != "c", route).alias("before"), F.when(op != "d", route).alias("after"),
        F.col("o_orderdate").cast("timestamp").alias("et"),
    )


def routed_changes(t: Tables) -> DataFrame:
    """Line items as changes of one table per supplier, over the years in which routes change."""
    op = F.when(F.col("l_returnflag") == "R", "delete").when(F.col("l_linestatus") == "F", "update").otherwise("insert")
    return t("lineitem").select(
        F.concat_ws("_", F.lit("table"), "l_suppkey").alias("table"), F.lit(codes.DATABASE).alias("database"), op.alias("type"),
        seconds("l_shipdate").alias("ts"), text_map(id=F.col("l_partkey"), name=detail_id()).alias("data"),
        arrival().alias("seq"), F.col("l_shipdate").cast("timestamp").alias("et"),
    )


def _config_rows(t: Tables, rows: list[tuple]) -> DataFrame:
    """Literal routing changes (op, source table and types, sink, columns, key), in order."""
    values = ", ".join(str((n, *row)) for n, row in enumerate(rows, 1))
    return t.spark.sql(
        f"SELECT *, 'info' AS sink_family FROM VALUES {values} AS c(seq, op, sink_type,"
        " source_table, source_type, sink_table, sink_columns, sink_row_key)"
    ).select(
        F.col("seq").cast("bigint").alias("seq"), F.col("seq").cast("bigint").alias("ts"), "op",
        *[F.when((F.col("op") == "d") == gone, F.struct(
            "source_table", "source_type", "sink_table", "sink_type", "sink_family",
            "sink_columns", "sink_row_key")).alias(side)
          for side, gone in (("before", True), ("after", False))],
    )


def fact_config(t: Tables) -> DataFrame:
    """Routes of the configured facts."""
    return _config_rows(t, [
        ("c", "DWD", "user_info", "insert", "dwd_user_register", "id,create_time", "id"),
        ("c", "DWD", "cart_info", "insert", "dwd_cart", "id,user_id", "id"),
        ("u", "DWD", "cart_info", "update,delete", "dwd_cart", "id,user_id,sku_num", "id"),
        ("c", "DWD", "comment_info", "ALL", "dwd_comment", "id,appraise", "id"),
        ("c", "DWD", "payment_info", "ALL", "dwd_payment", "id", "id"),
        ("d", "DWD", "payment_info", "ALL", "dwd_payment", "id", "id"),
        ("c", "DIM", "refund_payment", "ALL", "dim_refund", "id", "id"),
    ])


def dimension_config(t: Tables) -> DataFrame:
    """Routes of the dimensions."""
    return _config_rows(t, [
        ("r", "DIM", "nation", "insert,update", "dim_province", "id,name", "id"),
        ("c", "DIM", "supplier", "insert", "dim_category3", "id", "id"),
        ("u", "DIM", "supplier", "ALL", "dim_category3", "id,name,category2_id", "id"),
        ("c", "DIM", "customer", "insert,delete", "dim_user", "id,name", "id"),
        ("c", "DIM", "part", "ALL", "dim_sku", "id,name", "id"),
        ("d", "DIM", "part", "ALL", "dim_sku", "id,name", "id"),
        ("c", "DWD", "region", "ALL", "dwd_region", "id", "id"),
    ])


def dimension_changes(t: Tables) -> DataFrame:
    """Snapshot of the dimension tables, then updates of rich and deletes of indebted ones."""
    parts = []
    for table, key, name, balance, more in (
        ("nation", "n_nationkey", "n_name", None, {}),
        ("region", "r_regionkey", "r_name", None, {}),
        ("part", "p_partkey", "p_name", None, {}),
        ("supplier", "s_suppkey", "s_name", "s_acctbal", {"category2_id": "s_nationkey"}),
        ("customer", "c_custkey", "c_name", "c_acctbal", {"segment": "c_mktsegment"}),
    ):
        rows, cols = t(table), {n: F.col(c) for n, c in more.items()}
        seq = F.col(key)
        data = dict(id=seq, name=F.col(name), **cols)
        parts.append(Branch(rows, table, "bootstrap-insert", F.lit(1), seq, data))
        if balance:
            renamed = dict(id=seq, name=F.upper(name), **cols)
            parts.append(Branch(
                rows.where(F.col(balance) >= 5000), table, "update", F.lit(2), seq, renamed,
                dict(name=F.col(name))))
            parts.append(Branch(rows.where(F.col(balance) < 0), table, "delete", F.lit(3), seq, data))
    return reduce(DataFrame.unionByName, [p.as_maps() for p in parts])


# --- dimensions -----------------------------------------------------------------------


def dictionary(t: Tables) -> DataFrame:
    """Code dictionary (fixed size, see codes)."""
    rows = ", ".join(f"('{code}', '{name}')" for code, name in codes.DICTIONARY)
    return t.spark.sql(f"SELECT * FROM VALUES {rows} AS dic(id, dic_name)")


def province(t: Tables) -> DataFrame:
    return t("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))


def sku(t: Tables) -> DataFrame:
    return t("part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.floor(F.col("p_partkey") / 10).cast("string").alias("spu_id"),
        money(F.col("p_retailprice")).cast("string").alias("price"),
        F.col("p_name").alias("sku_name"),
        F.substring_index("p_brand", "#", -1).alias("tm_id"),
        F.col("p_size").cast("string").alias("category3_id"),
    )


def spu(t: Tables) -> DataFrame:
    return (
        t("part").groupBy(F.floor(F.col("p_partkey") / 10).cast("string").alias("id"))
        .agg(F.min("p_name").alias("spu_name"))
    )


def trademark(t: Tables) -> DataFrame:
    return (
        t("part").groupBy(F.substring_index("p_brand", "#", -1).alias("id"))
        .agg(F.min("p_brand").alias("tm_name"))
    )


def category3(t: Tables) -> DataFrame:
    return t("supplier").select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("string").alias("category2_id"),
    )


def category2(t: Tables) -> DataFrame:
    return t("nation").select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("string").alias("category1_id"),
    )


def category1(t: Tables) -> DataFrame:
    return t("region").select(
        F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name")
    )
