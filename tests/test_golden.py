"""The worked examples as literal rows."""

from datetime import date, datetime, timezone
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from martflow.functions.scalar import safe_average, two_places
from martflow.functions.words import words
from martflow.operators import changes, first, routing
from martflow.operators.joins import interval_join
from martflow.operators.windows import stamped, tumble
from martflow.plans import ads, dwd, dws
from martflow.sources import ods


def ms(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1000)


def lines(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq BIGINT, value STRING")


def ordered(df, *columns):
    return [tuple(r) for r in df.orderBy("seq").select(*columns).collect()]


def visits(spark, rows, schema):
    data = [(i, ms(day), *rest) for i, (day, *rest) in enumerate(rows)]
    return spark.createDataFrame(data, f"seq BIGINT, ts BIGINT, {schema}").withColumn(
        "et", F.timestamp_millis("ts"))


def test_daily_visitor(spark):
    days = ["2024-01-06T01", "2024-01-06T02", "2024-01-06T03", "2024-01-07T01", "2024-01-07T02"]
    df = visits(spark, [(d, "1") for d in days], "mid STRING")
    assert ordered(first.daily_unique(df), "uv_ct") == [(1,), (0,), (0,), (1,), (0,)]


def test_session_first(spark):
    df = visits(spark, [("2024-01-06T01", "1")] * 4, "sid STRING")
    assert ordered(first.session_first(df), "sv_ct") == [(1,), (0,), (0,), (0,)]


def test_order_of_input_does_not_matter(spark):
    df = visits(spark, [(f"2024-01-0{1 + i % 3}T0{i % 7}", str(i % 4)) for i in range(40)], "mid STRING")
    once = ordered(first.daily_unique(df), "seq", "uv_ct")
    assert ordered(first.daily_unique(df.orderBy(F.rand(7)).repartition(3)), "seq", "uv_ct") == once


def test_login_and_return(spark):
    df = visits(spark, [
        ("2024-01-01T08", "a"), ("2024-01-01T09", "a"), ("2024-01-08T08", "a"),
        ("2024-01-01T08", "b"), ("2024-01-09T08", "b"),
    ], "uid STRING")
    found = ordered(first.back_flow(df), "seq", "uu_ct", "back_ct")
    assert found == [(0, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 1)]


def test_first_payment(spark):
    df = visits(spark, [("2024-01-01T08", "a"), ("2024-01-01T09", "a"), ("2024-01-02T08", "a")],
                "user_id STRING")
    assert ordered(first.first_payment(df), "seq", "unique_ct", "new_ct") == [(0, 1, 1), (2, 1, 0)]


def test_first_visit_fix(spark):
    df = visits(spark, [
        ("2024-01-05T08", "old", "0"), ("2024-01-05T09", "old", "1"),
        ("2024-01-05T08", "new", "1"), ("2024-01-05T09", "new", "1"), ("2024-01-06T08", "new", "1"),
    ], "mid STRING, is_new STRING")
    fixed = ordered(first.fix_first_visit(df), "is_new")
    assert [x for (x,) in fixed] == ["0", "0", "1", "1", "0"]


def test_first_orders(spark):
    rows = [("a", t) for t in ("2024-01-08 01:01:01", "2024-01-08 01:01:02",
                               "2024-01-08 01:01:03", "2024-01-09 01:01:03")]
    df = spark.createDataFrame(rows, "user_id STRING, create_time STRING").withColumn(
        "et", F.col("create_time").cast("timestamp"))
    found = {str(r.stt): (r.order_unique_user_count, r.order_new_user_count)
             for r in dws.order(df).collect()}
    assert found == {"2024-01-08 01:01:00": (1, 1), "2024-01-09 01:01:00": (1, 0)}


def test_repeated_line_counts_once(spark):
    rows = [("1", "s", "2", "10.00", "1.00", "0.50", "2024-01-08 01:01:01", seq) for seq in (5, 7)]
    df = spark.createDataFrame(
        rows, "id STRING, sku_id STRING, sku_num STRING, split_total_amount STRING,"
        " split_activity_amount STRING, split_coupon_amount STRING, create_time STRING, seq BIGINT")
    (row,) = dws.sku_amounts(df).collect()
    assert (row.sku_num, float(row.order_amount)) == (2, 10.0)


def test_province_averages_versions(spark):
    rows = [("1", "5", "o1", "10.00"), ("1", "5", "o1", "10.00"), ("2", "5", "o1", "3.00"),
            ("3", None, "o2", "9.00")]
    df = spark.createDataFrame(
        rows, "id STRING, province_id STRING, order_id STRING, split_total_amount STRING"
    ).withColumn("create_time", F.lit("2024-01-08 01:01:01"))
    (row,) = dws.province_amounts(df).collect()
    assert (row.order_count, float(row.order_amount)) == (1, 13.0)


def test_refunded_lines_and_orders(spark):
    rows = [("A", "u"), ("C", "u")]
    refunds = spark.createDataFrame(rows, "sku_id STRING, user_id STRING").withColumn(
        "et", F.lit("2024-01-08 01:01:01").cast("timestamp"))
    flat = spark.createDataFrame(
        [("A", "1"), ("C", "1")], "sku_id STRING, trademark_id STRING"
    ).selectExpr("*", *[f"'x' AS {c}" for c in dws.REFUND_KEYS if c not in ("user_id", "trademark_id")])
    window = dws.refund(refunds, flat)
    (row,) = window.collect()
    assert row.refund_count == 2
    (report,) = ads._refunds(window, ["cur_date", "trademark_id"]).collect()
    assert (report.refund_count, report.refund_uu_count) == (2, 1)


def test_window_day_is_that_of_its_start(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-06 23:59:58' AS et")
    (row,) = stamped(tumble(df, "et").agg(F.count("*").alias("n"))).collect()
    assert (str(row.stt), str(row.edt), row.cur_date) == (
        "2024-01-06 23:59:55", "2024-01-07 00:00:00", date(2024, 1, 6))


def test_cart_growth(spark):
    log = ods.change_log(lines(
        spark,
        '{"database":"retail","table":"cart_info","type":"insert","ts":1,"data":{"id":1,"sku_num":"3"}}',
        '{"database":"retail","table":"cart_info","type":"update","ts":2,"data":{"id":1,"sku_num":"5"},"old":{"sku_num":"3"}}',
        '{"database":"retail","table":"cart_info","type":"update","ts":3,"data":{"id":1,"sku_num":"4"},"old":{"sku_num":"5"}}',
    ))
    assert ordered(dwd.cart_add(log), "id", "sku_num") == [("1", 3), ("1", 2)]


def test_log_split(spark):
    raw = lines(
        spark,
        '{"common":{"mid":"m","is_new":"1"},"ts":1000,"page":{"page_id":"home"},'
        '"displays":[{"item":"1"},{"item":"2"}],"actions":[{"action_id":"a","ts":1500}],"err":{"error_code":7}}',
        '{"common":{"mid":"m","is_new":"1"},"ts":2000,"start":{"entry":"icon"}}',
        '{"common":{"mid":"m","is_new":"1"},"ts":3000,"displays":[]}',
        '{"common":{"mid":"m"',
    )
    facts = {name: df.collect() for name, df in dwd.split_log(raw).items()}
    assert {n: len(rows) for n, rows in facts.items()} == {
        "start": 1, "page": 1, "display": 2, "action": 1, "err": 1}
    assert facts["action"][0].record["ts"] == "1500"
    assert facts["display"][0].record["ts"] == "1000"
    assert facts["err"][0].record == {
        "mid": "m", "is_new": "1", "ts": "1000", "error_code": "7", "page_id": "home"}


def test_config_changes(spark):
    def change(op, columns, ts):
        route = ('{"source_table":"user_info","source_type":"ALL","sink_table":"dim_user",'
                 f'"sink_type":"DIM","sink_columns":"{columns}","sink_row_key":"id"}}')
        side = "before" if op == "d" else "after"
        return f'{{"op":"{op}","ts":{ts},"{side}":{route}}}'

    updated = ods.config_log(lines(spark, change("c", "id", 1), change("u", "id,name", 2)))
    assert [r.sink_columns for r in routing.active_config(updated, "DIM").collect()] == ["id,name"]
    retired = ods.config_log(lines(spark, change("c", "id", 1), change("u", "id,name", 2), change("d", "id", 3)))
    assert routing.active_config(retired, "DIM").count() == 0


def test_malformed_changes_are_dropped(spark):
    good = '{"database":"retail","table":"t","type":"insert","ts":1,"data":{"id":1}}'
    bad = [
        "{bad", good.replace("retail", "other"), good.replace('{"id":1}', "{}"),
        good.replace("insert", "rename"), good.replace('"ts":1,', ""), good[:-1],
        good.replace('"t"', '" "'),
    ]
    valid = ods.valid_changes(ods.change_log(lines(spark, good, *bad)))
    assert [r.seq for r in valid.collect()] == [0]


def test_state_transition(spark):
    log = ods.change_log(lines(
        spark,
        '{"database":"retail","table":"t","type":"update","ts":1,"data":{"s":"2"},"old":{"s":"1"}}',
        '{"database":"retail","table":"t","type":"update","ts":1,"data":{"s":"2"},"old":{"x":"1"}}',
        '{"database":"retail","table":"t","type":"update","ts":1,"data":{"s":"2"},"old":{"s":"0"}}',
    ))
    rows = changes.rows_of(log, "t", "update")
    assert [r.seq for r in changes.moved(rows, "s", "1", "2").collect()] == [0]
    assert sorted(r.seq for r in changes.changed_to(rows, "s", "2").collect()) == [0, 2]


def test_no_sessions_average_to_zero(spark):
    (row,) = spark.range(1).select(safe_average(F.lit(5), F.lit(0)).alias("x")).collect()
    assert row.x == 0.0


def test_two_places_go_by_the_exact_value(spark):
    values = [75.165, 0.125, 0.375, 2.675, 1.005, 100.0, 99.995, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE").select(two_places(F.col("x")))
    want = [float(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) for v in values]
    assert [r[0] for r in df.collect()] == want


def test_day_without_data_gives_null(spark):
    empty = spark.sql("SELECT DATE '2024-01-01' AS cur_date, CAST(1 AS DECIMAL(16,2)) AS order_amount")
    tables = {"province_order": empty}
    assert [r[0] for r in ads.for_day(ads.r15, tables, "20240101").collect()] == [1.0]
    assert [r[0] for r in ads.for_day(ads.r15, tables, "2024-01-02").collect()] == [None]
    assert [r[0] for r in ads.for_day(ads.r15, tables).collect()] == [None]  # today


def test_words(spark):
    df = lines(spark, "Red phone, red CASE", "  ", "--", None)
    assert sorted(r.word for r in words(df, "value").collect()) == ["case", "phone", "red"]


def test_interval_join_against_brute_force(spark):
    left = [(i, "ab"[i % 2], 977 * i) for i in range(60)]
    right = [(i, "ab"[i % 3 == 0], 613 * i) for i in range(90)]
    want = {(a, b) for a, k, t in left for b, m, u in right if k == m and t - 1800 <= u <= t}
    lhs = spark.createDataFrame(left, "l INT, lk STRING, s BIGINT").selectExpr("l", "lk", "timestamp_seconds(s) lt")
    rhs = spark.createDataFrame(right, "r INT, rk STRING, s BIGINT").selectExpr("r", "rk", "timestamp_seconds(s) rt")
    found = interval_join(lhs, rhs, {"lk": "rk"}, "lt", "rt", 1800).select("l", "r").collect()
    assert len(found) == len(want) and {tuple(x) for x in found} == want


def test_dimension_in_one_or_many_steps(spark):
    rows = [(i % 5, "delete" if i % 7 == 3 else "update", i, i, f"v{i}") for i in range(30)]
    log = spark.createDataFrame(rows, "k INT, op_type STRING, ts INT, seq INT, v STRING")
    want = {tuple(r) for r in routing.compact(log, ["k"]).collect()}
    table = log.where("false")
    for low in range(0, 30, 10):
        table = routing.apply_changes(table, log.where(f"seq >= {low} AND seq < {low + 10}"), ["k"])
    assert {tuple(r) for r in table.collect()} == want
