"""What the plans must and must not contain."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from martflow.operators import first, routing
from martflow.operators.joins import lookup
from martflow import catalogue, codes
from martflow.plans import ads, dwd, dws
from martflow.plans.warehouse import Warehouse
from martflow.functions.words import lexicon_words
from martflow.sources.store import refresh, stored_days, stored_windows, write_windows


def plan(df):
    return df._jdf.queryExecution().toString()


def test_first_rows_are_pruned_before_the_shuffle(spark, small):
    text = plan(entry.queries()["w1_first_version"](spark, small))
    final, partial = text.rindex(", Final"), text.rindex(", Partial")
    assert "WindowGroupLimit" in text and final < text.rindex("Exchange hashpartitioning(id") < partial


def test_large_dimension_is_not_broadcast(spark):
    facts = spark.range(100).select(F.col("id").cast("string").alias("k"))
    dim = spark.range(10**9).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("name"))
    assert "BroadcastHashJoin" not in plan(lookup(facts, dim, "k", {"n": "name"}))


def test_scan_reads_used_columns_and_pushes_filters(spark, small):
    text = plan(entry.queries()["p5_status_transition"](spark, small))
    assert "EqualTo(o_orderstatus,O)" in text
    assert "o_totalprice" not in text.split("== Physical Plan ==")[1]


def test_report_of_a_day_reads_one_partition(spark, small, tmp_path):
    w = Warehouse(spark, small)
    write_windows(w.windows, str(tmp_path), ["traffic"])
    write_windows(w.windows, str(tmp_path), ["traffic"])  # days are replaced, not added
    stored = stored_windows(spark, str(tmp_path), ["traffic"])
    assert stored["traffic"].count() == w.windows["traffic"].count()
    report = ads.for_day(ads.r1, stored, "20240105")
    assert re.search(r"PartitionFilters: \[[^\]]*cur_date", plan(report))
    want = ads.r1(w.windows).where("cur_date = '2024-01-05'").drop("cur_date")
    assert sorted(report.collect()) == sorted(want.collect())


def test_hot_device(spark):
    """One device with most records: the same flags as by brute force."""
    rows = [(i, 1_704_067_200_000 + i * 3_600_000, "hot" if i % 3 else f"m{i}", "1") for i in range(300)]
    df = spark.createDataFrame(rows, "seq BIGINT, ts BIGINT, mid STRING, is_new STRING")
    seen, want, start = set(), {}, {}
    for seq, ts, mid, _ in rows:
        day = ts // 86_400_000
        want[seq] = int((mid, day) not in seen)
        seen.add((mid, day))
        start.setdefault(mid, day)
    found = {r.seq: r.uv_ct for r in first.daily_unique(df).collect()}
    assert found == want
    fixed = {r.seq: r.is_new for r in first.fix_first_visit(df).collect()}
    assert fixed == {s: "1" if t // 86_400_000 == start[m] else "0" for s, t, m, _ in rows}


def initial(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_a_scan_is_not_dealt_out_again(spark, small):
    assert initial(entry.queries()["a1_window_count"](spark, small)).count("Exchange ") == 1


def test_order_windows_read_no_customer(spark, small):
    text = initial(entry.queries()["g8_order"](spark, small))
    assert "customer.parquet" not in text and text.count("lineitem.parquet") <= 2


def test_payment_windows_look_nothing_up(spark, small):
    assert "dic_name" not in initial(entry.queries()["g7_payment_suc"](spark, small))


def test_router_reads_routed_tables_only(spark, small):
    assert "lineitem.parquet" not in initial(entry.queries()["d9_routed_facts"](spark, small))


def test_wide_ids_and_amounts_are_kept(spark):
    rows = [("1-1", "3000000000", "2024-01-01 00:00:01", "40000", "99999999999999.99", "0", "0", k) for k in range(2)]  # two versions
    names = "id STRING, sku_id STRING, create_time STRING, sku_num STRING, split_total_amount STRING, split_activity_amount STRING, split_coupon_amount STRING, seq BIGINT"
    lines = spark.createDataFrame(rows + [("2-1", *rows[0][1:])], names)
    sku = spark.createDataFrame(
        [("3000000000", "3000000001", "s", "p", "9.50", "40000", "t", "70000", "a", "70001", "b", "70002", "c")],
        "sku_id STRING, spu_id STRING, sku_name STRING, spu_name STRING, price STRING, trademark_id STRING, trademark_name STRING,"
        " category1_id STRING, category1_name STRING, category2_id STRING, category2_name STRING, category3_id STRING, category3_name STRING")
    row = dws.sku_order(lines, sku).first()
    assert (row.sku_id, row.spu_id, row.trademark_id, row.category3_id) == (3000000000, 3000000001, 40000, 70002)
    assert str(row.order_amount) == "199999999999999.98" and row.original_amount == 760000


def test_stored_reports_read_no_raw_table(spark, small):
    for name in ("s16_stored_r9", "s16_stored_r16", "f22_report_of_a_day"):
        text = plan(entry.queries()[name](spark, small))
        assert "daily-" in text and not re.search(r"(orders|lineitem|events|customer)\.parquet", text)


def test_stored_reports_make_their_windows_once(spark, small, monkeypatch):
    """Both loads of the daily sums read stored windows; none makes them from the raw tables anew."""
    plans = []

    def seen(tables, path, names, months=None):
        plans.extend(plan(tables[name]) for name in names)
        refresh(tables, path, names, months)

    monkeypatch.setattr(catalogue, "refresh", seen)
    entry.queries()["f22_report_of_a_day"](spark, small)
    assert len(plans) == 2 and not any(re.search(r"(orders|lineitem|events|customer)\.parquet", text) for text in plans)


def test_refreshing_months_replaces_them_only(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "d STRING, n BIGINT").select(
        F.col("d").cast("timestamp").alias("stt"), F.col("d").cast("timestamp").alias("edt"),
        F.col("d").cast("date").alias("cur_date"), F.col("n").alias("register_ct"))
    first_load = df([("2024-01-30", 1), ("2024-01-30", 2), ("2024-02-01", 5), ("2024-03-01", 7)])
    refresh({"user_register": first_load}, str(tmp_path), ["user_register"])
    changed = df([("2024-01-30", 100), ("2024-02-01", 6), ("2024-02-03", 1)])
    refresh({"user_register": changed}, str(tmp_path), ["user_register"], F.col("month") == 202402)
    found = stored_days(spark, str(tmp_path), ["user_register"])["user_register"]
    assert sorted((str(r.cur_date), r.register_ct) for r in found.collect()) == [
        ("2024-01-30", 3), ("2024-02-01", 6), ("2024-02-03", 1), ("2024-03-01", 7)]


def test_words_of_any_length_in_a_lexicon(spark):
    """A word of fifty letters is found, and does not multiply what meets the lexicon."""
    long = "abcdefghij" * 5
    texts = spark.createDataFrame([(1, f"xx{long}yy ab"), (2, "日本語の辞書 a"), (3, None), (4, long[:-1])], "seq INT, item STRING")
    lexicon = spark.createDataFrame([(w,) for w in (long, "ab", "a", "本語", "辞書", "語の辞書", "zz", "", long + "k")], "word STRING")
    found = {(r.seq, r.word) for r in lexicon_words(texts, "item", lexicon).collect()}
    assert found == {(1, long), (1, "ab"), (1, "a"), (2, "a"), (2, "本語"), (2, "辞書"), (2, "語の辞書"), (4, "ab"), (4, "a")}


def test_reports_are_ordered(spark, small):
    """Days ascend, and within a day the measure descends."""
    for name, measure in (("r1", "uv_ct"), ("r2", "sv_ct"), ("r3", "pv_per_session"), ("r4", "dur_per_session")):
        last = float("inf")
        rows = [(r.cur_date, last if r[measure] is None else -r[measure]) for r in entry.queries()[name](spark, small).collect()]
        assert len(rows) > 10 and rows == sorted(rows)


def test_facts_of_one_pass_scan_the_lines_once(spark, small):
    text = plan(entry.queries()["d1_one_pass"](spark, small))
    assert "facts-" in text and "events.parquet" not in text and "from_json" not in text


def test_records_are_pruned_once_for_each_change(spark):
    """The filter on the row key must not prune the record anew, and lists of a route are parted on its side of the join."""
    changes = spark.sql("SELECT 't' AS table, 'update' AS type, map('id', id, 'op_type', 'x', 'no', 'y') AS data, id AS ts, id AS seq FROM VALUES ('1'), (null) AS v(id)")
    routes = spark.createDataFrame(
        [("t", "insert,update", s, c, k) for s, c, k in [("a", "id,name", "id"), ("b", "name", "id"), ("c", "id", "op_type"), ("d", None, "op_type"), ("e", "id", None)]],
        "source_table string, source_type string, sink_table string, sink_columns string, sink_row_key string")
    found = routing.dimension_changes(routing.prune(routing.route(changes, routes)))
    rows = [(r.sink_table, r.row_key, r.data) for r in found.collect()]
    gone = {"op_type": "update"}
    assert sorted(rows, key=str) == sorted([("a", "1", {"id": "1", **gone}), *[("c", "update", {"id": i, **gone}) for i in ("1", None)]], key=str)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("map_filter") == 1
    assert "split" not in text[: text.index("Join")]


def test_orders_join_payments_and_not_their_lines(spark, small, monkeypatch):
    """Paid lines meet their order through the payment, so lines are not shuffled once more for it."""
    seen = []
    joined = dwd.with_order
    monkeypatch.setattr(dwd, "with_order", lambda rows, orders: seen.append(rows.columns) or joined(rows, orders))
    w = Warehouse(spark, small)
    found = w.pay_detail
    assert len(seen) == 1 and "payment_type" in seen[0] and "split_total_amount" not in seen[0]
    monkeypatch.undo()
    shared = ["id", "detail_id", "user_id", "order_id", "province_id", "coupon_id", "activity_id", "sku_num", "seq"]
    want = dwd.paid_lines(w.log, w.order_detail)
    assert sorted(map(str, found.select(shared).collect())) == sorted(map(str, want.select(shared).collect()))


def test_repeated_and_missing_orders_of_paid_lines(spark):
    """An order that comes twice gives its lines twice, one that is missing leaves the province empty."""
    def rows(table, op, names, values, old=()):
        more = [f"data_{n} STRING" for n in names] + [f"old_{n} STRING" for n in old]
        schema = "table STRING, database STRING, type STRING, ts BIGINT, seq BIGINT, " + ", ".join(more)
        df = spark.createDataFrame([(table, codes.DATABASE, op, ts, seq, *rest) for ts, seq, *rest in values], schema)
        return df.withColumn("et", F.timestamp_seconds("ts"))

    pay = ("id", "user_id", "order_id", "trade_no", "total_amount", "payment_status", "payment_type", "callback_time")
    log = {
        "order_detail": rows("order_detail", "insert", dwd.DETAIL, [
            (100, 1, "a", "1", "s", "1", "1", "1", "1", "x"), (100, 2, "b", "2", "s", "1", "1", "1", "1", "x"),
            (100, 3, "c", None, "s", "1", "1", "1", "1", "x")]),
        "order_info": rows("order_info", "insert", ("id", "user_id", "province_id"), [(100, 1, "1", "u", "7"), (100, 2, "1", "u", "8"), (100, 3, None, "u", "9")]),
        "order_detail_coupon": rows("order_detail_coupon", "insert", ("order_detail_id", "coupon_id", "coupon_use_id"), [(1, 1, "b", "k", "l")]),
        "order_detail_activity": rows("order_detail_activity", "insert", ("order_detail_id", "activity_id", "activity_rule_id"), [(1, 1, "a", "m", "n")]),
        "payment_info": rows("payment_info", "update", pay, [
            (n, n, "p", "u", order, "t", "1", codes.PAYMENT_DONE, "1101", "c", codes.PAYMENT_OPEN) for n, order in ((200, "1"), (201, "2"), (202, None))],
            ("payment_status",)),
    }
    found = dwd.pay_detail(log, spark.createDataFrame([("1101", "p")], "id STRING, dic_name STRING"))
    got = [(r.detail_id, r.province_id, r.coupon_id, r.activity_id) for r in found.collect()]
    assert sorted(got, key=str) == sorted([("a", "7", None, "m"), ("a", "8", None, "m"), ("b", None, "k", None)], key=str)
