"""Streams over several micro-batches give what the batch jobs give."""

import random
from uuid import uuid4

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from martflow.catalogue import catalogue
from martflow.operators import first, routing
from martflow.operators.windows import stamped, tumble
from martflow.plans import dwd, dws
from martflow.plans.warehouse import Warehouse
from martflow.sources import replay
from martflow.sources.tables import Tables
from martflow.streaming import arrivals, jobs, queries, running
from martflow.streaming.arrivals import Arrivals
from martflow.streaming.sinks import UpsertTable, append_sink, read_current, run, text_sink, write_part
from martflow.streaming.sources import StreamTables, arrival_number


@pytest.fixture(scope="module")
def parts(spark, small, tmp_path_factory):
    """The events in a folder of four files, in order of time, beside a table whose name begins the same."""
    root = str(tmp_path_factory.mktemp("events"))
    (tmp := tmp_path_factory.getbasetemp() / root / "events.parquet").mkdir()
    ev = spark.read.parquet(f"{small}/events.parquet")
    cuts = [0, 250, 500, 750, 10**9]
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        rows = ev.where(f"event_id >= {low} AND event_id < {high}").toPandas()
        rows.to_parquet(tmp / f"part-{i}.parquet", coerce_timestamps="us")
    ev.limit(50).toPandas().to_parquet(f"{root}/events_old.parquet", coerce_timestamps="us")
    return root


@pytest.fixture(scope="module")
def spring(spark, small, tmp_path_factory):
    """The tables with the orders of two months only, as stream sinks write a folder per day."""
    root = str(tmp_path_factory.mktemp("spring"))
    orders = spark.read.parquet(f"{small}/orders.parquet").where("o_orderdate < '1995-03-01'")
    items = spark.read.parquet(f"{small}/lineitem.parquet")
    orders.write.parquet(f"{root}/orders.parquet")
    items.join(orders, items.l_orderkey == orders.o_orderkey, "left_semi").write.parquet(f"{root}/lineitem.parquet")
    for name in ("customer", "part", "supplier", "nation", "region"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    return root


def same(left, right):
    columns = sorted(right.columns)
    return sorted(map(str, left.select(columns).collect())) == sorted(map(str, right.select(columns).collect()))


def batches(spark, path):
    return spark.read.parquet(path).select("batch_id").distinct().count()


def mixed(self, rows, time):
    """Slices that have nothing to do with time."""
    return F.pmod(F.xxhash64("seq"), F.lit(self.batches))


@pytest.mark.parametrize("name, want", [
    ("w5_stream_first_visit", "w5_first_visit_fix"), ("w6_stream_daily_unique", "w6_daily_unique"),
    ("w8_stream_backflow", "w8_backflow"), ("t9_stream_traffic", "g2_traffic"),
])
def test_first_times_in_any_order_of_arrival(spark, small, monkeypatch, name, want):
    """A first row that comes after others takes their place, as long as the watermark lets it in."""
    monkeypatch.setattr(Arrivals, "_slice", mixed)
    monkeypatch.setattr(jobs, "DELAY", "5000 days")
    w = Warehouse(spark, small)
    assert same(queries.QUERIES[name](w), catalogue()[want](w))


@pytest.mark.parametrize("name, want", [
    ("d4_stream_order_detail", "d4_order_detail"), ("d5_stream_cancel_detail", "d5_cancel_detail"),
    ("d6_stream_pay_detail", "d6_pay_detail"), ("d7_stream_refund", "d7_refund"),
    ("g9_stream_sku_order", "g9_sku_order"), ("g11_stream_refund", "g11_refund"),
])
def test_joins_in_any_order_of_arrival(spark, spring, monkeypatch, name, want):
    """Halves of a pair that come with different batches find each other."""
    monkeypatch.setattr(Arrivals, "_slice", mixed)
    monkeypatch.setattr(jobs, "DELAY", "5000 days")
    w = Warehouse(spark, spring)
    found, full = queries.QUERIES[name](w), catalogue()[want](w)
    shared = [c for c in found.columns if c in full.columns]
    assert len(shared) > 3 and same(found.select(shared), full.select(shared))


def test_state_goes_when_the_span_is_over(spark, small):
    """An outer join with a span: every refund comes out once, and nothing is kept at the end."""
    s = queries.Stage(Warehouse(spark, small))
    rows = s.appended("refunds", jobs.refunds(*s.log("order_info", "order_refund_info"), 30, "leftOuter"))()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in s.progress("refunds")]
    assert len(states) >= 6 and max(states) > 0 and states[-1] == 0
    assert rows.count() == dwd.granted_refunds(s.warehouse.log).count()


def test_every_stream_goes_through_several_batches(spark, small):
    s = queries.Stage(Warehouse(spark, small))
    devices = queries._devices(s, s.behaviour())
    assert devices().count() and [p["batchId"] for p in s.progress("devices") if p["numInputRows"]] == [0, 1, 2, 3, 4]


def test_native_windows(spark, small, parts, tmp_path):
    """Every window's latest state, over four batches, with nothing read from the neighbour."""
    rows = replay.traffic(StreamTables(spark, parts, files_per_trigger=1)).select("et", "event_type")

    def counts(df):
        return stamped(tumble(df, "et", "event_type").agg(F.count("*").alias("n")))

    run(counts(rows.withWatermark("et", "1 day")), append_sink(f"{tmp_path}/out", "cur_date"), f"{tmp_path}/cp", "update")
    assert batches(spark, f"{tmp_path}/out") == 4
    want = counts(replay.traffic(Tables(spark, small)))
    assert same(read_current(spark, f"{tmp_path}/out", ["stt", "event_type"]), want)


def test_a_finished_run_goes_on(spark, tmp_path):
    """Nothing moves the watermark past the data: later records of an open window still count."""
    for name, second in (("a", 1), ("b", 2)):
        df = spark.createDataFrame([(f"2024-01-01 10:00:0{second}",)], "t STRING")
        df.selectExpr("CAST(t AS TIMESTAMP) AS create_time").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("create_time TIMESTAMP").parquet(f"{tmp_path}/in")
        run(dws.user_register(stream.withWatermark("create_time", "0 seconds")),
            append_sink(f"{tmp_path}/out", "cur_date"), f"{tmp_path}/cp", "update")
    assert [r.register_ct for r in read_current(spark, f"{tmp_path}/out", ["stt"]).collect()] == [2]


def test_three_aggregations_in_a_stream(spark, spring, tmp_path):
    """Chained groupings give each window once, when the watermark has passed it."""
    w = Warehouse(spark, spring)
    lines = w.detail_versions.select("id", F.coalesce("province_id", F.lit("")).alias("province_id"), "order_id", "split_total_amount",
                                     F.col("create_time").cast("timestamp").alias("create_time"))
    lines.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(lines.schema).parquet(f"{tmp_path}/in").withWatermark("create_time", "1 day")
    run(dws.province_amounts(stream), append_sink(f"{tmp_path}/out", "cur_date"), f"{tmp_path}/cp")
    latest = lines.agg(F.max("create_time") - F.expr("INTERVAL 1 DAY")).first()[0]
    found = spark.read.parquet(f"{tmp_path}/out").drop("batch_id")
    assert found.count() and same(found, dws.province_amounts(lines).where(F.col("edt") <= F.lit(latest)))


def test_late_records_are_dropped(spark, tmp_path):
    for name, times in (("a", ["10:00:01", "10:00:02"]), ("b", ["10:10:00"]), ("c", ["10:00:03", "10:20:00"])):
        df = spark.createDataFrame([(f"2024-01-01 {t}",) for t in times], "t STRING")
        df.selectExpr("CAST(t AS TIMESTAMP) AS create_time").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("create_time TIMESTAMP").parquet(f"{tmp_path}/in")
        run(dws.user_register(stream.withWatermark("create_time", "1 minute")),
            append_sink(f"{tmp_path}/out", "cur_date"), f"{tmp_path}/cp")
    found = {str(r.stt): r.register_ct for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {"2024-01-01 10:00:00": 2, "2024-01-01 10:10:00": 1}


def test_dimensions_follow_the_configuration(spark, small, tmp_path):
    w = Warehouse(spark, small)
    changes = replay.dimension_changes(w.tables)
    config = [replay.dimension_config(w.tables).where("seq < 7"), replay.dimension_config(w.tables)]
    seen = []
    job = jobs.dimensions(str(tmp_path), lambda batch: config[min(len(seen), 1)])
    for batch_id, ts in enumerate((1, 2, 3)):
        job(changes.where(f"ts = {ts}"), batch_id)
        seen.append(ts)
    log = spark.read.parquet(str(tmp_path))
    rows = jobs.current_dimensions(log, w.dimension_config).select("sink_table", "row_key", "op_type")
    want = routing.compact(
        dwd.dimension_log(changes, w.dimension_config), ["sink_table", "row_key"]
    ).select("sink_table", "row_key", "op_type")
    assert same(rows, want)


def test_repeated_batch_after_a_route_changed(spark, tmp_path):
    """Only the rows of the last try stay."""
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, sink_table STRING")
    write_part(df, str(tmp_path), 7, "sink_table")
    write_part(df.withColumn("sink_table", F.lit("c")), str(tmp_path), 7, "sink_table")
    assert {(r.id, r.sink_table) for r in spark.read.parquet(str(tmp_path)).collect()} == {(1, "c"), (2, "c")}


def test_offsets_that_repeat_across_partitions(spark):
    rows = [(p, o, f"m{p}", 1000 * o) for p in range(3) for o in range(4)]
    df = spark.createDataFrame(rows, "p INT, offset BIGINT, mid STRING, ts BIGINT")
    numbered = df.select(arrival_number(F.col("offset"), F.col("p")).alias("seq"), "mid", "ts")
    assert numbered.select("seq").distinct().count() == 12
    found = first.daily_unique(numbered).collect()
    assert len(found) == 12 and sum(r.uv_ct for r in found) == 3
    repeated = first.daily_unique(df.select(F.col("offset").alias("seq"), "mid", "ts"))
    assert repeated.count() == 12 and repeated.agg(F.sum("uv_ct")).first()[0] == 3


def test_a_change_overtaken_stays_overtaken(spark):
    schema = "k INT, op_type STRING, ts INT, seq INT, v STRING"
    table = spark.createDataFrame([(1, "update", 10, 1, "new"), (2, "delete", 10, 2, None)], schema)
    late = spark.createDataFrame([(1, "update", 5, 3, "old"), (2, "insert", 5, 4, "old")], schema)
    assert [(r.k, r.v) for r in routing.current(routing.apply_changes(table, late, ["k"])).collect()] == [(1, "new")]


def test_upsert_table_by_bucket(spark, tmp_path):
    """Random changes and deletes over many batches, some repeated: always the rows of a dictionary."""
    rng = random.Random(1)
    df = lambda rows: spark.createDataFrame(rows, "id INT, v INT, at INT, deleted BOOLEAN")
    table = UpsertTable(str(tmp_path), df([]).schema, ("id",), ("at",), buckets=5, every=3)
    want = {}
    for batch_id in range(9):
        rows = [(rng.randint(0, 30), rng.randint(0, 99), 100 * rng.randint(0, batch_id) + k, rng.random() < 0.3) for k in range(8)]
        table.write(df(rows), batch_id)
        if batch_id % 4 == 2:
            table.write(df(rows), batch_id)
        for k, v, at, gone in rows:
            if at >= want.get(k, (0, -1))[1]:
                want[k] = (v, at, gone)
        found = {(r.id, r.v) for r in table.read(spark, batch_id).collect()}
        assert found == {(k, v) for k, (v, _, gone) in want.items() if not gone}
    # However long the stream runs, a reader opens the last folders only.
    assert len({f.split("batch_id=")[1][0] for f in table.read(spark, 8).inputFiles()}) <= 3


def test_text_lines_through_a_stream(spark, small, tmp_path):
    source = replay.change_lines(Tables(spark, small))
    source.select("value").write.text(f"{tmp_path}/in")
    stream = jobs.validated(spark.readStream.text(f"{tmp_path}/in"))
    run(stream, text_sink(f"{tmp_path}/out", "table"), f"{tmp_path}/cp")
    found = spark.read.text(f"{tmp_path}/out").select(F.get_json_object("value", "$.data.id").alias("id"))
    want = source.where("""value LIKE '%retail%' AND value LIKE '%"data"%' AND value LIKE '%}'""")
    want = want.where(F.try_parse_json("value").isNotNull()).select(F.col("seq").cast("string").alias("id"))
    assert same(found.distinct(), want)


def test_upserts(spark, tmp_path):
    path = f"{tmp_path}/{uuid4().hex}"
    for batch_id, rows in enumerate(([(1, "a"), (2, "a")], [(2, "b"), (3, "b")], [(2, "b"), (3, "b")])):
        write_part(spark.createDataFrame(rows, "id INT, v STRING"), path, min(batch_id, 1))
    found = {tuple(r) for r in read_current(spark, path, ["id"]).collect()}
    assert found == {(1, "a"), (2, "b"), (3, "b")}


def test_a_slice_of_several_files_is_one_batch(spark, small, tmp_path, monkeypatch):
    """A large topic is written and read by several tasks; each micro-batch still holds one slice, however few rows that has."""
    monkeypatch.setattr(arrivals, "FILE_BYTES", 1 << 10)
    topics = Arrivals(spark, str(tmp_path))
    rows = replay.traffic(Tables(spark, small)).select("seq", "et")
    # The second slice has one row, the third none.
    slices = F.when(F.col("seq") < 400, 0).when(F.col("seq") == 400, 1).when(F.col("seq") < 700, 3).otherwise(4)
    stream = topics.topic("events", rows, slices=slices)
    files = spark.read.parquet(f"{tmp_path}/topics/events").inputFiles()
    assert len(files) % topics.batches == 0 and len(files) > topics.batches
    run(stream, append_sink(f"{tmp_path}/out"), f"{tmp_path}/cp")
    found = spark.read.parquet(f"{tmp_path}/out").groupBy("batch_id").agg(F.min("seq"), F.max("seq"), F.count("*")).collect()
    n = rows.count()
    assert sorted(map(tuple, found)) == [(0, 0, 399, 400), (1, 400, 400, 1), (3, 401, 699, 299), (4, 700, n - 1, n - 700)]


def test_searched_items_are_split_by_the_stream(spark, small):
    """The keyword topic has a row for an item, whatever number of words it has."""
    w = Warehouse(spark, small)
    seen = []
    monitor = queries.Stage.topic

    def topic(self, name, rows, time="et", **how):
        seen.append((name, rows.count()))
        return monitor(self, name, rows, time, **how)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(queries.Stage, "topic", topic)
        found = queries.QUERIES["t4_stream_keyword"](w)
    assert seen == [("searches", w.tables("documents").count())]
    assert same(found, catalogue()["g1_keyword"](w))


def test_a_user_is_one_value_of_state(spark, spring):
    """The running minima of a user are one state row, however many days are open: a read and a write a batch."""
    s = queries.Stage(Warehouse(spark, spring))
    lines = jobs.placed_lines(*s.log("order_info", "order_detail")).select("user_id", "et", "create_time")
    users = s.warehouse.detail_versions.select("user_id").where("user_id IS NOT NULL").distinct().count()
    with s.settings(running.STORE):
        s.appended("windows", running.order_windows(lines))()
    held = [o["numRowsTotal"] for p in s.progress("windows") for o in p["stateOperators"] if o["operatorName"].startswith("transformWithState")]
    assert 0 < max(held) <= users


def test_a_topic_is_written_once_with_a_column_a_value(spark, spring):
    """The log of a table is a topic of its own, without maps; no copy of it is staged before, and its slices come in order."""
    s = queries.Stage(Warehouse(spark, spring))
    log, _ = s.log("order_info", "order_refund_info")
    assert set(log) == {"order_info", "order_refund_info"}
    assert not any(f.dataType.typeName() == "map" for rows in log.values() for f in rows.schema.fields)
    system, folder = s.arrivals._where(s.folder)
    assert {f.getPath().getName() for f in system.listStatus(folder)} == {"topics", "empty"}
    for name in log:
        changes = replay.Changes(s.warehouse.tables)[name]
        assert same(spark.read.schema(changes.schema).parquet(f"{s.folder}/topics/{name}/_slice=*"), changes)
    slices = [s.arrivals._files(f"{s.folder}/topics/order_info/_slice={k}") for k in range(s.arrivals.batches)]
    times = [{system.getFileStatus(f).getModificationTime() for f in files} for files in slices]
    assert len({len(files) for files in slices}) == 1
    assert all(max(a) < min(b) for a, b in zip(times, times[1:]))


def test_rows_without_a_slice_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (2, None), (3, 4)], "seq BIGINT, k INT")
    topics = Arrivals(spark, str(tmp_path))
    run(topics.topic("rows", rows, slices=F.col("k")), append_sink(f"{tmp_path}/out"), f"{tmp_path}/cp")
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("seq").collect()) == [1, 2, 3]


def test_a_file_of_long_texts_is_read_in_parts(spark, tmp_path, monkeypatch):
    """A file of a topic has row groups of bounded size, so that no task need read it whole."""
    monkeypatch.setattr(arrivals, "GROUP_BYTES", 1 << 16)
    topics = Arrivals(spark, str(tmp_path))
    rows = spark.range(0, 20_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 512).alias("value"))
    topics.topic("texts", rows, slices=F.lit(0))
    groups = [pq.ParquetFile(f.removeprefix("file:")).num_row_groups for f in map(str, [
        p.toString() for p in topics._files(f"{tmp_path}/topics/texts/_slice=0")])]
    assert max(groups) > 4


def test_folders_that_nobody_reads_again_go(spark, tmp_path):
    """An upsert table keeps the folders of its last batches only, however many it has written."""
    df = lambda k: spark.createDataFrame([(n, k) for n in range(k, k + 20)], "id INT, v INT")
    table = UpsertTable(str(tmp_path), df(0).schema, ("id",), buckets=4, every=2)
    for k in range(7):
        table.write(df(k), k)
        assert {int(f.name.split("=")[1]) for f in tmp_path.glob("batch_id=*")} == set(range(max(0, k - 2), k + 1))
        want = {n: min(n, k) for n in range(k + 20)}
        assert {r.id: r.v for r in table.read(spark, k, "id").collect()} == want


def test_slices_are_bounded(spark, spring, monkeypatch):
    """Larger tables arrive in more slices, and so more batches; where state lives for all days, in as many as ever."""
    monkeypatch.setattr(arrivals, "SLICE_BYTES", 1_500)
    w = Warehouse(spark, spring)
    s = queries.Stage(w)
    rows = s.appended("windows", jobs.sku_amounts(*s.log("order_detail")))()
    assert s.arrivals.batches > arrivals.BATCHES
    assert len([p for p in s.progress("windows") if p["numInputRows"]]) > s.arrivals.batches
    assert same(dws.sku_order_of(rows, w.flat_sku), catalogue()["g9_sku_order"](w))
    s = queries.Stage(w)
    s.log("order_detail", days=queries.WHOLE_DAYS)
    assert s.arrivals.batches == arrivals.BATCHES


def test_topics_are_packed(spark, tmp_path):
    topics = Arrivals(spark, str(tmp_path))
    topics.topic("rows", spark.range(9), slices=F.lit(0))
    files = [f.toString().removeprefix("file:") for f in topics._files(f"{tmp_path}/topics/rows/_slice=0")]
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f).metadata.num_rows} == {"ZSTD"}


def test_users_share_a_value_of_state(spark, spring):
    """Users are dealt into groups, each one row of state, however many users it has; the windows are those of the batch job."""
    w = Warehouse(spark, spring)
    s = queries.Stage(w)
    lines = jobs.placed_lines(*s.log("order_info", "order_detail")).select("user_id", "et", "create_time")
    with s.settings(running.STORE):
        rows = s.appended("windows", running.order_windows(lines, 5))()
    held = [o["numRowsTotal"] for p in s.progress("windows") for o in p["stateOperators"] if o["operatorName"].startswith("transformWithState")]
    assert max(held) == 5 < w.detail_versions.select("user_id").distinct().count()
    assert same(rows, catalogue()["g8_order"](w))


def test_running_minimum_of_groups():
    rng = random.Random(4)
    rows = [(rng.randint(0, 3), rng.randint(0, 9), rng.randint(-5, 5) * 10**12) for _ in range(200)]
    found = running.running_min(*map(np.array, zip(*rows)))
    assert found.tolist() == [min(v for h, n, v in rows if h == g and n <= m) for g, m, _ in rows]
    assert running.least(np.array([1, 0, 1]), np.array([3, 4, 2])).tolist() == [4, 2]


def test_state_of_words_is_on_disk(spark, small, monkeypatch):
    seen = []
    start = queries.start

    def noted(*args):
        seen.append(spark.conf.get("spark.sql.streaming.stateStore.providerClass"))
        return start(*args)

    monkeypatch.setattr(queries, "start", noted)
    w = Warehouse(spark, small)
    assert same(queries.QUERIES["t4_stream_keyword"](w), catalogue()["g1_keyword"](w))
    assert [name.rsplit(".", 1)[1] for name in seen] == ["RocksDBStateStoreProvider"]


def test_a_payment_comes_once(spark, spring):
    """First payments need a payment that has lines once, not once a line."""
    s = queries.Stage(Warehouse(spark, spring))
    seen = []
    appended = s.appended

    def noted(name, stream, *by):
        rows = appended(name, stream, *by)
        seen.append(rows)
        return rows

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(queries, "Stage", lambda w: s)
        patch.setattr(s, "appended", noted)
        found = queries.QUERIES["t9_stream_payment"](s.warehouse)
    assert same(found, catalogue()["g7_payment_suc"](s.warehouse))
    assert seen[0]().count() == seen[0]().distinct().count() > 0
