"""Streams give what the batch operators give."""

import random
import time

import pytest
from pyspark.sql import functions as F

from vigil.operators import folds, ledger, perimeter
from vigil.sources import telemetry
from vigil.streaming import processors, sinks, stateful

S = 1_000_000


def drained(q):
    q.processAllAvailable()
    q.stop()


def replayed(spark, df, tmp_path, make, name, files=3):
    """The rows of a stream that gets df in a few files by time, each its own micro-batch."""
    rows = sorted(df.collect(), key=lambda r: (r.ts_us, r.seq))
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.table(name)


def test_perimeter_stream_equals_batch(spark, tmp_path):
    """On the catalog's requests: every decision, and every block's end at its own time."""
    from vigil.plans.catalog import requests_of
    from vigil.sources.telemetry import telemetry_of

    df = requests_of(telemetry_of(spark, "/root/testdata/sf0.001")).withColumn("ts_us", (F.col("ts_us") / 50).cast("bigint")).cache()
    last = max(r.ts_us for r in df.collect())
    got = replayed(spark, df, tmp_path, lambda s: stateful.perimeter(s, "0 seconds"), "decisions")
    want = {tuple(r) for r in perimeter.timeline(df, last).collect()}
    assert {tuple(r) for r in got.collect()} == want and {"expired", "blocked"} <= {r[3] for r in want}
    plain = {tuple(r) for r in perimeter.pipeline(df).collect()}
    assert {r[:5] for r in plain} == {r[:5] for r in want if r[3] != "expired"}


def test_ledger_stream_equals_batch(spark, tmp_path):
    """Commands with clears, ends and throttles over several shards."""
    random.seed(3)
    rows = []
    for i in range(300):
        op = "clear" if i % 70 == 69 else random.choice(["block", "block", "unblock", "throttle"])
        rows.append((None if op == "clear" else f"1.1.1.{random.randrange(12)}", (i + 1) * 5 * S, i, op, random.choice([None, "abuse"]), random.choice(["low", "high", "odd"]), random.choice([None, 0, 7, 40]), random.choice([None, 5]), random.choice([None, "rule"])))
    rows += [("127.0.0.1", 7, 1000, "block", None, "low", 5, None, None)]
    df = spark.createDataFrame(rows, ledger.COMMAND)
    got = stateful.cleared(replayed(spark, df, tmp_path, lambda s: stateful.ledger(s, 4, "0 seconds"), "entries"))
    want = {tuple(r) for r in ledger.ledger(df).collect()}
    assert {tuple(r) for r in got.collect()} == want
    assert {r[0] for r in want} == {"block", "extend_block", "unblock", "auto_unblock", "throttle", "clear_all"} and not any(r[1] == "127.0.0.1" for r in want)
    assert {r.topic for r in ledger.heard(got).collect()} == {"ip:blocked", "ip:unblocked", "ip:rate_limited", "ip:cleared"}


def test_cooldown_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("a", i * 7 * S, i) for i in range(20)] + [("b", i * 31 * S, 100 + i) for i in range(5)], "k string, t bigint, seq bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = processors.cooldown(stream, "k", "t", 30 * S).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "ck")).start()
    want, end = {tuple(r) for r in folds.cooldown(df, ["k"], "t", 30 * S).collect()}, time.time() + 60
    while time.time() < end and spark.table("kept").count() < len(want):
        time.sleep(0.5)
    q.stop()
    assert {tuple(r) for r in spark.table("kept").collect()} == want


def test_topics_and_store(spark, tmp_path):
    df = spark.createDataFrame([("alert", "x"), ("ip:blocked", "y"), ("alert", "z")], "topic string, body string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {}
    drained(processors.broadcast_topics(stream, str(tmp_path / "c1"), lambda t, d: got.setdefault(t, []).extend(r.body for r in d.collect()), ("alert", "ip:blocked")))
    assert sorted(got["alert"]) == ["x", "z"] and got["ip:blocked"] == ["y"]
    drained(processors.append_store(stream, str(tmp_path / "store"), str(tmp_path / "c2")))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3
    processors.clear_store(df, str(tmp_path / "store2"))
    assert spark.read.parquet(str(tmp_path / "store2")).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"event_id": "1", "payload": {"cpu": 92.5, "s": "92"}, "timestamp": 5}]')
    row = telemetry.json_array(spark, str(tmp_path / "a.json"))
    got = row.select(telemetry.typed_metric("payload", "cpu").alias("a"), telemetry.typed_metric("payload", "s").alias("b")).first()
    assert (got.a, got.b) == (92.5, None)
    (tmp_path / "b.json").write_text('{"event_id": "1"}\nnot json\n')
    lines = telemetry.json_lines(spark, str(tmp_path / "b.json")).cache()
    assert lines.where("_corrupt_record is not null").count() == 1
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    from pyspark.sql import types as T

    assert telemetry.csv_table(spark, str(tmp_path / "c.csv"), T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])).first().a == 1
    assert telemetry.synthetic(spark, 20).count() == 20


def test_blocks_end_without_another_request(spark, tmp_path):
    """A blocked address that stays silent gets its auto_unblock when others carry time past the block's end, and is forgotten then."""
    rows = [("9.9.9.9", S * i, i, "/", "1=1", "GET", 200, None) for i in (1, 2)] + [("1.1.1.1", 4000 * S * i, 10 + i, "/", "", "GET", 200, None) for i in range(1, 4)]
    df = spark.createDataFrame(rows, perimeter.REQUEST)
    got = sorted((r for r in replayed(spark, df, tmp_path, lambda s: stateful.perimeter(s, "0 seconds", idle_s=100), "swept", 5).collect() if r.source_ip == "9.9.9.9"), key=lambda r: r.ts_us)
    assert [r.decision for r in got] == ["allowed", "sql_injection", "expired"] and got[2].audit == "auto_unblock" and got[2].ts_us == 902 * S


def test_topics_of_decisions(spark):
    df = spark.createDataFrame([("a", 1, 1, "flooding", "flooding", "block", 100), ("a", 2, 2, "rate_limited", "rate_limit", "throttle", 0), ("a", 3, None, "expired", "", "auto_unblock", 0)], perimeter.DECISION)
    got = sorted((r.topic, r.ts_us) for r in processors.published(df).collect())
    assert got == [("attack_blocked", 1), ("ip:blocked", 1), ("ip:dropped", 1), ("ip:dropped", 2), ("ip:rate_limited", 2), ("ip:unblocked", 3)]
    assert processors.subscribed(processors.published(df), "ip:blocked").count() == 1


def test_block_list_is_read_anew_after_a_while(spark):
    lists, calls = [["a"], ["b"], None], []

    def read():
        calls.append(1)
        if lists[min(len(calls) - 1, 2)] is None:
            raise OSError("away")
        return spark.createDataFrame([(x,) for x in lists[len(calls) - 1]], "ip string")

    add = processors.with_block_list(read, 5)
    batch = spark.createDataFrame([("a",), ("b",)], "source_ip string")
    marked = lambda now: {r.source_ip for r in add(batch, now).where("is_blocked").collect()}
    assert [marked(0), marked(4), marked(5), marked(20)] == [{"a"}, {"a"}, {"b"}, {"b"}] and len(calls) == 3


def test_a_block_list_outlives_its_source(spark, tmp_path):
    """The folder of the list goes: its last version holds, within the time and after it."""
    import shutil

    path = str(tmp_path / "list")
    spark.createDataFrame([("a",), (None,)], "ip string").write.parquet(path)
    add = processors.with_block_list(lambda: spark.read.parquet(path), 5)
    batch = spark.createDataFrame([("a",), ("b",), (None,)], "source_ip string")
    marked = lambda now: {r.source_ip for r in add(batch, now).where("is_blocked").collect()}
    assert marked(0) == {"a"} and add.version() == (1, 0)
    shutil.rmtree(path)
    assert marked(3) == {"a"} and marked(60) == {"a"} and add.version() == (1, 0)
    spark.createDataFrame([("b",)], "ip string").write.parquet(path)
    assert marked(70) == {"b"} and add.version() == (2, 70)


def test_bodies_that_do_not_parse(spark):
    event = '{"event_id": "1", "source_ip": "a", "event_type": "x"}'
    bodies = [(1, f"[{event}, {{}}, null, 5]"), (2, "not json"), (3, None), (4, event), (5, "[]"), (6, f"[{event}")]
    got = [(r.batch_id, r["index"], r.ok, r.error) for r in telemetry.batch(spark.createDataFrame(bodies, "batch_id bigint, body string")).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 0, True, None), (1, 1, False, "not an event: {}"), (1, 2, False, "not an event: null"), (1, 3, False, "not an event: 5"),
        (2, None, False, "not json: not json"), (3, None, False, "no body"), (4, None, False, f"not a batch: {event}"), (5, None, False, "no events: []"), (6, None, False, f"not json: [{event}"),
    ], key=str)


def streamed(spark, parts, schema, folder, make, name, mode="append"):
    """Rows of a query over a stream whose micro-batches are the parts."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.table(name).collect()


def test_windows_with_late_rows(spark, tmp_path):
    """A row behind the watermark is left out, one within it counts; sessions end by their gap."""
    schema = "source_ip string, event_type string, t bigint"
    parts = [[("a", "auth_failure", 10 * S), ("a", "x", 14 * S)], [("a", "x", 100 * S), ("b", "x", 101 * S)], [("a", "x", 95 * S)], [("a", "x", 11 * S), ("b", "x", 500 * S)], [("b", "x", 900 * S)]]
    (tmp_path / "s").mkdir()
    got = streamed(spark, parts, schema, tmp_path / "s", lambda s: processors.sessions(s, "t", "10 seconds", "20 seconds", "source_ip"), "sessions")
    assert {(r.source_ip, r.session.start.timestamp(), r.n, r.failures) for r in got} == {("a", 10, 2, 1), ("a", 95, 2, 0), ("b", 101, 1, 0), ("b", 500, 1, 0)}
    (tmp_path / "w").mkdir()
    got = streamed(spark, parts, schema, tmp_path / "w", lambda s: processors.sliding(s, "t", "20 seconds", "10 seconds", "20 seconds", "source_ip"), "sliding")
    assert {(r.source_ip, r.window.start.timestamp(), r.n) for r in got if r.source_ip == "a"} == {("a", 0, 2), ("a", 10, 2), ("a", 80, 1), ("a", 90, 2), ("a", 100, 1)}


def test_interval_join_of_two_streams(spark, tmp_path):
    """Requests of one stream that blocks of another cover equal the batch semi-join on a replay."""
    from vigil.operators import joins

    random.seed(6)
    asked = [(str(i), random.choice("abc"), i * S) for i in range(1, 200)]
    spans = [("a", 5 * S, 40 * S), ("a", 90 * S, 91 * S), ("b", 60 * S, 150 * S), ("c", 190 * S, 250 * S)]
    r, b = spark.createDataFrame(asked, "event_id string, source_ip string, ts_us bigint"), spark.createDataFrame(spans, "ip string, start_us bigint, end_us bigint")
    r.repartitionByRange(3, "ts_us").write.parquet(str(tmp_path / "r"))
    b.coalesce(1).write.parquet(str(tmp_path / "b"))
    made = processors.blocked_requests(spark.readStream.schema(r.schema).parquet(str(tmp_path / "r")), spark.readStream.schema(b.schema).parquet(str(tmp_path / "b")), 100)
    q = made.writeStream.format("memory").queryName("covered").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert {tuple(x) for x in spark.table("covered").collect()} == {tuple(x) for x in joins.blocked(r, b).collect()} and spark.table("covered").count() > 20


def test_a_repeated_batch_counts_once(spark, tmp_path):
    """What a crashed batch wrote is replaced when it runs again, in the store and in the counts."""
    rows = spark.createDataFrame([("a", i * 40_000 * S, i) for i in range(10)] + [("b", None, 10)], "service string, ts_us bigint, seq bigint")
    store, counts = str(tmp_path / "store"), str(tmp_path / "counts")
    for number, part in ((0, "seq < 6"), (1, "seq >= 3 and seq < 5"), (1, "seq >= 6"), (1, "seq >= 6")):
        sinks.stored(rows.where(part), number, store)
        sinks.counted(rows.where(part), number, counts, "service")
    got = spark.read.parquet(store)
    assert {r.seq for r in got.where("day is null").collect()} == {10} and got.where("day = '1970-01-05'").count() == 1
    assert {r.service: r.n for r in sinks.totals(spark, counts, "service").collect()} == {"a": 10, "b": 1}
    sinks.settled(spark, counts, str(tmp_path / "settled"), 0, "service")
    assert {r.service: r.n for r in sinks.totals(spark, str(tmp_path / "settled"), "service").collect()} == {"a": 6}


def test_store_goes_on_after_a_crash(spark, tmp_path):
    """A query that dies after its batch was written, and before that was noted, writes the batch again and not twice."""
    schema = "service string, ts_us bigint, seq bigint"
    rows = spark.createDataFrame([("a", i * S, i) for i in range(8)], schema)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    path, tries = str(tmp_path / "store"), []

    def write(batch, number):
        sinks.stored(batch, number, path)
        tries.append(number)
        if len(tries) == 1:
            raise RuntimeError("crash")

    start = lambda: stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(write).start()
    with pytest.raises(Exception):  # noqa: B017, PT011
        start().awaitTermination(60)
    assert start().awaitTermination(60) and tries == [0, 0]
    assert sorted(r.seq for r in spark.read.parquet(path).collect()) == list(range(8))


def test_node_status_stream_equals_batch(spark, tmp_path):
    from vigil.operators import joins

    random.seed(12)
    at, rows = S, []
    for i in range(120):
        at += random.choice([1, 2, 50]) * S
        rows.append((f"n{random.randrange(3)}", "urban", at, i))
    df = spark.createDataFrame(rows, "service string, domain string, ts_us bigint, seq bigint")
    got = replayed(spark, df, tmp_path, lambda s: stateful.node_status(s, 30, "0 seconds"), "status")
    want = {tuple(r) for r in joins.status_changes(df, at, 30).collect()}
    assert {tuple(r) for r in got.collect()} == want and {r[2] for r in want} == {"online", "offline"}


def test_every_topic_has_a_stream(spark, tmp_path):
    """All topics that a subscriber may name come out of one run of the streams."""
    from vigil.plans.catalog import nodes, requests_of
    from vigil.plans.response import ledger_commands
    from vigil.sources.telemetry import telemetry_of

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    tel = telemetry_of(spark, "/root/testdata/sf0.001").drop("payload")
    parts = {"events": tel, "requests": requests_of(tel).withColumn("ts_us", (F.col("ts_us") / 50).cast("bigint")), "commands": ledger_commands(telemetry_of(spark, "/root/testdata/sf0.01"))}
    streams = {}
    for name, rows in parts.items():
        rows.coalesce(1).write.parquet(str(tmp_path / name))
        streams[name] = spark.readStream.schema(rows.schema).parquet(str(tmp_path / name))
    table = nodes(tel).withColumn("status", F.lit("online"))
    out = sinks.topics(streams["events"], stateful.perimeter(streams["requests"]), stateful.ledger(streams["commands"], 2), stateful.node_status(streams["events"]), table)
    heard = {}
    q = out.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda b, n: sinks.publish(b, n, lambda t, k, rows: heard.setdefault(t, []).append((k, rows.count())), processors.TOPICS)).start()
    assert q.awaitTermination(240)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert set(heard) == set(processors.TOPICS) and all(n > 0 for told in heard.values() for _, n in told)


def test_ingest_pause_and_counts(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "1.json").write_text('{"event_id": "1", "source_ip": "a", "event_type": "x"}\nnot json\n')
    rows = processors.ingested(spark, str(folder))
    seen = []
    start = lambda: rows.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda d, _: seen.extend((r.event_id, r._corrupt_record is not None) for r in d.collect())).start()
    feed = processors.Feed(start)
    assert feed.query.awaitTermination(60)
    feed.pause()
    (folder / "2.json").write_text('{"event_id": "2"}\n')
    feed.resume()
    assert feed.query.awaitTermination(60) and sorted(map(str, seen)) == sorted(map(str, [("1", False), (None, True), ("2", False)]))
    q = processors.counters(rows, "event_type").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    assert q.awaitTermination(60) and {(r.event_type, r.n) for r in spark.table("counted").collect()} == {("x", 1), (None, 2)}
    assert processors.sampled(spark).isStreaming
