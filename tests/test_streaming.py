"""Streams against their batch twins."""

import time

import pytest
from pyspark.sql import functions as F

from tidelog.client import Broker
from tidelog.operators.fold import membership
from tidelog.streaming import sinks
from tidelog.streaming.coordinator import membership_stream
from tidelog.streaming.source import TideLog, _Stream

CONTROL = "grp string, seq bigint, ts timestamp_ntz, conn_id bigint, op string, generation bigint"


@pytest.fixture(scope="module", autouse=True)
def setup(spark):
    spark.dataSource.register(TideLog)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@pytest.fixture
def wait_for(spark):
    def wait(table, condition, n):
        end = time.time() + 60
        while time.time() < end and spark.table(table).where(condition).count() < n:
            time.sleep(0.5)

    return wait


def feed(b, spark, items):
    b.store.append("t", spark.createDataFrame([(p, bytearray(x.encode()), i) for i, (p, x) in enumerate(items)], "partition int, payload binary, n int"), ["n"])


def test_source_resumes_and_sink_commits_with_a_fence(spark, tmp_path):
    b = Broker(spark, str(tmp_path / "log"), clock=lambda: 0)
    b.store.create_topic("t", 2)
    feed(b, spark, [(0, "h0"), (1, "h1"), (0, "h2")])
    load = lambda r: r.format("tidelog").option("root", str(tmp_path / "log")).option("topic", "t").load()
    assert load(spark.read).count() == 3
    member, generation, _ = b.groups.join(1, "g", "t", 2, 0)
    seen = []

    def go():
        sink = sinks.consume_stream(load(spark.readStream), b.groups, "g", member, generation, lambda: 0, lambda f: seen.extend(sorted((r.partition, r.offset) for r in f.collect())))
        q = sink.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    go()
    assert sorted(seen) == [(0, 0), (0, 1), (1, 0)] and b.groups.groups["g"].committed == {0: 2, 1: 1}
    feed(b, spark, [(1, "h3")])
    go()
    assert seen[-1] == (1, 1) and len(seen) == 4 and b.store.load_positions("g") == ("t", {0: 2, 1: 2})
    feed(b, spark, [(1, "h4")])
    b.groups.join(2, "g", "t", 2, 0)
    with pytest.raises(Exception, match="STALE_GENERATION"):
        go()
    assert b.groups.groups["g"].committed == {0: 2, 1: 2}


def test_append_stream_equals_a_batch_append(spark, tmp_path):
    b = Broker(spark, str(tmp_path / "log"))
    b.store.create_topic("t", 4)
    spark.range(40).select((F.col("id") % 4).cast("int").alias("partition"), F.concat(F.lit("msg-"), "id").alias("payload"), F.col("id").alias("n")).repartition(3).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("partition int, payload string, n bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sinks.append_stream(rows, b.store, "t", ["n"], "q").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert b.store.frontier("t") == [10] * 4
    assert sorted(bytes(r.payload).decode() for r in b.store.log("t").collect()) == sorted(f"msg-{i}" for i in range(40))


def test_streaming_coordinator_equals_the_fold(spark, tmp_path, wait_for):
    events = [("a", 1, None, 1, "join", None), ("a", 2, None, 2, "join", None), ("a", 3, None, 1, "heartbeat", None), ("b", 4, None, 9, "join", None), ("a", 5, None, 2, "leave", None), ("a", 6, None, 1, "commit", 1), ("b", 7, None, 8, "heartbeat", None)]
    batch = spark.createDataFrame([(*e[:2], None, *e[3:]) for e in events], CONTROL).withColumn("ts", F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in membership(batch, 4, 10_000).collect()}
    stream = membership_stream(spark.readStream.schema(CONTROL).parquet(str(tmp_path / "in")), 4, 60_000)
    q = stream.writeStream.format("memory").queryName("members").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        wait_for("members", "op <> 'sweep'", len(events))  # timers keep such a query busy, so it is never at rest
        assert {tuple(r) for r in spark.table("members").where("op <> 'sweep'").collect()} == want
    finally:
        q.stop()


def test_streaming_coordinator_sweeps(spark, tmp_path, wait_for):
    spark.createDataFrame([("a", 1, None, 1, "join", None), ("a", 2, None, 2, "join", None)], CONTROL).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = membership_stream(spark.readStream.schema(CONTROL).parquet(str(tmp_path / "in")), 4, 300)
    q = stream.writeStream.format("memory").queryName("swept").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        wait_for("swept", "op = 'sweep'", 2)
        assert sorted(r.generation for r in spark.table("swept").where("op = 'sweep'").collect()) == [3, 4]
    finally:
        q.stop()


def test_windows_and_dedupe(spark, tmp_path):
    spark.range(100).select(F.col("id"), (F.col("id") % 50).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id bigint, k bigint, ts timestamp").parquet(str(tmp_path / "in"))
    for name, frame, n in (("ticks", sinks.tick_counts(rows, "ts"), 1), ("firsts", sinks.dedupe_stream(rows, ["k"]), 50)):
        q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() >= n


def test_a_limited_stream_goes_on_where_it_stood(spark, tmp_path):
    b = Broker(spark, str(tmp_path / "log"), clock=lambda: 0)
    b.store.create_topic("t", 2)
    feed(b, spark, [(i % 2, f"r{i}") for i in range(14)])
    with pytest.raises(ValueError, match="needs a name"):
        _Stream({"root": str(tmp_path / "log"), "topic": "t", "maxRecordsPerPartition": "2"}).latestOffset()
    batches = []

    def go(wanted):
        rows = spark.readStream.format("tidelog").option("root", str(tmp_path / "log")).option("topic", "t").option("name", "s").option("maxRecordsPerPartition", 2).load()
        q = rows.writeStream.foreachBatch(lambda f, i: batches.append(sorted((r.partition, r.offset) for r in f.collect()))).option("checkpointLocation", str(tmp_path / "c")).start()
        end = time.time() + 60
        while time.time() < end and sum(map(len, batches)) < wanted:
            time.sleep(0.2)
        q.stop()

    go(6)
    go(14)
    feed(b, spark, [(0, "r14")])
    go(15)
    assert sorted(x for b in batches for x in b) == sorted([(p, o) for p in (0, 1) for o in range(7)] + [(0, 7)])
    assert max(sum(p == 0 for p, _ in b) for b in batches) <= 2
