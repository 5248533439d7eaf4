"""Streams end as the batch operators do; readers of raw captures."""

import datetime as dt
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tessera.sources import readers
from tessera.streaming import streams


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, tmp_path, parts=3):
    e = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"{tmp_path}/in"
    e.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(path)
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_day_counts_equal_batch(spark, tmp_path):
    e, s = source(spark, tmp_path)
    got = drain(streams.day_counts(s, late="40 days"), "day_counts", "complete")
    want = e.groupBy(F.window("ts", "1 day").start.alias("window_start"), "event_type").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in got.select("window_start", "event_type", "n").collect()} == {tuple(r) for r in want.collect()}


def test_first_rows_and_once_sink(spark, tmp_path):
    _, s = source(spark, tmp_path)
    got = drain(streams.first_within(s, ["user_id"], late="40 days"), "firsts")
    assert got.count() == got.select("user_id").distinct().count()
    root = f"file://{tmp_path}/runs"
    sink = streams.once_sink(root, ["event_id"])
    batch = spark.range(4).withColumnRenamed("id", "event_id")
    sink(batch, 0)
    sink(batch, 1)
    assert spark.read.parquet(root).count() == 4


LEASE_LOG = "item long, at timestamp, seq long, event string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_leases_replay_and_stream(spark, tmp_path, rocks):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(1, t(0), 0, "claim"), (1, t(1), 1, "done"), (2, t(0), 0, "claim"), (2, t(5), 1, "claim"), (2, t(11), 2, "claim"), (2, t(12), 3, "fail"), (2, t(13), 4, "claim"), (2, t(14), 5, "fail"), (2, t(15), 6, "claim"), (3, t(0), 0, "done"), (4, t(0), 0, "claim"), (4, t(1), 1, "reject"), (4, t(2), 2, "claim"), (5, t(0), 0, "claim"), (5, t(10), 1, "claim")]
    log = spark.createDataFrame(rows, LEASE_LOG)
    want = {(1, "success", 1, ""), (2, "failed_retryable", 3, ""), (3, "pending", 0, ""), (4, "failed_terminal", 1, ""), (5, "in_progress", 1, "")}
    assert {tuple(r) for r in streams.leases(log).collect()} == want
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = streams.lease_stream(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log"))
    query = stream.writeStream.format("memory").queryName("leases").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").start()
    try:  # batches go on without data, since a timer may be due in each
        deadline = time.time() + 90
        while spark.table("leases").count() < len(want) and time.time() < deadline:
            time.sleep(0.5)
    finally:
        query.stop()
    assert {tuple(r) for r in spark.table("leases").collect()} == want


def test_silence_alone_ends_a_lease(spark, tmp_path, rocks):
    now = dt.datetime(2024, 1, 1)
    folder = f"{tmp_path}/log"
    add = lambda *rows: spark.createDataFrame(rows, LEASE_LOG).coalesce(1).write.mode("append").parquet(folder)
    add((1, now, 0, "claim"), (2, now, 0, "claim"), (2, now, 1, "done"))
    stream = streams.lease_stream(spark.readStream.schema(LEASE_LOG).parquet(folder), lease=0.05)
    query = stream.writeStream.format("memory").queryName("silent").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    seen = lambda: [tuple(r)[1:] for r in spark.table("silent").where("item = 1").collect()]
    try:
        deadline = time.time() + 90
        while len(seen()) < 2 and time.time() < deadline:
            time.sleep(0.5)
        assert seen() == [("in_progress", 1, ""), ("failed_retryable", 1, "lease_expired")]
        assert [tuple(r)[1:] for r in spark.table("silent").where("item = 2").collect()] == [("success", 1, "")]
        add((1, now, 1, "claim"), (1, now, 2, "done"))
        while len(seen()) < 3 and time.time() < deadline:
            time.sleep(0.5)
        assert seen()[2] == ("success", 2, "")
    finally:
        query.stop()


def test_replay_takes_state_up_again_and_late_reports_count():
    events = lambda *rows: pd.DataFrame(rows, columns=["at", "event"])
    t = pd.Timestamp("2024-01-01")
    claimed = streams.replay(events((t, "claim")))
    assert streams.replay(events((t, "fail")), claimed) == ("failed_retryable", 1, None, "")
    expired = ("failed_retryable", 1, None, "lease_expired")
    assert streams.replay(events((t, "done")), expired)[0] == "success"
    assert streams.replay(events((t, "claim")), expired)[:2] == ("in_progress", 2)
    assert streams.replay(events((t + pd.Timedelta(minutes=11), "claim")), ("in_progress", 3, t, "")) == ("failed_retryable", 3, None, "lease_expired")


def test_runs_are_completed_from_their_items(spark):
    items = spark.createDataFrame([("r", k) for k in range(5)] + [("r", 0), ("s", 1)], "run_id string, item long")
    states = spark.createDataFrame([(0, "success", 1), (0, "failed_terminal", 2), (1, "failed_terminal", 1), (1, "failed_retryable", 2), (2, "failed_retryable", 1), (3, "in_progress", 1), (9, "success", 1)], "item long, status string, attempts long")
    got = {r.run_id: tuple(r)[1:] for r in streams.completed_runs(items, states).collect()}
    assert got == {"r": (5, 1, 3, 1), "s": (1, 0, 0, 1)}


def test_feeds(spark):
    rss = "<rss><channel><item><title> A </title><link>l</link><pubDate>p</pubDate></item><item><title>B</title></item></channel></rss>"
    df = spark.createDataFrame([(1, rss), (2, "<broken")], "k long, body string")
    assert [r.title for r in readers.rss(df).orderBy("title").collect()] == ["A", "B"]
    atom = '<feed><entry><id>1</id><title>T  x</title><published>p</published><author><name>N</name></author><author><name>M</name></author><link href="h" rel="alternate"/><link href="g" rel="related"/></entry></feed>'
    r = readers.atom(spark.createDataFrame([(atom,)], "body string")).first()
    assert (r.id, r.title, r.link, r.authors) == ("1", "T x", "h", ["N", "M"])
    m = "<urlset><url><loc>https://e.com/news/a</loc></url><url><loc>https://e.com/b</loc></url></urlset>"
    assert [x["loc"] for x in readers.sitemap(spark.createDataFrame([(m,)], "body string")).collect()] == ["https://e.com/news/a"]


def test_checkpoint_fold_cache_and_blobs(spark, tmp_path):
    lines = spark.createDataFrame([(1, "a", "v", None, "e1"), (2, "a", "v", "r1", None), (3, "b", "v", None, "e2"), (4, "a", "w", "r9", None), (5, "a", "v", "r2", None)], "pos long, entity string, contract string, result string, error string")
    assert {tuple(r) for r in readers.checkpoint_fold(lines, "v").collect()} == {("a", "r2", None), ("b", None, "e2")}
    resp = spark.createDataFrame([("q", dt.datetime(2024, 1, 1), 1, "old"), ("q", dt.datetime(2024, 1, 2), 2, "new")], "request string, fetched_at timestamp, response_id long, body string")
    assert [r.body for r in readers.cached(resp, "2024-01-02 00:01:00", 120).collect()] == ["new"]
    assert readers.cached(resp, "2024-01-03 00:00:00", 120).count() == 0
    readers.blobs(resp.union(resp), "body", f"file://{tmp_path}/blobs")
    assert spark.read.parquet(f"file://{tmp_path}/blobs").count() == 2
