import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from paperloom.sources import registry_csv
from paperloom.streaming import events, state, tables

ROWS = "key string, ts timestamp, kind string, ok boolean"


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of files that a stream reads one after the other, and what it has written so far."""
    state.use_rocksdb(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    folder = str(tmp_path / "in")
    os.makedirs(folder)

    class Feed:
        path, number = folder, 0

        def add(self, *rows):
            self.number += 1
            frame = spark.createDataFrame([(k, t, kind, ok) for k, t, kind, ok in rows], "key string, ts string, kind string, ok boolean")
            frame.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{folder}")

        def read(self):
            return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)

        def drain(self, rows, out):
            q = rows.writeStream.format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / f"{out}-mark")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
            return spark.read.parquet(str(tmp_path / out)).collect()

    return Feed()


def at(minute, hour=10):
    return f"2024-01-01 {hour:02d}:{minute:02d}:00"


def test_sessions_end_by_event_and_by_timer_over_restarts(feed):
    run = lambda: feed.drain(state.ended_sessions(feed.read(), F.col("key"), F.col("ts"), idle_s=600, late="0 seconds"), "sessions")
    feed.add(("a", at(0), "x", True), ("a", at(5), "x", True), ("b", at(1), "x", True), (None, at(1), "x", True))
    assert run() == []
    feed.add(("a", at(30), "x", True))  # ends a's first session; the watermark ends b's
    feed.add(("c", at(50), "x", True))
    got = {(r.key, r.start.minute, r.end.minute, r.n) for r in run()}
    assert {("a", 0, 5, 2), ("b", 1, 1, 1), ("a", 30, 30, 1)} >= got >= {("a", 0, 5, 2), ("b", 1, 1, 1)}
    feed.add(("c", at(59, 11), "x", True))
    feed.add(("d", at(59, 12), "x", True))
    rows = [(r.key, r.start.minute, r.end.minute, r.n) for r in run()]
    assert sorted(rows)[:4] == [("a", 0, 5, 2), ("a", 30, 30, 1), ("b", 1, 1, 1), ("c", 50, 50, 1)] and len(rows) == len(set(rows))


def test_lockouts_lock_and_release(feed):
    run = lambda: feed.drain(state.lockouts(feed.read(), F.col("key"), F.col("ts"), F.col("kind"), F.col("ok"), threshold=3, window_s=600, lock_s=900, late="0 seconds"), "locks")
    feed.add(("a", at(0), "pw", False), ("a", at(1), "pw", False), ("a", at(1), "otp", False), ("b", at(0), "pw", False), ("b", at(1), "pw", True), ("b", at(2), "pw", False))
    assert run() == []
    feed.add(("a", at(3), "pw", False), ("a", at(4), "pw", False), ("b", at(5), "pw", False))  # the state goes on; locked rows don't count
    assert [(r.key, r.kind, r.ts.minute, r.what) for r in run()] == [("a", "pw", 3, "locked")]
    feed.add(("z", at(40), "pw", True))
    feed.add(("z", at(41), "pw", True))
    got = sorted((r.key, r.what, r.locked_until.minute) for r in run())
    assert got == [("a", "locked", 18), ("a", "released", 18)]


def test_finished_jobs_leave_the_state(feed):
    run = lambda: feed.drain(state.kept_jobs(feed.read(), F.col("key"), F.col("ts"), F.col("kind"), keep_s=600, late="0 seconds"), "jobs")
    feed.add(("j1", at(0), "queued", True), ("j1", at(1), "running", True), ("j2", at(0), "queued", True))
    feed.add(("j1", at(2), "done", True), ("j1", at(3), "done", True))
    assert sorted((r.key, r.status, r.what) for r in run()) == [("j1", "done", "changed"), ("j1", "queued", "changed"), ("j1", "running", "changed"), ("j2", "queued", "changed")]
    feed.add(("j3", at(30), "queued", True))
    feed.add(("j3", at(31), "running", True))
    got = [(r.key, r.status, r.ts.minute) for r in run() if r.what == "expired"]
    assert got == [("j1", "done", 13)]  # j2 isn't finished and stays


# ---- batches that are run again


def test_an_upsert_that_runs_again_counts_once(spark, tmp_path):
    root, schema = str(tmp_path / "jobs"), "id long, status string, at long"
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    read = lambda: sorted(tuple(r) for r in tables.upserted(spark, root, schema).collect())
    assert read() == []
    tables.upsert_batch(frame((1, "queued", 1), (2, "queued", 1), (None, "x", 1)), 0, root, "id", "at", buckets=3)
    tables.upsert_batch(frame((1, "running", 2), (1, "done", 3), (3, "queued", 2)), 1, root, "id", "at", buckets=3)
    want = [(1, "done", 3), (2, "queued", 1), (3, "queued", 2)]
    assert read() == want
    tables.upsert_batch(frame((1, "other", 9)), 1, root, "id", "at", buckets=3)  # published: skipped
    tables.upsert_batch(frame((2, "late", 0)), 2, root, "id", "at", buckets=3)  # older than what is known
    assert read() == want and tables.manifests(spark, root) == [0, 1, 2]


def test_a_batch_that_broke_off_is_written_anew(spark, tmp_path):
    root = str(tmp_path / "results")
    spark.range(5).write.parquet(f"{root}/data/{0:020d}")  # written, never published
    assert tables.appended(spark, root, "id long").count() == 0
    tables.append_batch(spark.range(3).toDF("id"), 0, root)
    tables.append_batch(spark.range(3).toDF("id"), 0, root)
    tables.append_batch(spark.range(10, 12).toDF("id"), 4, root)
    assert sorted((r.id, r.batch) for r in tables.appended(spark, root, "id long").collect()) == [(0, 0), (1, 0), (2, 0), (10, 4), (11, 4)]
    assert sorted(r.id for r in tables.appended(spark, root, "id long", since=0).collect()) == [10, 11]


def test_streams_write_tables(feed, spark, tmp_path):
    feed.add(("a", at(0), "queued", True), ("b", at(0), "queued", True))
    feed.add(("a", at(1), "done", True))
    rows = feed.read()
    for _ in range(2):  # a second run finds nothing new
        tables.append_stream(rows, str(tmp_path / "log"), str(tmp_path / "log-mark")).awaitTermination()
        tables.upsert_stream(rows, str(tmp_path / "latest"), str(tmp_path / "latest-mark"), "key", "ts").awaitTermination()
    assert tables.appended(spark, str(tmp_path / "log"), ROWS).count() == 3
    assert sorted((r.key, r.kind) for r in tables.upserted(spark, str(tmp_path / "latest"), ROWS).collect()) == [("a", "done"), ("b", "queued")]


def test_a_batch_sent_whole_is_not_sent_again(feed, spark, tmp_path):
    feed.add(("a", at(0), "x", True))
    out = str(tmp_path / "sent")

    def sink(lines):
        with open(out, "a") as f:
            f.writelines(f"{x}\n" for x in lines)

    def broken(lines):
        raise OSError("down")

    mark = str(tmp_path / "mark")
    events.forward(feed.read(), mark, {"a": sink, "b": broken}, {"a": F.col("key"), "b": F.col("kind")}, pause_s=0.01).awaitTermination()
    os.remove(f"{mark}/commits/0")  # as if the stream had died behind its work
    if os.path.exists(f"{mark}/commits/.0.crc"):
        os.remove(f"{mark}/commits/.0.crc")
    events.forward(feed.read(), mark, {"a": sink, "b": broken}, {"a": F.col("key"), "b": F.col("kind")}, pause_s=0.01).awaitTermination()
    assert open(out).read() == "a\n"
    assert [(r.line, r.destination) for r in spark.read.parquet(f"{mark}-dead-letters").collect()] == [("x", "b")]


# ---- quoted CSV in ranges


@pytest.mark.parametrize("encoding, size", [("utf-8-sig", 300), ("utf-8", 97), ("big5", 211), ("utf-8", 1 << 20)])
def test_ranges_of_a_file_give_the_rows_of_the_whole(spark, tmp_path, encoding, size):
    rng = random.Random(size)
    cells = ["功許蓋", 'a "b" c', "x,y", "line\nnext", "\n\n", "", "plain", "三\r\n四", '"', "許\n功,蓋"]
    book = io.StringIO()
    writer = csv.writer(book, lineterminator=rng.choice(["\n", "\r\n"]))
    writer.writerow(["統一編號", "營業人名稱", "地址"])
    for k in range(200):
        writer.writerow([f"{k:08d}", rng.choice(cells), rng.choice(cells)])
        if k % 50 == 7:
            book.write("\n")
    for name in ("one.csv", "two.csv"):
        (tmp_path / name).write_bytes(book.getvalue().encode(encoding))
    (tmp_path / "empty.csv").write_bytes(b"")
    want = [r for r in csv.reader(io.StringIO(book.getvalue(), newline="")) if r][1:]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = registry_csv.read_csv(spark, str(tmp_path))
        if size < 1000:
            assert registry_csv.ranges(registry_csv.lines(spark, str(tmp_path))).count() > 20
        got = registry_csv.named(rows, {"vat": "統一編號", "name": "營業人名稱", "address": "地址", "none": "電話"}).orderBy("path", "pos").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [[r.vat, r.name, r.address] for r in got] == want + want and all(r.none is None for r in got)
