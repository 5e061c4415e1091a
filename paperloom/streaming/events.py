"""Event streams: windows, sessions, dedup within a watermark, lock-outs with state, and a forwarding drain."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.streaming import tables

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Parquet files of events, so many a batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def buckets(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value_sum) of tumbling windows."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value_sum")).select(F.col("window.start").alias("start"), "event_type", "n", "value_sum")


def sessions(events: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): activity with pauses of less than the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def samples(metrics: DataFrame, every: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """The last row of each interval of a stream, under the interval's start, once the watermark has passed it."""
    columns = [c for c in metrics.columns if c != "ts"]
    slots = metrics.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w")).agg(F.max(F.struct("ts", *columns)).alias("r"))
    return slots.select(F.col("w.start").alias("ts"), *(F.col(f"r.{c}").alias(c) for c in columns))


def lockouts(attempts: DataFrame, threshold: int = 5, window_s: float = 900, lock_s: float = 900, late: str = "1 hour") -> DataFrame:
    """(key, ts, locked_until) as failures come in; ``attempts`` has key, ts, ok. State of idle keys is dropped."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, last = state.get if state.exists else (0, -1.0)
        out = []
        rows = pd.concat(list(frames)).sort_values("t")
        for t, ok in zip(rows["t"], rows["ok"]):
            if ok:
                count, last = 0, -1.0
                continue
            count = 1 if last < 0 or t - last > window_s else count + 1
            last = t
            if count >= threshold:
                out.append((key[0], t, t + lock_s))
                count = 0
        state.update((count, float(last)))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(max(last, float(rows["t"].max())) * 1000 + window_s * 1000)))
        yield pd.DataFrame(out, columns=["key", "t", "until"])

    rows = attempts.withWatermark("ts", late).select(F.col("key").cast("string").alias("key"), "ts", (F.unix_micros("ts") / 1e6).alias("t"), "ok")
    found = rows.groupBy("key").applyInPandasWithState(step, "key string, t double, until double", "count int, last double", "append", GroupStateTimeout.EventTimeTimeout)
    at = lambda c: F.timestamp_micros(F.round(F.col(c) * 1e6).cast("long"))
    return found.select("key", at("t").alias("ts"), at("until").alias("locked_until"))


def forward(
    events: DataFrame,
    checkpoint: str,
    destinations: dict[str, Callable[[Iterable[str]], None]],
    formats: dict[str, object],
    tries: int = 3,
    pause_s: float = 0.5,
    dead_letters: str | None = None,
) -> StreamingQuery:
    """Send each batch's lines to every destination, each tried a few times with growing pauses (0.5 s, 1 s, …).

    The stream's checkpoint is the bookmark. ``formats`` maps a destination to the column that formats its line; a batch is
    planned once, and its lines are sent from the executors, Arrow batch by Arrow batch, to one destination after the other.
    Lines that no try delivers are kept in ``dead_letters`` (beside the checkpoint, if not named) as batch, destination, line
    and error. A batch that was sent whole is not sent again when the stream is restarted; one that broke off is.
    """
    lost_path = (dead_letters or f"{checkpoint.rstrip('/')}-dead-letters").rstrip("/")
    names = list(destinations)

    def send(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if tables.is_published(spark, f"{checkpoint.rstrip('/')}-sent", number):
            return

        def tried(sink: Callable[[Iterable[str]], None], lines: list[str]) -> str | None:
            for k in range(tries):
                try:
                    sink(lines)
                    return None
                except OSError as error:
                    said = str(error)
                    if k + 1 < tries:
                        time.sleep(pause_s * (k + 1))
            return said

        def deliver(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for k, name in enumerate(names):
                    lines = frame[f"line{k}"].tolist()
                    said = tried(destinations[name], lines) if lines else None
                    if said is not None:
                        yield pd.DataFrame({"line": lines, "error": said, "destination": name})

        columns = [formats[name].alias(f"line{k}") for k, name in enumerate(names)]
        lost = batch.select(*columns).mapInPandas(deliver, "line string, error string, destination string")
        lost.write.mode("overwrite").partitionBy("destination").parquet(f"{lost_path}/batch={number}")
        tables.publish(spark, f"{checkpoint.rstrip('/')}-sent", number, {})

    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
