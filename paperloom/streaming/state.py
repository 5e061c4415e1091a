"""Streams whose keys have state of several parts, with timers that end it: sessions, lock-outs, and jobs that are kept for a time.

State lives in the RocksDB store on the executors and goes with a timer of event time, so that it leaves the store when the
watermark passes, whether the key has new events or not, and a stream that is started again goes on with it. Rows without a
key or a time are left out before they reach the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers and maps needs this store; set it before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def timed(rows: DataFrame, key: Column, at: Column, late: str, *others: Column) -> DataFrame:
    """(key, t, …) with a watermark on ``ts``; ``t`` is the time in milliseconds."""
    named = rows.select(key.cast("string").alias("key"), at.cast("timestamp").alias("ts"), *others).filter("key IS NOT NULL AND ts IS NOT NULL")
    return named.withWatermark("ts", late).withColumn("t", F.unix_millis("ts"))


def frames_of(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("t", kind="stable")


class Sessions(StatefulProcessor):
    """One open session a key; it ends when nothing has come for ``idle_ms``, by the next event or by the timer."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first, last, n = self.open.get() if self.open.exists() else (None, None, 0)
        ended = []
        for t in frames_of(rows)["t"].tolist():
            if n and t - last >= self.idle_ms:
                ended.append((key[0], first, last, n))
                n = 0
            first, last, n = (t, t, 1) if not n else (min(first, t), max(last, t), n + 1)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.open.update((first, last, n))
        self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame(ended, columns=["key", "first", "last", "n"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            first, last, n = self.open.get()
            self.open.clear()
            yield pd.DataFrame([(key[0], first, last, n)], columns=["key", "first", "last", "n"])

    def close(self) -> None:
        pass


def ended_sessions(events: DataFrame, key: Column, at: Column, idle_s: float = 900, late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of each session, once it has ended."""
    found = timed(events, key, at, late).groupBy("key").transformWithStateInPandas(Sessions(int(idle_s * 1000)), "key string, first long, last long, n long", "append", "eventTime")
    return found.select("key", F.timestamp_millis("first").alias("start"), F.timestamp_millis("last").alias("end"), "n")


class Lockouts(StatefulProcessor):
    """Failures of each kind of a key, in a map; too many within the window lock the key until a timer lets it go."""

    def __init__(self, threshold: int, window_ms: int, lock_ms: int) -> None:
        self.threshold, self.window_ms, self.lock_ms = threshold, window_ms, lock_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getMapState("failures", "kind string", "n int, last long")
        self.locked = handle.getValueState("locked", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        out = []
        frame = frames_of(rows)
        until = self.locked.get()[0] if self.locked.exists() else -1
        counts = {k[0]: tuple(v) for k, v in self.failures.iterator()} if self.failures.exists() else {}
        for t, kind, ok in zip(frame["t"].tolist(), frame["kind"].tolist(), frame["ok"].tolist()):
            if t < until:
                continue
            n, last = counts.get(kind, (0, 0))
            if ok:
                counts.pop(kind, None)
                continue
            n = n + 1 if n and t - last <= self.window_ms else 1
            counts[kind] = (n, t)
            if n >= self.threshold:
                until = t + self.lock_ms
                counts.pop(kind)
                out.append((key[0], kind, t, until, "locked"))
        self.failures.clear()
        for kind, value in counts.items():
            self.failures.updateValue((kind,), value)
        if until >= 0:
            self.locked.update((until,))
        ends = [last + self.window_ms + 1 for _, last in counts.values()] + ([until] if until >= 0 else [])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for end in set(ends):
            self.handle.registerTimer(end)
        yield pd.DataFrame(out, columns=["key", "kind", "t", "until", "what"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        if self.locked.exists() and self.locked.get()[0] <= now:
            out.append((key[0], None, now, self.locked.get()[0], "released"))
            self.locked.clear()
        if self.failures.exists():
            for kind, value in list(self.failures.iterator()):
                if value[1] + self.window_ms < now:
                    self.failures.removeKey(kind)
        yield pd.DataFrame(out, columns=["key", "kind", "t", "until", "what"])

    def close(self) -> None:
        pass


def lockouts(attempts: DataFrame, key: Column, at: Column, kind: Column, ok: Column, threshold: int = 5, window_s: float = 900, lock_s: float = 900, late: str = "1 hour") -> DataFrame:
    """(key, kind, ts, locked_until, what): ``locked`` when a kind of attempts has failed too often, ``released`` when its time
    is up. A success clears the kind's failures; attempts while locked count for nothing."""
    rows = timed(attempts, key, at, late, F.coalesce(kind.cast("string"), F.lit("")).alias("kind"), F.coalesce(ok, F.lit(False)).alias("ok"))
    processor = Lockouts(threshold, int(window_s * 1000), int(lock_s * 1000))
    found = rows.groupBy("key").transformWithStateInPandas(processor, "key string, kind string, t long, until long, what string", "append", "eventTime")
    return found.select("key", "kind", F.timestamp_millis("t").alias("ts"), F.timestamp_millis("until").alias("locked_until"), "what")


class KeptJobs(StatefulProcessor):
    """The newest status of a job; a finished job leaves the state when it has been kept long enough."""

    def __init__(self, keep_ms: int, done: tuple[str, ...]) -> None:
        self.keep_ms, self.done = keep_ms, done

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, started long, t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        status, started, last = self.job.get() if self.job.exists() else (None, None, -1)
        out = []
        for t, new in frames_of(rows)[["t", "status"]].itertuples(index=False):
            if t < last:
                continue
            if new != status:
                out.append((key[0], new, t, "changed"))
            status, started, last = new, t if started is None else started, t
        self.job.update((status, started, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status in self.done:
            self.handle.registerTimer(last + self.keep_ms)
        yield pd.DataFrame(out, columns=["key", "status", "t", "what"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists():
            status, started, last = self.job.get()
            self.job.clear()
            yield pd.DataFrame([(key[0], status, expiredTimerInfo.getExpiryTimeInMs(), "expired")], columns=["key", "status", "t", "what"])

    def close(self) -> None:
        pass


def kept_jobs(updates: DataFrame, key: Column, at: Column, status: Column, keep_s: float = 86400, done: tuple[str, ...] = ("done", "error", "cancelled"), late: str = "1 hour") -> DataFrame:
    """(key, status, ts, what): each change of a job's status, and when a finished job is let go. Late updates are left out."""
    rows = timed(updates, key, at, late, status.cast("string").alias("status"))
    found = rows.groupBy("key").transformWithStateInPandas(KeptJobs(int(keep_s * 1000), tuple(done)), "key string, status string, t long, what string", "append", "eventTime")
    return found.select("key", "status", F.timestamp_millis("t").alias("ts"), "what")
