"""Jobs: latest state, history in time buckets with empty ones kept, priority order, percentiles, lock-out replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.quantiles import quantiles

from paperloom.session import numbered

PRIORITY_USERS = 15


def latest(rows: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def bounds(hours: int, buckets: int) -> tuple[int, int]:
    return max(1, min(hours, 720)), max(6, min(buckets, 480))


def spine(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))


def bucket_of(ts: Column, start: Column, width: float, buckets: int) -> Column:
    """Bucket of equal width; what lies outside falls in the first or last."""
    k = F.floor((F.unix_micros(ts) - F.unix_micros(start)) / F.lit(width * 1e6))
    return F.least(F.lit(buckets - 1), F.greatest(F.lit(0), k)).cast("int")


def job_history(jobs: DataFrame, now: str, hours: int = 24, buckets: int = 96, created: str = "created_at", finished: str = "finished_at") -> DataFrame:
    """(bucket, started, active): an interval is exploded into the buckets it covers, no range join is needed."""
    hours, buckets = bounds(hours, buckets)
    end = F.lit(now).cast("timestamp")
    start = end - F.make_dt_interval(F.lit(0), F.lit(hours))
    width = hours * 3600 / buckets
    done = F.coalesce(finished, end)
    live = jobs.filter((done >= start) | (F.col(created) >= start))
    at = lambda ts: bucket_of(ts, start, width, buckets)
    started = live.filter(F.col(created) >= start).groupBy(at(F.col(created)).alias("bucket")).agg(F.count("*").alias("started"))
    low, high = at(F.greatest(F.col(created), start)), at(F.least(done, end))
    covered = live.select(low.alias("lo"), high.alias("hi")).filter("lo <= hi").groupBy("lo", "hi").agg(F.count("*").alias("n"))
    active = covered.select(F.explode(F.sequence("lo", "hi")).alias("bucket"), "n").groupBy("bucket").agg(F.sum("n").alias("active"))
    return spine(jobs, buckets).join(started, "bucket", "left").join(active, "bucket", "left").fillna(0, ["started", "active"])


def metric_history(samples: DataFrame, now: str, hours: int, buckets: int, value: str = "value", ts: str = "ts") -> DataFrame:
    """(bucket, samples, avg, max), empty buckets as zeros."""
    hours, buckets = bounds(hours, buckets)
    end = F.lit(now).cast("timestamp")
    start = end - F.make_dt_interval(F.lit(0), F.lit(hours))
    inside = samples.filter(F.col(ts) >= start)
    grouped = inside.groupBy(bucket_of(F.col(ts), start, hours * 3600 / buckets, buckets).alias("bucket"))
    out = grouped.agg(F.count("*").alias("samples"), F.avg(F.coalesce(F.col(value), F.lit(0.0))).alias("avg"), F.max(F.coalesce(F.col(value), F.lit(0.0))).alias("max"))
    return spine(samples, buckets).join(out, "bucket", "left").fillna(0, ["samples", "avg", "max"])


def clean_priorities(users: list) -> list[int]:
    """Positive ids, each once, in order, the first fifteen."""
    out: list[int] = []
    for u in users:
        if str(u).isdecimal() and int(u) > 0 and int(u) not in out:
            out.append(int(u))
    return out[:PRIORITY_USERS]


def queue_order(queued: DataFrame, ranks: dict[int, int], owner: str = "owner_id", order: str = "created_at") -> DataFrame:
    """Place in the queue, from 1: by rank, those without last, first come first served within a rank."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(owner)) if ranks else F.lit(None).cast("int")
    ranked = queued.withColumn("priority", rank)
    # ranks before those without, days within a rank
    group = F.concat(F.coalesce(F.lpad(F.col("priority").cast("string"), 10, "0"), F.lit("last")), F.lit("|"), F.date_format(order, "yyyy-MM-dd"))
    return numbered(ranked, "place", group, order, "id")


def select_jobs(jobs: DataFrame, owner: int | None = None, client_ip: str | None = None, active: bool = False, tool: str | None = None, limit: int = 100) -> DataFrame:
    for column, value in (("owner_id", owner), ("client_ip", client_ip), ("tool_id", tool)):
        if value is not None:
            jobs = jobs.filter(F.col(column) == value)
    if active:
        jobs = jobs.filter(F.col("status").isin("queued", "running"))
    return jobs.orderBy(F.desc("created_at"), "id").limit(max(1, min(limit, 500)))


def overlay(stored: DataFrame, live: DataFrame, key: str = "id") -> DataFrame:
    """Stored jobs with what is known live: its status and progress come first."""
    l = live.select(F.col(key).alias("_id"), F.col("status").alias("_status"), F.col("progress").alias("_progress"))
    joined = stored.join(l, stored[key] == F.col("_id"), "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).withColumn("progress", F.coalesce("_progress", "progress")).drop("_id", "_status", "_progress")


def inbox(jobs: DataFrame, seen: DataFrame) -> DataFrame:
    """(owner_id, finished, unread)."""
    joined = jobs.filter("finished_at IS NOT NULL").join(seen, "owner_id", "left")
    return joined.groupBy("owner_id").agg(F.count("*").alias("finished"), F.count_if(F.col("last_seen").isNull() | (F.col("finished_at") > F.col("last_seen"))).alias("unread"))


SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def request_report(rows: DataFrame, by: str, value: str, failed: Column, ts: str = "ts") -> DataFrame:
    """(by, n, succeeded, failures, success_rate, per_second, p50, p95, p99, max): a load run's figures for each tool; the rate
    is over the whole run's time."""
    span = rows.agg(((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6).alias("span"))
    bad = F.count_if(failed)
    out = rows.groupBy(by).agg(F.count("*").alias("n"), (F.count("*") - bad).alias("succeeded"), bad.alias("failures"), F.max(value).alias("max"))
    out = out.join(F.broadcast(span), F.lit(True))  # one row
    out = out.withColumns({"success_rate": F.round(F.col("succeeded") / F.col("n"), 6), "per_second": F.round(F.try_divide("n", "span"), 9)}).drop("span")
    return _with_quantiles(out, rows, by, value)


def _with_quantiles(figures: DataFrame, rows: DataFrame, by: str, value: str) -> DataFrame:
    found = quantiles(rows, by, value, SHARES).withColumnRenamed(by, "_of")
    return figures.join(found, F.col(by).eqNullSafe(F.col("_of")), "left").drop("_of")


def error_classes(rows: DataFrame, by: str, error: Column) -> DataFrame:
    """(by, error, n) of the rows that have an error."""
    return rows.withColumn("error", error).filter("error IS NOT NULL").groupBy(by, "error").agg(F.count("*").alias("n"))


def results_from(results: DataFrame, start: int, job: str = "job_id", at: str = "at") -> DataFrame:
    """What a poll gets: each job's results from a place on, and how many there are by now."""
    total = results.groupBy(job).agg(F.count("*").alias("total"))
    return results.filter(F.col(at) >= start).join(total, job)


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, p50, p95, p99, max): exact percentiles by group, of groups of any size."""
    return _with_quantiles(rows.groupBy(by).agg(F.count("*").alias("n"), F.max(value).alias("max")), rows, by, value)


def replay_lockouts(attempts: DataFrame, threshold: int = 5, window_s: float = 900, lock_s: float = 900, key: str = "key", ts: str = "ts", ok: str = "ok") -> DataFrame:
    """(key, ts, locked_until) of each lock that the failures in order bring about; one pass over each key's attempts, at one time failures first.

    A failure later than the window after the last starts anew; a success clears; a lock resets the counter.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, count, last, key_now = [], 0, None, None
        for frame in frames:
            for k, t, fine in zip(frame["key"], frame["t"], frame["ok"]):
                if k != key_now:
                    key_now, count, last = k, 0, None
                if fine:
                    count, last = 0, None
                    continue
                count = 1 if last is None or t - last > window_s else count + 1
                last = t
                if count >= threshold:
                    out.append((k, t, t + lock_s))
                    count = 0
        yield pd.DataFrame(out, columns=["key", "t", "until"])

    rows = attempts.select(F.col(key).cast("string").alias("key"), (F.unix_micros(ts) / 1e6).alias("t"), F.col(ok).alias("ok"))
    # keys are whole within a partition and sorted: a key's attempts stream through, none is held in memory
    placed = rows.repartition("key").sortWithinPartitions("key", "t", "ok")
    locks = placed.mapInPandas(run, "key string, t double, until double")
    return locks.select("key", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")).alias("ts"), F.timestamp_micros(F.round(F.col("until") * 1e6).cast("long")).alias("locked_until"))


def admin_list(jobs: DataFrame, places: DataFrame, live: DataFrame, ranks: DataFrame, tags: Column) -> DataFrame:
    """Jobs with live state, place in the queue, the owner's rank and resource tags, numbered as administrators see them:
    queued by place, then running, then the newest first."""
    out = overlay(jobs, live).join(places, "id", "left").join(ranks, "owner_id", "left").withColumn("tags", tags)
    kind = F.when(F.col("status") == "queued", 0).when(F.col("status") == "running", 1).otherwise(2)
    newest = -F.unix_micros("created_at")
    group = F.concat(kind.cast("string"), F.lit("|"), F.when(kind == 0, F.lpad(F.floor(F.coalesce("place", F.lit(0)) / 1000).cast("string"), 12, "0")).otherwise(F.lpad((F.lit(10**6) - F.datediff(F.col("created_at"), F.lit("1970-01-01").cast("date"))).cast("string"), 12, "0")))
    return numbered(out, "row", group, F.when(kind == 0, F.col("place")).asc_nulls_last(), newest, "id")


def resource_tags(tool: Column, office: list[str], ocr: list[str], remote: list[str]) -> Column:
    """The shared resources a tool draws on; a tool may have several."""
    return F.array_compact(F.array(*[F.when(tool.isin(ids), name) for name, ids in (("office", office), ("ocr", ocr), ("remote", remote))]))


def joint_history(jobs: DataFrame, samples: DataFrame, now: str, hours: int, buckets: int) -> DataFrame:
    """Job history and metric history on the same buckets."""
    return job_history(jobs, now, hours, buckets).join(metric_history(samples, now, hours, buckets), "bucket")


def sampled(rows: DataFrame, ts: str = "ts", every: str = "1 minute") -> DataFrame:
    """The last row of each interval, under the interval's start."""
    slot = F.window(ts, every)["start"]
    columns = [c for c in rows.columns if c != ts]
    return rows.groupBy(slot.alias("slot")).agg(F.max_by(F.struct(*columns), F.struct(ts, *columns)).alias("r")).select(F.col("slot").alias(ts), "r.*")


def due(last_run: Column, now: Column, weekday: int, hour: int, least_days: int = 6) -> Column:
    """A weekly job is due on its day (0 is Monday) and hour if it has not run for some days."""
    fresh = F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(last_run)) < least_days * 86400, F.lit(False))
    return (F.weekday(now) == weekday) & (F.hour(now) == hour) & ~fresh
