"""Audit events: filters, facets, JSON details, per-user activity, line formats for collectors, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANONYMOUS = "(匿名)"


def iso_bound(text: str | None) -> Column | None:
    """A bound of a time range; what isn't a time is ignored."""
    from datetime import datetime

    try:
        return F.lit(datetime.fromisoformat(text)) if text else None
    except ValueError:
        return None


def select_events(events: DataFrame, user: str | None = None, event: str | None = None, since: str | None = None, until: str | None = None, exact_user: bool = False) -> DataFrame:
    """Predicates only for the arguments given, so that they all reach the scan; ``exact_user`` as in the export."""
    if user:
        events = events.filter(F.col("username") == user if exact_user else F.col("username").contains(user))
    if event:
        events = events.filter(F.col("event_type") == event)
    if (low := iso_bound(since)) is not None:
        events = events.filter(F.col("ts") >= low)
    if (high := iso_bound(until)) is not None:
        events = events.filter(F.col("ts") <= high)
    return events


def newest(events: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """One page, newest first: a bounded top-k, no full sort."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).offset((max(1, page) - 1) * size).limit(size)


def choices(events: DataFrame) -> DataFrame:
    """(kind, value): the distinct event types and users, for a filter's lists."""
    rows = events.select(F.explode(F.array(F.struct(F.lit("event_type").alias("kind"), F.col("event_type").alias("value")), F.struct(F.lit("username").alias("kind"), F.col("username").alias("value")))).alias("x"))
    return rows.select("x.*").filter("value IS NOT NULL").distinct()


def detail(path: str, column: str = "details_json") -> Column:
    """A member of the JSON details, null if there is none or the text is no JSON."""
    return F.get_json_object(column, f"$.{path}")


def capped_details(column: str, limit: int) -> Column:
    """Details whose text is too long keep only their scalar members, with a mark."""
    whole = F.from_json(column, "map<string,string>")
    scalars = F.map_filter(whole, lambda k, v: ~F.coalesce(v, F.lit("")).rlike(r"^\s*[\[{]"))
    marked = F.map_concat(scalars, F.create_map(F.lit("_truncated"), F.lit("true")))
    return F.when(F.length(column) <= limit, F.col(column)).otherwise(F.to_json(marked))


def user_activity(events: DataFrame, size_path: str = "size_bytes") -> DataFrame:
    """(username, files, bytes) of events that moved something."""
    size = F.get_json_object("details_json", f"$.{size_path}").try_cast("long")
    moved = events.select(F.coalesce(F.nullif(F.trim("username"), F.lit("")), F.lit(ANONYMOUS)).alias("username"), size.alias("size")).filter("size > 0")
    return moved.groupBy("username").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def storage_and_activity(storage: DataFrame, activity: DataFrame) -> DataFrame:
    """Everyone with stored files or recent activity, what is missing as zero."""
    joined = storage.join(activity, "username", "full_outer")
    return joined.select("username", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in joined.columns if c != "username"])


# ---- formats for collectors


def cef_escape(value: Column) -> Column:
    v = F.coalesce(value.cast("string"), F.lit(""))
    for plain, safe in (("\\", "\\\\"), ("=", "\\="), ("|", "\\|")):
        v = F.replace(v, F.lit(plain), F.lit(safe))
    return F.translate(v, "\n\r", "  ")


def as_syslog(host: str, app: str) -> Column:
    """RFC 5424, facility local0, severity notice."""
    message = F.to_json(F.struct(F.col("username").alias("user"), "ip", F.col("event_type").alias("event"), "target", F.col("details_json").alias("details")), {"ignoreNullFields": "false"})
    return F.concat(F.lit("<133>1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f".000Z {host} {app} - "), "event_type", F.lit(" - "), message)


def as_cef(vendor: str, product: str, version: str = "1") -> Column:
    pairs = (("src", "ip"), ("suser", "username"), ("act", "event_type"), ("target", "target"), ("msg", "details_json"))
    extension = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), cef_escape(F.col(c))) for k, c in pairs], F.concat(F.lit("rt="), F.unix_millis("ts").cast("string")))
    return F.concat(F.lit(f"CEF:0|{vendor}|{product}|{version}|"), "event_type", F.lit("|"), "event_type", F.lit("|5|"), extension)


def as_gelf(host: str) -> Column:
    fields = F.struct(
        F.lit("1.1").alias("version"), F.lit(host).alias("host"), F.col("event_type").alias("short_message"), F.col("details_json").alias("full_message"),
        (F.unix_micros("ts") / 1e6).alias("timestamp"), F.lit(5).alias("level"), F.col("username").alias("_user"), F.col("ip").alias("_ip"), F.col("target").alias("_target"), F.col("event_id").alias("_event_id"),
    )
    return F.to_json(fields)


# ---- retention


def retained(rows: DataFrame, now: Column, days: dict[str, int], category: str = "category", ts: str = "ts", running: Column | None = None) -> DataFrame:
    """Rows still kept: 0 or less keeps a category for ever, and what is running is never dropped."""
    age = F.create_map(*[F.lit(x) for kv in days.items() for x in kv])
    limit = F.coalesce(F.element_at(age, F.col(category)), F.lit(0)) if days else F.lit(0)
    keep = (limit <= 0) | (F.col(ts) >= now - F.make_dt_interval(limit))
    return rows.filter(keep if running is None else keep | running)


def keep_newest(rows: DataFrame, n: int, by: str, ts: str = "ts") -> DataFrame:
    """The n newest of each group."""
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(ts)))).filter(F.col("_n") <= n).drop("_n")


def page_sum(rows: DataFrame, order: list[Column], page: int, size: int, value: str) -> DataFrame:
    """(rows, value): how many rows a page of a list has and what they sum up to; pages count from 1, beyond the last are empty."""
    shown = rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)
    return shown.agg(F.count("*").alias("rows"), F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(value))
