"""Column functions of invoices and receipts: local calendars, fiscal periods, amounts, display formats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Years of the local calendar begin behind this one.
ERA = 1911


def era_date(text: Column) -> Column:
    """YYYMMDD of the local calendar as a date, null if there is no such day."""
    year = (F.substring(text, 1, 3).try_cast("int") + ERA).cast("string")
    return F.when(text.rlike("^[0-9]{7}$"), F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.substring(text, 4, 2), F.substring(text, 6, 2)), "yyyy-MM-dd"))


def flexible_date(text: Column) -> Column:
    """Y-M-D or Y/M/D; a year below the era's start is a local one; null if there is no such day."""
    s = F.trim(text)
    parts = F.when(s.rlike(r"^\s*\d{1,4}\s*-\s*\d{1,2}\s*-\s*\d{1,2}\s*$"), F.split(s, "-")).when(s.rlike(r"^\s*\d{1,4}\s*/\s*\d{1,2}\s*/\s*\d{1,2}\s*$"), F.split(s, "/"))
    number = lambda k: F.trim(F.get(parts, F.lit(k))).try_cast("int")
    year = F.when(number(0) < ERA, number(0) + ERA).otherwise(number(0))
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(number(1).cast("string"), 2, "0"), F.lpad(number(2).cast("string"), 2, "0")), "yyyy-MM-dd")


def hex_amount(text: Column) -> Column:
    return F.when(text.rlike("^[0-9A-Fa-f]+$"), F.conv(text, 16, 10).cast("long"))


def first_integer(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, r"-?\d[\d,]*", 0), ",", "").try_cast("long")


def period_number(day: Column) -> Column:
    """Two-month fiscal period, 1 to 6."""
    return F.ceil(F.month(day) / 2).cast("int")


def period_start(day: Column) -> Column:
    return F.make_date(F.year(day), period_number(day) * 2 - 1, F.lit(1))


def period_end(day: Column) -> Column:
    return F.last_day(F.make_date(F.year(day), period_number(day) * 2, F.lit(1)))


def period_label(day: Column) -> Column:
    n = period_number(day)
    return F.format_string("%d 年第 %d 期 (%d-%d 月)", F.year(day), n, n * 2 - 1, n * 2)


def filing_day(today: Column) -> Column:
    """A day of the latest period to file: the one with the month before today's."""
    return F.add_months(F.trunc(today, "month"), -1)


def recent_periods(today: Column, n: int = 6) -> Column:
    """First days of the n latest periods that have begun, newest first."""
    return F.sequence(period_start(today), F.add_months(period_start(today), -2 * (n - 1)), F.expr("INTERVAL -2 MONTHS"))


def in_period(day: Column, start: Column, end: Column) -> Column:
    return F.coalesce(day.between(start, end), F.lit(False))


def show_date(day: Column, style: str) -> Column:
    """iso, slash, chinese, roc, roc_chinese; null is empty."""
    era = F.year(day) - ERA
    shown = {
        "iso": F.date_format(day, "yyyy-MM-dd"),
        "slash": F.date_format(day, "yyyy/MM/dd"),
        "chinese": F.format_string("%d年%d月%d日", F.year(day), F.month(day), F.day(day)),
        "roc": F.format_string("%03d/%02d/%02d", era, F.month(day), F.day(day)),
        "roc_chinese": F.format_string("民國%d年%d月%d日", era, F.month(day), F.day(day)),
    }[style]
    return F.when(day.isNull(), "").otherwise(shown)


def show_amount(amount: Column, style: str) -> Column:
    """plain, comma, currency; null is empty."""
    shown = {"plain": amount.cast("string"), "comma": F.format_number(amount, 0), "currency": F.concat(F.lit("NT$ "), F.format_number(amount, 0))}[style]
    return F.when(amount.isNull(), "").otherwise(shown)


def show_relative(then: Column, now: Column) -> Column:
    """Just now, minutes, hours, days ago; the date beyond a week."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    ago = lambda unit, word: F.concat(F.floor(seconds / unit).cast("string"), F.lit(word))
    return F.when(seconds < 60, "剛剛").when(seconds < 3600, ago(60, " 分鐘前")).when(seconds < 86400, ago(3600, " 小時前")).when(seconds < 7 * 86400, ago(86400, " 天前")).otherwise(F.date_format(then, "yyyy/MM/dd"))


def show_time(then: Column, style: str, now: Column | None = None) -> Column:
    """iso, local, date_only, relative (to ``now``) in the session's zone; null is empty. ISO times show fractions only if there
    are any."""
    fraction = F.when(F.unix_micros(then) % 1_000_000 != 0, F.date_format(then, ".SSSSSS")).otherwise("")
    shown = {
        "iso": lambda: F.concat(F.date_format(then, "yyyy-MM-dd'T'HH:mm:ss"), fraction),
        "local": lambda: F.date_format(then, "yyyy/MM/dd HH:mm:ss"),
        "date_only": lambda: F.date_format(then, "yyyy/MM/dd"),
        "relative": lambda: show_relative(then, F.current_timestamp() if now is None else now),
    }[style]()
    return F.when(then.isNull(), "").otherwise(shown)


def show_number(number: Column, style: str) -> Column:
    """An invoice number of ten characters compact, or with a dash or a space behind the letters; others as they are."""
    mark = {"compact": "", "dash": "-", "space": " "}[style]
    whole = F.coalesce(number, F.lit(""))
    return F.when(F.length(whole) == 10, F.concat(F.left(whole, F.lit(2)), F.lit(mark), F.substring(whole, 3, 8))).otherwise(whole)


#: The formats that fields can be shown in, the first of which holds unless another is chosen.
FIELD_FORMATS = {
    "invoice_number": ("compact", "dash", "space"),
    "date": ("iso", "slash", "chinese", "roc", "roc_chinese"),
    "amount_total": ("plain", "comma", "currency"),
    "amount_untaxed": ("plain", "comma", "currency"),
    "tax": ("plain", "comma", "currency"),
    "scanned_at": ("iso", "local", "date_only", "relative"),
}


def show_field(field: str, value: Column, chosen: dict[str, str], now: Column | None = None) -> Column:
    """A field as its format says; unknown formats count as not chosen, fields without formats are shown as they are."""
    if field not in FIELD_FORMATS:
        return F.coalesce(value.cast("string"), F.lit(""))
    style = chosen.get(field) if chosen.get(field) in FIELD_FORMATS[field] else FIELD_FORMATS[field][0]
    if field == "invoice_number":
        return show_number(value, style)
    if field == "date":
        return show_date(value.cast("date"), style)
    if field == "scanned_at":
        return show_time(value, style, now)
    return show_amount(value, style)


def show_fields(columns: list[str], chosen: dict[str, str], now: Column | None = None) -> list[Column]:
    """All columns of an invoice as they are exported; the tax is what the totals differ by."""
    values = {c: F.col(c) for c in columns}
    if {"amount_total", "amount_untaxed"} <= values.keys():
        values["tax"] = values["amount_total"] - values["amount_untaxed"]
    return [show_field(name, value, chosen, now).alias(name) for name, value in values.items()]


def blake2b(value: Column, size: int) -> Column:
    """The BLAKE2b digest of a text, of so many bytes, in hex; null for null."""

    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: hashlib.blake2b(t.encode(), digest_size=size).hexdigest(), na_action="ignore")

    digests.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(digests, StringType())(value)


def buffer_key(username: Column, realm: Column) -> Column:
    """The key under which a user's rows are kept: a digest of name and realm, ``default`` without a name."""
    named = F.concat(username, F.lit("|"), F.coalesce(realm, F.lit("")))
    return F.when(F.coalesce(username, F.lit("")) == "", "default").otherwise(blake2b(named, 8))


def station(name: Column) -> Column:
    """A station's plain name."""
    out = F.regexp_replace(F.trim(name), "^高鐵", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "車站$", ""), "站$", ""))


def epoch_iso(seconds: Column) -> Column:
    """Seconds since the epoch as ISO time of the session's zone; null and negative ones have none."""
    return F.when(seconds >= 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"))
