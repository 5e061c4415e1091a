"""Rail receipts: kind, fields by label or by shape, and the key that tells copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import business as B


def kind_of(text: Column) -> Column:
    return F.when(F.lower(text).contains("thsrc") | text.contains("高鐵"), "高鐵").when(text.rlike("購票證明|車次|臺鐵|台鐵"), "台鐵")


def labelled(text: Column, label: str) -> Column:
    return F.trim(F.regexp_extract(text, rf"\Q{label}\E[\s]*[:：][\s]*(.*)", 1))


def iso_day(text: Column, sep: str) -> Column:
    """The first day in a text as ISO text, else empty."""
    p = rf"([0-9]{{4}}){sep}([0-9]{{1,2}}){sep}([0-9]{{1,2}})"
    part = lambda k: F.regexp_extract(text, p, k)
    return F.when(part(1) == "", "").otherwise(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def parse(receipts: DataFrame, text_col: str = "text") -> DataFrame:
    """The fields of every receipt; ``parsed`` is false where neither date, origin nor fare was found."""
    t = receipts[text_col]
    ride = labelled(t, "乘車日期")
    hour, minute = F.regexp_extract(ride, r"[0-9]\s+([0-9]{1,2}):([0-9]{2})", 1), F.regexp_extract(ride, r"[0-9]\s+([0-9]{1,2}):([0-9]{2})", 2)
    fast = {
        "date": iso_day(ride, "[-/]"),
        "depart_time": F.when(hour == "", "").otherwise(F.concat_ws(":", F.lpad(hour, 2, "0"), minute)),
        "arrive_time": F.lit(""),
        "origin": B.station(labelled(t, "起程站")),
        "destination": B.station(labelled(t, "到達站")),
        "fare": B.first_integer(labelled(t, "票價")),
        "amount_untaxed": B.first_integer(labelled(t, "銷售額")),
        "tax": B.first_integer(labelled(t, "營業稅額")),
        "train": F.lit(""),
        "ticket_type": F.lit(""),
        "ticket_no": F.coalesce(F.nullif(labelled(t, "卡號/票號"), F.lit("")), labelled(t, "票號")),
        "buyer_tax_id": labelled(t, "統一編號"),
    }
    days = F.regexp_extract_all(t, F.lit(r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"), 0)
    printed = F.regexp_extract(t, r"印製日期\s*\n?\s*([0-9]{4}/[0-9]{1,2}/[0-9]{1,2})", 1)
    travel = F.coalesce(F.get(F.filter(days, lambda d: d != printed), F.lit(0)), printed)
    span = r"([0-9]{1,2}:[0-9]{2})\s*([^\s>＞]+)\s*[>＞]\s*([0-9]{1,2}:[0-9]{2})\s*([^\s]+)"
    model = r"(?<!乘車)(自強|莒光|復興|普悠瑪|太魯閣|新自強|PP自強|EMU[0-9]*|區間快|區間)\s*(\([^)]*\))?"
    class_ = r"(全票|孩童|敬老|愛心|優待|團體|軍警)\s*(\([^)]*\))?"
    number = F.regexp_extract(t, r"([0-9]+)\s*車次", 1)
    slow = {
        "date": iso_day(travel, "/"),
        "depart_time": F.regexp_extract(t, span, 1),
        "arrive_time": F.regexp_extract(t, span, 3),
        "origin": F.regexp_extract(t, span, 2),
        "destination": F.regexp_extract(t, span, 4),
        "fare": B.first_integer(F.regexp_extract(t, r"([0-9][0-9,]*)\s*元", 1)),
        "amount_untaxed": F.lit(None).cast("long"),
        "tax": F.lit(None).cast("long"),
        "train": F.trim(F.concat(F.regexp_extract(t, model, 1), F.regexp_extract(t, model, 2), F.when(number == "", "").otherwise(F.concat(F.lit(" "), number, F.lit("車次"))))),
        "ticket_type": F.concat(F.regexp_extract(t, class_, 1), F.regexp_extract(t, class_, 2)),
        "ticket_no": F.regexp_extract(t, r"(?<![\p{L}\p{N}_])([A-Z][0-9]{10,})(?![\p{L}\p{N}_])", 1),
        "buyer_tax_id": F.lit(""),
    }
    out = receipts.withColumn("transport", kind_of(t))
    for name in fast:
        out = out.withColumn(name, F.when(F.col("transport") == "高鐵", fast[name]).when(F.col("transport") == "台鐵", slow[name]))
    return out.withColumn("parsed", F.coalesce((F.col("date") != "") | (F.col("origin") != "") | F.col("fare").isNotNull(), F.lit(False))).withColumn("subject", F.lit("旅費"))


def copy_key(r: DataFrame) -> Column:
    """Ticket number, or day, route and fare where there is none."""
    number = F.nullif(F.trim("ticket_no"), F.lit(""))
    return F.when(number.isNotNull(), F.concat_ws("|", "transport", number)).otherwise(F.concat_ws("|", "transport", "date", "origin", "destination", F.col("fare").cast("string")))


def route(r: DataFrame) -> Column:
    return F.concat_ws(" → ", F.nullif("origin", F.lit("")), F.nullif("destination", F.lit("")))
