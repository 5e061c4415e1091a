"""Segments of running text: fragments joined to sentences, broken paragraphs, prefixes of lines, aligned corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

#: Marks at which a paragraph is complete.
COMPLETE = r"[.!?。！？:：;；]\s*$"


def merge_fragments(rows: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """Segments without a letter or digit join the one before (the first joins the next): one window, one aggregation."""
    w = Window.partitionBy(by).orderBy(order)
    real = F.col(text).rlike(r"[\p{L}\p{N}]")
    number = F.sum(real.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    grouped = rows.withColumn("_g", F.greatest(number, F.lit(1))).groupBy(by, "_g")
    parts = grouped.agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("parts"))
    return parts.select(by, F.col("_g").alias("segment"), F.array_join(F.col(f"parts.{text}"), "").alias(text))


def reflow(lines: DataFrame, by: str, order: str, text: str = "line") -> DataFrame:
    """Lines joined to paragraphs: one ends at a complete line or a blank one; no space between CJK characters."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.lag(text).over(w)
    starts = before.isNull() | before.rlike(COMPLETE) | T.blank(before) | T.blank(F.col(text))
    numbered = lines.withColumn("_g", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(~T.blank(F.col(text)))
    parts = numbered.groupBy(by, "_g").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("parts"))
    joined = F.array_join(F.transform(F.col(f"parts.{text}"), T.strip), " ")
    return parts.select(by, F.col("_g").alias("paragraph"), join_cjk(joined).alias("text"))


def join_cjk(text: Column) -> Column:
    """Without single spaces between CJK characters, those of form blanks (年 月 日, 時 分) kept."""
    return F.regexp_replace(text, "(?<=[㐀-䶿一-鿿豈-﫿、。，；：])(?<![年月日時分]) (?=[㐀-䶿一-鿿豈-﫿、。，；：])(?![月日時分])", "")


def split_prefix(line: Column) -> Column:
    """(prefix, rest): bullet, box, number, quote or heading mark in front of a line."""
    mark = r"^(\s*(?:[-*•●○■□◆▪]\s+(?:\[[ xX]\]\s+)?|\[[ xX]\]\s+|\d{1,3}[.)、]\s*|>+\s*|#{1,6}\s+)?)"
    prefix = F.regexp_extract(line, mark, 1)
    return F.struct(prefix.alias("prefix"), F.substring(line, F.length(prefix) + 1, F.length(line)).alias("rest"))


def corrected_lines(original: DataFrame, corrected: DataFrame, by: str, order: str = "pos", text: str = "line", share: float = 0.3, least_aligned: float = 0.3) -> DataFrame:
    """Corrections line by line: a page whose line count differs much keeps its own, as does a line whose count of characters does.

    Space is not counted; a line that is blank on one side only, or blank on both and not the same, stays.
    """
    o = original.select(by, order, F.col(text).alias("own"))
    c = corrected.select(by, order, F.col(text).alias("new"))
    limits = o.groupBy(by).agg(F.count("*").alias("n")).join(c.groupBy(by).agg(F.count("*").alias("m")), by, "left")
    fits = limits.filter(F.abs(F.col("n") - F.coalesce("m", F.lit(0))) <= F.greatest(F.lit(2.0), share * F.col("n"))).select(by, F.lit(True).alias("_fits"))
    joined = o.join(c, [by, order], "left").join(fits, by, "left")
    size = lambda c: F.length(F.regexp_replace(c, r"(?U)\s+", ""))
    own, new = size("own"), size("new")
    emptied = (F.least(own, new) == 0) & (F.col("own") != F.col("new"))
    keep = F.col("_fits").isNull() | F.col("new").isNull() | emptied | (F.abs(own - new) > F.greatest(F.lit(2.0), share * own))
    # a page of which hardly any line aligns keeps its own
    judged = joined.select(by, order, "own", "new", (~keep).alias("fits")).withColumn("part", F.avg(F.col("fits").cast("double")).over(Window.partitionBy(by)))
    taken = F.col("fits") & (F.col("part") >= least_aligned)
    return judged.select(by, order, F.when(taken, F.col("new")).otherwise(F.col("own")).alias(text), taken.alias("corrected"))


def fingerprint(spans: DataFrame, by: str, text: str = "text", least: int = 60) -> DataFrame:
    """(by, fingerprint): SHA-256 of the first sixty distinct short texts, joined by bars."""
    short = spans.filter((F.length(text) > 0) & (F.length(text) <= 40)).groupBy(by).agg(F.array_sort(F.collect_set(text)).alias("t"))
    return short.select(by, F.sha2(F.array_join(F.slice("t", 1, least), "|"), 256).alias("fingerprint"))


def same_word_count(a: Column, b: Column) -> Column:
    words = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    return words(a) == words(b)


def labels_normalised(label: Column) -> Column:
    """A form label for look-up: width folded, no space, no leading star or number, no colon or bracket at the end, lower case."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
    s = F.regexp_replace(F.translate(label, wide, narrow), r"(?U)\s+", "")
    s = F.regexp_replace(s, r"^[*＊]+", "")
    s = F.regexp_replace(s, r"^(?:\(?\d{1,3}[.)、]|[一二三四五六七八九十]+[、.])", "")
    s = F.regexp_replace(s, r":+$", "")
    s = F.regexp_replace(s, r"\([^()]*\)$", "")
    return F.lower(F.regexp_replace(s, r"[-‐‑–—_]+", ""))
