"""Labels of forms: synonyms, look-up of canonical keys, spans that hold several labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.segments import labels_normalised


def merge_synonyms(own: DataFrame, defaults: DataFrame) -> DataFrame:
    """(key, synonyms): a user's synonyms first, then the defaults they lack; blanks and repeats dropped, keys kept."""
    tidy = lambda words: F.array_distinct(F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.trim(w)), lambda w: w != ""))
    a = own.select(F.trim("key").alias("key"), tidy(F.col("synonyms")).alias("own")).filter("key <> ''")
    b = defaults.select("key", tidy(F.col("synonyms")).alias("given"))
    joined = a.join(b, "key", "full_outer")
    none = F.array().cast("array<string>")
    return joined.select("key", F.array_union(F.coalesce("own", none), F.coalesce("given", none)).alias("synonyms"))


def synonym_index(synonyms: DataFrame) -> DataFrame:
    """(label, keys): each normalised synonym with the keys it may stand for."""
    pairs = synonyms.select("key", F.explode("synonyms").alias("s")).select("key", labels_normalised(F.col("s")).alias("label"))
    return pairs.groupBy("label").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def label_keys(labels: DataFrame, index: DataFrame, column: str = "text") -> DataFrame:
    """The labels with each canonical key they may stand for, one row a key; unknown labels have none."""
    return labels.withColumn("label", labels_normalised(F.col(column))).join(index, "label").withColumn("key", F.explode("keys")).drop("keys", "label")


def label_parts(text: Column, x0: Column, x1: Column) -> Column:
    """(text, x0, x1) of each label of a text of two or more that end in colons, with its share of the width; else none."""
    one = r"[^\s:：][^:：]{1,20}[:：]"
    parts = F.regexp_extract_all(text, F.lit(f"({one})"), 1)
    none = F.array().cast("array<string>")
    # where each label starts: what stands before it, the labels before included
    at = F.aggregate(
        F.when(F.size(parts) >= 2, parts).otherwise(none),
        F.struct(F.lit(1).alias("from"), F.array().cast("array<struct<label:string,start:int>>").alias("out")),
        lambda s, p: F.struct((_locate(p, text, s["from"]) + F.length(p)).alias("from"), F.array_append(s["out"], F.struct(p.alias("label"), (_locate(p, text, s["from"]) - 1).cast("int").alias("start"))).alias("out")),
        lambda s: s["out"],
    )
    width = (x1 - x0) / F.length(text)
    found = F.transform(at, lambda p: F.struct(p["label"].alias("text"), (x0 + p["start"] * width).alias("x0"), (x0 + (p["start"] + F.length(p["label"])) * width).alias("x1")))
    return F.when(text.rlike("(?s)[:：].*[:：]"), found).otherwise(F.array().cast("array<struct<text:string,x0:double,x1:double>>"))


def split_labels(spans: DataFrame, text: str = "text") -> DataFrame:
    """Spans of two or more labels that end in colons, cut into one row a label with its share of the width."""
    out = spans.withColumn("_p", F.explode(label_parts(F.col(text), F.col("x0"), F.col("x1"))))
    return out.select(*[c for c in spans.columns if c not in (text, "x0", "x1")], F.col("_p.text").alias(text), F.col("_p.x0").alias("x0"), F.col("_p.x1").alias("x1"))


def _locate(part: Column, text: Column, start: Column) -> Column:
    """First place of ``part`` from ``start`` on, from 1."""
    return F.call_function("locate", part, text, start)


def without_pages(pages: DataFrame, excluded: DataFrame, page: str = "page") -> DataFrame:
    """Pages that stay, renumbered from 1 within their document."""
    kept = pages.join(excluded, ["doc_id", page], "left_anti")
    return kept.withColumn("new_page", F.row_number().over(Window.partitionBy("doc_id").orderBy(page)))
