"""Counts, term frequencies and rollups of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

MEASURES = ("char_total", "char_no_ws", "cjk_chars", "en_words", "numbers", "word_total", "paragraphs", "sentences", "lines")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(docs[id_col], *[c.alias(n) for n, c in T.char_classes(F.coalesce(docs[text_col], F.lit(""))).items()])


def counts(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    out = docs.select(*keep, *[c.alias(n) for n, c in T.text_counts(F.coalesce(docs[text_col], F.lit(""))).items()])
    return out.withColumn("reading_min", T.reading_minutes(F.col("cjk_chars"), F.col("en_words")))


def rollup(counted: DataFrame, *by: str) -> DataFrame:
    """Sums over documents, the average of words, and the rank by words; one partial sum a task before the shuffle."""
    summed = counted.groupBy(*by).agg(F.count("*").alias("file_count"), *[F.sum(m).alias(m) for m in MEASURES])
    return summed.withColumn("avg_words_per_file", F.bround(F.col("word_total").cast("decimal(30,6)") / F.col("file_count"), 1).cast("double"))


def word_terms(docs: DataFrame, *by: str, text_col: str = "text") -> DataFrame:
    """(by, term, at) of English words that count as terms."""
    terms = docs.select(*by, F.posexplode(F.regexp_extract_all(docs[text_col], F.lit(T.WORD), 0)).alias("at", "term"))
    terms = terms.withColumn("term", F.lower("term"))
    return terms.filter((F.length("term") >= 2) & ~F.col("term").isin(*T.STOP_WORDS))


def cjk_terms(docs: DataFrame, *by: str, text_col: str = "text") -> DataFrame:
    return docs.select(*by, F.posexplode(F.regexp_extract_all(docs[text_col], F.lit(T.CJK), 0)).alias("at", "term"))


def cjk_bigrams(docs: DataFrame, *by: str, text_col: str = "text") -> DataFrame:
    """Adjacent pairs of CJK characters: all pairs of each run of them."""
    pairs = F.regexp_extract_all(docs[text_col], F.lit(f"(?=({T.CJK}{T.CJK}))"), 1)
    return docs.select(*by, F.posexplode(pairs).alias("at", "term"))


def top_terms(terms: DataFrame, k: int, *by: str) -> DataFrame:
    """The k most frequent terms of each group, ties by first place, then term."""
    counted = terms.groupBy(*by, "term").agg(F.count("*").alias("count"), F.min("at").alias("first_at"))
    order = Window.partitionBy(*by).orderBy(F.desc("count"), "first_at", "term")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("first_at")


def by_page_and_overall(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, page, chars, words) of every page and, with a null page, of the whole document; one shuffle for both."""
    counted = pages.select(doc, page, F.length(text).cast("long").alias("chars"), F.size(F.split(text, " ", -1)).cast("long").alias("words"))
    return counted.groupingSets([[F.col(doc), F.col(page)], [F.col(doc)]], F.col(doc), F.col(page)).agg(F.sum("chars").alias("chars"), F.sum("words").alias("words"))
