"""An inverted index of the registry: written once, partitioned by token bucket, searched by reading the buckets of a query's tokens.

A posting is (bucket, token, key, field, places): where in a field of a record a token stands. Postings are dealt by ranges
of (bucket, token, key) and lie sorted in their files, so that a search prunes partitions by bucket and row groups by token,
and a token of many records fills several tasks and files. A keyword of several CJK characters is a phrase: its characters
must follow each other in one field. Keywords are all required, each in any of the asked fields; variants of one character
and case are folded. Empty fields have no postings; keywords without a letter or digit ask for nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import registry as R

FIELDS = ("name", "address", "owner", "org_type", "industries")


@dataclass(frozen=True)
class Index:
    """Where an index lies, and by how many buckets and which fields it was built."""

    path: str
    buckets: int = 256
    fields: tuple[str, ...] = FIELDS


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def build(registry: DataFrame, path: str, buckets: int = 256, key: str = "vat", fields: tuple[str, ...] = FIELDS) -> Index:
    """Write the postings of all records; the folder must be new, and reachable for the driver and all executors."""
    known = tuple(f for f in fields if f in registry.columns)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), R.tokens(F.col(f)).alias("tokens")) for f in known]))
    placed = registry.select(F.col(key).alias("key"), each.alias("x")).select("key", "x.field", F.posexplode("x.tokens").alias("place", "token"))
    rows = placed.groupBy("key", "field", "token").agg(F.array_sort(F.collect_list("place")).alias("places"))
    rows = rows.withColumn("bucket", bucket_of(F.col("token"), buckets))
    rows.repartitionByRange("bucket", "token", "key").sortWithinPartitions("bucket", "token", "key").write.partitionBy("bucket").parquet(path)
    return Index(path, buckets, known)


def keywords(spark: SparkSession, text: str) -> list[list[str]]:
    """The keywords of a query, each as its tokens: the same rule as the index's, applied to this one text."""
    words = [w for w in text.split() if w]
    if not words:
        return []
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(dict.fromkeys(words))], "k int, word string")
    return [r.tokens for r in rows.select("k", R.tokens(F.col("word")).alias("tokens")).orderBy("k").collect() if r.tokens]


def read_postings(spark: SparkSession, index: Index, tokens: list[str]) -> DataFrame:
    """The postings of some tokens: only their buckets' folders are read."""
    asked = spark.createDataFrame([(t,) for t in tokens], "token string").select(bucket_of(F.col("token"), index.buckets).alias("bucket")).distinct()
    buckets = [r.bucket for r in asked.collect()]
    return spark.read.parquet(index.path).filter(F.col("bucket").isin(buckets) & F.col("token").isin(tokens))


def hits(spark: SparkSession, index: Index, text: str, fields: tuple[str, ...] | None = None) -> DataFrame | None:
    """(key) of the records in which every keyword stands; None if the text asks for nothing.

    The posting lists of all tokens meet by record in one shuffle; a record brings no more rows than the query has tokens
    in each field.
    """
    asked = keywords(spark, text)
    if not asked:
        return None
    wanted = [f for f in fields or index.fields if f in index.fields] or list(index.fields)
    lists = read_postings(spark, index, sorted({t for word in asked for t in word}))
    if set(wanted) != set(index.fields):
        lists = lists.filter(F.col("field").isin(wanted))
    held = lists.groupBy("key", "field").agg(F.map_from_entries(F.collect_list(F.struct("token", "places"))).alias("at"))

    def stands(word: list[str]) -> Column:
        first = F.coalesce(F.col("at")[word[0]], F.array().cast("array<int>"))
        follows = [lambda p, k=k, t=t: F.coalesce(F.array_contains(F.col("at")[t], p + k), F.lit(False)) for k, t in enumerate(word[1:], 1)]
        return F.exists(first, lambda p: reduce(lambda a, f: a & f(p), follows, F.lit(True)))

    found = [F.max(stands(word)).alias(f"w{k}") for k, word in enumerate(asked)]
    every = reduce(lambda a, b: a & b, [F.col(f"w{k}") for k in range(len(asked))])
    return held.groupBy("key").agg(*found).filter(every).select("key")


def matching(registry: DataFrame, index: Index, text: str, fields: tuple[str, ...] | None = None, key: str = "vat") -> DataFrame:
    """The records that a query finds, whole; records of equal keys all of them."""
    found = hits(registry.sparkSession, index, text, fields)
    if found is None:
        return registry.limit(0)
    return registry.join(found.withColumnRenamed("key", "_hit"), registry[key] == F.col("_hit"), "left_semi")


def search(registry: DataFrame, index: Index, text: str, fields: tuple[str, ...] | None = None, limit: int = 50, **filters) -> DataFrame:
    """Filtered matches by name, then id; ``filters`` are those of ``registry.filtered``."""
    return R.filtered(matching(registry, index, text, fields), **filters).orderBy("name", "vat").limit(max(1, min(limit, 500)))


def totals(found: DataFrame, k: int = 8) -> DataFrame:
    """(facet, value, count) of all matches: the k most frequent cities, kinds and industries, and the number of matches as
    facet ``total``. Values are ranked in groups first, so that no task sorts all values of a facet."""
    other = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("其他"))
    values = F.array(
        F.struct(F.lit("total").alias("facet"), F.lit("").alias("value")),
        F.struct(F.lit("city").alias("facet"), T.city_of(F.coalesce("address", F.lit(""))).alias("value")),
        F.struct(F.lit("org").alias("facet"), other("org_type").alias("value")),
    )
    industries = F.transform(F.split(F.coalesce("industries", F.lit("")), r"\s*[／/]\s*"), lambda v: F.struct(F.lit("industry").alias("facet"), F.trim(v).alias("value")))
    rows = found.select(F.explode(F.concat(values, F.filter(industries, lambda x: x["value"] != ""))).alias("x")).select("x.*")
    return R.most_frequent(rows.groupBy("facet", "value").agg(F.count("*").alias("count")), k)
