"""Queries on the registry's inverted index, over customers whose numbers are written in Chinese digits as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import search_index
from paperloom.plans.business_queries import REGISTRY_SQL, _registry
from paperloom.plans.registry import query
from paperloom.session import new_path

NAMED = f"""{REGISTRY_SQL}, cjk AS (
  SELECT vat, name || ' ' || translate(vat, '0123456789', '零一二三四五六七八九') || '商行' AS name, left(translate(vat, '01234567', '臺高新桃基苗彰雲'), 8)[8] || '北市' || address AS address, org_type, category, industries FROM reg
), tok AS (SELECT *, regexp_extract_all(lower(name || ' ' || address || ' ' || org_type || ' ' || industries), '[a-z]+|[0-9]+') AS words FROM cjk)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _registry(spark, sf_dir)
    digits = F.translate("vat", "0123456789", "零一二三四五六七八九")
    place = F.substring(F.translate("vat", "01234567", "臺高新桃基苗彰雲"), 8, 1)
    return rows.withColumns({"name": F.concat_ws(" ", "name", F.concat(digits, F.lit("商行"))), "address": F.concat(place, F.lit("北市"), "address")})


def _index(spark: SparkSession, rows: DataFrame) -> search_index.Index:
    return search_index.build(rows, new_path(spark, "registry-index"), buckets=32)


@query("registry_index_search", f"""
WITH {NAMED} SELECT vat, name, address, org_type FROM tok
WHERE contains(name, '一二') AND list_contains(words, 'asia') AND org_type = 'BUILDING' ORDER BY name, vat LIMIT 50""")
def registry_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keywords, one of them a phrase of two characters, in any field."""
    rows = _named(spark, sf_dir)
    return search_index.search(rows, _index(spark, rows), "一二 Asia", org_type="BUILDING").select("vat", "name", "address", "org_type")


@query("registry_index_fields", f"""
WITH {NAMED} SELECT vat, name FROM tok WHERE contains(translate(address, '臺', '台'), '台北') AND NOT contains(address, '#') AND contains(address, '市') ORDER BY name, vat LIMIT 500""")
def registry_index_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase of folded characters in one field."""
    rows = _named(spark, sf_dir)
    return search_index.search(rows, _index(spark, rows), "臺北 市", ("address",), limit=500).select("vat", "name")


@query("registry_index_facets", f"""
WITH {NAMED}, hit AS (SELECT * FROM tok WHERE contains(name, '三')), v AS (
  SELECT 'total' AS facet, '' AS value FROM hit UNION ALL SELECT 'city', translate(address[1:3], '臺', '台') FROM hit WHERE contains(address[1:4], '市') UNION ALL SELECT 'org', org_type FROM hit
  UNION ALL SELECT 'industry', trim(unnest(string_split(industries, '/'))) FROM hit),
c AS (SELECT facet, value, count(*) AS count FROM v GROUP BY ALL)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) <= 8""")
def registry_index_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of matches and their most frequent cities, kinds and industries, from all matches."""
    rows = _named(spark, sf_dir)
    return search_index.totals(search_index.matching(rows, _index(spark, rows), "三"))


@query("registry_token_counts", f"""
WITH {NAMED}, f AS (SELECT vat, unnest([{{'field': 'name', 't': name}}, {{'field': 'industries', 't': industries}}]) AS x FROM tok),
t AS (SELECT vat, x.field AS field, unnest(regexp_extract_all(lower(x.t), '[零一二三四五六七八九商行]|[a-z]+|[0-9]+')) AS token FROM f)
SELECT field, token, count(DISTINCT vat) AS records, count(*) AS places FROM t GROUP BY ALL""")
def registry_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records and places each token of the index has."""
    rows = _named(spark, sf_dir)
    index = search_index.build(rows, new_path(spark, "registry-index"), buckets=32, fields=("name", "industries"))
    return spark.read.parquet(index.path).groupBy("field", "token").agg(F.count("*").alias("records"), F.sum(F.size("places")).alias("places"))
