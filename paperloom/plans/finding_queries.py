"""Queries on findings across documents and on layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import consistency, layout
from paperloom.plans.registry import query
from paperloom.session import table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business texts made of the orders: a company, a case number, a date and an amount each."""
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("大安"), (F.col("o_custkey") % 40).cast("string"), F.lit("號有限公司 案號 AB-"), F.lpad((F.col("o_orderkey") % 90).cast("string"), 4, "0"), F.lit("-77 "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 金額 "), F.floor("o_totalprice").cast("string"), F.lit(" 元"))
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


@query("entity_totals", """
WITH e AS (
  SELECT 'company' AS kind, '大安' || (o_custkey % 40) || '號有限公司' AS value FROM orders
  UNION ALL SELECT 'case_number', 'AB-' || lpad((o_orderkey % 90)::VARCHAR, 4, '0') || '-77' FROM orders
  UNION ALL SELECT 'date', strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE year(o_orderdate) >= 2000
  UNION ALL SELECT 'tax_id', floor(o_totalprice)::BIGINT::VARCHAR FROM orders WHERE length(floor(o_totalprice)::BIGINT::VARCHAR) = 8)
SELECT kind, value, count(*)::BIGINT AS total_count, count(*) AS file_count FROM e GROUP BY ALL""")
def entity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.across_files(consistency.entities(_texts(spark, sf_dir)))


@query("entity_outliers", """
WITH t AS (SELECT o_orderstatus AS kind, o_orderpriority || o_custkey % 50 AS value, count(*)::BIGINT AS total_count, count(DISTINCT o_custkey) AS file_count FROM orders GROUP BY ALL),
r AS (SELECT *, first(value) OVER w AS top_value, first(file_count) OVER w AS top_files FROM t WINDOW w AS (PARTITION BY kind ORDER BY file_count DESC, total_count DESC, value))
SELECT kind, value, total_count, file_count, top_value, top_files FROM r WHERE value <> top_value AND top_files >= 2 AND (file_count <= top_files // 2 OR file_count = 1)""")
def entity_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind"), F.concat("o_orderpriority", (F.col("o_custkey") % 50).cast("string")).alias("value"))
    return consistency.outliers(o.agg(F.count("*").alias("total_count"), F.countDistinct("o_custkey").alias("file_count")))


@query("amount_digit_shift", """
WITH a AS (SELECT DISTINCT l_orderkey AS doc, floor(l_extendedprice)::BIGINT AS v FROM lineitem WHERE l_extendedprice >= 10000 UNION SELECT l_orderkey, l_partkey * 10 FROM lineitem WHERE l_partkey * 10 >= 1000)
SELECT DISTINCT x.v AS low, y.v AS high, r::BIGINT AS ratio FROM a x, unnest([10, 100, 1000]) AS t(r), a y WHERE x.v * r = y.v AND x.doc <> y.doc""")
def amount_digit_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    found = lines.filter("l_extendedprice >= 10000").select(F.col("l_orderkey").alias("doc_id"), F.floor("l_extendedprice").cast("long").alias("amount"))
    more = lines.filter("l_partkey * 10 >= 1000").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") * 10).alias("amount"))
    return consistency.digit_shifts(found.union(more).distinct())


@query("duplicate_contents", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.duplicate_groups(table(spark, sf_dir, "documents"))


@query("severity_scores", """
SELECT source AS case_id, count(*) FILTER (toxic = 1) AS fails, count(*) FILTER (toxic = 0 AND quality = 0) AS warns, count(*) FILTER (toxic = 0 AND quality = 1) AS infos,
  greatest(0, 100 - 10 * count(*) FILTER (toxic = 1) - 3 * count(*) FILTER (toxic = 0 AND quality = 0)) AS score FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def severity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("case_id")).join(table(spark, sf_dir, "labels"), "doc_id")
    return consistency.severity_score(joined.withColumn("severity", F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 0, "warn").otherwise("info")))


@query("finding_overrides", """
SELECT doc_id AS finding_key, CASE WHEN doc_id % 5 = 0 THEN 'info' ELSE 'fail' END AS severity, CASE WHEN doc_id % 5 = 0 THEN 'fail' END AS original_severity FROM labels WHERE toxic = 1""")
def finding_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("finding_key"), F.lit("fail").alias("severity"))
    return consistency.apply_overrides(found, found.filter("finding_key % 5 = 0").select("finding_key"))


@query("fuzzy_names", """
WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a FROM part), b AS (SELECT DISTINCT n_name AS b FROM nation UNION SELECT DISTINCT lower(p_brand) FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part)
SELECT a, b, levenshtein(a, b)::INTEGER AS distance FROM a, b WHERE abs(length(a) - length(b)) <= 3 AND levenshtein(a, b) BETWEEN 1 AND 3 AND levenshtein(a, b) < 0.4 * least(length(a), length(b))""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    left = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))
    right = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(part.select(F.lower("p_brand"))).union(part.select(F.split_part("p_name", F.lit(" "), F.lit(2))))
    return consistency.fuzzy_matches(left, right)


@query("size_tiers", "SELECT p_partkey, p_brand, p_size, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INTEGER) AS level FROM part QUALIFY level <= 3")
def size_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.size_tiers(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size")


@query("body_sizes", "WITH s AS (SELECT p_brand, p_size, sum(length(p_name)) AS chars FROM part GROUP BY ALL) SELECT p_brand, arg_max(p_size, (chars, p_size)) AS body_size FROM s GROUP BY 1")
def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.body_size(table(spark, sf_dir, "part"), ["p_brand"], "p_size", F.length("p_name"))


@query("value_clusters", """
WITH g AS (SELECT p_brand, p_retailprice AS v, p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) > 8 AS new FROM part),
c AS (SELECT p_brand, v, sum(coalesce(new, false)::INTEGER) OVER (PARTITION BY p_brand ORDER BY v ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g)
SELECT p_brand, cluster, round(avg(v), 6) AS center, count(*) AS n FROM c GROUP BY ALL""")
def value_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cluster_1d(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", 8.0).withColumn("center", F.round("center", 6))


@query("index_runs", """
WITH i AS (SELECT user_id, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g, event_type FROM events)
SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM i GROUP BY event_type, g HAVING count(*) >= 2""")
def index_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.index_runs(table(spark, sf_dir, "events"), ["event_type"], "event_id")


@query("consecutive_repeats", "SELECT event_id FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
def consecutive_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.drop_repeats(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id")


@query("nearest_right_cells", """
WITH c AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS cell, (l_partkey % 50) * 12.0 AS x0, (l_partkey % 50) * 12.0 + 10 AS x1, (l_orderkey % 40) * 20.0 AS y0, (l_orderkey % 40) * 20.0 + 15 AS y1 FROM lineitem)
SELECT a.page, a.cell, arg_min(b.cell, (b.x0 - a.x1, b.cell)) AS "right" FROM c a JOIN c b ON a.page = b.page AND a.cell <> b.cell AND b.x0 - a.x1 BETWEEN 0 AND 300 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.5 * least(a.y1 - a.y0, b.y1 - b.y0) GROUP BY ALL""")
def nearest_right_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 50) * 12.0, (F.col("l_orderkey") % 40) * 20.0
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell"), x.alias("x0"), (x + 10).alias("x1"), y.alias("y0"), (y + 15).alias("y1"))
    return layout.nearest_right(cells)


@query("repeated_page_lines", """
WITH p AS (SELECT o_custkey AS doc_id, count(DISTINCT o_orderkey) AS pages FROM orders GROUP BY 1), s AS (SELECT o_custkey AS doc_id, o_orderpriority AS text, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY ALL)
SELECT doc_id, text, n, pages FROM s JOIN p USING (doc_id) WHERE n >= greatest(2, pages // 2)""")
def repeated_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.repeated_lines(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), F.col("o_orderpriority").alias("text")))


@query("bin_packing", """
WITH RECURSIVE l AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS "at", sum(l_quantity) AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM lineitem GROUP BY l_suppkey, l_orderkey * 10 + l_linenumber),
r AS (SELECT l_suppkey, "at", k, v AS used, 0.0::DOUBLE AS bin FROM l WHERE k = 1
  UNION ALL SELECT l.l_suppkey, l."at", l.k, CASE WHEN used > 0 AND used + v > 250 THEN v ELSE used + v END, CASE WHEN used > 0 AND used + v > 250 THEN bin + 1 ELSE bin END FROM r JOIN l ON l.l_suppkey = r.l_suppkey AND l.k = r.k + 1)
SELECT l_suppkey, "at", bin FROM r""")
def bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at")
    items = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", at).agg(F.sum("l_quantity").alias("l_quantity"))
    return layout.packed(items, "l_suppkey", "at", "l_quantity", 250.0)


@query("level_repair", """
WITH RECURSIVE p AS (SELECT p_brand, p_partkey, (p_size % 6 + 1)::DOUBLE AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
r AS (SELECT p_brand, p_partkey, k, 1.0::DOUBLE AS level FROM p WHERE k = 1 UNION ALL SELECT p.p_brand, p.p_partkey, p.k, least(v, level + 1) FROM r JOIN p ON p.p_brand = r.p_brand AND p.k = r.k + 1)
SELECT p_brand, p_partkey, level FROM r""")
def level_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.repaired_levels(table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") % 6 + 1).alias("level")), "p_brand", "p_partkey", "level")
