"""Queries on personal data, checks and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import checks
from paperloom.operators import deident, diff
from paperloom.plans.registry import query
from paperloom.session import by_key, table


@query("pii_findings")
def pii_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of the default patterns."""
    return deident.findings(deident.detect(table(spark, sf_dir, "documents")))


@query("pii_masked_texts")
def pii_masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = deident.detect(table(spark, sf_dir, "documents"), mode="mask")
    return masked.select("doc_id", F.size("spans").alias("n_spans"), F.sha2("text", 256).alias("masked_sha256"))


@query("pii_email_ip_counts", r"""
SELECT doc_id, len(regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b')) AS emails,
  len(regexp_extract_all(text, '\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\b')) AS ips,
  len(regexp_extract_all(text, '\b[a-fA-F0-9]{40}\b')) AS sha1s
FROM documents""")
def pii_email_ip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counting path stays in the JVM; word borders are spelt out, so that accents count as letters there too."""
    left, right = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    octet = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
    kinds = {
        "emails": rf"{left}[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}{right}",
        "ips": rf"{left}(?:{octet}\.){{3}}{octet}{right}",
        "sha1s": rf"{left}[a-fA-F0-9]{{40}}{right}",
    }
    return table(spark, sf_dir, "documents").select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in kinds.items()])


@query("business_id_check", r"""
WITH k AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS vat FROM customer),
d AS (SELECT *, list_transform(range(1, 9), lambda i: CAST(vat[i:i] AS INTEGER) * [1,2,1,2,1,2,4,1][i]) AS p FROM k),
t AS (SELECT *, list_sum(list_transform(p, lambda x: x // 10 + x % 10)) AS total FROM d)
SELECT c_custkey, vat, total % 10 = 0 OR (vat[7:7] = '7' AND (total + 1) % 10 = 0) AS valid FROM t""")
def business_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("vat"))
    return found.withColumn("valid", checks.business_id_valid(F.col("vat")))


@query("national_id_check", r"""
WITH k AS (SELECT o_orderkey, 'A' || (1 + o_orderkey % 2) || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS v FROM orders)
SELECT o_orderkey, v, (1 * 1 + 0 * 9 + list_sum(list_transform(range(1, 10), lambda i: CAST(v[i + 1:i + 1] AS INTEGER) * [8,7,6,5,4,3,2,1,1][i]))) % 10 = 0 AS valid FROM k""")
def national_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("A"), (1 + key % 2).cast("string"), F.lpad(key.cast("string"), 8, "0")).alias("v"))
    return made.withColumn("valid", checks.national_id_valid(F.col("v")))


@query("card_luhn_check", r"""
WITH k AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 4000000000000000 AS VARCHAR), 16, '0') AS v FROM orders)
SELECT o_orderkey, v, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (CAST(v[i:i] AS INTEGER) * 2) // 10 + (CAST(v[i:i] AS INTEGER) * 2) % 10 ELSE CAST(v[i:i] AS INTEGER) END)) % 10 = 0 AS valid FROM k""")
def card_luhn_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919 + F.lit(4000000000000000)).cast("string"), 16, "0").alias("v"))
    return made.withColumn("valid", checks.card_valid(F.col("v")))


@query("turn_line_diff")
def turn_line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the next of its conversation."""
    turns = table(spark, sf_dir, "conversations")
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_b"))
    pairs = turns.join(nxt, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("pair_id"), F.col("text").alias("text_a"), "text_b")
    found = diff.line_diff(pairs)
    return found.select("pair_id", "added", "removed", "changed", "chars_added", "chars_removed", F.size("rows").alias("rows"))


@query("role_key_diff", """
WITH a AS (SELECT conv_id::VARCHAR AS key, min(text) AS v FROM conversations WHERE role = 'user' GROUP BY 1),
b AS (SELECT conv_id::VARCHAR AS key, max(text) AS v FROM conversations WHERE role = 'user' AND turn > 0 GROUP BY 1)
SELECT key, coalesce(a.v, '') AS a, coalesce(b.v, '') AS b FROM a FULL JOIN b USING (key) WHERE coalesce(a.v, '') <> coalesce(b.v, '')""")
def role_key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("conv_id").cast("string").alias("key"), "turn", "text")
    a = users.groupBy("key").agg(F.min("text").alias("v"))
    b = users.filter("turn > 0").groupBy("key").agg(F.max("text").alias("v"))
    return diff.key_diff(a, b, "key", "v")


FORM_CELLS = """
i AS (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS l_shipdate, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL),
f AS (SELECT l_orderkey AS page, l_linenumber AS n, l_shipdate AS d,
  CASE l_linenumber % 4 WHEN 1 THEN '出生日期' WHEN 2 THEN '備註' WHEN 3 THEN '生日' ELSE strftime(l_shipdate, '%Y.%m.%d') END AS label,
  CASE l_linenumber % 4 WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 2 THEN 'user' || l_partkey || '@example.com' ELSE 'n/a' END AS value FROM i)"""


@query("form_personal_data", f"""
WITH {FORM_CELLS}
SELECT page, n * 10 + 1 AS cell, 'dob' AS type, value, '****-**-**' AS masked FROM f WHERE n % 4 = 1
UNION ALL SELECT page, n * 10, 'dob', label, '****-**-**' FROM f WHERE n % 4 = 0 AND EXISTS (SELECT 1 FROM f g WHERE g.page = f.page AND g.n = f.n - 1)
UNION ALL SELECT page, n * 10 + 1, 'email', value, NULL FROM f WHERE n % 4 = 2""")
def form_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of birth whose label stands in the cell at the left or above, and addresses that need no label."""
    n, day = F.col("l_linenumber"), F.col("l_shipdate")
    label = F.when(n % 4 == 1, "出生日期").when(n % 4 == 2, "備註").when(n % 4 == 3, "生日").otherwise(F.date_format(day, "yyyy.MM.dd"))
    value = F.when(n % 4 == 1, F.date_format(day, "yyyy-MM-dd")).when(n % 4 == 2, F.concat(F.lit("user"), F.col("l_partkey").cast("string"), F.lit("@example.com"))).otherwise("n/a")
    both = F.explode(F.array(F.struct(F.lit(0).alias("k"), label.alias("text")), F.struct(F.lit(1).alias("k"), value.alias("text"))))
    own = by_key(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey"), "l_orderkey")
    items = own.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("l_shipdate"), F.min("l_partkey").alias("l_partkey"))
    rows = items.select(F.col("l_orderkey").alias("page"), n.alias("n"), both.alias("c"))
    x = 50.0 + 100 * F.col("c.k")
    cells = rows.select("page", (F.col("n") * 10 + F.col("c.k")).alias("cell"), "c.text", x.alias("x0"), (x + 80).alias("x1"), (F.col("n") * 20.0).alias("y0"), (F.col("n") * 20.0 + 15).alias("y1"))
    found = deident.across_cells(cells, ("dob", "email"))
    return found.select("page", "cell", "type", "value", F.when(F.col("type") == "dob", F.col("masked")).alias("masked"))
