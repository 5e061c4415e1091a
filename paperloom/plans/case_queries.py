"""Queries on cases, accounts and page geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import access, audit, consistency, deident, invoices, layout
from paperloom.plans.registry import query
from paperloom.session import table


@query("items_paired", """
WITH i AS (SELECT o_custkey AS batch_id, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O'),
t AS (SELECT o_custkey AS batch_id, o_orderpriority AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F')
SELECT coalesce(i.batch_id, t.batch_id) AS batch_id, pos, coalesce(item, '') AS items FROM i FULL JOIN t ON i.batch_id = t.batch_id AND i.k = t.k""")
def items_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("pos"), F.array("o_orderpriority").alias("items"))
    out = invoices.pair_items(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"))
    return out.select("batch_id", "pos", F.coalesce(F.array_join("items", " / "), F.lit("")).alias("items"))


@query("attachment_numbers", """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE (o_orderkey % 12)::INTEGER END AS declared, (o_custkey % 12)::INTEGER AS actual,
  CASE WHEN o_orderkey % 3 = 0 THEN false ELSE o_orderkey % 12 > 0 AND abs(o_orderkey % 12 - o_custkey % 12) > 1 END AS mismatch FROM orders""")
def attachment_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, "無").otherwise(F.concat(F.lit("附件 "), (F.col("o_orderkey") % 12).cast("string")))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"), (F.col("o_custkey") % 12).cast("int").alias("n"))
    return consistency.declared_attachments(docs, F.col("n"))


@query("expiring_dates", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE > DATE '1996-01-01' AND o_orderdate::DATE < DATE '1996-01-31'")
def expiring_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return consistency.expiring(days, F.lit("1996-01-01").cast("date"), 30)


@query("case_dashboard", """
WITH c AS (SELECT o_orderkey AS case_id, o_orderstatus AS status, o_totalprice AS score FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'),
f AS (SELECT l_shipinstruct AS category, count(*) AS n FROM (SELECT l_orderkey, l_returnflag || l_linenumber AS l_shipinstruct FROM lineitem) JOIN c ON l_orderkey = case_id GROUP BY 1 ORDER BY n DESC, category LIMIT 10)
SELECT 'status' AS kind, status AS value, count(*) AS n FROM c GROUP BY status UNION ALL SELECT 'category', category, n FROM f UNION ALL SELECT 'score_tenths', 'avg', round(avg(score) * 10)::BIGINT FROM c""")
def case_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("category"))
    return consistency.dashboard(cases, found, F.lit("1997-01-01").cast("timestamp"))


@query("account_views", """
WITH u AS (SELECT c_custkey AS id, c_custkey % 3 > 0 AS enabled, CASE WHEN c_custkey % 2 = 0 THEN 'directory' ELSE 'local' END AS source, c_custkey % 10 = 0 AS gone, CASE WHEN c_custkey % 7 = 0 THEN true WHEN c_custkey % 7 = 1 THEN false END AS dir_disabled, c_custkey % 40 - 5 AS left_days FROM customer)
SELECT 'active' AS view, count(*) AS n FROM u WHERE enabled UNION ALL SELECT 'directory', count(*) FROM u WHERE source = 'directory' UNION ALL SELECT 'missing', count(*) FROM u WHERE source = 'directory' AND gone
UNION ALL SELECT 'dir_disabled', count(*) FROM u WHERE dir_disabled UNION ALL SELECT 'pwd_expiring', count(*) FROM u WHERE left_days BETWEEN 0 AND 14""")
def account_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, key = F.lit("2024-01-01").cast("timestamp"), F.col("c_custkey")
    users = table(spark, sf_dir, "customer").select(
        key.alias("id"), (key % 3 > 0).alias("enabled"), F.when(key % 2 == 0, "directory").otherwise("local").alias("source"), F.when(key % 10 == 0, now).alias("missing_since"),
        F.when(key % 7 == 0, True).when(key % 7 == 1, False).alias("dir_disabled"), (now + F.make_dt_interval((key % 40 - 5).cast("int"), F.lit(1))).alias("pwd_expires"),
    )
    out = None
    for view in ("active", "directory", "missing", "dir_disabled", "pwd_expiring"):
        one = access.user_view(users, view, True, now).agg(F.count("*").alias("n")).select(F.lit(view).alias("view"), "n")
        out = one if out is None else out.union(one)
    return out


@query("overlapping_spans", """
WITH s AS (SELECT l_orderkey AS doc_id, l_partkey % 100 AS a, l_partkey % 100 + l_quantity::BIGINT AS b, l_linenumber FROM lineitem), t AS (SELECT * FROM s WHERE l_linenumber = 1)
SELECT doc_id, a AS start, b AS "end" FROM s WHERE l_linenumber > 1 AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = s.doc_id AND s.a < t.b AND t.a < s.b)""")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 100).alias("start"), (F.col("l_partkey") % 100 + F.col("l_quantity").cast("long")).alias("end"))
    return deident.drop_overlapping(spans.filter("l_linenumber > 1"), spans.filter("l_linenumber = 1")).select("doc_id", "start", "end")


@query("box_unions", "SELECT l_suppkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity + 1) AS x1, max(l_discount + 1) AS y1 FROM lineitem GROUP BY 1")
def box_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"), (F.col("l_quantity") + 1).alias("x1"), (F.col("l_discount") + 1).alias("y1"))
    return layout.bounding_boxes(boxes, "l_suppkey")


@query("two_columns", """
WITH b AS (SELECT l_suppkey AS page, (CASE WHEN l_linenumber % 2 = 0 AND l_suppkey % 2 = 0 THEN 400 ELSE 0 END + l_partkey % 150)::DOUBLE AS center FROM lineitem),
g AS (SELECT page, center, lead(center) OVER w AS nxt, row_number() OVER w AS k, count(*) OVER (PARTITION BY page) AS n FROM b WINDOW w AS (PARTITION BY page ORDER BY center)),
m AS (SELECT * FROM g WHERE nxt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page ORDER BY nxt - center DESC, k) = 1)
SELECT page, (center + nxt) / 2 AS boundary FROM m WHERE nxt - center >= 90 AND n >= 6 AND k >= 2 AND n - k >= 2""")
def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = F.when((F.col("l_linenumber") % 2 == 0) & (F.col("l_suppkey") % 2 == 0), 400).otherwise(0)
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (shift + F.col("l_partkey") % 150).cast("double").alias("center"))
    return layout.two_columns(blocks)


@query("activity_sessions", """
WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS new FROM events),
s AS (SELECT user_id, ts, sum(coalesce(new, false)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, s""")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query("mark_summary", "SELECT o_orderpriority AS kind, o_orderstatus AS author, count(*) AS n, count(DISTINCT o_custkey) AS pages FROM orders GROUP BY ALL")
def mark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks by kind and author, on how many pages."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("author")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("pages"))


@query("case_board", """
WITH c AS (SELECT o_orderkey AS case_id, o_orderstatus AS status, o_totalprice AS score, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 4 END AS n_files, ['text', 'layout', 'rules'][1:o_orderkey % 4] AS layers FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'),
f AS (SELECT l_returnflag || l_linenumber AS category, ['info', 'warn', 'fail'][1 + l_linenumber % 3] AS severity FROM lineitem JOIN c ON l_orderkey = case_id)
SELECT 'status' AS kind, status AS value, count(*) AS n FROM c GROUP BY status UNION ALL (SELECT 'category', category, count(*) AS n FROM f GROUP BY category ORDER BY n DESC, category LIMIT 10)
UNION ALL SELECT 'score_tenths', 'avg', round(avg(score) * 10)::BIGINT FROM c UNION ALL SELECT 'files_total', 'all', coalesce(sum(n_files), 0)::BIGINT FROM c
UNION ALL SELECT 'layer', layer, count(*) FROM (SELECT unnest(layers) AS layer FROM c) GROUP BY layer UNION ALL SELECT 'severity', severity, count(*) FROM f GROUP BY severity""")
def case_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases since a day: states, files, score, finished layers, categories and severities of their findings."""
    layers = F.slice(F.array(*map(F.lit, ("text", "layout", "rules"))), F.lit(1), (F.col("o_orderkey") % 4).cast("int"))
    n_files = F.col("o_custkey") % 4
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(n_files > 0, n_files).alias("n_files"), layers.alias("layers"))
    line = F.col("l_linenumber")
    severity = F.get(F.array(*map(F.lit, ("info", "warn", "fail"))), line % 3)
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat("l_returnflag", line.cast("string")).alias("category"), severity.alias("severity"))
    return consistency.case_board(cases, found, F.lit("1997-01-01").cast("timestamp"))


@query("page_bytes", """
WITH p AS (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents ORDER BY doc_id DESC LIMIT 40 OFFSET 40)
SELECT count(*) AS rows, sum(n)::BIGINT AS bytes FROM p""")
def page_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of the second page of a list, newest first, summed over that page only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    return audit.page_sum(docs, [F.desc("doc_id")], 2, 40, "n").withColumnRenamed("n", "bytes")
