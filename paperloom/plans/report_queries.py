"""Queries on reports, imports and polls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import access, audit, consistency, jobs, layout, registry, reviews
from paperloom.plans.business_queries import REGISTRY_SQL, _registry
from paperloom.plans.event_queries import _events
from paperloom.plans.finding_queries import _texts
from paperloom.plans.registry import query
from paperloom.session import table


@query("audit_export", "SELECT event_id, 'u' || user_id AS username FROM events WHERE 'u' || user_id = 'u8' AND event_type = 'click' AND ts <= TIMESTAMP '2024-01-20'")
def audit_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.select_events(_events(spark, sf_dir), user="u8", event="click", until="2024-01-20", exact_user=True).select("event_id", "username")


@query("request_report", """
SELECT 'tool ' || user_id % 5 AS tool, count(*) AS n, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failures,
  quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS max,
  round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate, round(count(*) / ((SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 FROM events)), 9) AS per_second
FROM events GROUP BY 1""")
def request_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("tool", F.concat(F.lit("tool "), (F.col("user_id") % 5).cast("string")))
    return jobs.request_report(rows, "tool", "value", F.col("event_type") == "error")


@query("error_classes", """
SELECT 'tool ' || user_id % 5 AS tool, 'HTTP ' || (500 + event_id % 4) AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("tool", F.concat(F.lit("tool "), (F.col("user_id") % 5).cast("string")))
    code = F.concat(F.lit("HTTP "), (500 + F.col("event_id") % 4).cast("string"))
    return jobs.error_classes(rows, "tool", F.when(F.col("event_type") == "error", code))


@query("joint_history", """
WITH s AS (SELECT TIMESTAMP '2024-01-31' - INTERVAL 720 HOUR AS t0), e AS (SELECT ts AS c, ts + INTERVAL 30 HOUR AS f, value FROM events),
p AS (SELECT greatest(0, least(59, floor(epoch_us(c - t0)::DOUBLE / 43200e6))) AS cb, greatest(0, least(59, floor(epoch_us(greatest(c, t0) - t0)::DOUBLE / 43200e6))) AS lo,
  greatest(0, least(59, floor(epoch_us(least(f, TIMESTAMP '2024-01-31') - t0)::DOUBLE / 43200e6))) AS hi, c >= t0 AS fresh, value FROM e, s WHERE f >= t0 OR c >= t0)
SELECT k::INTEGER AS bucket, (SELECT count(*) FROM p WHERE cb = k AND fresh) AS started, (SELECT count(*) FROM p WHERE lo <= k AND hi >= k) AS active,
  (SELECT count(*) FROM p WHERE cb = k AND fresh) AS samples, round((SELECT coalesce(avg(value), 0) FROM p WHERE cb = k AND fresh), 6) AS avg, (SELECT coalesce(max(value), 0) FROM p WHERE cb = k AND fresh) AS max
FROM range(60) AS t(k)""")
def joint_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    work = events.select(F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 30 HOUR")).alias("finished_at"))
    return jobs.joint_history(work, events, "2024-01-31 00:00:00", hours=720, buckets=60).withColumn("avg", F.round("avg", 6))


@query("session_owners", """
SELECT event_id AS session_id, user_id, c_name AS username FROM events JOIN customer ON user_id = c_custkey WHERE ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-15'""")
def session_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _events(spark, sf_dir).filter(F.col("ts") + F.expr("INTERVAL 1 DAY") > F.lit("2024-01-15").cast("timestamp")).select(F.col("event_id").alias("session_id"), "user_id")
    return access.session_owners(live, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username")))


@query("imported_role_perms", """
WITH own AS (SELECT p_brand AS role_id, p_type AS tool_id FROM part WHERE p_size <= 25), named AS (SELECT DISTINCT p_brand AS role_id FROM part WHERE p_size > 48),
new AS (SELECT p_brand AS role_id, p_type || ' new' AS tool_id FROM part WHERE p_size > 40)
SELECT * FROM own WHERE role_id NOT IN (SELECT role_id FROM named) UNION SELECT * FROM new WHERE role_id IN (SELECT role_id FROM named)""")
def imported_role_perms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup of some roles is merged into those of another server."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("role_id"), F.col("p_type").alias("tool_id"), "p_size")
    return access.import_role_perms(part.filter("p_size <= 25"), part.filter("p_size > 48"), part.filter("p_size > 40").withColumn("tool_id", F.concat("tool_id", F.lit(" new"))))


@query("imported_unit_roles", """
WITH r AS (SELECT o_custkey AS unit, ['admin', 'auditor', 'clerk', 'viewer'][1 + o_orderkey % 4] AS role_id, o_orderstatus AS s FROM orders)
SELECT unit, role_id FROM r WHERE s = 'O' UNION SELECT unit, role_id FROM r WHERE s <> 'O' AND role_id NOT IN ('admin', 'auditor')""")
def imported_unit_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("admin", "auditor", "clerk", "viewer")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("role_id"), "o_orderstatus")
    return access.import_unit_roles(rows.filter("o_orderstatus = 'O'"), rows.filter("o_orderstatus <> 'O'"))


@query("registry_filters", f"""
WITH {REGISTRY_SQL} SELECT vat, name, address, category FROM reg WHERE category IN ('small', 'large') AND starts_with(lower(address), 'nation_1') AND contains(industries, 'Y / A')
ORDER BY name, vat LIMIT 200""")
def registry_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registry.search(_registry(spark, sf_dir), categories=["small", "large"], city="Nation_1", industry="Y / A", limit=200)
    return found.select("vat", "name", "address", "category")


@query("registry_filters_by_industry", f"""
WITH {REGISTRY_SQL} SELECT vat, name FROM reg WHERE org_type = 'MACHINERY' AND contains(industries, 'ASIA') ORDER BY name, vat LIMIT 500""")
def registry_filters_by_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.search(_registry(spark, sf_dir), org_type="MACHINERY", industry="ASIA", limit=9999).select("vat", "name")


@query("entity_files", """
WITH e AS (
  SELECT o_orderkey AS file, 'company' AS kind, '大安' || (o_custkey % 40) || '號有限公司' AS value FROM orders
  UNION ALL SELECT o_orderkey, 'case_number', 'AB-' || lpad((o_orderkey % 90)::VARCHAR, 4, '0') || '-77' FROM orders
  UNION ALL SELECT o_orderkey, 'date', strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE year(o_orderdate) >= 2000
  UNION ALL SELECT o_orderkey, 'tax_id', floor(o_totalprice)::BIGINT::VARCHAR FROM orders WHERE length(floor(o_totalprice)::BIGINT::VARCHAR) = 8),
n AS (SELECT kind, value, file, count(*) AS n FROM e GROUP BY ALL)
SELECT kind, value, file, n, (sum(n) OVER (PARTITION BY kind, value))::BIGINT AS total_count FROM n""")
def entity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.entity_files(consistency.entities(_texts(spark, sf_dir)))


@query("repeated_edge_lines", """
WITH l AS (SELECT o_custkey AS doc_id, o_orderkey AS page, o_orderpriority AS text, (o_orderkey * 37 % 800)::DOUBLE AS top FROM orders),
p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY 1), s AS (SELECT doc_id, text, count(DISTINCT page) AS n FROM l WHERE top < 800 * 0.1 OR top > 800 * (1 - 0.1) GROUP BY ALL)
SELECT doc_id, text, n, pages FROM s JOIN p USING (doc_id) WHERE n >= greatest(2, pages // 2)""")
def repeated_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and footers: only lines in the highest and lowest tenth of a page count."""
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), F.col("o_orderpriority").alias("text"), (F.col("o_orderkey") * 37 % 800).cast("double").alias("top"))
    return layout.repeated_lines(lines, where=layout.at_edge(F.col("top"), F.lit(800.0)))


MARKS = """
marks AS (SELECT event_id AS place, user_id % 30 + 1 AS page, event_type AS kind, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'u' || user_id END AS author,
  CASE WHEN event_id % 3 > 0 THEN '=' || props || chr(10) || 'second' END AS content, CASE WHEN event_id % 2 = 0 THEN 'about ' || event_id % 7 END AS subject FROM events)"""


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, at = F.col("user_id"), F.col("event_id")
    author = F.when(user % 4 == 0, "").otherwise(F.concat(F.lit("u"), user.cast("string")))
    content = F.when(at % 3 > 0, F.concat(F.lit("="), "props", F.lit("\nsecond")))
    subject = F.when(at % 2 == 0, F.concat(F.lit("about "), (at % 7).cast("string")))
    return table(spark, sf_dir, "events").select(at.alias("place"), (user % 30 + 1).alias("page"), F.col("event_type").alias("kind"), author.alias("author"), content.alias("content"), subject.alias("subject"))


@query("mark_review", f"""
WITH {MARKS}, r AS (SELECT CASE WHEN author = '' THEN '(未署名)' ELSE author END AS who, place,
  '- **第 ' || page || ' 頁** · ' || kind || ' · ' || who || chr(10) || '  > ' || replace(coalesce(content, '(無內容)'), chr(10), chr(10) || '  > ') AS entry FROM marks)
SELECT who AS "group", place, entry, min(place) OVER (PARTITION BY who) AS first FROM r""")
def mark_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.review(_marks(spark, sf_dir), by="author")


@query("mark_todos", f"""
WITH {MARKS} SELECT place, '- [ ] **第 ' || page || ' 頁**: ' || coalesce(content, subject, kind) || ' _(來源:' || CASE WHEN author = '' THEN '?' ELSE author END || ' · ' || kind || ')_' AS line FROM marks""")
def mark_todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir).select("place", reviews.todo_line().alias("line"))


@query("mark_todo_table", f"""
WITH {MARKS}, t AS (SELECT *, coalesce(content, subject, kind) AS body FROM marks)
SELECT place, '[ ]' AS status, page, CASE WHEN body[1] IN ('=', '+', '-', '@') THEN chr(39) || body ELSE body END AS todo, author AS assignee, '' AS priority, kind AS type, '' AS notes FROM t""")
def mark_todo_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir).select("place", *reviews.todo_row())


@query("text_pairs", r"""
SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f]+$', '') || chr(10) || coalesce(role, '') || chr(10) AS block,
  '| ' || replace(replace(coalesce(text, ''), '|', '\|'), chr(10), '<br>') || ' | ' || coalesce(role, '') || ' |' AS line FROM conversations""")
def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", reviews.pair_text(F.col("text"), F.col("role")).alias("block"), reviews.pair_row(F.col("text"), F.col("role")).alias("line"))


@query("results_from", "SELECT conv_id AS job_id, turn AS at, total FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) WHERE turn >= 2")
def results_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that a poll gets which has seen the first two."""
    return jobs.results_from(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("at")), 2)
