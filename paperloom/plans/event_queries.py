"""Queries on events, jobs and grants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import access, audit, jobs
from paperloom.plans.registry import query
from paperloom.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), "event_type",
        F.lit("10.0.0.1").alias("ip"), F.concat(F.lit("a|b="), F.col("user_id").cast("string")).alias("target"), F.col("props").alias("details_json"), "user_id", "value",
    )


@query("audit_filter", "SELECT event_id, 'u' || user_id AS username FROM events WHERE event_type = 'error' AND contains('u' || user_id, '1') AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.newest(audit.select_events(_events(spark, sf_dir), user="1", event="error", since="2024-01-10", until="no date")).select("event_id", "username")


@query("audit_choices", "SELECT DISTINCT 'event_type' AS kind, event_type AS value FROM events UNION ALL SELECT DISTINCT 'username', 'u' || user_id FROM events")
def audit_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.choices(_events(spark, sf_dir))


@query("audit_details", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def audit_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", audit.detail("k").alias("k"))


@query("audit_user_activity", "SELECT 'u' || user_id AS username, count(*) AS files, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS bytes FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 0 GROUP BY 1")
def audit_user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.user_activity(_events(spark, sf_dir), "k")


@query("audit_cef", r"SELECT event_id, 'CEF:0|own|engine|1|' || event_type || '|' || event_type || '|5|src=10.0.0.1 suser=u' || user_id || ' act=' || event_type || ' target=a\|b\=' || user_id || ' msg=' || replace(replace(replace(props, '\', '\\'), '=', '\='), '|', '\|') || ' rt=' || epoch_us(ts) // 1000 AS line FROM events")
def audit_cef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", audit.as_cef("own", "engine").alias("line"))


@query("audit_syslog_prefix", "SELECT event_id, '<133>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z host engine - ' || event_type || ' - ' AS prefix FROM events")
def audit_syslog_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.regexp_extract(audit.as_syslog("host", "engine"), r"^([^{]*)\{", 1).alias("prefix"))


@query("audit_gelf_level", "SELECT event_id, '5' AS level, event_type AS short_message FROM events")
def audit_gelf_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = audit.as_gelf("host")
    return _events(spark, sf_dir).select("event_id", F.get_json_object(line, "$.level").alias("level"), F.get_json_object(line, "$.short_message").alias("short_message"))


@query("retention", "SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view') OR (event_type = 'click' AND ts >= TIMESTAMP '2024-01-20') OR event_type = 'view'")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-30").cast("timestamp")
    return audit.retained(_events(spark, sf_dir), now, {"click": 10, "view": -1}, category="event_type").select("event_id")


@query("newest_per_user", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def newest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _events(spark, sf_dir).withColumn("order", F.struct("ts", "event_id"))
    return audit.keep_newest(ranked, 3, "user_id", "order").select("event_id", "user_id")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each line: from the order's day to its shipping."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("created_at"), "o_custkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("finished_at"), "l_extendedprice", "l_shipmode" if "l_shipmode" in table(spark, sf_dir, "lineitem").columns else F.col("l_returnflag").alias("l_shipmode"))
    return lines.join(o, lines.l_orderkey == o.o_orderkey)


JOBS = "SELECT o_orderdate AS c, least(l_shipdate, TIMESTAMP '1998-12-01') AS f, l_shipdate AS raw FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query("job_history", f"""
WITH j AS (SELECT c, f FROM ({JOBS}) WHERE raw >= TIMESTAMP '1998-12-01' - INTERVAL 720 HOUR OR c >= TIMESTAMP '1998-12-01' - INTERVAL 720 HOUR),
b AS (SELECT k AS bucket FROM range(48) AS t(k)),
p AS (SELECT c, greatest(0, least(47, floor(epoch_us(c - (TIMESTAMP '1998-12-01' - INTERVAL 720 HOUR))::DOUBLE / 54000e6))) AS cb,
  greatest(0, least(47, floor(epoch_us(greatest(c, TIMESTAMP '1998-12-01' - INTERVAL 720 HOUR) - (TIMESTAMP '1998-12-01' - INTERVAL 720 HOUR))::DOUBLE / 54000e6))) AS lo,
  greatest(0, least(47, floor(epoch_us(f - (TIMESTAMP '1998-12-01' - INTERVAL 720 HOUR))::DOUBLE / 54000e6))) AS hi FROM j)
SELECT bucket::INTEGER AS bucket, (SELECT count(*) FROM p WHERE cb = bucket AND c >= TIMESTAMP '1998-12-01' - INTERVAL 720 HOUR) AS started, (SELECT count(*) FROM p WHERE lo <= bucket AND hi >= bucket) AS active FROM b""")
def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_history(_jobs(spark, sf_dir), "1998-12-01 00:00:00", hours=720, buckets=48)


@query("metric_history", """
WITH e AS (SELECT greatest(0, least(95, floor(epoch_us(ts - (TIMESTAMP '2024-01-15' - INTERVAL 240 HOUR))::DOUBLE / 9000e6)))::INTEGER AS bucket, value FROM events WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 240 HOUR)
SELECT k::INTEGER AS bucket, count(value) AS samples, coalesce(avg(value), 0) AS avg, coalesce(max(value), 0) AS max FROM range(96) AS t(k) LEFT JOIN e ON bucket = k GROUP BY k""")
def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.metric_history(_events(spark, sf_dir), "2024-01-15 00:00:00", hours=240, buckets=96)


@query("queue_order", """
SELECT o_orderkey AS id, CASE o_custkey WHEN 1 THEN 1 WHEN 7 THEN 2 WHEN 4 THEN 3 END::INTEGER AS priority, row_number() OVER (ORDER BY CASE o_custkey WHEN 1 THEN 1 WHEN 7 THEN 2 WHEN 4 THEN 3 END NULLS LAST, o_orderdate, o_orderkey)::INTEGER AS place FROM orders WHERE o_orderstatus = 'P'""")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderdate").alias("created_at"))
    ranks = {u: k for k, u in enumerate(jobs.clean_priorities([1, 7, "x", 7, 0, 4]), 1)}
    return jobs.queue_order(waiting, ranks).select("id", "priority", "place")


@query("latency_percentiles", """
SELECT event_type, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS max FROM events GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latency(table(spark, sf_dir, "events"), "event_type", "value")


@query("job_inbox", """
SELECT o_custkey AS owner_id, count(*) AS finished, count(*) FILTER (o_orderdate > CASE WHEN o_custkey % 2 = 0 THEN TIMESTAMP '1995-06-01' ELSE TIMESTAMP '1900-01-01' END) AS unread FROM orders GROUP BY 1""")
def job_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner_id"), F.col("o_orderdate").cast("timestamp").alias("finished_at"))
    seen = done.select("owner_id").distinct().filter("owner_id % 2 = 0").withColumn("last_seen", F.lit("1995-06-01").cast("timestamp"))
    return jobs.inbox(done, seen)


@query("lockout_replay", """
WITH RECURSIVE e AS (SELECT 'u' || user_id AS key, epoch_us(ts)::DOUBLE / 1e6 AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'error') AS k FROM events),
r(key, k, n, last, hit, t) AS (
  SELECT key, k, CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN ok THEN NULL ELSE t END, false, t FROM e WHERE k = 1
  UNION ALL SELECT e.key, e.k, CASE WHEN e.ok THEN 0 ELSE c.n % 3 END, CASE WHEN e.ok THEN NULL ELSE e.t END, NOT e.ok AND c.n = 3, e.t
  FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1, LATERAL (SELECT CASE WHEN r.last IS NULL OR e.t - r.last > 259200 THEN 1 ELSE r.n + 1 END AS n) c)
SELECT key, make_timestamp(round(t * 1e6)::BIGINT) AS ts, make_timestamp(round((t + 900) * 1e6)::BIGINT) AS locked_until FROM r WHERE hit""")
def lockout_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("username", "ts", (F.col("event_type") != "error").alias("ok"))
    return jobs.replay_lockouts(events, threshold=3, window_s=86400 * 3, key="username")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations below regions below one root."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("root").alias("parent"))
    return n.union(r)


GROUPS = "g AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region)"


@query("group_closure", f"""
WITH RECURSIVE {GROUPS}, a(node, ancestor, depth) AS (
  SELECT DISTINCT n, n, 0 FROM (SELECT child AS n FROM g UNION SELECT parent FROM g) UNION ALL SELECT a.node, g.parent, a.depth + 1 FROM a JOIN g ON a.ancestor = g.child WHERE a.depth < 10)
SELECT node, ancestor, depth FROM a""")
def group_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.ancestors(_groups(spark, sf_dir))


@query("effective_tools", """
SELECT c_custkey AS user_id, CASE WHEN c_nationkey = 3 THEN [] WHEN c_nationkey = 5 THEN ['*'] ELSE list_sort(list_distinct(['tool-r' || n_regionkey, 'base'] || CASE WHEN c_custkey % 10 = 0 THEN ['own'] ELSE [] END)) END AS tools
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def effective_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    members = users.select(F.col("id").alias("user_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("group_id"))
    roles = spark.createDataFrame([("group", "n3", "auditor"), ("group", "n5", "admin"), ("group", "root", "basic"), *(("group", f"r{k}", f"role{k}") for k in range(5))], "subject_type string, subject_key string, role_id string")
    perms = spark.createDataFrame([("basic", "base"), *((f"role{k}", f"tool-r{k}") for k in range(5))], "role_id string, tool_id string")
    direct = users.filter("id % 10 = 0").select(F.lit("user").alias("subject_type"), F.col("id").cast("string").alias("subject_key"), F.lit("own").alias("tool_id"))
    subjects = access.user_subjects(users, members, access.ancestors(_groups(spark, sf_dir)))
    return access.effective_tools(subjects, roles, perms, direct)


@query("tree_order", """
WITH t AS (SELECT 'root' AS id, 0 AS depth, 'root' AS path UNION ALL SELECT 'r' || r_regionkey, 1, 'root/' || r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 2, 'root/' || r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT * FROM t""")
def tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = spark.createDataFrame([("root", None, "root")], "id string, parent_id string, name string")
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.lit("root"), "r_name")
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name")
    found = access.tree_order(root.union(r).union(n))
    return found.select("id", "depth", F.array_join("path", "/").alias("path"))


@query("directory_tree", """
WITH m AS (SELECT lower('CN=' || n_name || ',OU=' || r_name || ',OU=world,DC=own,DC=net') AS dn, lower('OU=' || r_name || ',OU=world,DC=own,DC=net') AS p FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT dn, true AS matched, 5 AS depth, p AS parent_dn FROM m UNION SELECT p, false, 4, 'ou=world,dc=own,dc=net' FROM m UNION SELECT 'ou=world,dc=own,dc=net', false, 3, 'dc=own,dc=net'""")
def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return access.matched_tree(rows.select(F.concat(F.lit("CN="), "n_name", F.lit(", OU="), "r_name", F.lit(",OU=world,DC=own,DC=net")).alias("dn")))


@query("online_users", """
SELECT count(DISTINCT user_id) AS users, count(*) AS sessions FROM events WHERE ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-15' AND ts > TIMESTAMP '2024-01-15' - INTERVAL 600 MINUTE""")
def online_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select("user_id", ts.alias("created_at"), F.lit(None).cast("timestamp").alias("last_seen_at"), (ts + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    return access.online_users(rows, F.lit("2024-01-15").cast("timestamp"), 600)
