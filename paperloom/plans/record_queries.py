r"""Queries on accounts, jobs, invoices, forms and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import business as B
from paperloom.functions import text as T
from paperloom.operators import access, audit, consistency, deident, forms, invoices, jobs, receipts, segments
from paperloom.plans.registry import query
from paperloom.session import table

# ---- accounts and cases

GRANTS = """
s AS (SELECT c_custkey AS user_id, 'user' AS kind, c_custkey::VARCHAR AS key FROM customer UNION ALL SELECT c_custkey, 'group', 'n' || c_nationkey FROM customer),
roles AS (SELECT 'group' AS kind, 'n' || n_nationkey AS key, 'role' || n_regionkey AS role FROM nation),
perms AS (SELECT 'role' || r_regionkey AS role, 'tool-' || r_name AS tool FROM region UNION ALL SELECT 'role1', 'extra'),
direct AS (SELECT 'user' AS kind, c_custkey::VARCHAR AS key, 'extra' AS tool FROM customer WHERE c_custkey % 10 = 0)"""


def _grants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    text = lambda c: F.col(c).cast("string")
    customers, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    subjects = customers.select(F.col("c_custkey").alias("user_id"), F.lit("user").alias("subject_type"), text("c_custkey").alias("subject_key"))
    subjects = subjects.union(customers.select("c_custkey", F.lit("group"), F.concat(F.lit("n"), text("c_nationkey"))))
    roles = nation.select(F.lit("group").alias("subject_type"), F.concat(F.lit("n"), text("n_nationkey")).alias("subject_key"), F.concat(F.lit("role"), text("n_regionkey")).alias("role_id"))
    perms = region.select(F.concat(F.lit("role"), text("r_regionkey")).alias("role_id"), F.concat(F.lit("tool-"), "r_name").alias("tool_id")).union(spark.range(1).select(F.lit("role1"), F.lit("extra")))
    direct = customers.filter("c_custkey % 10 = 0").select(F.lit("user").alias("subject_type"), text("c_custkey").alias("subject_key"), F.lit("extra").alias("tool_id"))
    return subjects, roles, perms, direct


@query("grant_provenance", f"""
WITH {GRANTS}, r AS (
  SELECT user_id, tool AS tool_id, 'role:' || roles.role || ' via ' || s.kind AS reason FROM s JOIN roles ON s.kind = roles.kind AND s.key = roles.key JOIN perms ON perms.role = roles.role
  UNION SELECT user_id, tool, 'direct via ' || s.kind FROM s JOIN direct ON s.kind = direct.kind AND s.key = direct.key)
SELECT user_id, tool_id, list_sort(list(reason)) AS reasons FROM r GROUP BY ALL""")
def grant_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.provenance(*_grants(spark, sf_dir))


@query("group_members", """
SELECT n_nationkey AS id, n_name AS name, coalesce((SELECT list_sort(list(c_custkey::VARCHAR)) FROM customer WHERE c_nationkey = n_nationkey), []) AS members,
  CASE WHEN n_nationkey % 2 = 0 THEN ['role' || n_regionkey] ELSE [] END AS roles FROM nation""")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("user_id"))
    roles = nation.filter("n_nationkey % 2 = 0").select(F.lit("group").alias("subject_type"), F.col("n_nationkey").cast("string").alias("subject_key"), F.concat(F.lit("role"), F.col("n_regionkey").cast("string")).alias("role_id"))
    return access.members_and_roles(nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), members, roles)


@query("storage_and_activity", """
WITH s AS (SELECT 'u' || o_custkey AS username, count(*) AS stored, sum(o_orderkey)::BIGINT AS stored_bytes FROM orders GROUP BY 1), a AS (SELECT 'u' || user_id AS username, count(*) AS files, sum(event_id + 1)::BIGINT AS bytes FROM events GROUP BY 1)
SELECT coalesce(s.username, a.username) AS username, coalesce(stored, 0) AS stored, coalesce(stored_bytes, 0) AS stored_bytes, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes FROM s FULL JOIN a ON s.username = a.username""")
def storage_and_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    storage = table(spark, sf_dir, "orders").groupBy(user("o_custkey").alias("username")).agg(F.count("*").alias("stored"), F.sum("o_orderkey").alias("stored_bytes"))
    events = table(spark, sf_dir, "events").select(user("user_id").alias("username"), F.to_json(F.struct((F.col("event_id") + 1).alias("size_bytes"))).alias("details_json"))
    return audit.storage_and_activity(storage, audit.user_activity(events))


@query("visible_cases", """
SELECT o_orderkey AS case_id, o_orderdate AS created_at FROM orders WHERE o_orderpriority = '3-MEDIUM' AND o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200""")
def visible_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("owner"), (F.col("o_orderstatus") == "F").alias("deleted"))
    return access.visible_cases(cases, "3-MEDIUM", False).select("case_id", "created_at")


@query("orphan_files", "SELECT o_orderkey AS upload_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("upload_id"))
    return access.orphans(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("upload_id")), owners)


@query("account_search", "SELECT c_name AS username, c_mktsegment AS display_name FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), '1 m') ORDER BY c_name LIMIT 20")
def account_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.find_accounts(table(spark, sf_dir, "customer").select(F.col("c_name").alias("username"), F.col("c_mktsegment").alias("display_name")), " 1 M ")


@query("marks_filtered", """
WITH m AS (SELECT event_id, event_type AS kind, CASE WHEN user_id % 4 = 0 THEN '(未署名)' ELSE 'a' || user_id % 4 END AS author FROM events) SELECT * FROM m WHERE kind IN ('error', 'click') AND author IN ('(未署名)', 'a2')""")
def marks_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.col("user_id") % 4
    marks = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.when(who == 0, " ").otherwise(F.concat(F.lit("a"), who.cast("string"))).alias("author"))
    return access.marks_of(marks, ["error", "click"], ["(未署名)", "a2"])


@query("mark_groups", """
SELECT event_type AS kind, min(event_id) OVER (PARTITION BY event_type) AS first, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place, event_id FROM events""")
def mark_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("at"), "event_id")
    return access.into_groups(rows, "kind", "at", "event_id")


@query("oldest_event", "SELECT floor((epoch(TIMESTAMP '2025-01-01') - floor(epoch(min(ts)))) / 86400)::BIGINT AS oldest_days FROM events")
def oldest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.oldest_days(table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts")), "ts", F.lit("2025-01-01").cast("timestamp"))


@query("pages_renumbered", """
SELECT conv_id AS doc_id, turn AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS new_page FROM conversations WHERE (conv_id + turn) % 3 > 0""")
def pages_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"))
    return forms.without_pages(pages, pages.filter("(doc_id + page) % 3 = 0"))


# ---- jobs

JOBS = "j AS (SELECT o_orderkey AS id, o_custkey AS owner_id, CASE o_orderstatus WHEN 'F' THEN 'queued' WHEN 'O' THEN 'running' ELSE 'done' END AS status, o_orderdate AS created_at, 'tool' || o_orderkey % 5 AS tool_id FROM orders)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "queued").when(F.col("o_orderstatus") == "O", "running").otherwise("done")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), state.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.concat(F.lit("tool"), (F.col("o_orderkey") % 5).cast("string")).alias("tool_id"), F.lit(0.0).alias("progress"))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"), F.lit("running").alias("status"), (F.col("o_orderkey") % 100 / 100).alias("progress"))


@query("job_overlay", f"WITH {JOBS} SELECT id, CASE WHEN id % 7 = 0 THEN 'running' ELSE status END AS status, CASE WHEN id % 7 = 0 THEN id % 100 / 100 ELSE 0.0 END AS progress FROM j")
def job_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.overlay(_jobs(spark, sf_dir), _live(spark, sf_dir)).select("id", "status", "progress")


@query("job_list", f"WITH {JOBS} SELECT id, status FROM j WHERE tool_id = 'tool3' AND status IN ('queued', 'running') ORDER BY created_at DESC, id LIMIT 150")
def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.select_jobs(_jobs(spark, sf_dir), active=True, tool="tool3", limit=150).select("id", "status")


@query("admin_job_list", f"""
WITH {JOBS}, q AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS place FROM j WHERE status = 'queued'),
o AS (SELECT j.id, CASE WHEN j.id % 7 = 0 THEN 'running' ELSE status END AS status, place, created_at, tool_id, CASE WHEN owner_id % 20 = 0 THEN (owner_id // 20)::INTEGER END AS rank FROM j LEFT JOIN q USING (id))
SELECT id, status, place::INTEGER AS place, rank, list_filter([CASE WHEN tool_id IN ('tool1', 'tool2') THEN 'office' END, CASE WHEN tool_id = 'tool2' THEN 'ocr' END, CASE WHEN tool_id = 'tool4' THEN 'remote' END], lambda x: x IS NOT NULL) AS tags,
  row_number() OVER (ORDER BY CASE status WHEN 'queued' THEN 0 WHEN 'running' THEN 1 ELSE 2 END, CASE WHEN status = 'queued' THEN place END, created_at DESC, id)::INTEGER AS "row" FROM o""")
def admin_job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_jobs = _jobs(spark, sf_dir)
    places = jobs.queue_order(all_jobs.filter("status = 'queued'"), {}).select("id", "place")
    ranks = table(spark, sf_dir, "customer").filter("c_custkey % 20 = 0").select(F.col("c_custkey").alias("owner_id"), F.floor(F.col("c_custkey") / 20).cast("int").alias("rank"))
    tags = jobs.resource_tags(F.col("tool_id"), ["tool1", "tool2"], ["tool2"], ["tool4"])
    return jobs.admin_list(all_jobs, places, _live(spark, sf_dir), ranks, tags).select("id", "status", "place", "rank", "tags", "row")


@query("sampled_values", """
SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1""")
def sampled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sampled(table(spark, sf_dir, "events").select("ts", "event_id", "value"))


@query("due_runs", """
SELECT o_orderkey, isodow(o_orderdate) = 1 AND hour(o_orderdate) = 0 AND NOT (o_orderkey % 10 < 6) AS due FROM orders""")
def due_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.col("o_orderdate").cast("timestamp")
    last = now - F.make_dt_interval((F.col("o_orderkey") % 10).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", jobs.due(last, now, 0, 0).alias("due"))


# ---- invoices and receipts


@query("invoice_export", """
SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey)::INTEGER AS "No", o_orderkey AS "Number", (floor(o_totalprice) - floor(o_totalprice / 1.05))::BIGINT AS "Tax" FROM orders""")
def invoice_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with the computed columns, under the labels chosen."""
    catalogue = [{"id": "seq", "label": "No"}, {"id": "invoice_number", "label": "Number"}, {"id": "amount_total", "label": "Total", "default_visible": False}, {"id": "tax", "label": "VAT"}]
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_number"), F.col("o_orderdate").alias("scanned_at"), F.floor("o_totalprice").alias("amount_total"), F.floor(F.col("o_totalprice") / 1.05).alias("amount_untaxed"))
    return invoices.export_rows(own, invoices.export_columns(catalogue, labels={"tax": " Tax "}))


@query("reclassified", """
WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS old, CASE WHEN o_orderkey % 4 > 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE o_orderpriority END END AS new FROM orders)
SELECT count(*) AS total, count(new) AS classified, count(*) FILTER (new IS DISTINCT FROM old) AS changed FROM a""")
def reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, was = F.col("o_orderkey"), F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select(key.alias("invoice_number"), F.when(key % 3 > 0, was).alias("old"), F.when(key % 4 > 0, F.when(key % 5 == 0, "other").otherwise(was)).alias("new"))
    return invoices.reclassified(rows.select("invoice_number", F.col("old").alias("subject")), rows.select("invoice_number", F.col("new").alias("subject")))


@query("receipt_keys", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '高鐵|' || l_partkey ELSE '高鐵|' || strftime(l_shipdate, '%Y-%m-%d') || '|台北|左營|' || l_quantity::BIGINT END AS copy_key FROM lineitem""")
def receipt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("高鐵").alias("transport"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), F.col("l_partkey").cast("string"))).otherwise("").alias("ticket_no"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.lit("台北").alias("origin"), F.lit("左營").alias("destination"), F.col("l_quantity").cast("long").alias("fare"))
    return rows.select("l_orderkey", "l_linenumber", receipts.copy_key(rows).alias("copy_key"))


@query("dates_shown", """
SELECT o_orderkey, CASE WHEN s < 60 THEN '剛剛' WHEN s < 3600 THEN s // 60 || ' 分鐘前' WHEN s < 86400 THEN s // 3600 || ' 小時前' WHEN s < 604800 THEN s // 86400 || ' 天前' ELSE strftime(then_, '%Y/%m/%d') END AS relative,
  o_orderdate::DATE BETWEEN DATE '1996-03-01' AND DATE '1996-04-30' AS in_period, floor((epoch(o_orderdate) - epoch(TIMESTAMP '1996-01-01')) / 86400)::BIGINT AS days_left, strftime(make_timestamp(o_orderkey * 1000000000), '%Y-%m-%dT%H:%M:%S') AS iso
FROM (SELECT *, o_orderkey * 37 AS s, TIMESTAMP '2024-06-01' - to_seconds(o_orderkey * 37) AS then_ FROM orders)""")
def dates_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-06-01").cast("timestamp")
    then = F.timestamp_seconds(F.unix_timestamp(now) - F.col("o_orderkey") * 37)
    day = F.to_date("o_orderdate")
    date = lambda d: F.lit(d).cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        B.show_relative(then, now).alias("relative"),
        B.in_period(day, date("1996-03-01"), date("1996-04-30")).alias("in_period"),
        access.expiring_days(F.col("o_orderdate").cast("timestamp"), F.lit("1996-01-01").cast("timestamp")).alias("days_left"),
        B.epoch_iso(F.col("o_orderkey") * 1000).alias("iso"),
    )


# ---- forms

SYNONYMS = "SELECT c_mktsegment || c_nationkey % 4 AS key, '* ' || left(c_mktsegment, 4) || ' ' || c_nationkey % 3 || '：' AS synonym FROM customer"


def _synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", (nation % 4).cast("string")).alias("key"), F.concat(F.lit("* "), F.left("c_mktsegment", F.lit(4)), F.lit(" "), (nation % 3).cast("string"), F.lit("：")).alias("s"))
    return rows.groupBy("key").agg(F.collect_list("s").alias("synonyms"))


@query("synonym_index", f"WITH s AS ({SYNONYMS}) SELECT lower(replace(replace(replace(synonym, ' ', ''), '*', ''), '：', '')) AS label, list_sort(list_distinct(list(key))) AS keys FROM s GROUP BY 1")
def synonym_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.synonym_index(_synonyms(spark, sf_dir))


@query("label_keys", f"""
WITH s AS ({SYNONYMS}), i AS (SELECT DISTINCT lower(replace(replace(replace(synonym, ' ', ''), '*', ''), '：', '')) AS label, key FROM s), l AS (SELECT s_suppkey AS id, ['Auto 0:', 'BUIL1', '１．furn ２', 'mach  1', 'none'][1 + s_suppkey % 5] AS text, ['auto0', 'buil1', 'furn2', 'mach1', 'none'][1 + s_suppkey % 5] AS label FROM supplier)
SELECT id, text, key FROM l JOIN i USING (label)""")
def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[F.lit(x) for x in ("Auto 0:", "BUIL1", "１．furn ２", "mach  1", "none")])
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.get(texts, (F.col("s_suppkey") % 5).cast("int")).alias("text"))
    return forms.label_keys(labels, forms.synonym_index(_synonyms(spark, sf_dir)))


@query("merged_synonyms", """
WITH o AS (SELECT c_mktsegment AS key, list_sort(list_distinct(list('s' || c_nationkey % 5))) AS own FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1), d AS (SELECT c_mktsegment AS key, ['s1', 'x', 'y'] AS given FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1)
SELECT coalesce(o.key, d.key) AS key, coalesce(own, []) || list_filter(coalesce(given, []), lambda g: NOT list_contains(coalesce(own, []), g)) AS synonyms FROM o FULL JOIN d ON o.key = d.key""")
def merged_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.concat(F.lit("s"), (F.col("c_nationkey") % 5).cast("string")).alias("s"))
    own = customers.filter("key <> 'MACHINERY'").groupBy("key").agg(F.array_append(F.array_sort(F.collect_set("s")), F.lit(" ")).alias("synonyms"))
    defaults = customers.filter("key <> 'BUILDING'").select("key").distinct().withColumn("synonyms", F.array(*[F.lit(x) for x in ("s1", "x", " y", "x")]))
    return forms.merge_synonyms(own, defaults)


@query("split_labels", """
WITH s AS (SELECT p_partkey AS id, replace(p_name, ' ', ':  ') || '：' AS text, p_size * 1.0 AS x0 FROM part), w AS (SELECT *, string_split(regexp_replace(text, '[:：]\\s*$', ''), ':  ') AS parts FROM s),
p AS (SELECT id, text, x0, k, parts[k] || CASE WHEN k = len(parts) THEN '：' ELSE ':' END AS label, coalesce(list_sum(list_transform(range(1, k), lambda i: length(parts[i]) + 3)), 0) AS start FROM w, unnest(range(1, len(parts) + 1)) AS u(k) WHERE len(parts) >= 2)
SELECT id, label AS text, round(x0 + start * 10.0, 6) AS x0, round(x0 + (start + length(label)) * 10.0, 6) AS x1 FROM p""".replace("\\\\", "\\"))
def split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(":  ")), F.lit("："))
    spans = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"), F.col("p_size").cast("double").alias("x0"))
    spans = spans.withColumn("x1", F.col("x0") + F.length("text") * 10.0)
    return forms.split_labels(spans).select("id", "text", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query("word_guards", "SELECT p_partkey, len(string_split(trim(p_name), ' ')) = len(string_split(trim(p_type), ' ')) AS same FROM part")
def word_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a replacement has as many words as what it replaces."""
    return table(spark, sf_dir, "part").select("p_partkey", segments.same_word_count(F.col("p_name"), F.col("p_type")).alias("same"))


# ---- findings


@query("resolved_references", """
WITH p AS (SELECT c_custkey AS owner, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS name, CASE c_custkey % 4 WHEN 0 THEN '（同上）' WHEN 1 THEN '同登記地址' WHEN 2 THEN '同泰路' ELSE 'own' END AS invoice, CASE WHEN c_custkey % 3 = 0 THEN '同上' ELSE 'road ' || c_nationkey END AS address FROM customer)
SELECT owner, 'address' AS key, address AS value, NULL::VARCHAR AS source FROM p
UNION ALL SELECT owner, 'invoice_address', CASE WHEN owner % 4 < 2 AND owner % 3 > 0 THEN address ELSE invoice END, CASE WHEN owner % 4 < 2 AND owner % 3 > 0 THEN 'address' END FROM p
UNION ALL SELECT owner, 'bank_account_name', CASE WHEN owner % 5 > 0 THEN name ELSE 'ditto' END, CASE WHEN owner % 5 > 0 THEN 'company_name' END FROM p
UNION ALL SELECT owner, 'company_name', name, NULL FROM p""")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, owner = table(spark, sf_dir, "customer"), F.col("c_custkey")
    kind = owner % 4
    values = {
        "address": F.when(owner % 3 == 0, "同上").otherwise(F.concat(F.lit("road "), F.col("c_nationkey").cast("string"))),
        "invoice_address": F.when(kind == 0, "（同上）").when(kind == 1, "同登記地址").when(kind == 2, "同泰路").otherwise("own"),
        "bank_account_name": F.lit("ditto"),
        "company_name": F.when(owner % 5 == 0, " ").otherwise(F.col("c_name")),
    }
    profile = c.select(owner.alias("owner"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])).alias("p")).select("owner", "p.*")
    labels = spark.createDataFrame([("登記地址", "address"), ("公司地址", "address"), ("公司名稱", "company_name")], "label string, key string")
    return consistency.resolve_references(profile, labels, {"invoice_address": "address", "bank_account_name": "company_name"})


TOTALS = "t AS (SELECT ['company', 'legal_person', 'tax_id', 'case_number', 'government'][1 + l_linenumber % 5] AS kind, CASE l_linenumber % 5 WHEN 2 THEN lpad((l_partkey * 7 % 3000 + 10000000)::VARCHAR, 8, '0') ELSE 'N' || l_suppkey % 30 END AS value, count(*) AS total_count, count(DISTINCT l_orderkey) AS file_count FROM lineitem GROUP BY ALL), v AS (SELECT *, CASE WHEN kind = 'tax_id' THEN list_transform(range(1, 9), lambda i: CAST(value[i:i] AS INTEGER) * [1,2,1,2,1,2,4,1][i]) END AS p FROM t), w AS (SELECT *, kind = 'tax_id' AND (list_sum(list_transform(p, lambda x: x // 10 + x % 10)) % 10 = 0 OR (value[7:7] = '7' AND (list_sum(list_transform(p, lambda x: x // 10 + x % 10)) + 1) % 10 = 0)) AS valid FROM v)"


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber") % 5
    kind = F.get(F.array(*[F.lit(x) for x in ("company", "legal_person", "tax_id", "case_number", "government")]), line)
    value = F.when(line == 2, F.lpad((F.col("l_partkey") * 7 % 3000 + 10000000).cast("string"), 8, "0")).otherwise(F.concat(F.lit("N"), (F.col("l_suppkey") % 30).cast("string")))
    return table(spark, sf_dir, "lineitem").groupBy(kind.alias("kind"), value.alias("value")).agg(F.count("*").alias("total_count"), F.countDistinct("l_orderkey").alias("file_count"))


@query("expected_findings", f"""
WITH {TOTALS}
SELECT 'identity-mismatch' AS category, 'warn' AS severity, kind, value, total_count, file_count FROM w WHERE kind IN ('company', 'legal_person') AND NOT (contains(value, 'N1') OR contains('N1', value) OR contains(value, 'N2') OR contains('N2', value) OR value = 'N7' OR contains(value, 'N7'))
UNION ALL SELECT 'tax-id-mismatch', 'warn', kind, value, total_count, file_count FROM w WHERE kind = 'tax_id' AND value <> '10000007'
UNION ALL SELECT 'tax-id-invalid', CASE WHEN file_count >= 2 OR total_count >= 3 THEN 'info' ELSE 'warn' END, kind, value, total_count, file_count FROM w WHERE kind = 'tax_id' AND NOT valid
UNION ALL SELECT 'case-num-other', 'info', kind, value, total_count, file_count FROM w WHERE kind = 'case_number' AND value <> 'N3'""")
def expected_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.rule_findings(_totals(spark, sf_dir), main="N1", main_id="10000007", counterparty="N 2", case_number="N3", own_names=["N7"])


@query("free_findings", f"""
WITH {TOTALS}
SELECT 'tax-id-multiple' AS category, 'warn' AS severity, 'tax_id' AS kind, value, total_count, file_count FROM w WHERE valid AND value <> '10000007' AND (SELECT count(*) FROM w WHERE valid AND value <> '10000007') >= 2
UNION ALL SELECT 'tax-id-invalid', CASE WHEN file_count >= 2 OR total_count >= 3 THEN 'info' ELSE 'warn' END, kind, value, total_count, file_count FROM w WHERE kind = 'tax_id' AND NOT valid""")
def free_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an expected party: several valid foreign tax ids, and invalid ones."""
    return consistency.rule_findings(_totals(spark, sf_dir), own_ids=["10000007"])


@query("finding_keys", """
SELECT event_id, event_type || ':' || left('title ' || user_id, 50) || ':' || CASE WHEN event_id % 2 = 0 THEN '' ELSE (event_id % 9)::VARCHAR END AS plain_key,
  CASE event_id % 3 WHEN 0 THEN 'identity-mismatch:v' || user_id WHEN 1 THEN 'metadata-leak:a,b' ELSE 'duplicate-hash:' || left(repeat('ab' || user_id, 20), 16) END AS known_key FROM events""")
def finding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, kind = F.col("user_id").cast("string"), F.col("event_id") % 3
    evidence = F.to_json(F.struct(F.concat(F.lit("v"), user).alias("actual"), F.struct(F.lit(1).alias("b"), F.lit(2).alias("a")).alias("metadata"), F.repeat(F.concat(F.lit("ab"), user), F.lit(20)).alias("sha256")))
    category = F.when(kind == 0, "identity-mismatch").when(kind == 1, "metadata-leak").otherwise("duplicate-hash")
    title, page = F.concat(F.lit("title "), user), F.when(F.col("event_id") % 2 == 1, F.col("event_id") % 9)
    return table(spark, sf_dir, "events").select("event_id", consistency.finding_key(F.col("event_type"), evidence, title, page).alias("plain_key"), consistency.finding_key(category, evidence, title, page).alias("known_key"))


@query("merged_variants", """
SELECT c_nationkey AS group_id, arg_max(value, (length(value), value)) AS value, sum(n)::BIGINT AS total_count, list_sort(list_distinct(flatten(list(files)))) AS files
FROM (SELECT c_nationkey, c_mktsegment AS value, count(*) AS n, list('f' || c_custkey % 10) AS files FROM customer GROUP BY ALL) GROUP BY 1""")
def merged_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("group_id"), F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("total_count"), F.collect_list(F.concat(F.lit("f"), (F.col("c_custkey") % 10).cast("string"))).alias("files"))
    return consistency.merge_variants(groups)


@query("tax_ids_in_text", r"""
WITH f AS (SELECT doc_id, list_distinct(regexp_extract_all(regexp_replace(text, '([\p{L}\p{N}_]*[\p{L}_][\p{L}\p{N}_]*|[\p{N}]{9,})', ' ', 'g'), '[0-9]{8}')) AS ids FROM (SELECT o_orderkey AS doc_id, 'tax ' || lpad((o_orderkey * 7 % 1000)::VARCHAR, 8, '0') || ', x1234567890 and ' || lpad((o_custkey)::VARCHAR, 8, '0') AS text FROM orders)),
r AS (SELECT doc_id, unnest(ids) AS tax_id FROM f), d AS (SELECT *, list_transform(range(1, 9), lambda i: CAST(tax_id[i:i] AS INTEGER) * [1,2,1,2,1,2,4,1][i]) AS p FROM r)
SELECT doc_id, tax_id, list_sum(list_transform(p, lambda x: x // 10 + x % 10)) % 10 = 0 OR (tax_id[7:7] = '7' AND (list_sum(list_transform(p, lambda x: x // 10 + x % 10)) + 1) % 10 = 0) AS valid FROM d""")
def tax_ids_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("tax "), F.lpad((F.col("o_orderkey") * 7 % 1000).cast("string"), 8, "0"), F.lit(", x1234567890 and "), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    return consistency.tax_ids(o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))).select("doc_id", "tax_id", "valid")


@query("amounts_in_text", """
SELECT o_orderkey AS doc_id, unnest(list_distinct(list_filter([floor(o_totalprice)::BIGINT, o_custkey * 1000], lambda v: v >= 10000))) AS amount FROM orders""")
def amounts_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("總價 "), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), F.lit(" 元, 另 "), (F.col("o_custkey") * 1000).cast("string"))
    return consistency.amounts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))


@query("own_names", "SELECT p_partkey, p_name AS value FROM part WHERE contains(replace(p_name, ' ', ''), 'widget') OR contains('coldgear', replace(p_name, ' ', ''))")
def own_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.contained_names(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("value")), ["wid get", "cold gear"])


@query("agreed_corrections", """
WITH c AS (SELECT l_partkey AS key, l_linenumber AS round FROM lineitem), r AS (SELECT * FROM c WHERE round > 1)
SELECT key FROM r GROUP BY key HAVING count(DISTINCT round) = (SELECT count(DISTINCT round) FROM r)""")
def agreed_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.consensus(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("round")))


@query("finding_label_counts", r"""
SELECT 'sha1' AS type, sum(len(regexp_extract_all(text, '\b[a-fA-F0-9]{40}\b')))::BIGINT AS count FROM documents HAVING count > 0""")
def finding_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by kind: here of one that SQL can write as well, by an own rule."""
    found = deident.detect(table(spark, sf_dir, "documents"), ids=(), custom="sha1 | (?<![^\\W])[a-fA-F0-9]{40}(?![^\\W])")
    return deident.label_counts(found).select(F.lit("sha1").alias("type"), "count")


@query("close_values", """
WITH v AS (SELECT p_partkey, lower(replace(p_name, ' ', '')) AS a, lower(replace(CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' more text here' WHEN 2 THEN 'xx ' || p_name || ' yy zz' WHEN 3 THEN p_type ELSE left(p_name, 1) || 'q' || p_name[3:] END, ' ', '')) AS b FROM part)
SELECT p_partkey, a = b OR (length(a) >= 3 AND starts_with(b, a)) OR (length(a) >= 5 AND contains(b, a)) OR (abs(length(a) - length(b)) <= greatest(4, length(a) // 5) AND levenshtein(a, b) <= 0.04 * (length(a) + length(b))) AS close FROM v""")
def close_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    actual = F.when(k == 0, F.upper(name)).when(k == 1, F.concat(name, F.lit(" more text here"))).when(k == 2, F.concat(F.lit("xx "), name, F.lit(" yy zz"))).when(k == 3, F.col("p_type")).otherwise(F.concat(F.left(name, F.lit(1)), F.lit("q"), F.substring(name, 3, 1000)))
    return table(spark, sf_dir, "part").select("p_partkey", T.closely_equal(name, actual).alias("close"))
