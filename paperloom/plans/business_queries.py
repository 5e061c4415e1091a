"""Queries on the registry, invoices and receipts, over the customer and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import business as B
from paperloom.functions import text as T
from paperloom.operators import invoices, receipts, registry
from paperloom.plans.registry import query
from paperloom.session import table

REGISTRY_SQL = """
reg AS (
  SELECT lpad(c_custkey::VARCHAR, 8, '0') AS vat, c_name AS name, n_name || ' ' || r_name AS address, NULL::VARCHAR AS owner, c_mktsegment AS org_type,
    CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 5000 THEN 'small' ELSE 'large' END AS category, c_mktsegment || ' / ' || r_name AS industries
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("vat"),
        F.col("c_name").alias("name"),
        F.concat_ws(" ", "n_name", "r_name").alias("address"),
        F.lit(None).cast("string").alias("owner"),
        F.col("c_mktsegment").alias("org_type"),
        F.when(F.col("c_acctbal") < 0, None).when(F.col("c_acctbal") < 5000, "small").otherwise("large").alias("category"),
        F.concat_ws(" / ", "c_mktsegment", "r_name").alias("industries"),
    )


@query("registry_lookup", f"""
WITH {REGISTRY_SQL}, k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x' || o_custkey ELSE lpad((o_custkey + o_orderkey % 3 * 700)::VARCHAR, 8, '0') END AS vat FROM orders)
SELECT o_orderkey, k.vat, reg.name, CASE WHEN reg.vat IS NOT NULL THEN 'found' WHEN NOT regexp_full_match(k.vat, '[0-9]{{8}}') THEN '非 8 位數字' ELSE '查無' END AS result FROM k LEFT JOIN reg USING (vat)""")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    keys = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 7 == 0, F.concat(F.lit("x"), F.col("o_custkey").cast("string"))).otherwise(F.lpad((F.col("o_custkey") + key % 3 * 700).cast("string"), 8, "0")).alias("vat"))
    return registry.lookup(keys, _registry(spark, sf_dir)).select("o_orderkey", "vat", "name", "result")


@query("registry_search", f"""
WITH {REGISTRY_SQL} SELECT vat, name, address, org_type FROM reg
WHERE (contains(lower(name), '1') OR contains(lower(address), '1') OR contains(lower(industries), '1') OR contains(vat, '1')) AND (contains(lower(name), 'asia') OR contains(lower(address), 'asia') OR contains(lower(industries), 'asia') OR contains(vat, 'asia'))
  AND org_type = 'BUILDING' ORDER BY name, vat LIMIT 50""")
def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.search(_registry(spark, sf_dir), "1 ASIA", org_type="BUILDING", limit=50).select("vat", "name", "address", "org_type")


@query("registry_facets", f"""
WITH {REGISTRY_SQL}, v AS (
  SELECT 'city' AS facet, '其他' AS value FROM reg UNION ALL SELECT 'org', org_type FROM reg UNION ALL SELECT 'industry', trim(unnest(string_split(industries, '/'))) FROM reg),
c AS (SELECT facet, value, count(*) AS count FROM v GROUP BY ALL)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) <= 8""")
def registry_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.facets(_registry(spark, sf_dir))


@query("registry_categories", f"WITH {REGISTRY_SQL} SELECT coalesce(category, '未分類') AS category, count(*) AS count FROM reg GROUP BY 1")
def registry_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.category_counts(_registry(spark, sf_dir))


@query("registry_last_wins", """
WITH s AS (SELECT o_custkey::VARCHAR AS vat, o_orderpriority AS name, o_orderkey FROM orders) SELECT vat, arg_max(name, o_orderkey) AS name, max(o_orderkey) AS o_orderkey FROM s GROUP BY vat""")
def registry_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("vat"), F.col("o_orderpriority").alias("name"), "o_orderkey")
    return registry.last_wins(rows, "vat", "o_orderkey")


@query("registry_upsert", f"""
WITH {REGISTRY_SQL}, s AS (SELECT lpad((s_suppkey * 40)::VARCHAR, 8, '0') AS vat, s_name AS name FROM supplier)
SELECT coalesce(reg.vat, s.vat) AS vat, coalesce(reg.name, s.name) AS name, CASE WHEN s.vat IS NOT NULL THEN 'supplier' ELSE category END AS category FROM reg FULL JOIN s USING (vat)""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "supplier").select(F.lpad((F.col("s_suppkey") * 40).cast("string"), 8, "0").alias("vat"), F.col("s_name").alias("name"))
    return registry.upsert_category(_registry(spark, sf_dir), source, "supplier").select("vat", "name", "category")


@query("registry_postings", f"""
WITH {REGISTRY_SQL}, f AS (SELECT vat, 'name' AS field, name AS t FROM reg UNION ALL SELECT vat, 'industries', industries FROM reg)
SELECT DISTINCT field, token, count(*) OVER (PARTITION BY field, token) AS n FROM (SELECT DISTINCT vat, field, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS token FROM f)""")
def registry_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.postings(_registry(spark, sf_dir), ("name", "industries")).groupBy("field", "token").agg(F.count("*").alias("n"))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invoice code for each order, with some broken ones."""
    day = F.col("o_orderdate")
    era = F.lpad((F.year(day) - B.ERA).cast("string"), 3, "0")
    untaxed = F.floor(F.col("o_totalprice")).cast("long")
    code = F.concat(
        F.lit("AB"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), era, F.date_format(day, "MMdd"), F.lit("1234"),
        F.lpad(F.hex(untaxed), 8, "0"), F.lpad(F.hex(F.floor(untaxed * 21 / 20)), 8, "0"), F.lit("00000000"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("A" * 24),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 11 == 0, F.left(code, F.lit(70))).otherwise(code).alias("qr_text"))


CODES_SQL = """
inv AS (
  SELECT o_orderkey, 'AB' || lpad(o_orderkey::VARCHAR, 8, '0') AS invoice_number, o_orderdate::DATE AS date, floor(o_totalprice)::BIGINT AS amount_untaxed,
    floor(floor(o_totalprice)::BIGINT * 21 / 20)::BIGINT AS amount_total, lpad(o_custkey::VARCHAR, 8, '0') AS seller_vat FROM orders WHERE o_orderkey % 11 <> 0)"""


@query("invoice_parse", f"WITH {CODES_SQL} SELECT o_orderkey, invoice_number, date, amount_untaxed, amount_total, amount_total - amount_untaxed AS tax, NULL::VARCHAR AS buyer_vat, seller_vat FROM inv")
def invoice_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = invoices.classify_codes(_codes(spark, sf_dir)).filter("kind = 'invoice'").select("o_orderkey", "invoice.*")
    return found.select("o_orderkey", "invoice_number", "date", "amount_untaxed", "amount_total", (F.col("amount_total") - F.col("amount_untaxed")).alias("tax"), "buyer_vat", "seller_vat")


@query("invoice_kinds", "SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE 'invoice' END AS kind, count(*) AS n FROM orders GROUP BY 1")
def invoice_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoices.classify_codes(_codes(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query("invoice_enrich", f"WITH {REGISTRY_SQL}, {CODES_SQL} SELECT invoice_number, seller_vat, name AS seller_name, address AS seller_address FROM inv LEFT JOIN reg ON seller_vat = vat")
def invoice_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = invoices.classify_codes(_codes(spark, sf_dir)).filter("kind = 'invoice'").select("invoice.*")
    return invoices.enrich(found, _registry(spark, sf_dir)).select("invoice_number", "seller_vat", "seller_name", "seller_address")


@query("invoice_dedup_cap", """
WITH s AS (SELECT o_custkey AS user_key, o_orderpriority AS invoice_number, o_orderkey AS scanned_at FROM orders),
d AS (SELECT user_key, invoice_number, min(scanned_at) AS scanned_at FROM s GROUP BY 1, 2)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY scanned_at) <= 3""")
def invoice_dedup_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_key"), F.col("o_orderpriority").alias("invoice_number"), F.col("o_orderkey").alias("scanned_at"))
    return invoices.deduplicate(rows, cap=3)


_NAME_RULES = (("metal", ("STEEL", "COPPER", "BRASS", "NICKEL")), ("alloy", ("TIN",)))


@query("rule_classifier", """
SELECT p_partkey, CASE WHEN contains(p_type, 'PROMO') THEN 'promotion' WHEN contains(p_name, 'PROMO') THEN 'promotion' WHEN regexp_matches(p_type, 'STEEL|COPPER|BRASS|NICKEL') THEN 'metal' WHEN contains(p_type, 'TIN') THEN 'alloy' END AS subject FROM part""")
def rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = invoices.account_subject(F.col("p_type"), F.col("p_name"), custom=(("promotion", ("PROMO",)),), industry_rules=_NAME_RULES)
    return table(spark, sf_dir, "part").select("p_partkey", subject["subject"].alias("subject"))


@query("fiscal_periods", """
WITH d AS (SELECT o_orderdate::DATE AS d, o_totalprice FROM orders), p AS (SELECT year(d) AS y, (month(d) + 1) // 2 AS p, count(*) AS n FROM d GROUP BY ALL)
SELECT make_date(y, p * 2 - 1, 1) AS start, last_day(make_date(y, p * 2, 1)) AS "end", y || ' 年第 ' || p || ' 期 (' || (p * 2 - 1) || '-' || (p * 2) || ' 月)' AS label, n FROM p""")
def fiscal_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(B.period_start(day).alias("start"), B.period_end(day).alias("end"), B.period_label(day).alias("label"))
    return rows.groupBy("start", "end", "label").agg(F.count("*").alias("n"))


@query("filing_periods", """
WITH d AS (SELECT o_orderkey, (date_trunc('month', o_orderdate) - INTERVAL 1 MONTH)::DATE AS d FROM orders)
SELECT o_orderkey, year(d) AS filing_year, CAST((month(d) + 1) // 2 AS INTEGER) AS filing_period FROM d""")
def filing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = B.filing_day(F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(day).cast("long").alias("filing_year"), B.period_number(day).alias("filing_period"))


@query("date_formats", """
WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d, floor(o_totalprice)::BIGINT AS a FROM orders)
SELECT o_orderkey, strftime(d, '%Y/%m/%d') AS slash, year(d) || '年' || month(d) || '月' || day(d) || '日' AS chinese, lpad((year(d) - 1911)::VARCHAR, 3, '0') || strftime(d, '/%m/%d') AS roc, 'NT$ ' || format('{:,}', a) AS amount FROM d""")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, amount = F.to_date("o_orderdate"), F.floor("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[B.show_date(day, s).alias(s) for s in ("slash", "chinese", "roc")], B.show_amount(amount, "currency").alias("amount"))


@query("receipt_parse", """
WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, floor(o_totalprice)::BIGINT AS fare, o_custkey FROM orders)
SELECT o_orderkey, '高鐵' AS transport, strftime(d, '%Y-%m-%d') AS date, '07:20' AS depart_time, '台北' AS origin, '左營' AS destination, fare, '高鐵|' || o_orderkey AS copy_key FROM o""")
def receipt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("台灣高鐵 乘車證明\n乘車日期 : "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 07:20:00\n起程站：高鐵台北站\n到達站：高鐵左營站\n票價：NT$ "), F.format_number(F.floor("o_totalprice").cast("long"), 0), F.lit("\n卡號/票號："), F.col("o_orderkey").cast("string"))
    parsed = receipts.parse(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")))
    return parsed.select("o_orderkey", "transport", "date", "depart_time", "origin", "destination", "fare", receipts.copy_key(parsed).alias("copy_key"))


@query("time_formats", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END AS iso, strftime(ts, '%Y/%m/%d %H:%M:%S') AS local, strftime(ts, '%Y/%m/%d') AS date_only,
  CASE WHEN s < 60 THEN '剛剛' WHEN s < 3600 THEN s // 60 || ' 分鐘前' WHEN s < 86400 THEN s // 3600 || ' 小時前' WHEN s < 604800 THEN s // 86400 || ' 天前' ELSE strftime(ts, '%Y/%m/%d') END AS relative
FROM (SELECT *, (epoch(TIMESTAMP '2024-01-25') - floor(epoch(ts)))::BIGINT AS s FROM events)""")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, now = F.col("ts").cast("timestamp"), F.lit("2024-01-25").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", *(B.show_time(ts, style, now).alias(style) for style in ("iso", "local", "date_only", "relative")))


@query("code_stats", """
SELECT o_custkey AS batch_id, count(*) AS total, count(*) FILTER (o_orderkey % 3 = 0) AS left_qr_count, count(*) FILTER (o_orderkey % 3 = 1) AS right_qr_count, count(*) FILTER (o_orderkey % 3 = 2) AS unknown_count FROM orders GROUP BY 1""")
def code_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many invoices, item lists and unknown codes each scan has."""
    key = F.col("o_orderkey")
    left = F.concat(F.lit("AB"), F.lpad((key % 10**8).cast("string"), 8, "0"), F.lit("1130513" + "1234" + "000003E8" + "0000041A" + "00000000" + "12345678" + "A" * 24))
    code = F.when(key % 3 == 0, left).when(key % 3 == 1, F.concat(F.lit("**:item"), key.cast("string"), F.lit(":1:100"))).otherwise("neither")
    codes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), code.alias("qr_text"))
    return invoices.code_stats(invoices.classify_codes(codes))


@query("invoice_fields_shown", """
SELECT o_orderkey, 'AB-' || lpad((o_orderkey % 100000000)::VARCHAR, 8, '0') AS invoice_number, strftime(o_orderdate, '%Y/%m/%d') AS date, 'NT$ ' || format('{:,}', floor(o_totalprice)::BIGINT) AS amount_total,
  (floor(o_totalprice)::BIGINT - o_custkey)::VARCHAR AS amount_untaxed, format('{:,}', o_custkey) AS tax, coalesce(o_orderpriority, '') AS note FROM orders""")
def invoice_fields_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice columns in the formats that a user has chosen, with the computed tax."""
    total = F.floor("o_totalprice").cast("long")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("AB"), F.lpad((F.col("o_orderkey") % 10**8).cast("string"), 8, "0")).alias("invoice_number"), F.col("o_orderdate").alias("date"), total.alias("amount_total"), (total - F.col("o_custkey")).alias("amount_untaxed"), F.col("o_orderpriority").alias("note"))
    chosen = {"invoice_number": "dash", "date": "slash", "amount_total": "currency", "amount_untaxed": "no such format", "tax": "comma"}
    return rows.select("o_orderkey", *B.show_fields(rows.columns[1:], chosen))


@query("safe_reasons", """
SELECT event_id, left('cannot open ''x' || user_id || '.pdf'' for ' || event_type || ' or 檔案 twice in b.txt', 300) AS reason FROM events""")
def safe_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without the paths of the machine that they come from."""
    user = F.col("user_id").cast("string")
    error = F.concat(F.lit("cannot open '/srv/tmp/u"), user, F.lit("/x"), user, F.lit(".pdf' for "), F.col("event_type"), F.lit(" or C:\\temp\\"), user, F.lit("\\ twice in /a//b.txt"))
    return table(spark, sf_dir, "events").select("event_id", T.safe_reason(error).alias("reason"))
