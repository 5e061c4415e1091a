import datetime

import pytest

from pyspark.sql import functions as F

from paperloom.functions import business as B
from paperloom.functions import text as T
from paperloom.operators import access, audit, consistency, invoices, jobs, layout, receipts, registry, segments
from paperloom.plans import registry as plans

REGISTRY = [
    ("11111111", "節省工具有限公司", "台北市大同區", "王小明", "有限公司", None, "超級市場"),
    ("22222222", "大同電器行", "台北市中山區", "張三", "獨資", None, "家電零售"),
    ("33333333", "台中科技股份有限公司", "台中市西屯區", "李四", "股份有限公司", None, "半導體"),
    ("44444444", "節省超商", "雲林縣斗六市", "陳五", "有限公司", None, "便利商店 / 超級市場"),
]
SCHEMA = "vat string, name string, address string, owner string, org_type string, category string, industries string"


def test_registry_fields_and_facets(spark):
    reg = spark.createDataFrame(REGISTRY, SCHEMA)
    names = lambda *a, **k: [r.name for r in registry.search(reg, *a, **k).collect()]
    assert names("大同", fields=("name",)) == ["大同電器行"]
    assert names("大同", fields=("address",)) == ["節省工具有限公司"]
    assert names("臺中") == ["台中科技股份有限公司"] == names("西屯", city="臺中")
    facets = {(r.facet, r.value): r["count"] for r in registry.facets(registry.matches(reg, "節省")).collect()}
    assert facets == {("industry", "超級市場"): 2, ("industry", "便利商店"): 1, ("city", "台北市"): 1, ("city", "雲林縣"): 1, ("org", "有限公司"): 2}


def test_registry_ingest(spark):
    raw = spark.createDataFrame([("12345678", "old", " ", 1), ("12345678", "new", "x", 2), ("bad", "n", "x", 3), ("87654321", " ", "x", 4)], "`統一編號` string, `營業人名稱` string, `營業地址` string, n int")
    assert [(r.vat, r.name, r.address) for r in registry.ingest(raw, "n").collect()] == [("12345678", "new", "x")]


def test_lookup_reasons(spark):
    keys = spark.createDataFrame([(0, "11111111"), (1, "x"), (2, "99999999"), (3, "11111111"), (4, None)], "k int, vat string")
    got = [r.result for r in registry.lookup(keys, spark.createDataFrame(REGISTRY, SCHEMA)).orderBy("k").collect()]
    assert got == ["found", "非 8 位數字", "查無", "found", "非 8 位數字"]


def test_invoice_codes(spark):
    code = "AB12345678" + "1150513" + "1234" + "000003E8" + "0000041A" + "00000000" + "12345678" + "A" * 24
    rows = [(1, code), (2, "**1:0:0:2:2:Big5:鉛筆: 橡皮擦 "), (3, "**:Card:1:7875.000"), (4, "**:Card:x:1"), (5, "junk"), (6, "**1:0:1:2:2:Big5:x"), (7, None)]
    got = {r.k: r for r in invoices.classify_codes(spark.createDataFrame(rows, "k int, qr_text string")).collect()}
    i = got[1].invoice
    assert (i.invoice_number, i.date, i.amount_untaxed, i.amount_total, i.buyer_vat, i.seller_vat) == ("AB12345678", datetime.date(2026, 5, 13), 1000, 1050, None, "12345678")
    assert got[2].items == ["鉛筆", "橡皮擦"] and got[3].items == ["Card"]
    assert [got[k].kind for k in range(1, 8)] == ["invoice", "items", "items", "unknown", "unknown", "unknown", "unknown"]


def test_missing_keys_are_never_duplicates(spark):
    rows = spark.createDataFrame([("u", "A", 1), ("u", "A", 2), ("u", None, 3), ("u", " ", 4)], "user_key string, invoice_number string, scanned_at int")
    assert sorted(r.scanned_at for r in invoices.deduplicate(rows).collect()) == [1, 3, 4]
    stored = spark.createDataFrame([("u", "A", 0)], "user_key string, invoice_number string, scanned_at int")
    assert sorted(r.scanned_at for r in invoices.deduplicate(rows, stored, cap=2).collect()) == [3]


def test_subjects(spark):
    df = spark.createDataFrame([("汽車加油站", "x"), ("無", "My Taxi"), (None, None)], "i string, n string")
    s = invoices.account_subject(F.col("i"), F.col("n"), custom=[("旅費", ("Taxi",))])
    assert [r[0] and (r[0].subject, r[0].source) for r in df.select(s).collect()] == [("油料費", "industries"), ("旅費", "custom-name"), None]


def test_periods_and_dates(spark):
    day = F.lit("2026-01-15").cast("date")
    row = spark.range(1).select(B.period_number(B.filing_day(day)).alias("p"), F.year(B.filing_day(day)).alias("y"), B.period_label(day).alias("l"), B.recent_periods(day, 3).alias("r"), B.flexible_date(F.lit("115/05/13")).alias("f"), B.flexible_date(F.lit("2026-02-30")).alias("n"), B.show_date(day, "roc").alias("s")).first()
    assert (row.p, row.y, row.l) == (6, 2025, "2026 年第 1 期 (1-2 月)")
    assert row.r == [datetime.date(2026, 1, 1), datetime.date(2025, 11, 1), datetime.date(2025, 9, 1)]
    assert (row.f, row.n, row.s) == (datetime.date(2026, 5, 13), None, "115/01/15")


def test_slow_train_receipt(spark):
    text = "臺鐵購票證明\nA12345678901234\n印製日期\n2026/06/10\n乘車區間 2026/06/09\n18:41 臺北 > 20:50 臺中\n自強(3000) 477 車次 全票 950 元"
    r = receipts.parse(spark.createDataFrame([(text,), ("nothing",), (None,)], "text string")).collect()
    assert (r[0].date, r[0].origin, r[0].destination, r[0].depart_time, r[0].arrive_time, r[0].fare, r[0].train, r[0].ticket_no) == ("2026-06-09", "臺北", "臺中", "18:41", "20:50", 950, "自強(3000) 477車次", "A12345678901234")
    assert [x.parsed for x in r] == [True, False, False]


def test_spreadsheet_guard(spark):
    df = spark.createDataFrame([("=1",), ("+x",), ("a",), (None,), ("'=1",)], "v string")
    assert [r[0] for r in df.select(T.spreadsheet_safe(F.col("v"))).collect()] == ["'=1", "'+x", "a", "", "'=1"]


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert access.ancestors(e).count() == 9


def test_lockouts(spark):
    rows = [("k", f"2024-01-01 00:0{m}:00", False) for m in range(5)] + [("k", "2024-01-01 00:06:00", True), ("j", "2024-01-01 00:00:00", False), ("j", "2024-01-01 02:00:00", False)]
    df = spark.createDataFrame(rows, "key string, ts string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    got = jobs.replay_lockouts(df, threshold=5).collect()
    assert [(r.key, str(r.ts), str(r.locked_until)) for r in got] == [("k", "2024-01-01 00:04:00", "2024-01-01 00:19:00")]


def test_sequential_layout(spark):
    df = spark.createDataFrame([("d", k, v) for k, v in enumerate([3, 1, 3, 4, 2])], "d string, k int, level int")
    assert [r.level for r in layout.repaired_levels(df, "d", "k", "level").orderBy("k").collect()] == [1.0, 1.0, 2.0, 3.0, 2.0]
    assert [r.bin for r in layout.packed(df, "d", "k", "level", 5).orderBy("k").collect()] == [0.0, 0.0, 1.0, 2.0, 3.0]


def test_references(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "同a"), ("c", "同b"), ("d", "同e"), ("e", "同d")], "key string, value string")
    got = {r.key: r.value for r in consistency.expand_references(df).collect()}
    assert (got["b"], got["c"]) == ("x", "x") and got["d"] and got["e"]


def test_details_cap(spark):
    df = spark.createDataFrame([('{"a": 1, "b": [1, 2, 3]}',), ("{}",)], "d string")
    assert [r[0] for r in df.select(audit.capped_details("d", 10)).collect()] == ['{"a":"1","_truncated":"true"}', "{}"]


def test_corrections_compare_character_counts(spark):
    own = [(1, 0, "the old line " * 100), (1, 1, "kept as it is"), (1, 2, "a b"), (1, 3, "x y z"), (1, 4, "ab")]
    new = [(1, 0, "THE NEW LINE " * 100), (1, 1, "kept"), (1, 2, "a  b c d"), (1, 3, "xyz" + " " * 40), (1, 4, " ")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, pos long, line string")
    got = segments.corrected_lines(frame(own), frame(new), "doc_id").orderBy("pos").collect()
    assert [r.corrected for r in got] == [True, False, True, True, False]
    assert [r.line for r in got] == [new[0][2], own[1][2], new[2][2], new[3][2], own[4][2]]


def test_corrections_reach_lines_of_any_length(spark, tmp_path):
    text = "the short line\n" + "the long line " * 50
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.queries()["corrected_lines_all"](spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.line for r in got] == text.replace("the", "The").split("\n")


def test_buffer_keys_and_rule_bounds(spark):
    import hashlib

    rows = spark.createDataFrame([("ann", "ldap"), ("bob", None), ("", "x"), (None, "x")], "name string, realm string")
    got = [r.k for r in rows.select(B.buffer_key(F.col("name"), F.col("realm")).alias("k")).collect()]
    assert got == [hashlib.blake2b(b"ann|ldap", digest_size=8).hexdigest(), hashlib.blake2b(b"bob|", digest_size=8).hexdigest(), "default", "default"]
    assert invoices.own_rules([(" a ", ["x", " x ", ""]), ("", ["y"]), ("b", [" "])]) == [("a", ("x",))]
    with pytest.raises(ValueError, match="200"):
        invoices.own_rules([("a", ["x"])] * 201)
    with pytest.raises(ValueError, match="20 words"):
        invoices.own_rules([("a", [str(k) for k in range(21)])])
