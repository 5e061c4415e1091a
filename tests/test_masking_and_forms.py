"""Masking of overlapping spans, and functions that SQL can't express."""

import re

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import access, deident, forms, jobs, layout


def spans_of(text, *found):
    return [(kind, kind, "g", text[a:b], masked, a, b) for kind, masked, a, b in found]


def test_an_outer_span_decides_for_those_inside():
    text = "see https://srv1.corp.example/u?m=jonathan.smith@example.com now"
    outer, inner = (text.index("https"), text.index(" now")), (text.index("jonathan"), text.index(" now"))
    spans = spans_of(text, ("url", "https://***", *outer), ("mail", "jo***@example.com", *inner))
    assert deident.rewrite(text, spans, "mask") == "see https://*** now"
    assert deident.rewrite(text, spans, "redact") == "see " + "█" * (outer[1] - outer[0]) + " now"


def test_spans_that_cross_are_blacked_out_whole():
    text = "0123456789abcdef"
    spans = spans_of(text, ("a", "0*********", 0, 10), ("b", "8****f", 8, 16))
    assert deident.rewrite(text, spans, "mask") == "█" * 16
    assert deident.rewrite(text, spans, "fake") == "█" * 16


def test_nothing_of_any_value_stays_in_clear(spark):
    texts = ["url https://srv1.corp.example/u?m=jonathan.smith@example.com", "mail a.b@example.com and 10.1.2.3", None, "", "x" * 200_000 + " amy.long@example.org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for mode in ("redact", "mask", "fake"):
        for r in deident.detect(docs, mode=mode).collect():
            for s in r.spans:
                assert s.value not in r.text, (mode, s.value)


def test_addresses_are_found(spark):
    docs = spark.createDataFrame([(1, "住在新竹縣竹北市中山路12號附近")], "doc_id long, text string")
    found = deident.detect(docs, ids=[p for p in deident.PATTERNS if "address" in p or "addr" in p]).first().spans
    assert any("竹北市中山路12號" in s.value for s in found)


def test_spans_of_documents_by_brute_force(spark):
    """The registered findings against the catalogue's expressions applied one by one, on a small table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, s.type, s.start, s.end) for r in deident.detect(docs).collect() for s in r.spans}
    want = set()
    for doc_id, text in docs.collect():
        for name in deident.DEFAULT:
            p = deident.PATTERNS[name]
            check = deident.CHECKS.get(p.check or "", lambda v: True)
            own = [m.span(p.value_group) for m in re.finditer(p.expression, text or "", p.flags) if m[p.value_group] and check(m[p.value_group])]
            want |= {(doc_id, name, a, b) for a, b in own if not any((c, d) != (a, b) and c <= a and b <= d for c, d in own)}
    assert got == want


@pytest.mark.parametrize("text,joined", [("中 文 字", "中文字"), ("a 中 b", "a 中 b"), ("年 月 日", "年 月 日"), ("時 分", "時 分"), ("年 度", "年度"), ("甲　乙", "甲乙")])
def test_spaces_between_cjk(spark, text, joined):
    assert spark.range(1).select(T.joined_cjk(F.lit(text)).alias("t")).first().t == joined


@pytest.mark.parametrize("text,bad", [("aaaaaaaa", True), ("aaaaaaa", False), ("abababababab", True), ("abab abab", False), ("", False), (None, False), ("........", False), ("-=-=-=-=-=", False), ("eeoeeoeeoeeo", True), ("中文∂", True), ("∂" + "中" * 20, False), ("∂∂∂∂∂" + "中" * 14, True), ("一般文字", False), ("ㄅ" * 3 + "字" * 8, True)])
def test_garbled(spark, text, bad):
    assert spark.range(1).select(T.garbled(F.lit(text).cast("string")).alias("t")).first().t == bad


def test_entries_of_contents(spark):
    lines = ["第一章 緒論 …… 3", "    1.1 背景   5 ", "12", "no page", "　　深 7", None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string").select("k", T.toc_entry(F.col("line")).alias("e"))
    got = [r.e and tuple(r.e) for r in rows.orderBy("k").collect()]
    assert got == [("第一章 緒論", 3, 1), ("1.1 背景", 5, 3), None, None, ("深", 7, 3), None]


def test_one_label_alone_is_not_split(spark):
    rows = spark.createDataFrame([(1, "only one:", 0.0, 9.0), (2, "A label: B label:", 0.0, 17.0)], "id int, text string, x0 double, x1 double")
    assert [tuple(r) for r in forms.split_labels(rows).orderBy("x0").collect()] == [(2, "A label:", 0.0, 8.0), (2, "B label:", 9.0, 17.0)]


def test_clean_up_guard_and_due_runs(spark):
    assert access.cleanup_allowed(20, 100) and not access.cleanup_allowed(21, 100)
    stamp = lambda x: F.lit(x).cast("timestamp")
    cases = [("2024-01-01 03:10:00", "2023-12-25 03:10:00", True), ("2024-01-01 03:10:00", "2023-12-31 03:10:00", False), ("2024-01-02 03:10:00", None, False), ("2024-01-01 03:10:00", None, True)]
    for now, last, want in cases:
        assert spark.range(1).select(jobs.due(stamp(last), stamp(now), 0, 3).alias("d")).first().d == want


def test_numbers_run_over_all_groups(spark):
    rows = spark.createDataFrame([(k, f"2024-01-{1 + k % 9:02d} 00:00:00", k % 3) for k in range(100)], "id long, at string, owner_id long").withColumn("created_at", F.to_timestamp("at"))
    got = [r.id for r in jobs.queue_order(rows, {1: 2, 2: 1}).orderBy("place").collect()]
    rank = {1: 2, 2: 1, 0: 99}
    assert got == sorted(range(100), key=lambda k: (rank[k % 3], k % 9, k))


def test_levels_and_bins_by_brute_force(spark):
    values = [3, 5, 1, 9, 2, 2, 7, 1, 4, 6]
    rows = spark.createDataFrame([(g, k, float(v)) for g in "ab" for k, v in enumerate(values)], "g string, k int, v double").repartition(3)
    level, want = None, []
    for v in values:
        level = 1 if level is None else min(v, level + 1)
        want.append(level)
    got = {(r.g, r.k): r.v for r in layout.repaired_levels(rows, "g", "k", "v").collect()}
    assert [got["a", k] for k in range(10)] == [got["b", k] for k in range(10)] == want
    used, bin_, bins = 0, 0, []
    for v in values:
        if used and used + v > 10:
            used, bin_ = 0, bin_ + 1
        used += v
        bins.append(bin_)
    got = {(r.g, r.k): r.bin for r in layout.packed(rows, "g", "k", "v", 10.0).collect()}
    assert [got["a", k] for k in range(10)] == bins


def test_a_failing_fixer_is_left_out(spark):
    from paperloom.operators import fixers

    lines = spark.createDataFrame([(1, 0, 1, 0.0, 100.0, "a b"), (1, 0, 2, 50.0, 100.0, "x"), (1, 0, 3, 60.0, 100.0, "x"), (1, 0, 4, 70.0, 100.0, None), (1, 0, 5, 75.0, 100.0, "x"), (1, 0, 6, 80.0, 100.0, "____")], "doc_id long, page int, pos long, y double, height double, text string")

    def broken_plan(rows):
        return rows.withColumn("text", F.col("nowhere"))

    def broken_task(rows):
        return rows.withColumn("text", F.raise_error(F.lit("in a task")).cast("string"))

    def other_columns(rows):
        return rows.withColumn("more", F.lit(1))

    chain = [("plan", broken_plan), *fixers.FIXERS, ("task", broken_task), ("columns", other_columns)]
    fixed, report = fixers.run(lines, chain, skip=["repeated_edges"])
    assert sorted((r.pos, r.text) for r in fixed.collect()) == [(1, "a b"), (2, "x"), (4, "")]
    assert [name for name, *_, error in report if error] == ["plan", "task", "columns"]
    assert [(name, before, after) for name, before, after, error in report if not error] == [("private_signs", 6, 6), ("cjk_spaces", 6, 6), ("form_blanks", 6, 5), ("repeated_lines", 5, 3)]


@pytest.mark.parametrize("a,b,close", [("Acme Co.,Ltd", "ACME CO.,,LTD", True), ("abcdefghijklmnop", "abcdefghijklmnpo", True), ("abcdefgh", "abcdefhg", False), ("ab", "abc", False), ("abc", "abc trailing", True), ("0123456789abcdefghijklmn", "mn0123456789abcdefghijkl", False), ("", "x", False), (None, "x", False), ("x", None, False)])
def test_closeness_by_matching_blocks(spark, a, b, close):
    from difflib import SequenceMatcher

    if a and b and len(a) > 8 and not b.startswith(a):
        x, y = (re.sub(r"\s+", "", re.sub(r"([,.\-_;:])\1+", r"\1", t)).lower() for t in (a, b))
        assert (x == y or SequenceMatcher(None, x, y).ratio() >= 0.92) == close
    assert spark.range(1).select(T.closely_equal(F.lit(a).cast("string"), F.lit(b).cast("string")).alias("c")).first().c == close
