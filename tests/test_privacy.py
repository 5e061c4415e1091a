import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.functions import checks
from paperloom.operators import deident, diff
from pyspark.sql import functions as F


def values(text, kind):
    return [s[3] for s in deident.find_spans(text, [deident.PATTERNS[kind]])]


@pytest.mark.parametrize("text, want", [("出生日期 1998/12/18", "1998/12/18"), ("生日 1998.12.20", "1998.12.20"), ("出生年月日 民國87年12月21日", "民國87年12月21日"), ("Date of Birth 1998.7.5", "1998.7.5"), ("出生日期 19981218", "19981218")])
def test_birth_dates_need_a_label(text, want):
    assert values(text, "dob") == [want]
    assert values(want, "dob") == []


def test_whole_catalogue_compiles_and_is_found():
    assert len(deident.PATTERNS) == 41
    for p in deident.PATTERNS.values():
        assert p.regex
    assert values("mail me at jane.doe@example.com now", "email") == ["jane.doe@example.com"]
    assert values("A123456789 A123456788", "tw_id") == ["A123456789"]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("A1B2C ９٣@.-/:：(No) DL Account生日帳戶路號市台北段Rd年月日PO\n"), max_size=60))
def test_patterns_left_out_have_no_match(text):
    tried = {p.id for _, p in deident.possible(text, deident.PATTERNS.values())}
    assert not [p.id for p in deident.PATTERNS.values() if p.id not in tried and p.regex.search(text)]


def test_patterns_left_out_by_text():
    left_out = {p.id for p in deident.PATTERNS.values()} - {p.id for _, p in deident.possible("no number here", deident.PATTERNS.values())}
    assert left_out == deident.WITH_DIGITS | {"email"}


@pytest.mark.parametrize("kind, value, want", [("id", "A123456789", "A1******89"), ("phone", "0912-345-678", "0912-***-678"), ("email", "jane@x.org", "ja***@x.org"), ("digits:4:4:8", "4111 1111 1111 1111", "4111 **** **** 1111"), ("ip", "10.1.2.3", "10.***.***.***"), ("name", "王小明", "王O明")])
def test_masks(kind, value, want):
    assert deident.mask_value(kind, value) == want


def test_fakes_keep_checksums_and_repeat():
    fake = deident.fake_value("tw_id", "A123456789")
    assert checks.is_national_id(fake) and fake == deident.fake_value("tw_id", "A123456789")
    assert checks.is_card(deident.fake_value("cc", "4111 1111 1111 1111"))
    assert checks.is_business_id(deident.fake_value("tw_biz", "04595257"))


def test_detect_modes(spark):
    df = spark.createDataFrame([(1, "call 0912-345-678"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in deident.detect(df, mode="redact").collect()}
    assert rows[1].text == "call ████████████" and rows[2].spans == [] and rows[3].text == ""


def test_column_checks_agree_with_plain_ones(spark):
    ids = [f"{n:08d}" for n in range(0, 3000, 7)] + ["04595257", "x", ""]
    df = spark.createDataFrame([(i,) for i in ids], "v string").withColumn("b", checks.business_id_valid(F.col("v")))
    assert all(r.b == checks.is_business_id(r.v) for r in df.collect())
    people = [f"{c}1{n:08d}" for c in "AIOWZ" for n in range(123456780, 123456800)]
    df = spark.createDataFrame([(i[:10],) for i in people], "v string").withColumn("b", checks.national_id_valid(F.col("v")))
    assert all(r.b == checks.is_national_id(r.v) for r in df.collect())


def test_diff_rebuilds_both_sides():
    a, b = "one\ntwo\nthree", "one\n2\nthree\nfour"
    rows, n = diff.align(a, b)
    assert "\n".join(r[0] for r in rows if r[1] != "blank") == a
    assert "\n".join(r[2] for r in rows if r[3] != "blank") == b
    assert (n["added"], n["removed"], n["changed"]) == (1, 0, 1)


def test_overlap_anti_join(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 0, 5)], "doc_id long, start int, end int")
    taken = spark.createDataFrame([(1, 4, 5)], "doc_id long, start int, end int")
    assert sorted((r.doc_id, r.start) for r in deident.drop_overlapping(a, taken).collect()) == [(1, 5), (2, 0)]
