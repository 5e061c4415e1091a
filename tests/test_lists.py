import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import lists, text_stats
from paperloom.sources.files import page_spec


def run(spark, lines, ops):
    df = spark.createDataFrame([(1, k, line) for k, line in enumerate(lines)], "doc_id long, pos long, line string")
    out, applied = lists.pipeline(df, ops)
    return [r.line for r in out.orderBy("pos").collect()], applied


def of_text(spark, lines, ops):
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "doc_id long, text string")
    rows = lists.of_documents(df, ops).orderBy("pos").collect()
    assert [(r.doc_id, r.pos) for r in rows] == [(1, k) for k in range(len(rows))]
    return [r.line for r in rows]


CASES = [
    (["zinc", "argon", "neon", "argon", "zinc"], [{"op": "dedup"}, {"op": "sort"}], ["argon", "neon", "zinc"]),
    (["p1", "q7", "p1", "r4", "q7", "s"], [{"op": "dedup", "keep": "last"}], ["p1", "r4", "q7", "s"]),
    (["oak", "elm", "oak", "oak"], [{"op": "dedup", "keep": "count"}], ["3\toak", "1\telm"]),
    (["Riga", "RIGA", "Oslo", "riga"], [{"op": "dedup", "case_insensitive": True}], ["Riga", "Oslo"]),
    (["page 31", "page 4", "Page 2"], [{"op": "sort", "natural": True}], ["Page 2", "page 4", "page 31"]),
    (["b", "C", "a"], [{"op": "sort"}], ["C", "a", "b"]),
    (["kilo 1", "LIMA", "KILO 2", "lima"], [{"op": "sort", "case_insensitive": True, "descending": True}], ["LIMA", "lima", "KILO 2", "kilo 1"]),
    (["mon", "tue", "wed", "thu"], [{"op": "reverse"}, {"op": "head", "n": 3}], ["thu", "wed", "tue"]),
    (["mon", "tue", "wed", "thu"], [{"op": "tail", "n": 3}], ["tue", "wed", "thu"]),
    (["mon", "tue"], [{"op": "tail", "n": 5}], ["mon", "tue"]),
    (["mon", "tue"], [{"op": "head", "n": 0}], []),
    (["mon", "tue"], [{"op": "tail", "n": 0}], []),
    (["\t left", "　wide　", "  ", "end \t"], [{"op": "trim"}, {"op": "drop_empty"}], ["left", "wide", "end"]),
    (["mc-kay o'hara b2b"], [{"op": "case", "mode": "title"}], ["Mc-Kay O'Hara B2B"]),
    (["Mixed"], [{"op": "case", "mode": "upper"}, {"op": "wrap", "prefix": "«", "suffix": "»"}], ["«MIXED»"]),
    (["row 12", "row x", "row 9"], [{"op": "filter", "pattern": "[0-9]+$", "regex": True, "exclude": True}], ["row x"]),
    (["Error: disk", "ok", "no errors"], [{"op": "filter", "pattern": "ERROR", "case_insensitive": True}], ["Error: disk", "no errors"]),
]


@pytest.mark.parametrize("lines, ops, want", CASES)
def test_pipeline(spark, lines, ops, want):
    assert run(spark, lines, ops)[0] == want


@pytest.mark.parametrize("lines, ops, want", CASES)
def test_arrays_give_the_same_lists(spark, lines, ops, want):
    assert of_text(spark, lines, ops) == want


def test_arrays_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "x\ny"), (1, "y")], "doc_id long, text string")
    ops = [{"op": "trim"}, {"op": "drop_empty"}, {"op": "dedup"}, {"op": "sort"}, {"op": "head", "n": 10}]
    out = lists.of_documents(df, ops)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.line for r in out.collect()) == ["x", "y", "y"]


def test_unknown_operators_are_skipped(spark):
    assert run(spark, ["only"], [{"op": "translate"}, 17, {"op": "trim"}]) == (["only"], ["trim"])


def test_simplify():
    wasted = [{"op": "reverse"}, {"op": "reverse"}, {"op": "wrap"}, {"op": "filter", "pattern": ""}, {"op": "drop_empty"}, {"op": "drop_empty"}]
    assert lists.simplify(wasted) == [{"op": "drop_empty"}]


def test_shuffle_is_repeatable_and_whole(spark):
    cards = [f"card {k}" for k in range(9)]
    dealt = run(spark, cards, [{"op": "shuffle", "seed": 31}])[0]
    assert dealt == run(spark, cards, [{"op": "shuffle", "seed": 31}])[0] and sorted(dealt) == cards


def test_bad_arguments(spark):
    df = spark.createDataFrame([], "doc_id long, pos long, line string")
    docs = spark.createDataFrame([], "doc_id long, text string")
    for call in (
        lambda: lists.head(df, -2),
        lambda: lists.tail(df, -2),
        lambda: lists.filter_lines(df, "[a", regex=True),
        lambda: lists.filter_lines(df, "w" * 1001),
        lambda: lists.of_documents(docs, [{"op": "head", "n": -2}]),
        lambda: lists.of_documents(docs, [{"op": "filter", "pattern": "[a", "regex": True}]),
    ):
        with pytest.raises(ValueError):
            call()


def test_lines_end_like_unicode_says(spark):
    df = spark.createDataFrame([(1, "uno\r\ndos\x0btres cuatro\n"), (2, ""), (3, None)], "doc_id long, text string")
    assert [r.line for r in lists.explode_lines(df).orderBy("pos").collect()] == ["uno", "dos", "tres", "cuatro"]


def test_white_space_is_that_of_the_expressions(spark):
    chars = spark.range(0x110000).filter("id NOT BETWEEN 55296 AND 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    assert "".join(sorted(r.c for r in chars.filter(F.col("c").rlike(r"(?U)^[\s\x1c-\x1f]$")).collect())) == T.WHITE
    df = spark.createDataFrame([(" \u3000x y\x1c\n",), ("\u2003",), ("",), (None,)], "t string").select(T.strip(F.col("t")).alias("s"), T.blank(F.col("t")).alias("b"))
    assert [tuple(r) for r in df.collect()] == [("x y", False), ("", True), ("", True), (None, None)]


def test_char_classes(spark):
    row = text_stats.classes(spark.createDataFrame([(1, "Qx 天氣好 7?")], "doc_id long, text string")).first()
    assert (row.cjk, row.en_letter, row.digit, row.punct, row.whitespace, row.other) == (3, 2, 1, 1, 2, 0)


def test_terms_and_bigrams(spark):
    df = spark.createDataFrame([(1, "the river and the bridge, the river; boats 山水山水畫"), (2, "水山 水山")], "doc_id long, text string")
    words = {(r.doc_id, r.term): r["count"] for r in text_stats.top_terms(text_stats.word_terms(df, "doc_id"), 20, "doc_id").collect()}
    assert words == {(1, "river"): 2, (1, "bridge"): 1, (1, "boats"): 1}
    pairs = {(r.doc_id, r.term): r["count"] for r in text_stats.top_terms(text_stats.cjk_bigrams(df, "doc_id"), 20, "doc_id").collect()}
    assert pairs == {(1, "山水"): 2, (1, "水山"): 1, (1, "水畫"): 1, (2, "水山"): 2}


def test_page_spec():
    assert page_spec("2-4,9,11-", 12) == [2, 3, 4, 9, 11, 12]
    assert page_spec("8-6", 10) == [8, 7, 6]
    with pytest.raises(ValueError):
        page_spec("two", 4)
