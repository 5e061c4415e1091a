"""Fields of forms and personal data by page: what pages of few rows give is what joins give, without their moves."""

import random

import pytest

from paperloom.operators import form_fields
from paperloom.plans import registry
from tests.conftest import SMALL
from tests.test_moves import exchanges


def random_form(spark, seed):
    rng = random.Random(seed)
    box = "x0 double, y0 double, x1 double, y1 double"
    words = ["公司名稱", "統編/電話", "電 話：", "公司名稱: 統編：", "1. 公司名稱(全名)", "note", "**", "/", " ", None, "電話/公司名稱", "ｔｅｌ："]
    place = lambda widths, heights: (lambda x, y: (x, y, x + rng.choice(widths), y + rng.choice(heights)))(rng.randrange(40) * 10.0, rng.randrange(30) * 5.0)
    spans = [(p, k, rng.choice(words), *place([20, 50, 90], [8, 10])) for p in range(6) for k in range(14)]
    cells = [(p, k, *place([5, 10, 45, 120, 300], [10, 20, 40])) for p in range(5) for k in range(12)]
    lines = [(p, rng.random() < 0.6, rng.randrange(60) * 5.0, low := rng.randrange(20) * 10.0, low + rng.choice([20, 100, 300])) for p in (0, 1, 3, 5, 9) for _ in range(25)]
    odd = [(0, 90, "電話", None, 1.0, 2.0, 3.0), (None, 91, "電話", 0.0, 0.0, 30.0, 10.0), (1, 92, "電話", 50.0, 10.0, 20.0, 5.0), spans[0]]
    return (
        spark.createDataFrame(spans + odd, f"page long, span long, text string, {box}").repartition(3),
        spark.createDataFrame([("company", ["公司名稱"]), ("tax", ["統一編號", "統編"]), ("phone", ["電話", "tel"]), ("call", ["電話"])], "key string, synonyms array<string>"),
        spark.createDataFrame([*cells, (0, 95, None, 0.0, 500.0, 500.0), (2, 96, 200.0, 0.0, 100.0, 10.0)], f"page long, cell long, {box}").repartition(3),
        spark.createDataFrame([*lines, (0, None, 1.0, 0.0, 500.0), (0, True, None, 0.0, 500.0), (0, True, 20.0, None, 500.0)], "page long, level boolean, at double, low double, high double").repartition(3),
    )


@pytest.mark.parametrize("few", [500, 40])
def test_fields_of_small_pages_are_those_of_joins(spark, monkeypatch, few):
    given = random_form(spark, few)
    monkeypatch.setattr(form_fields, "FEW", few)
    found = form_fields.fields(*given)
    joined = form_fields._in_tiles(*given, "page", 595.0)
    assert found.columns == joined.columns
    plain = lambda df: sorted(map(repr, map(tuple, df.collect())))
    got = plain(found)
    assert got == plain(joined)
    assert len(got) > 50 and len({r.split(", ")[5] for r in got}) > 3  # several kinds of slots


def test_forms_are_dealt_once(spark):
    # line items with and without their parts, and the labels, which come back from Python
    assert exchanges(registry.queries()["form_field_slots"](spark, SMALL)) <= 4


def random_cells(spark, seed):
    rng = random.Random(seed)
    day = lambda: f"19{rng.randrange(50, 99)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}"
    texts = lambda: rng.choice(["出生日期", "生日：", "備註", "n/a", "", None, day(), f"生日 {day()}", f"{day()} 生日", "a@b.com", f"u{rng.randrange(9)}@example.com 生日", "戶名", "密碼:"])
    cells = []
    for p in [*range(5), None]:
        for k in range(60):
            x, y = rng.randrange(10) * 55.0, rng.randrange(20) * 16.0
            cells.append((p, k, texts(), x, y, x + rng.choice([30.0, 50.0, 160.0]), y + rng.choice([8.0, 15.0, 120.0])))
    odd = [(1, 900, day(), None, 1.0, 2.0, 3.0), (None, 901, "a@b.com", None, 1.0, 2.0, 3.0), (2, None, "a@b.com", 0.0, 0.0, 9.0, 9.0), (2, None, "生日 1998-12-28 1998-12-28", 0.0, 0.0, 9.0, 9.0)]
    return spark.createDataFrame(cells + odd, "page long, cell long, text string, x0 double, y0 double, x1 double, y1 double").repartition(3)


@pytest.mark.parametrize("most, swept", [(1_000, 200_000), (1_000, 10), (61, 10), (5, 200_000)])
def test_personal_data_of_small_pages_is_that_of_joins(spark, monkeypatch, most, swept):
    from paperloom.operators import deident, layout

    ids = ("dob", "email", "account_name", "cred_label")
    cells = random_cells(spark, most + swept)
    joined = deident._in_bands(cells.fillna("", ["text"]), [deident.PATTERNS[i] for i in ids])
    monkeypatch.setattr(deident, "PAGE_CELLS", most)
    monkeypatch.setattr(layout, "SWEPT_CELLS", swept)
    plain = lambda df: sorted(map(repr, map(tuple, df.collect())))
    found = deident.across_cells(cells.withColumnRenamed("page", "p"), ids, "p")
    got = plain(found)
    assert found.columns[0] == "p" and got == plain(joined.distinct())
    assert len(got) > 60 and sum("'dob'" in r for r in got) > 20


def test_cells_are_dealt_once(spark):
    # the line items; of those without a page, which there are none of, another time
    assert exchanges(registry.queries()["form_personal_data"](spark, SMALL)) <= 2
