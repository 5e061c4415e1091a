"""Steps by page that are dealt once, and what they find at their borders."""

import pytest

from paperloom.plans import registry
from tests.conftest import SMALL
from tests.test_moves import exchanges


def test_cells_of_ruled_tables_are_dealt_once(spark):
    assert exchanges(registry.queries()["ruled_cells"](spark, SMALL)) == 1


@pytest.mark.parametrize("tiled", [64, 3])
def test_boxes_and_lines_meet_without_another_move(spark, monkeypatch, tiled):
    from paperloom.operators import form_fields

    monkeypatch.setattr(form_fields, "TILED_LINES", tiled)
    boxes = spark.createDataFrame([(1, 1, 10.0, 10.0, 20.0, 20.0), (1, 2, 60.0, 10.0, 70.0, 20.0), (1, 3, None, 1.0, 2.0, 2.0), (2, 1, 10.0, 10.0, 20.0, 20.0)], "page long, box long, x0 double, y0 double, x1 double, y1 double")
    rows = [(1, True, 0.0, 0.0, 100.0), (1, True, 5.0, 0.0, 30.0), (1, True, 5.0, 0.0, 30.0), (1, True, 90.0, -60.0, 200.0), (1, False, 0.0, 0.0, 90.0), (1, False, 40.0, 0.0, 90.0), (1, False, 100.0, 0.0, 90.0), (1, True, None, None, None)]
    found = form_fields.enclosing_cells(boxes, spark.createDataFrame(rows, "page long, level boolean, at double, low double, high double"))
    assert exchanges(found) == 1
    assert sorted(map(tuple, found.collect())) == [(1, 1, 0.0, 5.0, 40.0, 90.0), (1, 2, 40.0, 0.0, 100.0, 90.0)]
