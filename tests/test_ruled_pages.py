"""Tables of ruled lines: what whole pages give as arrays is what windows and groups give."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import layout, ruled_tables
from paperloom.plans import registry
from tests.conftest import SMALL

BOX = "x0 double, y0 double, x1 double, y1 double"


def random_pages(seed):
    """Grids with pieces left out, moved, doubled and cut, lines of any place, and odd rows."""
    rng = random.Random(seed)
    off = lambda: rng.choice([0.0, 0.0, 0.0, 0.3, -0.4, 0.5, 1.5, 4.0, 7.0])
    rows = []
    for page in range(40):
        top = 0.0
        for _ in range(rng.randrange(1, 4)):
            n, m, step = rng.randrange(1, 6), rng.randrange(1, 5), rng.choice([9.0, 20.0, 30.0, 70.0])
            for r in range(n + 1):
                y = top + r * step
                for c in range(m + 1):
                    x = 50.0 + 70 * c
                    if c < m and rng.random() < 0.8:
                        rows.append((page, x + off(), y + off(), x + 70 - off(), y + rng.choice([0.0, 0.2, 0.9])))
                    if r < n and rng.random() < 0.8:
                        rows.append((page, x + off(), y + step, x, y + off()))
            if rng.random() < 0.4:
                rows.append((page, 50.0, top, 50.0, top + n * step + 260))
            top += n * step + rng.choice([30.0, 90.0, 150.0, 240.0, 300.0])
        rows += [(page, x := rng.randrange(300) * 1.0, y := rng.randrange(300) * 1.0, x + rng.choice([0.0, 40.0]), y + rng.choice([0.0, 40.0])) for _ in range(rng.randrange(6))]
    rows += [(page, a, b, c, d) for page in (100, 101) for a, b, c, d in ((0.0, 5.0, 80.0, 5.0), (None, 5.0, 80.0, 5.0), (0.0, 40.0, 80.0, None))]
    rows += rng.sample(rows, 60)
    rng.shuffle(rows)
    return rows


def plain(found):
    return sorted(repr((*r[:6], *(round(v, 6) for v in r[6:]))) for r in found.collect())


@pytest.mark.parametrize("seed, pairs, swept", [(1, 1_000_000, 200_000), (2, 1_000_000, 30), (3, 400, 200_000), (4, 60, 30)])
def test_pages_give_what_windows_give(spark, monkeypatch, seed, pairs, swept):
    rows = random_pages(seed)
    odd = [(200, 0.0, float("nan"), 90.0, 0.0), (201, 0.0, 0.0, float("inf"), 0.0), (202, float("-inf"), 0.0, 90.0, 0.0)]
    frame = [(0.0, 0.0, 90.0, 0.0), (0.0, 40.0, 90.0, 40.0), (0.0, 0.0, 0.0, 40.0), (90.0, 0.0, 90.0, 40.0), (40.0, 0.0, 40.0, 25.0)]
    rows += odd + [(page, *line) for page in (200, 201, 202, None) for line in frame]
    segments = spark.createDataFrame(rows, f"page long, {BOX}").repartition(3)
    want = plain(ruled_tables._by_windows(ruled_tables._pieces(segments, "page"), "page"))
    monkeypatch.setattr(ruled_tables, "PAIRS", pairs)
    monkeypatch.setattr(layout, "SWEPT_CELLS", swept)
    found = ruled_tables.cells(segments)
    assert plain(found) == want
    assert len(want) > 150 and any(r.startswith("(None") for r in want) and any(r.startswith("(200") for r in want)


def test_arrays_of_segments_are_their_rows(spark):
    rows = [(f"p{page}", *line[1:]) for page in range(3) for line in random_pages(5) if line[0] == page]
    segments = spark.createDataFrame(rows, f"sheet string, {BOX}")
    several = [(page, [tuple(r[1:]) for r in rows if r[0] == page][k::3] + [None]) for page in ("p0", "p1", "p2") for k in range(3)]
    packed = spark.createDataFrame([*several, ("p0", None), ("p7", []), ("p8", None)], f"sheet string, segments array<struct<{BOX.replace(' ', ':').replace(',:', ',')}>>")
    found = ruled_tables.cells(packed, "sheet", F.col("segments"))
    assert found.columns[0] == "sheet"
    assert plain(found) == plain(ruled_tables.cells(segments, "sheet")) != []


@pytest.mark.parametrize("off", [0.0, 2.0**40, -(2.0**51)])
def test_far_places_are_told_apart(spark, off):
    rows = [(page, a, b + off, c, d + off) for page in (1, 2) for a, b, c, d in [(0.0, 0.0, 90.0, 0.0), (0.0, 40.0, 90.0, 40.0), (0.0, 0.0, 0.0, 40.0), (90.0, 0.0, 90.0, 40.0), (40.0, 0.0, 40.0, 25.0)]]
    segments = spark.createDataFrame([*rows, (3, 0.0, 0.0, 90.0, 0.0)], f"page long, {BOX}").coalesce(1)
    assert len(found := plain(ruled_tables.cells(segments))) == 4
    assert found == plain(ruled_tables._by_windows(ruled_tables._pieces(segments, "page"), "page"))


def test_a_page_of_many_lines_goes_through_windows(spark, monkeypatch):
    monkeypatch.setattr(ruled_tables, "PAIRS", 100)
    grid = [(0.0, 20.0 * k, 400.0, 20.0 * k) for k in range(21)] + [(20.0 * k, 0.0, 20.0 * k, 400.0) for k in range(21)]
    rows = [(1, *line) for line in grid] + [(2, *line) for line in grid[:3] + grid[21:26]] + [(3, *line) for line in grid[:21]]
    rows = spark.createDataFrame(rows, f"page long, {BOX}")
    assert [r[0] for r in ruled_tables._apart(rows.selectExpr("page", "array(struct(x0, y0, x1, y1)) AS segments")).collect()] == [1]
    assert sorted(r[:2] for r in ruled_tables.cells(rows).groupBy("page").count().collect()) == [(1, 400), (2, 8)]


def test_ruled_cells_take_no_windows(spark):
    plan = registry.queries()["ruled_cells"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count(" Sort ") <= 1
