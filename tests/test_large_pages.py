"""Pages above and below the bounds that decide how they are solved."""

import random

import pytest

from paperloom.operators import graph, regions
from tests.test_moves import exchanges
from tests.test_tables_and_regions import flood


@pytest.mark.parametrize("held", [200_000, 150, 20])
def test_regions_of_whole_and_of_cut_pages(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)
    monkeypatch.setattr(regions, "HELD", held)
    rng = random.Random(held)
    pixels = {(p, x, y) for p in range(4) for x in range(25) for y in range(10 + 8 * p) if rng.random() < 0.6}
    frame = spark.createDataFrame(sorted(pixels) + sorted(pixels)[:5], "page long, x long, y long").repartition(3)
    got = regions.boxes(regions.connected(regions.runs_of(frame), tile_rows=4))
    assert sorted((r.page, r.area, r.x0, r.y0, r.x1, r.y1) for r in got.collect()) == flood(pixels)


@pytest.mark.parametrize("held", [200_000, 3])
def test_components_within_groups(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)
    edges = [(p, f"{p}:{a}", f"{p}:{b}") for p, a, b in [(1, 5, 3), (1, 3, 9), (1, 9, 8), (1, 1, 2), (2, 4, 4), (2, 7, 6), (3, 2, 1)]]
    got = {r.node: r.root for r in graph.components_within(spark.createDataFrame(edges, "page long, a string, b string").repartition(3), "page").collect()}
    assert got.pop("2:4", "2:4") == "2:4"
    assert got == {"1:5": "1:3", "1:3": "1:3", "1:9": "1:3", "1:8": "1:3", "1:1": "1:1", "1:2": "1:1", "2:7": "2:6", "2:6": "2:6", "3:2": "3:1", "3:1": "3:1"}


def test_content_is_dealt_once(spark):
    frame = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 5, 5)], "page long, x long, y long")
    from pyspark.sql import functions as F

    assert exchanges(regions.dilated(regions.runs_of(frame), 1, F.lit(20), F.lit(20))) == 1
