"""Regions of a raster: connected content, found by runs of rows within tiles and joined over the tiles' borders.

A raster is a table of content: pixels (page, x, y) or runs (page, y, x0, x1), both ends included. A task links the
runs of many whole pages at a time. A page of more runs than HELD is dealt to tiles of some rows each, and the tiles' parts
are joined by an equi-join of neighbouring border rows, whose links are the only edges that the components of such a page
are made of. Repeated pixels and overlapping runs are one. Rows with nulls are
left out. A page without content has no regions. Content is dealt by page once; its rows stay where they are until their
regions are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.operators.graph import HELD, components_within, roots, whole_groups
from paperloom.session import by_key, cut

TILE_ROWS = 64
#: A pixel is content if it is so much darker than the background (absolute, or a share of it), or so colourful.
DARKER, DARKER_SHARE, COLOURED = 18.0, 0.06, 0.18
#: Boxes of one card share half of the lesser height and stand at most 0.6 of it apart.
SHARED_HEIGHT, APART = 0.5, 0.6
#: Fixed value: the least share of a page that a region covers.
LEAST_AREA = 0.006


def is_content(red: Column, green: Column, blue: Column, background: Column) -> Column:
    dark = G.luminance(red, green, blue) < background - F.greatest(F.lit(DARKER), background * DARKER_SHARE)
    return dark | (G.saturation(red, green, blue) > COLOURED)


def merged_runs(runs: DataFrame, page: str = "page") -> DataFrame:
    """(page, y, x0, x1): overlapping and touching runs of a row as one."""
    row = Window.partitionBy(page, "y")
    placed = by_key(runs.filter("x0 IS NOT NULL AND x1 IS NOT NULL AND y IS NOT NULL").select(page, "y", "x0", "x1"), page)
    reached = placed.withColumn("_reach", F.max("x1").over(row.orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_end", F.max("x1").over(row))
    # where one begins, what was reached before is the end of the one before it
    begins = reached.filter(F.col("_reach").isNull() | (F.col("x0") > F.col("_reach") + 1))
    return begins.select(page, "y", "x0", F.coalesce(F.lead("_reach").over(row.orderBy("x0", "x1")), "_end").alias("x1"))


def runs_of(pixels: DataFrame, page: str = "page") -> DataFrame:
    """The runs of content pixels (page, x, y)."""
    return merged_runs(pixels.select(page, "y", F.col("x").alias("x0"), F.col("x").alias("x1")), page)


def dilated(runs: DataFrame, times: int, width: Column, height: Column, page: str = "page") -> DataFrame:
    """Content grown by one pixel up, down, left and right, so many times, within the page: a run grows to a row ``d`` away by
    ``times - d`` pixels at both ends."""
    rows = runs.withColumn("_d", F.explode(F.array(*map(F.lit, range(-times, times + 1)))))
    grown = rows.select(page, (F.col("y") + F.col("_d")).alias("y"), F.greatest(F.col("x0") - times + F.abs("_d"), F.lit(0)).alias("x0"), F.least(F.col("x1") + times - F.abs("_d"), width - 1).alias("x1"))
    return merged_runs(grown.filter((F.col("y") >= 0) & (F.col("y") < height)), page)


def _links(group: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs that touch from one row to the next; runs are in order of (group, y, x0) and apart within a row."""
    new = np.r_[True, (np.diff(group) != 0) | (np.diff(y) != 0)]
    row, first = np.cumsum(new) - 1, np.flatnonzero(new)
    follows = np.r_[False, (np.diff(group[first]) == 0) & (np.diff(y[first]) == 1)]
    # all rows one behind the other on one axis; a run looks for the runs of the row before its own
    width = int(x1.max() - x0.min()) + 2
    starts, ends = x0 - x0.min() + row * width, x1 - x0.min() + row * width
    low = np.searchsorted(ends, starts - width)
    count = np.where(follows[row], np.searchsorted(starts, ends - width, side="right") - low, 0)
    below = np.repeat(np.arange(len(y)), count)
    return np.repeat(low, count) + np.arange(len(below)) - np.repeat(np.cumsum(count) - count, count), below


def linked(runs: DataFrame, page: str) -> DataFrame:
    """(page, y, x0, x1, region): runs (page, piece, y, x0, x1), sorted within partitions that hold whole pieces of pages, that
    are 4-connected within their piece share a region, named by its first run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, "page", "piece"):
            y, x0, x1 = (rows.column(c).to_numpy() for c in ("y", "x0", "x1"))
            root = roots(len(y), *_links(group, y, x0, x1))
            yield pa.RecordBatch.from_arrays([rows.column("page").combine_chunks(), *map(pa.array, (y, x0, x1, y[root], x0[root]))], names=["page", "y", "x0", "x1", "top", "left"])

    kind = runs.schema[page].dataType.simpleString()
    ready = runs.select(F.col(page).alias("page"), *(F.col(c).cast("long").alias(c) for c in ("piece", "y", "x0", "x1")))
    found = ready.sortWithinPartitions("page", "piece", "y", "x0").mapInArrow(run, f"page {kind}, y long, x0 long, x1 long, top long, left long")
    name = F.concat_ws(":", F.col("page").cast("string"), F.concat_ws("-", *(F.lpad(F.col(c).cast("string"), 19, "0") for c in ("top", "left"))))
    return found.select(F.col("page").alias(page), "y", "x0", "x1", name.alias("region"))


def connected(runs: DataFrame, page: str = "page", tile_rows: int = TILE_ROWS) -> DataFrame:
    """(page, y, x0, x1, region): 4-connected runs of a page share a region, named by its first run from the top.

    Pages of up to HELD runs are linked whole, many at a time; larger ones are dealt to tiles.
    """
    counted = by_key(runs.filter(F.col(page).isNotNull()), page).withColumn("_n", F.count("*").over(Window.partitionBy(page)))
    whole = linked(counted.filter(F.col("_n") <= HELD).withColumn("piece", F.lit(0)), page)
    large = counted.filter(F.col("_n") > HELD).withColumn("piece", F.floor(F.col("y") / tile_rows))
    if large.isEmpty():
        return whole
    parts = cut(linked(by_key(large, page, "piece"), page))
    lower = parts.filter(F.col("y") % tile_rows == 0).select(F.col(page).alias("_page"), (F.col("y") - 1).alias("_y"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("region").alias("b"))
    upper = parts.filter(F.pmod("y", F.lit(tile_rows)) == tile_rows - 1)
    meets = (F.col(page) == F.col("_page")) & (F.col("y") == F.col("_y")) & (F.col("x0") <= F.col("_x1")) & (F.col("_x0") <= F.col("x1"))
    roots_ = components_within(upper.join(lower, meets).select(page, F.col("region").alias("a"), "b"), page)
    named = parts.join(roots_, F.col("region") == F.col("node"), "left")
    return whole.union(named.select(page, "y", "x0", "x1", F.coalesce("root", "region").alias("region")))


def boxes(runs: DataFrame, page: str = "page") -> DataFrame:
    """(page, region, area, x0, y0, x1, y1) of ``connected`` runs; ends are included."""
    return runs.groupBy(page, "region").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"))


def aligned(found: DataFrame, page: str = "page", band: int = 32) -> DataFrame:
    """Boxes of which those that stand side by side are one, again and again until none are left to be joined.

    Boxes meet by the bands of rows that they touch, so that a page's boxes are not all held against each other. All joinable
    boxes of a round are joined at once.
    """
    found = cut(found)
    while True:
        dealt = found.withColumn("_band", F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band))))
        other = dealt.select(F.col(page).alias("_page"), F.col("_band").alias("_with"), *[F.col(c).alias(f"_{c}") for c in ("region", "x0", "y0", "x1", "y1")])
        shared = F.least("y1", "_y1") - F.greatest("y0", "_y0") + 1
        height = F.least(F.col("y1") - F.col("y0"), F.col("_y1") - F.col("_y0")) + 1
        gap = F.greatest("x0", "_x0") - F.least("x1", "_x1") - 1
        joins = (F.col("region") < F.col("_region")) & (shared >= SHARED_HEIGHT * height) & (gap <= APART * height)
        edges = cut(dealt.join(other, (F.col(page) == F.col("_page")) & (F.col("_band") == F.col("_with"))).filter(joins).select(page, F.col("region").alias("a"), F.col("_region").alias("b")).distinct())
        if edges.isEmpty():
            return found
        named = found.join(components_within(edges, page), F.col("region") == F.col("node"), "left").withColumn("region", F.coalesce("root", "region"))
        found = cut(named.groupBy(page, "region").agg(F.sum("area").alias("area"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")))


def regions(content: DataFrame, width: int, height: int, page: str = "page", dilations: int = 2, least_area: float = LEAST_AREA) -> DataFrame:
    """(page, place, x0, y0, x1, y1): the regions of pages of one size, from the top and from the left; ``x1`` and ``y1`` lie
    behind the region. Boxes are drawn closely around the content itself, not around its grown copy."""
    grown = dilated(content, dilations, F.lit(width), F.lit(height), page)
    found = aligned(boxes(connected(grown, page), page), page).filter(F.col("area") >= least_area * width * height)
    inside = (F.col(page) == F.col("_page")) & (F.col("y").between(F.col("y0"), F.col("y1"))) & (F.col("_x0") <= F.col("x1")) & (F.col("_x1") >= F.col("x0"))
    own = content.select(F.col(page).alias("_page"), "y", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    tight = found.join(own, inside).groupBy(page, "region").agg(F.min(F.greatest("x0", "_x0")).alias("x0"), F.min("y").alias("y0"), (F.max(F.least("x1", "_x1")) + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    place = F.row_number().over(Window.partitionBy(page).orderBy("y0", "x0", "x1", "y1"))
    return tight.select(page, place.alias("place"), "x0", "y0", "x1", "y1")
