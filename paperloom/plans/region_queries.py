"""Queries on rasters: pixels are derived from line items, a supplier's items being the content of a page of 120 by 130."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.operators import regions
from paperloom.plans.registry import query
from paperloom.session import table

WIDTH, HEIGHT = 120, 130
PIXELS = f"pix AS (SELECT DISTINCT l_suppkey AS page, (l_partkey * 7 + l_linenumber) % {WIDTH} AS x, (l_orderkey + l_partkey % 3) % {HEIGHT} AS y FROM lineitem WHERE l_orderkey % 3 = 0)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").filter("l_orderkey % 3 = 0")
    x, y = (F.col("l_partkey") * 7 + F.col("l_linenumber")) % WIDTH, (F.col("l_orderkey") + F.col("l_partkey") % 3) % HEIGHT
    return items.select(F.col("l_suppkey").alias("page"), x.alias("x"), y.alias("y"))


GROWN = f"""{PIXELS}, step AS (SELECT unnest([0, 1, -1, 0, 0]) AS dx, unnest([0, 0, 0, 1, -1]) AS dy),
grown AS (SELECT DISTINCT page, x + dx AS x, y + dy AS y FROM pix, step WHERE x + dx BETWEEN 0 AND {WIDTH - 1} AND y + dy BETWEEN 0 AND {HEIGHT - 1})"""


@query("raster_components", f"""
WITH RECURSIVE {GROWN}, px AS (SELECT *, y * {WIDTH} + x AS id FROM grown),
edge AS (SELECT a.page, a.id, b.id AS other FROM px a JOIN px b ON a.page = b.page AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))),
both_ AS (SELECT * FROM edge UNION ALL SELECT page, other, id FROM edge),
r(page, id, root) AS (SELECT page, id, id FROM px UNION SELECT e.page, e.other, r.root FROM r JOIN both_ e ON e.page = r.page AND e.id = r.id WHERE e.other > r.root),
least AS (SELECT page, id, min(root) AS root FROM r GROUP BY page, id)
SELECT page, count(*) AS area, min(id % {WIDTH}) AS x0, min(id // {WIDTH}) AS y0, max(id % {WIDTH}) AS x1, max(id // {WIDTH}) AS y1 FROM least GROUP BY page, root""")
def raster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of all pages' content, grown by a pixel."""
    grown = regions.dilated(regions.runs_of(_pixels(spark, sf_dir)), 1, F.lit(WIDTH), F.lit(HEIGHT))
    return regions.boxes(regions.connected(grown, tile_rows=16)).drop("region")


@query("raster_runs", f"""
WITH {GROWN}, g AS (SELECT page, y, x, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS island FROM grown)
SELECT page, y, min(x) AS x0, max(x) AS x1 FROM g GROUP BY page, y, island""")
def raster_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.dilated(regions.runs_of(_pixels(spark, sf_dir)), 1, F.lit(WIDTH), F.lit(HEIGHT))


@query("pixel_content", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS r, l_suppkey * 7 % 256 AS g, l_orderkey % 256 AS b FROM lineitem),
v AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS lum, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(r, g, b) ELSE 0 END AS sat FROM p)
SELECT l_orderkey, l_linenumber, round(lum, 6) AS lum, round(sat, 6) AS sat, lum < 240 - 18 OR sat > 0.18 AS content FROM v""")
def pixel_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brightness, colourfulness and whether a pixel stands out from a light background."""
    colours = [F.col("l_partkey") % 256, F.col("l_suppkey") * 7 % 256, F.col("l_orderkey") % 256]
    items = table(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", F.round(G.luminance(*colours), 6).alias("lum"), F.round(G.saturation(*colours), 6).alias("sat"), regions.is_content(*colours, F.lit(240.0)).alias("content"))


@query("raster_regions")
def raster_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of pages: grown content, connected, aligned boxes joined, small ones left out, drawn closely."""
    return regions.regions(regions.runs_of(_pixels(spark, sf_dir)), WIDTH, HEIGHT, dilations=1, least_area=0.002)
