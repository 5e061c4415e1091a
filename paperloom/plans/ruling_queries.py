"""Queries on ruled tables: pieces of lines are derived from line items, an order's items being the rows of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import ruled_tables
from paperloom.plans.registry import query
from paperloom.session import by_key, table

SEGMENTS = """
item AS (SELECT l_orderkey AS page, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS q, 100.0 + 30 * l_linenumber + CASE WHEN l_linenumber >= 5 THEN 120 ELSE 0 END AS y FROM lineitem),
part5 AS (SELECT *, unnest(range(0, 5)) AS c FROM item),
seg AS (
  SELECT page, 50.0 + 100 * c AS x0, y + 0.3 * (c % 2) AS y0, 150.0 + 100 * c AS x1, y + 0.3 * (c % 2) AS y1 FROM part5 WHERE c < 4 AND (p + c) % 5 <> 0
  UNION ALL SELECT page, 50.0 + 100 * c, y + 30, 150.0 + 100 * c, y + 30 FROM part5 WHERE c < 4 AND (s + c) % 3 <> 0
  UNION ALL SELECT page, 50.0 + 100 * c, y + 30, 50.0 + 100 * c, y FROM part5 WHERE c IN (0, 4) OR (q + c) % 4 <> 0
  UNION ALL SELECT page, 50.0, y, 50.0, y + 160 FROM item WHERE n = 4 AND p % 2 = 0)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = F.col("n"), F.col("c")
    # an item is dealt to its page before it becomes its up to fourteen pieces
    item = by_key(_items(spark, sf_dir), "page")
    top = F.lit(100.0) + 30 * n + F.when(n >= 5, 120).otherwise(0)
    parts = item.select("*", top.cast("double").alias("y"), F.explode(F.array(*map(F.lit, range(5)))).alias("c")).withColumn("x", F.lit(50.0) + 100 * c)
    kept = {"top": "c < 4 AND (p + c) % 5 <> 0", "bottom": "c < 4 AND (s + c) % 3 <> 0", "side": "c IN (0, 4) OR (q + c) % 4 <> 0", "bridge": "c = 0 AND n = 4 AND p % 2 = 0"}
    pieces = parts.select("page", "x", "y", "c", F.explode(F.array(*(F.when(F.expr(where), F.lit(kind)) for kind, where in kept.items()))).alias("k")).filter("k IS NOT NULL")
    x, y, k = F.col("x"), F.col("y"), F.col("k")
    level, step = k.isin("top", "bottom"), 0.3 * (c % 2)
    y0 = F.when(k == "top", y + step).when(k == "bridge", y).otherwise(y + 30)
    y1 = F.when(k == "top", y + step).when(k == "bottom", y + 30).when(k == "bridge", y + 160).otherwise(y)
    return pieces.select("page", x.alias("x0"), y0.alias("y0"), F.when(level, x + 100).otherwise(x).alias("x1"), y1.alias("y1"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("q"))


def _segments_of_item() -> Column:
    """The same segments, all of an item in one array; those that it lacks are null."""
    n, p, s, q = (F.col(c) for c in "npsq")
    y = (F.lit(100.0) + 30 * n + F.when(n >= 5, 120).otherwise(0)).cast("double")

    def segment(where: Column, x0: float, y0: Column, x1: float, y1: Column) -> Column:
        return F.when(where, F.struct(F.lit(x0).alias("x0"), y0.alias("y0"), F.lit(x1).alias("x1"), y1.alias("y1")))

    pieces = [segment((n == 4) & (p % 2 == 0), 50.0, y, 50.0, y + 160)]
    for c in range(5):
        x = 50.0 + 100 * c
        pieces.append(segment(F.lit(True) if c in (0, 4) else (q + c) % 4 != 0, x, y + 30, x, y))
        if c < 4:
            pieces += [segment((p + c) % 5 != 0, x, y + 0.3 * (c % 2), x + 100, y + 0.3 * (c % 2)), segment((s + c) % 3 != 0, x, y + 30, x + 100, y + 30)]
    return F.array(*pieces)


RULINGS = f"""{SEGMENTS},
axis AS (
  SELECT page, level, (CASE WHEN level THEN y0 + y1 ELSE x0 + x1 END) / 2 AS spot_at, CASE WHEN level THEN least(x0, x1) ELSE least(y0, y1) END AS low, CASE WHEN level THEN greatest(x0, x1) ELSE greatest(y0, y1) END AS high
  FROM (SELECT *, abs(y1 - y0) <= 1 AND abs(x1 - x0) > abs(y1 - y0) AS level, abs(x1 - x0) <= 1 AND abs(y1 - y0) > abs(x1 - x0) AS upright FROM seg) WHERE level OR upright),
once AS (SELECT page, level, round(spot_at) AS spot, low, high, min(spot_at) AS spot_at FROM axis GROUP BY ALL),
reach AS (SELECT *, max(high) OVER (PARTITION BY page, level, spot ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM once),
island AS (SELECT *, sum(coalesce(low > reach + 3, false)::INTEGER) OVER (PARTITION BY page, level, spot ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS g FROM reach),
rul AS (SELECT page, level, min(spot_at) AS spot_at, min(low) AS low, max(high) AS high FROM island GROUP BY page, level, spot, g)"""


@query("ruled_lines", f"""WITH {RULINGS} SELECT page, level, round(spot_at, 6) AS "at", low, high FROM rul""")
def ruled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines of all pages, from their pieces."""
    return ruled_tables.rulings(_segments(spark, sf_dir)).select("page", "level", F.round("at", 6).alias("at"), "low", "high")


def _clustered(source: str, by: str, tolerance: str) -> str:
    return f"""SELECT {by}, avg(spot_at) AS spot_at FROM (SELECT *, sum(coalesce(spot_at - before > {tolerance}, false)::INTEGER) OVER (PARTITION BY {by} ORDER BY spot_at RANGE UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, lag(spot_at) OVER (PARTITION BY {by} ORDER BY spot_at) AS before FROM {source})) GROUP BY {by}, g"""


TABLES = f"""{RULINGS},
rowy AS ({_clustered("(SELECT page, spot_at FROM rul WHERE level)", "page", "2")}),
gaps AS (SELECT page, spot_at - lag(spot_at) OVER (PARTITION BY page ORDER BY spot_at) AS gap FROM rowy),
med AS (SELECT page, gap AS median FROM (SELECT page, gap, row_number() OVER (PARTITION BY page ORDER BY gap) AS k, count(*) OVER (PARTITION BY page) AS n FROM gaps WHERE gap IS NOT NULL) WHERE k = n // 2 + 1),
lev AS (SELECT rul.*, spot_at - lag(spot_at) OVER (PARTITION BY page ORDER BY spot_at, low, high) AS gap, coalesce(median, 0) AS median FROM rul LEFT JOIN med USING (page) WHERE level),
stretch AS (SELECT *, sum(coalesce(gap > 80 OR (median > 0 AND gap > 3 * median AND gap > 20), false)::INTEGER) OVER (PARTITION BY page ORDER BY spot_at, low, high ROWS UNBOUNDED PRECEDING) AS g FROM lev),
edge AS (SELECT page, g, min(low) AS l, max(high) AS r, min(spot_at) AS first, max(spot_at) AS last FROM stretch GROUP BY page, g),
pair AS (SELECT page, g, first, last, lag(l) OVER w AS l, lag(r) OVER w AS r, lag(last) OVER w AS above FROM edge WINDOW w AS (PARTITION BY page ORDER BY g)),
open AS (SELECT *, g > 0 AND NOT (first - above <= 250 AND EXISTS (SELECT 1 FROM rul v WHERE v.page = pair.page AND NOT v.level AND (abs(v.spot_at - pair.l) < 10 OR abs(v.spot_at - pair.r) < 10) AND v.low <= above + 2 AND v.high >= first - 2)) AS starts FROM pair),
named AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY page ORDER BY g ROWS UNBOUNDED PRECEDING) AS tab FROM open),
ext AS (SELECT page, tab, min(first) AS top, max(last) AS bottom FROM named GROUP BY page, tab),
own AS (
  SELECT s.page, tab, true AS level, s.spot_at, s.low, s.high FROM stretch s JOIN named USING (page, g)
  UNION ALL SELECT rul.page, tab, false, spot_at, low, high FROM rul JOIN ext ON rul.page = ext.page AND low <= bottom + 2 AND high >= top - 2 WHERE NOT level),
box AS (SELECT *, max(CASE WHEN level THEN high ELSE spot_at END) OVER w - min(CASE WHEN level THEN low ELSE spot_at END) OVER w AS gw, max(CASE WHEN level THEN spot_at ELSE high END) OVER w - min(CASE WHEN level THEN spot_at ELSE low END) OVER w AS gh FROM own WINDOW w AS (PARTITION BY page, tab)),
long AS (SELECT *, high - low >= CASE WHEN level THEN least(0.2 * gw, 25) ELSE least(0.15 * gh, 18) END AS ok FROM box),
keep AS (SELECT page, tab, level, spot_at, low, high FROM (SELECT *, bool_or(ok AND level) OVER w AND bool_or(ok AND NOT level) OVER w AS two FROM long WINDOW w AS (PARTITION BY page, tab)) WHERE ok OR NOT two),
xs AS ({_clustered("(SELECT page, tab, spot_at FROM keep WHERE NOT level)", "page, tab", "6")}),
y2 AS ({_clustered("(SELECT page, tab, spot_at FROM keep WHERE level)", "page, tab", "2")}),
ys AS ({_clustered("(SELECT *, count(*) OVER (PARTITION BY page, tab) AS many FROM y2)", "page, tab", "CASE WHEN many > 2 THEN 10 ELSE 2 END")}),
col AS (SELECT page, tab, row_number() OVER w - 1 AS col, spot_at AS x0, lead(spot_at) OVER w AS x1 FROM xs WINDOW w AS (PARTITION BY page, tab ORDER BY spot_at)),
row_ AS (SELECT page, tab, row_number() OVER w - 1 AS r, spot_at AS y0, lead(spot_at) OVER w AS y1 FROM ys WINDOW w AS (PARTITION BY page, tab ORDER BY spot_at)),
grid AS (SELECT * FROM (SELECT *, max(x1) OVER w - min(x0) OVER w AS gw, max(y1) OVER w - min(y0) OVER w AS gh FROM row_ JOIN col USING (page, tab) WHERE x1 IS NOT NULL AND y1 IS NOT NULL WINDOW w AS (PARTITION BY page, tab)) WHERE gw >= 60 AND gh >= 20),
wall AS (
  SELECT *, EXISTS (SELECT 1 FROM keep k WHERE k.page = grid.page AND k.tab = grid.tab AND NOT k.level AND abs(k.spot_at - x1) <= 6 AND least(y1, k.high) - greatest(y0, k.low) >= 0.5 * (y1 - y0)) AS at_right,
    EXISTS (SELECT 1 FROM keep k WHERE k.page = grid.page AND k.tab = grid.tab AND k.level AND abs(k.spot_at - y1) <= 10 AND least(x1, k.high) - greatest(x0, k.low) >= 0.5 * (x1 - x0)) AS at_foot FROM grid),
run AS (SELECT *, sum(coalesce(before, true)::INTEGER) OVER (PARTITION BY page, tab, r ORDER BY col ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(at_right) OVER (PARTITION BY page, tab, r ORDER BY col) AS before FROM wall)),
wide AS (SELECT page, tab, r, min(col) AS col, count(*) AS col_span, bool_or(at_foot) AS foot, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM run GROUP BY page, tab, r, g),
tall AS (SELECT *, sum((NOT coalesce(pr = r - 1 AND NOT pf, false))::INTEGER) OVER (PARTITION BY page, tab, col, col_span ORDER BY r ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, lag(r) OVER w AS pr, lag(foot) OVER w AS pf FROM wide WINDOW w AS (PARTITION BY page, tab, col, col_span ORDER BY r)))"""


@query("ruled_cells", f"""
WITH {TABLES}
SELECT page, tab::BIGINT AS "table", min(r)::INTEGER AS "row", col::INTEGER AS col, count(*) AS row_span, col_span, round(min(x0), 6) AS x0, round(min(y0), 6) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1
FROM tall GROUP BY page, tab, col, col_span, g""")
def ruled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of all ruled tables, merged where walls are absent."""
    found = ruled_tables.cells(_items(spark, sf_dir), several=_segments_of_item())
    return found.select("page", "table", "row", "col", "row_span", "col_span", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))
