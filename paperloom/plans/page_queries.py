"""Queries on the geometry of pages, their lines and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import text as T
from paperloom.operators import alignment, layout, lists, text_stats
from paperloom.operators.quantiles import quantiles
from paperloom.plans.registry import query
from paperloom.plans.text_queries import LINES
from paperloom.session import by_key, table

CELLS = "SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS cell, (l_partkey % 50) * 12.0 AS x0, (l_partkey % 50) * 12.0 + 10 AS x1, (l_orderkey % 40) * 20.0 AS y0, (l_orderkey % 40) * 20.0 + 15 AS y1 FROM lineitem"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 50) * 12.0, (F.col("l_orderkey") % 40) * 20.0
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell"), x.alias("x0"), (x + 10).alias("x1"), y.alias("y0"), (y + 15).alias("y1"))


@query("nearest_below_cells", f"""
WITH c AS ({CELLS})
SELECT a.page, a.cell, arg_min(b.cell, (b.y0 - a.y1, b.cell)) AS below FROM c a JOIN c b ON a.page = b.page AND a.cell <> b.cell AND b.y0 - a.y1 BETWEEN 0 AND 1.6 * (a.y1 - a.y0)
  AND least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.3 * least(a.x1 - a.x0, b.x1 - b.x0) GROUP BY ALL""")
def nearest_below_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.nearest_below(_cells(spark, sf_dir))


GRID = "SELECT DISTINCT l_suppkey AS page, (l_partkey % 5) * 10 + l_linenumber AS cell, (l_partkey % 5) * 120.0 AS x0, (l_partkey % 5) * 120.0 + 110 + l_linenumber * 5 AS x1, l_linenumber * 90.0 AS y0, l_linenumber * 90.0 + 95 AS y1 FROM lineitem"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 5) * 120.0, F.col("l_linenumber") * 90.0
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), ((F.col("l_partkey") % 5) * 10 + F.col("l_linenumber")).alias("cell"), x.alias("x0"), (x + 110 + F.col("l_linenumber") * 5).alias("x1"), y.alias("y0"), (y + 95).alias("y1")).distinct()


@query("containing_cells", f"""
WITH c AS ({GRID}), p AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS point, (l_partkey % 60) * 11.0 AS x, (l_orderkey % 70) * 10.0 AS y FROM lineitem)
SELECT p.page, point, arg_min(cell, ((x1 - x0) * (y1 - y0), cell)) AS cell FROM p JOIN c ON p.page = c.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL""")
def containing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point"), ((F.col("l_partkey") % 60) * 11.0).alias("x"), ((F.col("l_orderkey") % 70) * 10.0).alias("y"))
    return layout.containing_cells(points, _grid(spark, sf_dir))


@query("collated_cells", f"""
WITH c AS ({GRID}), l AS (SELECT DISTINCT l_suppkey AS page, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS line, 't' || l_partkey AS text, (l_partkey % 60) * 11.0 + 4 AS x, (l_orderkey % 70) * 10.0 + 5 AS y FROM lineitem),
h AS (SELECT l.page, line, text, x, y, arg_min(cell, ((x1 - x0) * (y1 - y0), cell)) AS cell FROM l JOIN c ON l.page = c.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL)
SELECT page, cell, string_agg(text, chr(10) ORDER BY y, x, line) AS text FROM h GROUP BY ALL""")
def collated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 60) * 11.0, (F.col("l_orderkey") % 70) * 10.0
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("line"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("text"), x.alias("x0"), (x + 8).alias("x1"), y.alias("y0"), (y + 10).alias("y1")).distinct()
    return layout.collate(lines, _grid(spark, sf_dir))


@query("reading_order", f"WITH c AS ({CELLS}) SELECT page, cell AS id, row_number() OVER (PARTITION BY page ORDER BY floor(y0 / 50), x0, cell)::INTEGER AS place FROM c")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(_cells(spark, sf_dir).withColumnRenamed("cell", "id")).select("page", "id", "place")


@query("column_order", f"WITH c AS ({CELLS}) SELECT page, cell AS id, row_number() OVER (PARTITION BY page ORDER BY x0 >= 300, floor(y0), x0, cell)::INTEGER AS place FROM c")
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order of pages with two columns."""
    return layout.reading_order(_cells(spark, sf_dir).withColumnRenamed("cell", "id").withColumn("right", F.col("x0") >= 300), band=1.0, column="right").select("page", "id", "place")


@query("lines_at_one_place", f"""
WITH c AS ({CELLS}), t AS (SELECT page, cell AS line, CASE WHEN cell % 2 = 0 THEN 'a b' ELSE 'ab ' END || page % 3 AS text, x0, x1, y0, y1 FROM c)
SELECT page, line FROM t QUALIFY row_number() OVER (PARTITION BY page, round((x0 + x1) / 2), round((y0 + y1) / 2), replace(text, ' ', '') ORDER BY line) = 1""")
def lines_at_one_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _cells(spark, sf_dir).withColumnRenamed("cell", "line")
    text = F.concat(F.when(F.col("line") % 2 == 0, "a b").otherwise("ab "), (F.col("page") % 3).cast("string"))
    return layout.same_place(lines.withColumn("text", text)).select("page", "line")


@query("blanked_repeats", """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 2 = 0 THEN event_type ELSE left(event_type, 1) || ' ' || event_type[2:] END AS text FROM events),
p AS (SELECT *, replace(text, ' ', '') AS plain, lag(replace(text, ' ', '')) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e)
SELECT user_id, event_id, CASE WHEN plain <> '' AND plain = before THEN '' ELSE text END AS text FROM p""")
def blanked_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 2 == 0, kind).otherwise(F.concat(F.left(kind, F.lit(1)), F.lit(" "), F.substring(kind, 2, 1000)))
    return layout.blank_repeats(table(spark, sf_dir, "events").select("user_id", "event_id", text.alias("text")), ["user_id"], "event_id")


@query("overprinted_frames", """
WITH f AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS frame, (l_partkey % 40) * 3.0 AS x0, (l_orderkey % 30) * 3.0 AS y0, repeat(l_returnflag, 1 + l_linenumber % 3) || CASE WHEN l_linenumber > 5 THEN l_linestatus ELSE '' END AS text FROM lineitem),
p AS (SELECT a.page, a.frame, a.text, b.frame AS other, b.text AS by_text FROM f a JOIN f b ON a.page = b.page AND a.frame <> b.frame AND abs(a.x0 - b.x0) < 4 AND abs(a.y0 - b.y0) < 4)
SELECT DISTINCT page, frame FROM p WHERE (text = by_text AND other < frame)
  OR (length(by_text) > length(text) AND contains(by_text, text) AND NOT (length(text) = 1 AND replace(by_text, text, '') = ''))
  OR (length(by_text) = 1 AND length(text) > 1 AND replace(text, by_text, '') = '')""")
def overprinted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.repeat(F.col("l_returnflag"), 1 + F.col("l_linenumber") % 3), F.when(F.col("l_linenumber") > 5, F.col("l_linestatus")).otherwise(""))
    frames = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame"), ((F.col("l_partkey") % 40) * 3.0).alias("x0"), ((F.col("l_orderkey") % 30) * 3.0).alias("y0"), text.alias("text"))
    return layout.overprints(frames)


@query("merged_rows", """
WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL), l AS (SELECT l_orderkey AS page, l_linenumber * 1000000 + l_partkey AS line, l_partkey || ' ' || l_suppkey AS text, (l_partkey % 12) * 9.0 AS x0, 100.0 + (l_linenumber % 3) * 12 + 0.5 * (l_suppkey % 2) AS y FROM i),
c AS (SELECT page, line, k AS pos, text[k] AS ch, x0 + 6 * (k - 1) AS x, x0 + 6 * k AS r, y FROM l, unnest(range(1, length(text) + 1)) t(k)),
m AS (SELECT page, line, min(x) FILTER (trim(ch) <> '') AS s, max(r) AS e, y FROM c GROUP BY page, line, y),
w AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY page ORDER BY y, line ROWS UNBOUNDED PRECEDING) AS "row" FROM (SELECT *, coalesce(y - lag(y) OVER (PARTITION BY page ORDER BY y, line) > 2, false) AS new FROM m)),
b AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY page, "row" ORDER BY s, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3, false) AS new2 FROM w),
g AS (SELECT *, sum(new2::INTEGER) OVER (PARTITION BY page, "row" ORDER BY s, line ROWS UNBOUNDED PRECEDING) AS segment FROM b),
k AS (SELECT *, max(e) OVER (PARTITION BY page, "row", segment ORDER BY s, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM g)
SELECT c.page, "row"::BIGINT AS "row", segment::BIGINT AS segment, string_agg(ch, '' ORDER BY s, c.line, pos) AS text, min(x) AS x0, max(r) AS x1
FROM c JOIN k ON c.page = k.page AND c.line = k.line WHERE covered IS NULL OR (x + r) / 2 > covered GROUP BY c.page, "row", segment""")
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one row that overlap, merged without what is printed twice."""
    part, n = F.col("l_partkey"), F.col("l_linenumber")
    text = F.concat_ws(" ", part.cast("string"), F.col("l_suppkey").cast("string"))
    items = by_key(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    lines = items.select(F.col("l_orderkey").alias("page"), (n * 1000000 + part).alias("line"), ((part % 12) * 9.0).alias("x0"), (100.0 + (n % 3) * 12 + 0.5 * (F.col("l_suppkey") % 2)).alias("y"), F.posexplode(F.split(text, "")).alias("pos", "ch"))
    return layout.merged_rows(lines.select("page", "line", "pos", "ch", (F.col("x0") + 6 * F.col("pos")).alias("x"), F.lit(6.0).alias("width"), "y", F.lit(0.0).alias("height")))


@query("paragraph_groups", """
WITH r AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id, (l_orderkey % 300) * 3.0 AS y, (l_partkey % 40) * 10.0 AS x, 8.0 + l_linenumber AS size FROM lineitem),
g AS (SELECT *, lag(y) OVER w AS py, lag(x) OVER w AS px, lag(size) OVER w AS ps FROM r WINDOW w AS (PARTITION BY page ORDER BY y, x, id)),
b AS (SELECT *, coalesce(y - py - least(size, ps) > 0.8 * least(size, ps) OR abs(x - px) > 150, false) AS new FROM g)
SELECT page, id, sum(new::INTEGER) OVER (PARTITION BY page ORDER BY y, x, id ROWS UNBOUNDED PRECEDING)::BIGINT AS "group" FROM b""")
def paragraph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ((F.col("l_orderkey") % 300) * 3.0).alias("y"), ((F.col("l_partkey") % 40) * 10.0).alias("x"), (F.col("l_linenumber") + 8.0).alias("size"))
    return layout.paragraph_groups(rows, ["page"], ["y", "x", "id"]).select("page", "id", "group")


@query("word_gaps", """
WITH r AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id, (l_orderkey % 90) * 7.0 AS x, 8.0 + l_linenumber AS size FROM lineitem),
g AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY page ORDER BY x, id) > 1.8 * size, false) AS new FROM r)
SELECT page, id, sum(new::INTEGER) OVER (PARTITION BY page ORDER BY x, id ROWS UNBOUNDED PRECEDING)::BIGINT AS "group" FROM g""")
def word_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new segment where the gap is over 1.8 sizes."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ((F.col("l_orderkey") % 90) * 7.0).alias("x"), (F.col("l_linenumber") + 8.0).alias("size"))
    wide = F.col("x") - layout.prev("x", ["page"], ["x", "id"]) > 1.8 * F.col("size")
    return layout.gap_groups(rows, ["page"], ["x", "id"], wide).select("page", "id", "group")


@query("heading_levels", """
WITH m AS (SELECT p_brand, median(p_size) AS median FROM part GROUP BY 1)
SELECT p_partkey, median, CASE WHEN p_size / median >= 1.6 THEN 'H1' WHEN p_size / median >= 1.3 THEN 'H2' WHEN p_size / median >= 1.15 AND p_partkey % 2 = 0 THEN 'H3' END AS heading FROM part JOIN m USING (p_brand)""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by size against the median of their kind; bold ones need less."""
    part = table(spark, sf_dir, "part")
    median = quantiles(part, "p_brand", "p_size", {"median": 0.5})
    return part.join(median, "p_brand").select("p_partkey", "median", layout.heading(F.col("p_size"), F.col("median"), F.col("p_partkey") % 2 == 0).alias("heading"))


@query("box_covers", """
WITH b AS (SELECT l_orderkey AS o, l_linenumber AS l, l_quantity AS x0, l_quantity + 10 AS x1, l_partkey % 20 AS y0, l_partkey % 20 + 5 AS y1 FROM lineitem), a AS (SELECT * FROM b WHERE l = 1)
SELECT b.o AS l_orderkey, b.l AS l_linenumber, round(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / 50, 6) AS cover, (b.x0 + b.x1) / 2 AS cx, round((b.x1 - b.x0) * 25.4 / 72, 6) AS width_mm FROM a JOIN b ON a.o = b.o""")
def box_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 10).alias("x1"), (F.col("l_partkey") % 20).cast("double").alias("y0"), (F.col("l_partkey") % 20 + 5).cast("double").alias("y1"))
    a = b.filter("l_linenumber = 1").select("l_orderkey", *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    box, other = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"a_{c}") for c in ("x0", "y0", "x1", "y1"))
    return b.join(a, "l_orderkey").select("l_orderkey", "l_linenumber", F.round(G.cover(box, other), 6).alias("cover"), G.center(box)[0].alias("cx"), F.round(G.points_to_mm(F.col("x1") - F.col("x0")), 6).alias("width_mm"))


@query("contents_entries", r"""
WITH t AS (SELECT p_partkey, repeat(' ', p_size % 7) || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ..... ' WHEN p_partkey % 3 = 1 THEN '…… ' ELSE ' ' END || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_size::VARCHAR END || CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE '' END AS line FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN trim(regexp_replace(regexp_replace(line, '[0-9]+\s*$', ''), '[ .…]+$', '')) END AS title,
  CASE WHEN p_partkey % 5 > 0 THEN regexp_extract(line, '([0-9]+)\s*$', 1)::BIGINT END AS page, CASE WHEN p_partkey % 5 > 0 THEN ((length(line) - length(ltrim(line))) // 2 + 1)::INTEGER END AS level FROM t""")
def contents_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks from lines of contents; lines without a page have none."""
    key = F.col("p_partkey")
    leader = F.when(key % 3 == 0, " ..... ").when(key % 3 == 1, "…… ").otherwise(" ")
    line = F.concat(F.repeat(F.lit(" "), F.col("p_size") % 7), "p_name", leader, F.when(key % 5 == 0, "").otherwise(F.col("p_size").cast("string")), F.when(key % 2 == 0, "  ").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", T.toc_entry(line).alias("e")).select("p_partkey", "e.title", "e.page", "e.level")


@query("footer_lines", rf"""
WITH {LINES} SELECT doc_id, pos, length(line) <= 80 AND (regexp_matches(line, '(?i)(tel|phone|fax|電話|傳真)|\d{{2,4}}-\d{{3,4}}-?\d{{3,4}}')::INTEGER + regexp_matches(line, '[A-Za-z0-9_.+\-]+@[A-Za-z0-9_\-]+\.[A-Za-z0-9_.\-]+')::INTEGER
  + regexp_matches(line, '(統一編號|統編)|(?:^|\D)\d{{8}}(?:\D|$)')::INTEGER + regexp_matches(line, '(?i)(page|第)\s*\d+|^\s*-?\s*\d+\s*-?\s*$')::INTEGER) >= 2 AS footer FROM lined""")
def footer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.explode_lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", T.footer_like(F.col("line")).alias("footer"))


@query("tidy_names", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x{feff}\x{200b}\x{200c}\x{200d}]', '', 'g'), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2028}\x{2029}]+', ' ', 'g')) AS tidy,
  coalesce(nullif(left(regexp_replace(CASE WHEN contains(source || '/' || lang || '.txt', '.') THEN regexp_replace(source || '/' || lang || '.txt', '\.[^.]*$', '') END, '[\\/:*?"<>|]', '_', 'g'), 80), ''), 'list') AS file_name FROM documents""")
def tidy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.without_zero_width(F.col("text")).alias("tidy"), T.safe_file_name(F.concat("source", F.lit("/"), "lang", F.lit(".txt"))).alias("file_name"))


@query("page_and_overall_counts", """
WITH p AS (SELECT conv_id AS doc_id, turn AS page, length(text) AS chars, len(string_split(text, ' ')) AS words FROM conversations WHERE text IS NOT NULL)
SELECT doc_id, page, sum(chars)::BIGINT AS chars, sum(words)::BIGINT AS words FROM p GROUP BY GROUPING SETS ((doc_id, page), (doc_id))""")
def page_and_overall_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page and, with a null page, the whole document."""
    pages = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return text_stats.by_page_and_overall(pages)


@query("object_counts", "SELECT l_orderkey AS doc_id, count(DISTINCT l_partkey) AS images, count(DISTINCT l_suppkey) AS fonts, count(*) FILTER (l_returnflag = 'R') AS marks FROM lineitem GROUP BY 1")
def object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct images and fonts, and marks, of each document."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.countDistinct("l_partkey").alias("images"), F.countDistinct("l_suppkey").alias("fonts"), F.count_if(F.col("l_returnflag") == "R").alias("marks"))


@query("row_tables", """
WITH l AS (SELECT l_orderkey AS page, l_linenumber // 2 AS "row", (l_partkey % 4) * 100.0 + l_linenumber AS x0, (l_partkey % 4) * 100.0 + l_linenumber + 60 AS x1 FROM lineitem),
r AS (SELECT page, "row", list((x0 + x1) / 2 ORDER BY x0) AS xs, list(x0 ORDER BY x0) AS a, list(x1 ORDER BY x0) AS b FROM l GROUP BY ALL),
f AS (SELECT page, "row", xs, len(list_filter(range(2, len(xs) + 1), lambda k: a[k] - b[k - 1] >= 15)) > 0 AS wide FROM r),
p AS (SELECT *, lag(xs) OVER w AS before, coalesce(lag(wide) OVER w, false) AS wide_before FROM f WINDOW w AS (PARTITION BY page ORDER BY "row")),
g AS (SELECT *, sum((NOT coalesce(wide AND wide_before AND abs(len(xs) - len(before)) <= 1 AND len(list_filter(range(1, least(len(xs), len(before)) + 1), lambda k: abs(xs[k] - before[k]) > 25)) = 0, false))::INTEGER) OVER (PARTITION BY page ORDER BY "row") AS island FROM p)
SELECT page, min("row") AS first_row, max("row") AS last_row, count(*) AS n_rows, max(len(xs))::INTEGER AS n_cols FROM g WHERE wide GROUP BY page, island HAVING count(*) >= 2 OR max(len(xs)) >= 3 OR max(xs[2] - xs[1]) > 200""")
def row_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0 = (F.col("l_partkey") % 4) * 100.0 + F.col("l_linenumber")
    return layout.row_tables(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.expr("l_linenumber div 2").alias("row"), x0.alias("x0"), (x0 + 60).alias("x1")))


def _paragraphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations, and a second version of them in which every third is cut and the fourth ones come twice."""
    left = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text")
    cut = F.when(F.col("pos") % 3 == 1, F.expr("substring(text, 4)")).otherwise(F.col("text"))
    right = left.select("doc_id", F.explode(F.expr("CASE WHEN pos % 4 = 3 THEN array(2 * pos, 2 * pos + 1) ELSE array(2 * pos) END")).alias("pos"), cut.alias("text"))
    return left, right


TIDY = r"trim(regexp_replace(regexp_replace(text, '[\x{feff}\x{200b}\x{200c}\x{200d}]', '', 'g'), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2028}\x{2029}]+', ' ', 'g'))"


@query("paragraphs_paired", f"""
WITH l AS (SELECT conv_id AS doc_id, turn AS pos, {TIDY} AS text FROM conversations),
r AS (SELECT conv_id AS doc_id, 2 * turn + k AS pos, {TIDY} AS text FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN substring(text, 4) ELSE text END AS text FROM conversations), range(2) t(k) WHERE k = 0 OR turn % 4 = 3),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS nth FROM l WHERE doc_id IS NOT NULL AND text <> ''),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS nth FROM r WHERE doc_id IS NOT NULL AND text <> '')
SELECT doc_id, text, nth, a.pos::BIGINT AS "left", b.pos::BIGINT AS "right" FROM a FULL JOIN b USING (doc_id, text, nth)""")
def paragraphs_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round of the alignment: equal paragraphs, and what has no equal."""
    return alignment.paired(*_paragraphs(spark, sf_dir))


@query("paragraphs_aligned")
def paragraphs_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_paragraphs(*_paragraphs(spark, sf_dir))


@query("recovered_lines")
def recovered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on pages of forty; every ninth is taken out of the known texts."""
    lines = lists.explode_lines(table(spark, sf_dir, "documents"))
    placed = lines.select("doc_id", F.expr("pos div 40").alias("page"), ((F.col("pos") % 40) * 20.0).alias("y"), F.lit(800.0).alias("height"), F.col("line").alias("text"))
    return alignment.recovered_lines(placed, lines.filter("pos % 9 <> 4").select("doc_id", F.col("line").alias("text")))
