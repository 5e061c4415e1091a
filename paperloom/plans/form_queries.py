"""Queries on forms: pages whose rows are an order's items, with labels in cells, in wide cells and before underlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import form_fields
from paperloom.plans.registry import query
from paperloom.session import by_key, table

SYNONYMS = [("company", ["公司名稱", "Company Name"]), ("tax_id", ["統一編號"]), ("phone", ["電話"])]


ITEMS = "item AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with one row for each number of an order, dealt by order: pages made of them stay where they are."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return by_key(own, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))


def _form(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The spans, cells and lines of all pages."""
    item = _items(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), "l_partkey", (F.col("l_linenumber") * 30.0).alias("y"))
    kind = F.col("n") % 3
    text = F.when(kind == 0, "1. 公司名稱(全名)").when(kind == 1, "統 一 編 號：").otherwise("電話／手機")
    y = F.col("y")

    def box(name: str, number, x0: float, x1: float, top: float, bottom: float, *more):
        ends = zip(form_fields.BOX, (F.lit(x0), y + top, F.lit(x1), y + bottom))
        return F.struct(number.alias(name), *more, *(e.alias(c) for c, e in ends))

    def rows(*some):
        return item.select("page", F.explode(F.array(*some)).alias("b")).filter("b IS NOT NULL").select("page", "b.*")

    filled = F.when((kind == 1) & (F.col("l_partkey") % 2 == 0), box("span", F.col("n") * 2 + 1, 110.0, 150.0, 5, 15, F.lit("filled in").alias("text")))
    spans = rows(box("span", F.col("n") * 2, 0.0, 60.0, 5, 15, text.alias("text")), filled)
    left = F.when(kind != 2, F.struct((F.col("n") * 2).alias("cell"), F.lit(0.0).alias("x0"), y.alias("y0"), F.when(kind == 0, 400.0).otherwise(100.0).alias("x1"), (y + 20).alias("y1")))
    cells = rows(left, F.when(kind == 1, box("cell", F.col("n") * 2 + 1, 100.0, 250.0, 0, 20)))
    lines = item.filter("n % 3 = 2").select("page", F.lit(True).alias("level"), (y + 20).alias("at"), F.lit(70.0).alias("low"), F.lit(200.0).alias("high"))
    return spans, cells, lines


@query("form_field_slots", f"""
WITH {ITEMS}
SELECT l_orderkey AS page, l_linenumber * 2 AS span, ['company', 'tax_id', 'phone'][l_linenumber % 3 + 1] AS key, ['inline', 'right-adj', 'underline'][l_linenumber % 3 + 1] AS kind,
  [63.0, 103.0, 70.0][l_linenumber % 3 + 1]::DOUBLE AS slot_x0, (l_linenumber * 30 + [3, 3, 6][l_linenumber % 3 + 1])::DOUBLE AS slot_y0, [397.0, 247.0, 199.0][l_linenumber % 3 + 1]::DOUBLE AS slot_x1,
  (l_linenumber * 30 + [20, 20, 19][l_linenumber % 3 + 1])::DOUBLE AS slot_y1, l_linenumber % 3 = 1 AND l_partkey % 2 = 0 AS occupied FROM item""")
def form_field_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the value of each label belongs, and whether something stands there."""
    spans, cells, lines = _form(spark, sf_dir)
    found = form_fields.fields(spans, spark.createDataFrame(SYNONYMS, "key string, synonyms array<string>"), cells, lines)
    return found.select("page", "span", "key", "kind", *(f"slot_{c}" for c in form_fields.BOX), "occupied")


@query("enclosing_cells", f"""
WITH {ITEMS}, b AS (SELECT l_orderkey AS page, l_linenumber AS box, 20.0 + l_partkey % 200 AS x0, 30.0 + l_partkey % 200 AS x1, 5.0 + l_suppkey % 90 AS y0, 13.0 + l_suppkey % 90 AS y1 FROM item),
l AS (SELECT l_orderkey AS page, l_linenumber % 2 = 0 AS level, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 100 ELSE l_partkey % 260 END::DOUBLE AS place, 0.0 AS low, 40.0 * l_linenumber AS high FROM item UNION ALL
  SELECT DISTINCT l_orderkey, k % 2 = 0, [0, 0, 120, 300][k + 1]::DOUBLE, 0, 300 FROM item, range(4) t(k)),
h AS (SELECT b.page, box, max(place) FILTER (place < y0 - 0.5) AS ty, min(place) FILTER (place > y1 + 0.5) AS by_ FROM b JOIN l ON b.page = l.page AND level AND low <= x0 AND high >= x1 GROUP BY ALL),
v AS (SELECT b.page, box, max(place) FILTER (place < x0 - 0.5) AS lx, min(place) FILTER (place > x1 + 0.5) AS rx FROM b JOIN l ON b.page = l.page AND NOT level AND low <= y0 AND high >= y1 GROUP BY ALL)
SELECT page, box, lx AS x0, ty AS y0, rx AS x1, by_ AS y1 FROM h JOIN v USING (page, box) WHERE lx IS NOT NULL AND ty IS NOT NULL AND rx IS NOT NULL AND by_ IS NOT NULL""")
def enclosing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest lines on all sides of each box."""
    item = _items(spark, sf_dir)
    n, x, y = F.col("l_linenumber"), F.col("l_partkey") % 200, F.col("l_suppkey") % 90
    boxes = item.select(F.col("l_orderkey").alias("page"), n.alias("box"), (x + 20.0).alias("x0"), (y + 5.0).alias("y0"), (x + 30.0).alias("x1"), (y + 13.0).alias("y1"))
    at = F.when(n % 2 == 0, F.col("l_suppkey") % 100).otherwise(F.col("l_partkey") % 260).cast("double")
    own = item.select(F.col("l_orderkey").alias("page"), (n % 2 == 0).alias("level"), at.alias("at"), F.lit(0.0).alias("low"), (n * 40.0).alias("high"))
    frame = F.explode(F.array(*(F.struct(F.lit(k % 2 == 0).alias("level"), F.lit(float(v)).alias("at")) for k, v in enumerate((0, 0, 120, 300)))))
    outer = item.select(F.col("l_orderkey").alias("page")).distinct().select("page", frame.alias("f")).select("page", "f.level", "f.at", F.lit(0.0).alias("low"), F.lit(300.0).alias("high"))
    return form_fields.enclosing_cells(boxes, own.union(outer))


@query("label_keys_folded", """
SELECT c_custkey, lower(translate(regexp_replace(CASE c_custkey % 4 WHEN 0 THEN '電話' || c_custkey % 10 WHEN 1 THEN 'ｅMail' || c_nationkey WHEN 2 THEN '內' || c_mktsegment ELSE 'Name' || c_nationkey END, '[-－]', '', 'g'), '電話內ｅ', '电話内e')) AS key FROM customer""")
def label_keys_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as forms print them, spelled alike: numbers, spaces, stars, brackets, dashes, compatibility forms and scripts."""
    key = F.col("c_custkey") % 4
    digits, nation = (F.col("c_custkey") % 10).cast("string"), F.col("c_nationkey").cast("string")
    label = F.when(key == 0, F.concat(F.lit("**(3) 電 話"), digits, F.lit("：："))).when(key == 1, F.concat(F.lit("ｅ－Mail"), nation, F.lit("（必填）"))).when(key == 2, F.concat(F.lit("2、內 "), "c_mktsegment")).otherwise(F.concat(F.lit("Na-me "), nation, F.lit(":")))
    return table(spark, sf_dir, "customer").select("c_custkey", form_fields.label_key(label).alias("key"))
