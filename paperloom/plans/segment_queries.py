"""Queries on segments of text, pages and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import fixers, invoices, lists, segments
from paperloom.plans.registry import query
from paperloom.plans.text_queries import LINES
from paperloom.session import table


@query("merged_fragments", """
WITH p AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), s AS (SELECT conv_id * 1000 + turn AS id, k, w[k] AS t FROM p, unnest(range(1, len(w) + 1)) AS u(k)),
g AS (SELECT id, k, t, greatest(1, sum(regexp_matches(t, '[\\p{L}\\p{N}]')::INTEGER) OVER (PARTITION BY id ORDER BY k)) AS g FROM s)
SELECT id, g::BIGINT AS segment, string_agg(t, '' ORDER BY k) AS text FROM g GROUP BY ALL""".replace("\\\\", "\\"))
def merged_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.posexplode(F.split("text", " ", -1)).alias("k", "text"))
    return segments.merge_fragments(turns, "id", "k")


@query("reflowed_paragraphs", rf"""
WITH {LINES}, f AS (SELECT doc_id, pos, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM lined),
g AS (SELECT doc_id, pos, line, sum((b IS NULL OR regexp_matches(b, '[.!?。！？:：;；]\s*$') OR NOT regexp_matches(b, '\S') OR NOT regexp_matches(line, '\S'))::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM f)
SELECT doc_id, g::BIGINT AS paragraph, string_agg(trim(line), ' ' ORDER BY pos) AS text FROM g WHERE regexp_matches(line, '\S') GROUP BY ALL""")
def reflowed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.reflow(lists.explode_lines(table(spark, sf_dir, "documents")), "doc_id", "pos")


@query("line_prefixes", rf"""
WITH {LINES}, p AS (SELECT doc_id, pos, line, regexp_extract(line, '^(\s*(?:[-*•●○■□◆▪]\s+(?:\[[ xX]\]\s+)?|\[[ xX]\]\s+|\d{{1,3}}[.)、]\s*|>+\s*|#{{1,6}}\s+)?)', 1) AS prefix FROM lined)
SELECT doc_id, pos, prefix, line[length(prefix) + 1:] AS rest FROM p""")
def line_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.explode_lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", segments.split_prefix(F.col("line")).alias("s")).select("doc_id", "pos", "s.*")


@query("page_fingerprints", """
WITH s AS (SELECT DISTINCT source, lang || ' ' || n_chars % 97 AS t FROM documents), r AS (SELECT source, t, row_number() OVER (PARTITION BY source ORDER BY t) AS k FROM s)
SELECT source, sha256(string_agg(t, '|' ORDER BY t)) AS fingerprint FROM r WHERE k <= 60 GROUP BY source""")
def page_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "documents").select("source", F.concat_ws(" ", "lang", (F.col("n_chars") % 97).cast("string")).alias("text"))
    return segments.fingerprint(spans, "source")


_CORRECTED = rf"""
WITH {LINES}, n AS (SELECT *, regexp_replace(line, 'the', 'The', 'g') AS new FROM lined), c AS (SELECT *, length(regexp_replace(line, '\s', '', 'g')) AS a, length(regexp_replace(new, '\s', '', 'g')) AS b FROM n),
f AS (SELECT *, abs(a - b) <= greatest(2.0, 0.3 * a) AS fits FROM c), w AS (SELECT *, fits AND avg(fits::INTEGER) OVER (PARTITION BY doc_id) >= 0.3 AS corrected FROM f)
SELECT doc_id, pos, CASE WHEN corrected THEN new ELSE line END AS line, corrected FROM w"""


@query("corrected_lines", _CORRECTED)
def corrected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lists.explode_lines(table(spark, sf_dir, "documents"))
    return segments.corrected_lines(own, own.withColumn("line", F.regexp_replace("line", "the", "The")), "doc_id")


@query("corrected_lines_all", _CORRECTED)
def corrected_lines_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under the name it has had."""
    return corrected_lines(spark, sf_dir)


@query("corrected_turns", r"""
WITH n AS (SELECT conv_id AS doc_id, turn AS pos, text AS line, regexp_replace(text, 'a', CASE WHEN conv_id % 3 = 0 THEN 'aaaaaa' ELSE 'A' END, 'g') AS new FROM conversations WHERE text IS NOT NULL),
c AS (SELECT *, length(regexp_replace(line, '\s', '', 'g')) AS a, length(regexp_replace(new, '\s', '', 'g')) AS b FROM n),
f AS (SELECT *, abs(a - b) <= greatest(2.0, 0.3 * a) AS fits FROM c), w AS (SELECT *, fits AND avg(fits::INTEGER) OVER (PARTITION BY doc_id) >= 0.3 AS corrected FROM f)
SELECT doc_id, pos, CASE WHEN corrected THEN new ELSE line END AS line, corrected FROM w""")
def corrected_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of turns, some of which grow the text so much that they are refused."""
    own = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("text").alias("line"))
    grown = F.when(F.col("doc_id") % 3 == 0, F.replace("line", F.lit("a"), F.lit("aaaaaa"))).otherwise(F.replace("line", F.lit("a"), F.lit("A")))
    return segments.corrected_lines(own, own.withColumn("line", grown), "doc_id")


@query("html_escapes", r"""
SELECT page_id, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS escaped,
  length(replace(regexp_replace(html, '[\r\n]+', ' ', 'g'), '|', '\|')) AS markdown FROM pages""")
def html_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(T.xml_escape(F.col("html"))).cast("long").alias("escaped"), F.length(T.markdown_escape(F.col("html"))).cast("long").alias("markdown"))


@query("list_markers", rf"""
WITH {LINES} SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^\s*[-*]?\s*[\[［][ xX✓]?[\]］]') THEN 'checkbox' WHEN regexp_matches(line, '^\s*[•●○■□◆◇▪▫‣⁃*\-–—]\s+') THEN 'bullet'
  WHEN regexp_matches(line, '^\s*第[一二三四五六七八九十百0-9]+[條章節項款]') THEN 'article' WHEN regexp_matches(line, '^\s*[一二三四五六七八九十]+[、.．]') THEN 'cjk_number' WHEN regexp_matches(line, '^\s*[(（][一二三四五六七八九十]+[)）]') THEN 'cjk_paren'
  WHEN regexp_matches(line, '^\s*[(（]?\d{{1,3}}[)）]') THEN 'paren_number' WHEN regexp_matches(line, '^\s*\d+(?:\.\d+)+\s') THEN 'decimal' WHEN regexp_matches(line, '^\s*\d{{1,3}}[.、．]\s*') THEN 'number'
  WHEN regexp_matches(line, '^\s*(?:[IVX]+|[ivx]+)[.)]\s') THEN 'roman' WHEN regexp_matches(line, '^\s*[A-Za-z][.)]\s') THEN 'letter' WHEN regexp_matches(line, '^\s*>\s') THEN 'quote' WHEN regexp_matches(line, '^\s*#{{1,6}}\s') THEN 'heading' END AS marker FROM lined""")
def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.explode_lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", T.list_marker(F.col("line")).alias("marker"))


@query("items_attached", """
WITH i AS (SELECT o_custkey AS user_key, o_orderkey AS invoice_number, o_orderkey AS scanned_at FROM orders), m AS (SELECT user_key, max(scanned_at) AS invoice_number FROM i GROUP BY 1),
t AS (SELECT o_custkey AS user_key, list_sort(list_distinct(list(o_orderpriority))) AS items FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT i.user_key, i.invoice_number, coalesce(array_to_string(items, ' / '), '') AS items FROM i LEFT JOIN m ON i.user_key = m.user_key AND i.invoice_number = m.invoice_number LEFT JOIN t ON m.user_key = t.user_key""")
def items_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    inv = o.select(F.col("o_custkey").alias("user_key"), F.col("o_orderkey").alias("invoice_number"), F.col("o_orderkey").alias("scanned_at"), F.lit(None).cast("array<string>").alias("items"))
    items = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_key"), F.array("o_orderpriority").alias("items"))
    out = invoices.attach_items(inv, items)
    return out.select("user_key", "invoice_number", F.coalesce(F.array_join("items", " / "), F.lit("")).alias("items"))


@query("object_pages", "SELECT l_partkey AS object_id, min(l_linenumber)::INTEGER AS first_page, list_sort(list_distinct(list(l_linenumber))) AS pages, count(DISTINCT l_suppkey) AS documents FROM lineitem GROUP BY 1")
def object_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by id with their first page, all pages and in how many documents they are."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("object_id")).agg(F.min("l_linenumber").alias("first_page"), F.array_sort(F.collect_set("l_linenumber")).alias("pages"), F.countDistinct("l_suppkey").alias("documents"))


@query("page_sizes", """
WITH s AS (SELECT round(p_size * 10)::BIGINT AS w, round(p_retailprice / 10)::BIGINT AS h, count(*) AS n FROM part GROUP BY ALL)
SELECT w, h, n, CASE WHEN abs(least(w, h) - 210) <= 2 AND abs(greatest(w, h) - 297) <= 2 THEN 'A4' WHEN abs(least(w, h) - 148) <= 2 AND abs(greatest(w, h) - 210) <= 2 THEN 'A5' END AS paper FROM s""")
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of page sizes with the paper they are, within two millimetres."""
    sizes = table(spark, sf_dir, "part").groupBy(F.round(F.col("p_size") * 10).cast("long").alias("w"), F.round(F.col("p_retailprice") / 10).cast("long").alias("h")).agg(F.count("*").alias("n"))
    small, large = F.least("w", "h"), F.greatest("w", "h")
    near = lambda a, b: (F.abs(small - a) <= 2) & (F.abs(large - b) <= 2)
    return sizes.withColumn("paper", F.when(near(210, 297), "A4").when(near(148, 210), "A5"))


_ITEM = "CASE doc_id % 9 WHEN 0 THEN '(二) ' WHEN 1 THEN '1.2 ' WHEN 2 THEN '第 3 章 ' WHEN 3 THEN 'iv. ' WHEN 4 THEN '- ' WHEN 5 THEN '(B) ' WHEN 6 THEN '壹、' WHEN 7 THEN '7. ' ELSE '' END"


@query("list_items", rf"""
WITH {LINES}, l AS (SELECT doc_id, pos, {_ITEM} || line AS line FROM lined)
SELECT doc_id, pos, {"".join(f"CASE WHEN regexp_matches(line, '{p}') THEN '{n}' ELSE " for n, _, p in T.LIST_PATTERNS)}NULL{" END" * len(T.LIST_PATTERNS)} AS name,
  {"".join(f"CASE WHEN regexp_matches(line, '{p}') THEN regexp_extract(line, '{p}', {T.re.compile(p).groups}) ELSE " for _, _, p in T.LIST_PATTERNS)}NULL{" END" * len(T.LIST_PATTERNS)} AS body FROM l""")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers and bodies of list items; every document's lines get markers of one kind in front."""
    marks = F.array(*map(F.lit, ("(二) ", "1.2 ", "第 3 章 ", "iv. ", "- ", "(B) ", "壹、", "7. ", "")))
    lines = lists.explode_lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", F.concat(F.get(marks, (F.col("doc_id") % 9).cast("int")), "line").alias("line"))
    return lines.select("doc_id", "pos", T.list_item(F.col("line")).alias("i")).select("doc_id", "pos", "i.name", "i.body")


@query("garbled_lines", rf"""
WITH {LINES}, l AS (SELECT doc_id, pos, CASE pos % 5 WHEN 0 THEN '∂中' || line WHEN 1 THEN repeat('e' || left(line, 2), 4) WHEN 2 THEN repeat('x', 8) || line ELSE line END AS line FROM lined),
c AS (SELECT *, length(regexp_replace(line, '[^\x{{2200}}-\x{{23ff}}\x{{2500}}-\x{{257f}}\x{{25a0}}-\x{{27bf}}\x{{3100}}-\x{{318f}}\x{{e000}}-\x{{f8ff}}\x{{3400}}-\x{{4dbf}}\x{{20000}}-\x{{2ffff}}]', '', 'g')) AS odd,
  length(regexp_replace(line, '[^\x{{3400}}-\x{{9fff}}\x{{20000}}-\x{{2ffff}}]', '', 'g')) AS ideographs FROM l),
k AS (SELECT *, list_filter(range(1, length(line) + 1), lambda i: length(list_filter([2, 3, 4], lambda p: length(line[i:i + 4 * p - 1]) = 4 * p AND line[i:i + 4 * p - 1] = repeat(line[i:i + p - 1], 4) AND NOT contains(line[i:i + p - 1], chr(10)))) > 0) AS starts FROM c),
f AS (SELECT *, CASE WHEN len(starts) > 0 THEN line[starts[1]:starts[1] + list_filter([4, 3, 2], lambda p: length(line[starts[1]:starts[1] + 4 * p - 1]) = 4 * p AND line[starts[1]:starts[1] + 4 * p - 1] = repeat(line[starts[1]:starts[1] + p - 1], 4))[1] - 1] ELSE '' END AS cycle FROM k)
SELECT doc_id, pos, line <> '' AND ((odd >= 1 AND ideographs + odd <= 12) OR odd >= 0.25 * greatest(ideographs + odd, 1) OR regexp_matches(line, '{"|".join(f"{x}{{8}}" for x in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")}') OR regexp_matches(cycle, '[A-Za-z0-9]')) AS garbled FROM f""")
def garbled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a wrong character map spoils; some are spoilt here."""
    line, k = F.col("line"), F.col("pos") % 5
    spoilt = F.when(k == 0, F.concat(F.lit("∂中"), line)).when(k == 1, F.repeat(F.concat(F.lit("e"), F.left(line, F.lit(2))), 4)).when(k == 2, F.concat(F.lit("xxxxxxxx"), line)).otherwise(line)
    return lists.explode_lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", T.garbled(spoilt).alias("garbled"))


@query("cleaned_lines", rf"""
WITH {LINES}, l AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 0 THEN chr(57345) || chr(3) || line WHEN pos % 4 = 1 THEN 'bcdfghjk' || left(line, 2) ELSE line END AS line FROM lined),
k AS (SELECT doc_id, pos, regexp_replace(line, '[\x{{e000}}-\x{{f8ff}}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g') AS t FROM l),
c AS (SELECT *, greatest(length(t), 1) AS n, length(regexp_replace(t, '[^\x{{c0}}-\x{{24f}}]', '', 'g')) AS extra, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(t, '[^AEIOUaeiou]', '', 'g')) AS vowels, regexp_matches(t, '[\x{{4e00}}-\x{{9fff}}]') AS cjk FROM k)
SELECT doc_id, pos, CASE WHEN (extra >= 5 AND extra > 0.1 * n) OR (letters >= 8 AND vowels < 0.12 * letters AND NOT cjk) THEN '' ELSE t END AS line FROM c""")
def cleaned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without private and control characters, empty where the rest is noise; some are spoilt here."""
    line, k = F.col("line"), F.col("pos") % 4
    spoilt = F.when(k == 0, F.concat(F.lit("\x03"), line)).when(k == 1, F.concat(F.lit("bcdfghjk"), F.left(line, F.lit(2)))).otherwise(line)
    return lists.explode_lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", T.clean(spoilt).alias("line"))


@query("fixed_lines")
def fixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on pages of twenty with a header each, through all fixers."""
    lines = lists.explode_lines(table(spark, sf_dir, "documents"))
    placed = lines.select("doc_id", F.expr("pos div 20").alias("page"), (F.col("pos") + 1).cast("long").alias("pos"), ((F.col("pos") % 20 + 1) * 40.0).alias("y"), F.lit(1000.0).alias("height"), F.col("line").alias("text"))
    heads = placed.groupBy("doc_id", "page").agg(F.min("pos").alias("first"))
    heads = heads.select("doc_id", "page", F.col("first").alias("pos"), F.lit(0.0).alias("y"), F.lit(1000.0).alias("height"), F.concat(F.lit("page of "), "doc_id").alias("text"))
    # the header stands before the page's first line
    both = placed.withColumn("pos", F.col("pos") * 2).unionByName(heads.withColumn("pos", F.col("pos") * 2 - 1))
    return fixers.run(both)[0].select("doc_id", "page", "pos", "text")
