"""Fields of forms: labels found by their synonyms, and the place beside or below each where its value belongs.

Spans (page, span, text, x0, y0, x1, y1), cells (page, cell, x0, y0, x1, y1) and whole lines (page, level, at, low, high) are dealt
by page once, and each label holds those of its page. On pages of more than FEW of them they meet by equi-joins on tiles and by the
sweep of ``layout``, never as all pairs of a page. Rows without coordinates, and blank spans, are left out. Spans of several labels count as these; a label of two names around a slash goes by the first
one known.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom.operators import forms, layout
from paperloom.session import by_key, cut

#: Characters of two scripts that forms mix, and dashes that labels are spelled with or without.
FOLDS = ("內臺戶來會發電號業產廠幣稅於務", "内台户来会发电号业产厂币税于务")
DASHES = "-－–—−‐‑‒―﹣"
PLAIN = str.maketrans("／" + FOLDS[0], "/" + FOLDS[1], DASHES)
#: Fixed values in points: room that a value needs in a wide cell, and in any; widths of value cells; gaps; how far an
#: underline lies below a label, and how much of it must be in reach.
WIDE_ROOM, WIDE_TIMES, LEAST_ROOM = 100.0, 3.0, 30.0
VALUE_WIDTH, MARK_WIDTH = 40.0, 8.0
PAD, UNDERLINE_BELOW, UNDERLINE_REACH, UNDERLINE_SHARED = 3.0, 24.0, 80.0, 8.0
TILE = 50.0
#: Pages of more lines are cut into tiles.
TILED_LINES = 64
#: Pages of up to so many spans, cells and lines are held by each of their labels.
FEW = 500
#: Names of labels are sent to all tasks up to this number.
BROADCAST_ROWS = 200_000
BOX = ("x0", "y0", "x1", "y1")


def _plain(label: str) -> str:
    s = re.sub(r"[^\S\x1c-\x1f]+", "", unicodedata.normalize("NFKC", label))
    s = re.sub(r"^[*＊]+", "", s)
    s = re.sub(r"^[(（]?[0-9]+[)）]?[.、．。)]", "", s)
    s = re.sub(r"[:：]+$", "", s)
    bare = re.sub(r"[(（][^()（）]{1,10}[)）]$", "", s)
    return (bare or s).translate(PLAIN)


@F.pandas_udf(StringType())
def plain(labels: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Labels without what their keys lack; each text of a batch is read once, null stays null."""
    for batch in labels:
        known = {t: _plain(t) for t in batch.dropna().unique()}
        yield batch.map(known, na_action="ignore")


def label_key(label: Column) -> Column:
    """A label for look-up: compatibility forms and script variants folded, without space, leading stars and numbers, closing
    colons and a closing bracket of up to ten characters (unless that is all), dashes; lower case."""
    return F.lower(plain(label))


def _hits(spans: DataFrame, synonyms: DataFrame, page: str) -> DataFrame:
    """(page, span, part, at, key, text, box): labels with the keys of each of their names that is known, ``at`` its place."""
    index = cut(synonyms.select("key", F.explode("synonyms").alias("s")).select(label_key(F.col("s")).alias("name"), "key").filter("name <> ''").distinct())
    index = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index
    known = spans.select(page, "span", "text", *(F.col(c).cast("double") for c in BOX)).dropna(subset=list(BOX)).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    parts = F.transform(forms.label_parts(F.col("text"), F.col("x0"), F.col("x1")), lambda p, k: F.struct(k.alias("part"), p["text"].alias("text"), p["x0"].alias("x0"), p["x1"].alias("x1")))
    every = F.concat(F.array(F.struct(F.lit(-1).alias("part"), "text", "x0", "x1")), parts)
    named = known.select(page, "span", "y0", "y1", F.explode(every).alias("p")).select(page, "span", "p.*", "y0", "y1").withColumn("name", label_key(F.col("text")))
    # the whole name first, then its parts around slashes, in order; a filter of rows would work the names out twice
    several = F.array_distinct(F.filter(F.concat(F.array("name"), F.split("name", "/")), lambda n: n != ""))
    names = F.when(F.col("name").contains("/"), several).when(F.col("name") != "", F.array("name"))
    asked = named.select(page, "span", "part", "text", *BOX, F.posexplode(names).alias("at", "name"))
    return asked.join(index, "name").select(page, "span", "part", "at", "key", "text", *BOX)


def matched_labels(spans: DataFrame, synonyms: DataFrame, page: str = "page") -> DataFrame:
    """(page, span, part, key, text, box): the labels among the spans, with each key that they may stand for.

    ``synonyms`` holds (key, synonyms). ``part`` counts the labels of a span of several; -1 is the span itself.
    """
    hits = _hits(spans, synonyms, page).withColumn("_first", F.min("at").over(layout.Window.partitionBy(page, "span", "part")))
    return hits.filter("at = _first").select(page, "span", "part", "key", "text", *BOX).distinct()


def tiles(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / TILE), F.floor(high / TILE)))


def enclosing_cells(boxes: DataFrame, lines: DataFrame, page: str = "page", pad: float = 0.5) -> DataFrame:
    """(page, box, x0, y0, x1, y1): the nearest lines on all four sides that bracket a box; boxes without one of them have none.

    A line that brackets a box passes the tile of the box's corner, where both meet; a page of few lines is one tile. Boxes and lines
    are dealt by page once, and the lines of a tile are held by its row.
    """
    tile = lambda at: F.when(F.col("many"), F.floor(at / TILE)).otherwise(0)
    ask = lambda level, *ends: F.struct(F.lit(level).alias("level"), tile(ends[0]).alias("tile"), F.struct("box", *(e.alias(n) for n, e in zip(("start", "end", "first", "last"), ends))).alias("ask"), F.lit(None).cast("struct<at:double,low:double,high:double>").alias("line"))
    kind = boxes.select("box").schema["box"].dataType.simpleString()
    near = boxes.select(page, "box", *((F.col(c) + (-pad if c in ("x0", "y0") else pad)).cast("double").alias(c) for c in BOX))
    asks = near.select(page, "box", *BOX, *(F.lit(None).cast(t).alias(n) for n, t in (("level", "boolean"), ("at", "double"), ("low", "double"), ("high", "double"))))
    given = lines.select(page, F.lit(None).cast(kind).alias("box"), *(F.lit(None).cast("double").alias(c) for c in BOX), "level", *(F.col(c).cast("double").alias(c) for c in ("at", "low", "high")))
    dealt = by_key(asks.union(given), page).withColumn("many", F.count("at").over(layout.Window.partitionBy(page)) > TILED_LINES)
    x0, y0, x1, y1 = map(F.col, BOX)
    passed = F.transform(F.sequence(tile(F.col("low")), tile(F.col("high"))), lambda t: F.struct(F.col("level").alias("level"), t.alias("tile"), F.lit(None).cast(f"struct<box:{kind},start:double,end:double,first:double,last:double>").alias("ask"), F.struct("at", "low", "high").alias("line")))
    met = dealt.select(page, F.explode(F.when(F.col("level").isNull(), F.array(ask(True, x0, x1, y0, y1), ask(False, y0, y1, x0, x1))).otherwise(passed)).alias("m")).select(page, "m.*")
    held = met.groupBy(page, "level", "tile").agg(F.collect_list("ask").alias("asks"), F.collect_list("line").alias("lines")).filter((F.size("asks") > 0) & (F.size("lines") > 0))
    each = held.select(page, "level", F.explode("asks").alias("a"), "lines").select(page, "level", "a.*", "lines")
    beside = each.withColumn("lines", F.transform(F.filter("lines", lambda n: (n["low"] <= F.col("start") + 0.5) & (n["high"] >= F.col("end") - 0.5)), lambda n: n["at"]))
    found = beside.select(page, "box", "level", F.array_max(F.filter("lines", lambda at: at < F.col("first"))).alias("before"), F.array_min(F.filter("lines", lambda at: at > F.col("last"))).alias("behind"))
    sides = {"x0": (False, "before"), "y0": (True, "before"), "x1": (False, "behind"), "y1": (True, "behind")}
    return found.groupBy(page, "box").agg(*(F.max(F.when(F.col("level") == level, F.col(end))).alias(c) for c, (level, end) in sides.items())).dropna(subset=list(BOX))


def underlines(boxes: DataFrame, lines: DataFrame, page: str = "page") -> DataFrame:
    """(page, box, at, low, high): the nearest level line just below a box that reaches under it or under what follows it."""
    level = lines.filter("level").select(page, F.floor(F.col("at") / TILE).alias("_row"), tiles(F.col("low"), F.col("high")).alias("_tile"), "at", "low", "high")
    asks = boxes.withColumn("_tile", tiles(F.col("x0"), F.col("x1") + UNDERLINE_REACH)).withColumn("_row", tiles(F.col("y1"), F.col("y1") + UNDERLINE_BELOW))
    met = asks.join(level, [page, "_row", "_tile"]).filter(F.col("at").between(F.col("y1"), F.col("y1") + UNDERLINE_BELOW))
    shared = F.least("high", F.col("x1") + UNDERLINE_REACH) - F.greatest("low", "x0")
    return met.filter(shared >= UNDERLINE_SHARED).groupBy(page, "box").agg(F.min(F.struct("at", "low", "high")).alias("l")).select(page, "box", "l.*")


def adjacent(cells: DataFrame, page: str = "page") -> DataFrame:
    """(page, cell, right, below): the next cell to the right, past narrow marker columns if a wider one follows, and below."""
    wide = F.col("x1") - F.col("x0")
    # who asks are all cells, who answers are those wide enough: narrow ones ask, but lie behind everything
    def right(least: float) -> DataFrame:
        hidden = cells.withColumns({"x0": F.when(wide >= least, F.col("x0")).otherwise(F.col("x0") - 1e9)})
        return layout.nearest_right(hidden, page, max_gap=1e8, slack=0.5).withColumnRenamed("right", "hit")

    first = right(VALUE_WIDTH).withColumnRenamed("hit", "_wide")
    any_ = right(MARK_WIDTH).withColumnRenamed("hit", "_any")
    below = layout._near(cells, page, ("y0", "y1"), ("x0", "x1"), 0.5, reach=1e8, slack=0.5).withColumnRenamed("hit", "below")
    found = cells.select(page, "cell").join(first, [page, "cell"], "left").join(any_, [page, "cell"], "left").join(below, [page, "cell"], "left")
    return found.select(page, "cell", F.coalesce("_wide", "_any").alias("right"), "below")


def fields(spans: DataFrame, synonyms: DataFrame, cells: DataFrame, lines: DataFrame, page: str = "page", page_width: float = 595.0) -> DataFrame:
    """(page, span, part, key, label, kind, slot_x0, slot_y0, slot_x1, slot_y1, occupied) of each label and key.

    In a cell the value belongs in the cell at the right; else behind the label, if the cell is wide; else in the cell below;
    else behind the label, if there is some room. Outside of cells it belongs on an underline, or in the enclosing lines, or
    unbounded, up to the edge of the page. A slot that covers more than half of another label is no slot (``kind`` null); one
    that another span lies in by half is occupied.
    """
    given = (spans, cells, lines)
    large = layout.large_pages(FEW, page, *given)
    if large is None:
        return _in_rows(spans, synonyms, cells, lines, page, page_width)
    few, many = ([rows.join(large, page, how) for rows in given] for how in ("left_anti", "left_semi"))
    return _in_rows(few[0], synonyms, *few[1:], page, page_width).union(_in_tiles(many[0], synonyms, *many[1:], page, page_width))


def _slot(page_width: float) -> Column:
    """(kind, slot) of a label (box) from what is around it: cell, right, below and round (boxes), line (y, x0, x1)."""

    def slot(kind: str, *ends: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *(e.cast("double").alias(f"slot_{c}") for c, e in zip(BOX, ends)))

    c = F.col
    room, width = c("cell_x1") - c("x1"), F.greatest(F.lit(1.0), c("x1") - c("x0"))
    top = lambda name: F.greatest(c(f"{name}_y0"), c("y0") - 2)
    behind = slot("inline", c("x1") + PAD, top("cell"), c("cell_x1") - PAD, c("cell_y1"))
    size = c("y1") - c("y0")
    return (
        F.when(c("right_x0").isNotNull(), slot("right-adj", c("right_x0") + PAD, top("right"), c("right_x1") - PAD, c("right_y1")))
        .when((room > WIDE_ROOM) & (room >= WIDE_TIMES * width), behind)
        .when(c("below_x0").isNotNull(), slot("below-adj", c("below_x0") + PAD, c("below_y0"), c("below_x1") - PAD, c("below_y1")))
        .when(room > LEAST_ROOM, behind)
        .when(c("round_x0").isNotNull() & (c("round_x1") - c("x1") > LEAST_ROOM), slot("inline", c("x1") + PAD, top("round"), c("round_x1") - PAD, c("round_y1")))
        .when(c("line_y").isNotNull() & (c("line_x1") - 1 > F.greatest(c("line_x0"), c("x1") + PAD)), slot("underline", F.greatest(c("line_x0"), c("x1") + PAD), F.greatest(c("y0") - 0.2 * size, c("line_y") - 1.4 * size), c("line_x1") - 1, c("line_y") - 1))
        .otherwise(slot("unbounded", c("x1") + PAD, c("y0"), F.lit(page_width), c("y1")))
    )


def _in_rows(spans: DataFrame, synonyms: DataFrame, cells: DataFrame, lines: DataFrame, page: str, page_width: float) -> DataFrame:
    """``fields`` of pages of few rows: each label looks through arrays of what its page holds."""
    box = [F.col(b).cast("double").alias(b) for b in BOX]
    held = {
        "labels": by_key(_hits(spans, synonyms, page), page).distinct().select(page, F.struct("span", "part", "at", "key", "text", *BOX).alias("labels")),
        "texts": _texts(spans, page).select(page, F.struct("own.span", *BOX).alias("texts")),
        "cells": cells.select(page, "cell", *box).dropna().select(page, F.struct("cell", *BOX).alias("cells")),
        "lines": lines.select(page, "level", *(F.col(c).cast("double").alias(c) for c in ("at", "low", "high"))).dropna().select(page, F.struct("level", "at", "low", "high").alias("lines")),
    }
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), held.values()).filter(F.col(page).isNotNull())
    each = rows.select(page, F.col("labels").alias("l"), *(F.collect_list(n).over(layout.Window.partitionBy(page)).alias(n) for n in held)).filter(F.col("l").isNotNull())
    earlier = F.exists("labels", lambda o: (o["span"] == F.col("l.span")) & (o["part"] == F.col("l.part")) & (o["at"] < F.col("l.at")))
    each = each.filter((F.col("l.at") == 0) | ~F.coalesce(earlier, F.lit(False))).select("*", *(F.col(f"l.{b}").alias(b) for b in BOX))

    # what a label has no use for isn't looked for
    x0, y0, x1, y1 = map(F.col, BOX)
    cell, room = F.col("cell"), F.col("cell.x1") - x1
    wide = lambda least: F.filter("cells", lambda c: c["x1"] - c["x0"] >= least)
    right = lambda least: layout.first_behind(wide(least), cell, ("x0", "x1"), ("y0", "y1"), 0.5, 1e8, 0.5)
    below = layout.first_behind(F.col("cells"), cell, ("y0", "y1"), ("x0", "x1"), 0.5, 1e8, 0.5)
    each = each.withColumn("cell", layout.smallest_around(F.col("cells"), (x0 + x1) / 2, (y0 + y1) / 2))
    each = each.withColumn("right", F.when(cell.isNotNull(), F.coalesce(right(VALUE_WIDTH), right(MARK_WIDTH))))
    each = each.withColumn("below", F.when(cell.isNotNull() & F.col("right").isNull(), below))

    outside = F.col("right").isNull() & F.col("below").isNull() & F.coalesce(room <= LEAST_ROOM, F.lit(True))
    beside = lambda level, start, end: F.transform(F.filter("lines", lambda n: (n["level"] == level) & (n["low"] <= start - 0.5 + 0.5) & (n["high"] >= end + 0.5 - 0.5)), lambda n: n["at"])
    level, upright = beside(True, x0, x1), beside(False, y0, y1)
    before = lambda lines, first: F.array_max(F.filter(lines, lambda at: at < first - 0.5))
    behind = lambda lines, last: F.array_min(F.filter(lines, lambda at: at > last + 0.5))
    sides = (before(upright, x0), before(level, y0), behind(upright, x1), behind(level, y1))
    under = F.filter("lines", lambda n: n["level"] & n["at"].between(y1, y1 + UNDERLINE_BELOW) & (F.least(n["high"], x1 + UNDERLINE_REACH) - F.greatest(n["low"], x0) >= UNDERLINE_SHARED))
    line = F.array_min(F.transform(under, lambda n: F.struct(n["at"].alias("y"), n["low"].alias("x0"), n["high"].alias("x1"))))
    each = each.withColumns({"round": F.when(outside, F.struct(*(e.alias(b) for b, e in zip(BOX, sides)))), "line": F.when(outside, line)})
    whole = functools.reduce(lambda a, b: a & b, (F.col(f"round.{b}").isNotNull() for b in BOX))
    ends = [F.col(f"{n}.{b}").alias(f"{n}_{b}") for n in ("cell", "right", "below") for b in BOX] + [F.when(whole, F.col(f"round.{b}")).alias(f"round_{b}") for b in BOX]
    ends += [F.col(f"line.{b}").alias(f"line_{b}") for b in ("y", "x0", "x1")]
    slots = each.select(page, "l", "labels", "texts", *BOX, *ends).withColumn("s", _slot(page_width)).select(page, "l", "labels", "texts", "s.*")

    slot, own = [F.col(f"slot_{b}") for b in BOX], F.col("l")
    near = lambda o: (o["y0"] < slot[3]) & (o["y1"] > slot[1])
    on = lambda rows, part: F.coalesce(F.exists(rows, lambda o: near(o) & _covers(slot, [o[b] for b in BOX], 0.5) & ~_own(own["span"], own["part"], o["span"], part(o))), F.lit(False))
    found = slots.withColumns({"good": ~on("labels", lambda o: o["part"]), "occupied": on("texts", lambda o: F.lit(-1))})
    shown = (F.when(F.col("good"), F.col(n)).alias(n) for n in ("kind", *(f"slot_{b}" for b in BOX), "occupied"))
    return found.select(page, "l.span", "l.part", "l.key", F.col("l.text").alias("label"), *shown)


def _in_tiles(spans: DataFrame, synonyms: DataFrame, cells: DataFrame, lines: DataFrame, page: str, page_width: float) -> DataFrame:
    """``fields`` of pages of any size, by joins."""
    # labels and slots are read several times
    labels = cut(matched_labels(spans, synonyms, page))
    boxes = labels.select(page, F.struct("span", "part").alias("box"), *BOX).distinct()
    points = boxes.select(page, F.col("box").alias("point"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    held = layout.containing_cells(points, cells, page).withColumnRenamed("point", "box")
    beside = adjacent(cells, page)
    place = lambda name: cells.select(F.col(page).alias("_page"), F.col("cell").alias(f"_{name}"), *(F.col(c).alias(f"{name}_{c}") for c in BOX))
    rows = boxes.join(held, [page, "box"], "left").join(beside, [page, "cell"], "left")
    for name in ("cell", "right", "below"):
        own = place(name)
        rows = rows.join(own, (F.col(page) == F.col("_page")) & (F.col(name) == F.col(f"_{name}")), "left").drop("_page", f"_{name}")
    around = enclosing_cells(boxes, lines, page).select(page, "box", *(F.col(c).alias(f"round_{c}") for c in BOX))
    under = underlines(boxes, lines, page).select(page, "box", F.col("at").alias("line_y"), F.col("low").alias("line_x0"), F.col("high").alias("line_x1"))
    rows = rows.join(around, [page, "box"], "left").join(under, [page, "box"], "left")
    slots = cut(rows.withColumn("s", _slot(page_width)).select(page, "box", "s.*"))
    covering, filled = _covered(slots, boxes.withColumn("own", F.col("box")), page, 0.5), _covered(slots, _texts(spans, page), page, 0.5)
    found = slots.join(covering.withColumn("_bad", F.lit(True)), [page, "box"], "left").join(filled.withColumn("occupied", F.lit(True)), [page, "box"], "left")
    good = F.col("_bad").isNull()
    found = found.select(page, "box", *(F.when(good, F.col(n)).alias(n) for n in ("kind", *(f"slot_{b}" for b in BOX))), F.when(good, F.coalesce("occupied", F.lit(False))).alias("occupied"))
    keyed = labels.select(page, F.struct("span", "part").alias("box"), "key", F.col("text").alias("label"))
    return keyed.join(found, [page, "box"]).select(page, "box.span", "box.part", "key", "label", "kind", *(f"slot_{b}" for b in BOX), "occupied")


def _texts(spans: DataFrame, page: str) -> DataFrame:
    known = spans.filter(F.trim(F.coalesce("text", F.lit(""))) != "").dropna(subset=list(BOX))
    return known.select(page, *(F.col(b).cast("double").alias(b) for b in BOX), F.struct("span", F.lit(-1).alias("part")).alias("own"))


def _covers(slot: list[Column], other: list[Column], share: float) -> Column:
    across = F.least(slot[2], other[2]) - F.greatest(slot[0], other[0])
    down = F.least(slot[3], other[3]) - F.greatest(slot[1], other[1])
    return (across > 1) & (down > 1) & (across * down > share * ((other[2] - other[0]) * (other[3] - other[1])))


def _own(span: Column, part: Column, other_span: Column, other_part: Column) -> Column:
    """Whether a box is (a part of) a label's own span."""
    return (span == other_span) & ((other_part == -1) | (part == other_part) | (part == -1))


def _covered(slots: DataFrame, boxes: DataFrame, page: str, share: float) -> DataFrame:
    """(page, box) of the slots that cover more than a share of a box that isn't (a part of) their own span; they meet by tiles."""
    dealt = slots.withColumn("_tx", tiles(F.col("slot_x0"), F.greatest("slot_x0", "slot_x1"))).withColumn("_ty", tiles(F.col("slot_y0"), F.greatest("slot_y0", "slot_y1")))
    other = boxes.select(page, "own", *(F.col(b).alias(f"o_{b}") for b in BOX)).withColumn("_tx", tiles(F.col("o_x0"), F.col("o_x1"))).withColumn("_ty", tiles(F.col("o_y0"), F.col("o_y1")))
    met = dealt.join(other, [page, "_tx", "_ty"]).filter(_covers([F.col(f"slot_{b}") for b in BOX], [F.col(f"o_{b}") for b in BOX], share))
    return met.filter(~_own(F.col("box.span"), F.col("box.part"), F.col("own.span"), F.col("own.part"))).select(page, "box").distinct()
