"""Positioned text: gap groups, clusters, tiers, nearest cells, runs and repeated lines, as windows per page."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import by_key, cut

def gap_groups(rows: DataFrame, by: list[str], order: list[str], breaks: Column) -> DataFrame:
    """Rows with a group number that grows where ``breaks`` holds; ``breaks`` may use lag over (by, order) as prev()."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("group", F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def prev(column: str, by: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*by).orderBy(*order))


def paragraph_groups(lines: DataFrame, by: list[str], order: list[str] = ("y", "x")) -> DataFrame:
    """A new group where the vertical gap exceeds 0.8 of the smaller size or x jumps by over 150."""
    order = list(order)
    gap = F.col("y") - prev("y", by, order) - F.least("size", prev("size", by, order))
    return gap_groups(lines, by, order, (gap > 0.8 * F.least("size", prev("size", by, order))) | (F.abs(F.col("x") - prev("x", by, order)) > 150))


def cluster_1d(points: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """(by, cluster, center, n): neighbours within the tolerance belong together; the centre is their mean."""
    grouped = gap_groups(points, by, [value], F.col(value) - prev(value, by, [value]) > tolerance)
    return grouped.groupBy(*by, F.col("group").alias("cluster")).agg(F.avg(value).alias("center"), F.count("*").alias("n"))


#: Fixed values in points: least gap between columns, how far columns may be off, distance that makes a lone pair a table.
COLUMN_GAP = 15.0
COLUMN_OFF = 25.0
LONE_PAIR = 200.0


def row_tables(lines: DataFrame, page: str = "page", row: str = "row") -> DataFrame:
    """(page, first_row, last_row, n_rows, n_cols): runs of rows with several columns that lie above one another.

    ``lines`` holds (page, row, x0, x1). A row counts if two neighbours are COLUMN_GAP apart; it goes on with the row
    before, if that counts too, their numbers of lines differ by one at most and their centres by COLUMN_OFF. A single row
    is kept with three lines or with two that are over LONE_PAIR apart. Lines without coordinates are left out.
    """
    placed = lines.filter("x0 IS NOT NULL AND x1 IS NOT NULL").withColumn("_c", F.struct(((F.col("x0") + F.col("x1")) / 2).alias("center"), "x0", "x1"))
    rows = placed.groupBy(page, row).agg(F.sort_array(F.collect_list("_c")).alias("_cells"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("_cells") - 1), lambda k: F.get("_cells", k)["x0"] - F.get("_cells", k - 1)["x1"])
    rows = rows.withColumn("_xs", F.col("_cells.center")).withColumn("_wide", F.when(F.size("_cells") >= 2, F.exists(pairs, lambda gap: gap >= COLUMN_GAP)).otherwise(False))
    xs, before, wide_before = F.col("_xs"), prev("_xs", [page], [row]), prev("_wide", [page], [row])
    rows = rows.withColumn("_before", before).withColumn("_goes_on", F.col("_wide") & F.coalesce(wide_before, F.lit(False)))
    near = F.forall(F.zip_with(xs, F.col("_before"), lambda a, b: F.coalesce(F.abs(a - b) <= COLUMN_OFF, F.lit(True))), lambda ok: ok)
    goes_on = F.col("_goes_on") & (F.abs(F.size(xs) - F.size("_before")) <= 1) & near
    islands = gap_groups(rows, [page], [row], ~F.coalesce(goes_on, F.lit(False))).filter("_wide")
    n_cols = F.max(F.size("_xs"))
    found = islands.groupBy(page, "group").agg(F.min(row).alias("first_row"), F.max(row).alias("last_row"), F.count("*").alias("n_rows"), n_cols.alias("n_cols"), F.max(F.get("_xs", F.lit(1)) - F.get("_xs", F.lit(0))).alias("_apart"))
    return found.filter((F.col("n_rows") >= 2) | (F.col("n_cols") >= 3) | (F.col("_apart") > LONE_PAIR)).drop("group", "_apart")


def size_tiers(spans: DataFrame, by: list[str], size: str, top: int = 3) -> DataFrame:
    """The largest sizes as heading levels 1 to 3."""
    return spans.withColumn("level", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc(size)))).filter(F.col("level") <= top)


def body_size(spans: DataFrame, by: list[str], size: str, weight: Column) -> DataFrame:
    """The size that most characters have."""
    sized = spans.groupBy(*by, size).agg(F.sum(weight).alias("chars"))
    return sized.groupBy(*by).agg(F.max_by(size, F.struct("chars", size)).alias("body_size"))


def heading(size: Column, median: Column, bold: Column) -> Column:
    ratio = size / median
    return F.when(ratio >= 1.6, "H1").when(ratio >= 1.3, "H2").when((ratio >= 1.15) & bold, "H3")


def drop_repeats(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Without rows equal to the one before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_same", F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1)).filter("NOT _same").drop("_same")


def index_runs(rows: DataFrame, by: list[str], index: str, least: int = 2) -> DataFrame:
    """(by, first, last, n): runs of consecutive numbers."""
    island = F.col(index) - F.row_number().over(Window.partitionBy(*by).orderBy(index))
    runs = rows.withColumn("_i", island).groupBy(*by, "_i").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n"))
    return runs.filter(F.col("n") >= least).drop("_i")


def at_edge(top: Column, height: Column, share: float = 0.1) -> Column:
    """Whether a line's top lies in a page's highest or lowest band."""
    return (top < height * share) | (top > height * (1 - share))


def repeated_lines(lines: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text", where: Column | None = None) -> DataFrame:
    """Headers and footers: texts on at least max(2, half) of a document's pages, among the lines ``where`` holds for."""
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("pages"))
    seen = (lines if where is None else lines.filter(where)).groupBy(doc, text).agg(F.countDistinct(page).alias("n"))
    return seen.join(pages, doc).filter(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 2)))


#: Height (or breadth) of the bands that a page is cut into, and cells and bytes that a task sweeps together.
BAND = 50.0
SWEPT_CELLS = 200_000
SWEPT_BYTES = 32 << 20


def sweep(group: np.ndarray, cell: np.ndarray, along: tuple[np.ndarray, np.ndarray], across: tuple[np.ndarray, np.ndarray], reach: float | None, share: float, heights: float, slack: float) -> tuple[np.ndarray, ...]:
    """(cell, gap, hit) as places: for each cell of a group the first one behind its end, in order of where they begin, that
    shares enough of its breadth. All cells look at their next candidate at once, until they have a hit or are out of reach."""
    (a0, a1), (c0, c1) = along, across
    order = np.lexsort((cell, a0, group))
    group, cell, a0, a1, c0, c1 = (x[order] for x in (group, cell, a0, a1, c0, c1))
    n = len(cell)
    # where a cell's end falls among the begins of its band: the number of begins before it
    ask = np.lexsort((np.r_[np.ones(n), np.zeros(n)], np.r_[a0, a1 - slack], np.r_[group, group]))
    begins = np.cumsum(ask < n)
    at = np.empty(n, np.int64)
    queries = ask >= n
    at[ask[queries] - n] = begins[queries]
    limit = np.full(n, reach) if reach is not None else heights * (a1 - a0)
    hit, gap = np.full(n, -1), np.zeros(n)
    open_ = np.arange(n)
    while len(open_):
        j = at[open_]
        inside = j < n
        open_, j = open_[inside], j[inside]
        apart = a0[j] - a1[open_]
        inside = (group[j] == group[open_]) & (apart <= limit[open_])
        open_, j, apart = open_[inside], j[inside], apart[inside]
        common = np.minimum(c1[j], c1[open_]) - np.maximum(c0[j], c0[open_])
        fits = (common >= share * np.minimum(c1[j] - c0[j], c1[open_] - c0[open_])) & (cell[j] != cell[open_])
        hit[open_[fits]], gap[open_[fits]] = j[fits], apart[fits]
        open_ = open_[~fits]
        at[open_] += 1
    found = np.flatnonzero(hit >= 0)
    return order[found], gap[found], order[hit[found]]


def whole_groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole groups, with the group's number in ``_g``; a table ends with the first group that begins
    when it holds SWEPT_CELLS rows or SWEPT_BYTES."""
    held, last, number = [], None, 0
    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch), bool)
        for name in names:
            values = batch.column(name)
            new[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last != tuple(batch.column(name)[0].as_py() for name in names)
        if (sum(map(len, held)) >= SWEPT_CELLS or sum(b.nbytes for b in held) >= SWEPT_BYTES) and new.any():
            cut_ = int(np.flatnonzero(new)[0])
            held.append(batch.slice(0, cut_).append_column("_g", pa.array(np.full(cut_, number))))
            yield pa.Table.from_batches(held)
            held = []
            batch, new = batch.slice(cut_), new[cut_:]
        groups = number + np.cumsum(new)
        held.append(batch.append_column("_g", pa.array(groups)))
        number, last = int(groups[-1]), tuple(batch.column(name)[-1].as_py() for name in names)
    if held:
        yield pa.Table.from_batches(held)


def _near(cells: DataFrame, page: str, along: tuple[str, str], across: tuple[str, str], share: float, reach: float | None = None, heights: float = 0.0, slack: float = 0.0) -> DataFrame:
    """(page, cell, hit): the nearest cell that begins behind a cell's end, within reach, and shares enough of its breadth.

    Cells are dealt to the bands of their page that they cross, each band is swept in order by one task, and the nearest hit
    of a cell's bands is its hit; nothing is compared beyond the first candidates that fit. Cells without coordinates are left
    out. Of equally near ones the smaller cell is taken.
    """
    (a0, a1), (c0, c1) = along, across
    kind = {c: cells.schema[c].dataType.simpleString() for c in (page, "cell")}
    placed = cells.select(F.col(page).alias("page"), "cell", *(F.col(c).cast("double").alias(n) for n, c in zip(("a0", "a1", "c0", "c1"), (a0, a1, c0, c1)))).dropna()
    dealt = placed.withColumn("_band", F.explode(F.sequence(F.floor(F.col("c0") / BAND), F.floor(F.col("c1") / BAND))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "page", "_band"):
            at = {name: table.column(name).to_numpy() for name in ("_g", "cell", "a0", "a1", "c0", "c1")}
            found, gap, hit = sweep(at["_g"], at["cell"], (at["a0"], at["a1"]), (at["c0"], at["c1"]), reach, share, heights, slack)
            yield pa.RecordBatch.from_arrays([table.column("page").take(pa.array(found)).combine_chunks(), pa.array(at["cell"][found]), pa.array(gap), pa.array(at["cell"][hit])], names=["page", "cell", "gap", "hit"])

    bands = dealt.repartition("page", "_band").sortWithinPartitions("page", "_band")
    found = bands.mapInArrow(run, f"page {kind[page]}, cell {kind['cell']}, gap double, hit {kind['cell']}")
    return found.groupBy(F.col("page").alias(page), "cell").agg(F.min_by("hit", F.struct("gap", "hit")).alias("hit"))


def first_behind(cells: Column, own: Column, along: tuple[str, str], across: tuple[str, str], share: float, reach: Column | float, slack: float = 0.0) -> Column:
    """What ``_near`` finds, among an array of cells: the nearest one that begins behind the end of ``own``, as a whole."""
    (a0, a1), (c0, c1) = along, across

    def fits(c: Column) -> Column:
        common = F.least(c[c1], own[c1]) - F.greatest(c[c0], own[c0])
        near = (c[a0] >= own[a1] - slack) & (c[a0] - own[a1] <= reach)
        return near & (common >= share * F.least(c[c1] - c[c0], own[c1] - own[c0])) & (c["cell"] != own["cell"])

    return F.array_min(F.transform(F.filter(cells, fits), lambda c: F.struct(c[a0].alias("at"), c["cell"].alias("cell"), c.alias("of"))))["of"]


def smallest_around(cells: Column, x: Column, y: Column) -> Column:
    """What ``containing_cells`` finds, among an array of cells."""
    inside = F.filter(cells, lambda c: x.between(c["x0"], c["x1"]) & y.between(c["y0"], c["y1"]))
    return F.array_min(F.transform(inside, lambda c: F.struct(((c["x1"] - c["x0"]) * (c["y1"] - c["y0"])).alias("area"), c["cell"].alias("cell"), c.alias("of"))))["of"]


def large_pages(most: int, page: str, *frames: DataFrame) -> DataFrame | None:
    """The pages with more rows than that in all frames together; None if there are none."""
    rows = functools.reduce(DataFrame.union, (f.select(page) for f in frames))
    found = cut(rows.groupBy(page).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(page))
    return None if found.isEmpty() else found


def nearest_right(cells: DataFrame, page: str = "page", max_gap: float = 300.0, slack: float = 0.0) -> DataFrame:
    """(page, cell, right): the nearest cell to the right with half the height in common; it may begin ``slack`` within."""
    return _near(cells, page, ("x0", "x1"), ("y0", "y1"), 0.5, reach=max_gap, slack=slack).withColumnRenamed("hit", "right")


def nearest_below(cells: DataFrame, page: str = "page", heights: float = 1.6) -> DataFrame:
    """(page, cell, below): the nearest cell below within 1.6 heights, with 30 % of the width in common."""
    return _near(cells, page, ("y0", "y1"), ("x0", "x1"), 0.3, heights=heights).withColumnRenamed("hit", "below")


def containing_cells(points: DataFrame, cells: DataFrame, page: str = "page", tile: float = 100.0) -> DataFrame:
    """(page, point, cell): the smallest cell that a point (x, y) lies in; cells are dealt to the tiles they touch."""
    over = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / tile), F.floor(F.col(high) / tile)))
    dealt = cells.withColumn("_tx", over("x0", "x1")).withColumn("_ty", over("y0", "y1"))
    placed = points.withColumn("_tx", F.floor(F.col("x") / tile)).withColumn("_ty", F.floor(F.col("y") / tile))
    inside = placed.join(dealt, [page, "_tx", "_ty"]).filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return inside.groupBy(page, "point").agg(F.min_by("cell", F.struct(area, "cell")).alias("cell"))


def collate(lines: DataFrame, cells: DataFrame, page: str = "page") -> DataFrame:
    """(page, cell, text): the lines whose centre lies in a cell, from top to bottom and left to right."""
    centred = lines.select(page, F.col("line").alias("point"), "text", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    held = containing_cells(centred, cells, page).join(centred, [page, "point"])
    return held.groupBy(page, "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "point", "text"))), lambda t: t["text"]), "\n").alias("text"))


def reading_order(rows: DataFrame, by: str = "page", band: float = 50.0, column: str | None = None) -> DataFrame:
    """Rows with their place on the page: by column, if there is one, then by horizontal band, then from left to right."""
    keys = ([column] if column else []) + [F.floor(F.col("y0") / band), "x0", "id"]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*keys)))


def same_place(lines: DataFrame, page: str = "page", text: str = "text", key: str = "line") -> DataFrame:
    """Lines of one rounded centre that are equal but for white space, of which the first stays."""
    plain = F.regexp_replace(text, r"(?U)\s+", "")
    w = Window.partitionBy(page, F.round((F.col("x0") + F.col("x1")) / 2), F.round((F.col("y0") + F.col("y1")) / 2), plain).orderBy(key)
    return lines.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def blank_repeats(lines: DataFrame, by: list[str], order: str, text: str = "text") -> DataFrame:
    """A line that equals the last one before it but for white space becomes empty; a blank line starts anew."""
    w = Window.partitionBy(*by).orderBy(order)
    plain = F.regexp_replace(text, r"(?U)\s+", "")
    return lines.withColumn(text, F.when((plain != "") & F.lag(plain).over(w).eqNullSafe(plain), "").otherwise(F.col(text)))


#: Fixed values in points: lines of one row have centres so near; a line goes on with those before it, if it begins that far
#: within what they cover.
ROW_OFF, OVERLAP = 2.0, 3.0


def merged_rows(chars: DataFrame, page: str = "page") -> DataFrame:
    """(page, row, segment, text, x0, x1): lines printed over one another as one, without the characters covered already.

    ``chars`` holds (page, line, pos, ch, x, width, y, height). Lines of one row are taken from the left; what the lines
    before have covered of a segment is one stretch, as each begins within it, so a running maximum of their ends is the
    union of their intervals. A character whose centre lies in it is a repetition. Lines of white space only are left out.
    Characters are dealt by page once, and a line holds its own while it is placed.
    """
    chars = by_key(chars, page)
    right = F.col("x") + F.col("width")
    lines = chars.groupBy(page, "line").agg(
        F.min(F.when(F.trim("ch") != "", F.col("x"))).alias("start"),
        F.max(right).alias("end"),
        ((F.min("y") + F.max(F.col("y") + F.col("height"))) / 2).alias("middle"),
        F.collect_list(F.struct("pos", "ch", "x", "width")).alias("_chars"),
    )
    order = ["start", "line"]
    rows = gap_groups(lines.filter("start IS NOT NULL"), [page], ["middle", "line"], F.col("middle") - prev("middle", [page], ["middle", "line"]) > ROW_OFF).withColumnRenamed("group", "row")
    before = lambda by: F.max("end").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    parts = gap_groups(rows.withColumn("_reach", before([page, "row"])), [page, "row"], order, F.col("start") > F.col("_reach") - OVERLAP).withColumnRenamed("group", "segment")
    parts = parts.withColumn("_covered", before([page, "row", "segment"])).select(page, "line", "row", "segment", "start", "_covered", F.explode("_chars").alias("_c"))
    kept = parts.select("*", "_c.*").filter(F.col("_covered").isNull() | (F.col("x") + F.col("width") / 2 > F.col("_covered")))
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "line", "pos", "ch"))), lambda c: c["ch"]), "")
    return kept.groupBy(page, "row", "segment").agg(spelled.alias("text"), F.min("x").alias("x0"), F.max(right).alias("x1"))


def overprints(frames: DataFrame, page: str = "page", near: float = 4.0) -> DataFrame:
    """(page, frame) of frames that a kept frame at the same place prints again: the same text, a text that holds it, or, for
    one character repeated, a single one of them.

    ``frames`` holds (page, frame, x0, y0, text). Frames are at one place if both coordinates differ by less than ``near``;
    they meet by squares of twice that size: a frame asks in its own and answers in the up to four that lie so near, so that
    no border hides a pair. Of equal texts the first frame stays; of a text and a part of it the longer one; of ``aa`` and ``a`` the shorter.
    """
    side = 2 * near
    placed = frames.filter(F.coalesce("text", F.lit("")) != "").withColumns({"_gx": F.floor(F.col("x0") / side), "_gy": F.floor(F.col("y0") / side)})
    around = F.explode(F.array_distinct(F.array(*(F.struct(F.floor((F.col("x0") + i) / side).alias("_gx"), F.floor((F.col("y0") + j) / side).alias("_gy")) for i in (-near, near) for j in (-near, near)))))
    answers = placed.select(page, F.col("frame").alias("_by"), F.col("x0").alias("_x"), F.col("y0").alias("_y"), F.col("text").alias("_text"), around.alias("_s"))
    answers = answers.select(page, "_by", "_x", "_y", "_text", "_s._gx", "_s._gy")
    met = placed.join(answers, [page, "_gx", "_gy"]).filter((F.col("frame") != F.col("_by")) & (F.abs(F.col("x0") - F.col("_x")) < near) & (F.abs(F.col("y0") - F.col("_y")) < near))
    stutter = lambda long, short: (F.length(short) == 1) & (F.length(long) > 1) & (F.replace(long, short, F.lit("")) == "")
    same = (F.col("_text") == F.col("text")) & (F.col("_by") < F.col("frame"))
    part = (F.length("_text") > F.length("text")) & F.col("_text").contains(F.col("text")) & ~stutter(F.col("_text"), F.col("text"))
    return met.filter(same | part | stutter(F.col("text"), F.col("_text"))).select(page, "frame").distinct()


def bounding_boxes(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def two_columns(blocks: DataFrame, page: str = "page", width: float = 600.0) -> DataFrame:
    """(page, boundary): the widest gap between centres, if it is 15 % of the width with two or more blocks a side."""
    w = Window.partitionBy(page).orderBy("center")
    gaps = blocks.select(page, "center", F.lead("center").over(w).alias("next"), F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy(page)).alias("n"))
    widest = gaps.filter("next IS NOT NULL").groupBy(page).agg(F.max_by(F.struct("center", "next", "k", "n"), F.struct(F.col("next") - F.col("center"), -F.col("k"))).alias("g"))
    g = F.col("g")
    return widest.filter((g["next"] - g["center"] >= 0.15 * width) & (g["n"] >= 6) & (g["k"] >= 2) & (g["n"] - g["k"] >= 2)).select(page, ((g["center"] + g["next"]) / 2).alias("boundary"))


def _sequential(rows: DataFrame, by: str, order: str, value: str, out: str, step) -> DataFrame:
    """A value that depends on the one computed before it: sorted rows of a key stream through, none is gathered."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for frame in frames:
            got = []
            for k, v in zip(frame["k"], frame["v"]):
                if k != key:
                    key, state = k, None
                state, result = step(state, v)
                got.append(result)
            yield frame[["k", "o"]].assign(r=got)

    placed = rows.select(F.col(by).alias("k"), F.col(order).alias("o"), F.col(value).cast("double").alias("v")).repartition("k").sortWithinPartitions("k", "o")
    kinds = {n: rows.schema[c].dataType.simpleString() for n, c in (("k", by), ("o", order))}
    return placed.mapInPandas(run, f"k {kinds['k']}, o {kinds['o']}, r double").select(F.col("k").alias(by), F.col("o").alias(order), F.col("r").alias(out))


def repaired_levels(rows: DataFrame, by: str, order: str, level: str) -> DataFrame:
    """Levels never more than one below the repaired level before; the first is 1.

    The repaired level of row k is the least of v(j) + k - j over the rows j up to it, so a running minimum tells it.
    """
    w = Window.partitionBy(by).orderBy(order)
    k = F.row_number().over(w)
    value = F.when(k == 1, F.lit(1.0)).otherwise(F.col(level).cast("double"))
    placed = rows.select(by, order, k.alias("_k"), (value - k).alias("_v"))
    return placed.select(by, order, (F.min("_v").over(w) + F.col("_k")).alias(level))


def packed(rows: DataFrame, by: str, order: str, weight: str, capacity: float) -> DataFrame:
    """Bin of each row: the next one begins where the running sum would exceed the capacity."""

    def step(state, v):
        used, bin_ = state or (0.0, 0)
        if used and used + v > capacity:
            used, bin_ = 0.0, bin_ + 1
        return (used + v, bin_), float(bin_)

    return _sequential(rows, by, order, weight, "bin", step)


def anchored_lines(rows: DataFrame, by: str, order: str, top: str, tolerance: float) -> DataFrame:
    """Line number of each word: within the tolerance of the line's first word."""

    def step(state, v):
        anchor, n = state or (None, -1)
        if anchor is None or abs(v - anchor) > tolerance:
            anchor, n = v, n + 1
        return (anchor, n), float(n)

    return _sequential(rows, by, order, top, "line", step)
