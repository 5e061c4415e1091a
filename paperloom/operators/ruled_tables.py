"""Tables from ruled lines: collinear pieces are joined, lines are dealt to tables, and cells are merged where a wall is absent.

Segments are dealt by page once, and all that follows stays where it is. A task sorts and compares the lines of many whole pages
at a time, as arrays; pages of over PAIRS pieces, or pairs of level and upright ones, and odd ones go through windows and groups by
page and by parts of it, which give the same. There, stretches of a page's lines lie over LEAST_GAP points apart, so
that a page's rows can hold all its stretches; a row of a table holds the lines at its place. Input rows are segments (page, x0, y0, x1, y1)
in points; those that are neither level nor upright, and those with null coordinates, belong to no table. Repeated segments
change nothing. A page needs two rows of lines and two columns for a table; pages without have no rows in the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.layout import gap_groups, prev, whole_groups
from paperloom.session import bounded_batches, by_key, cut

#: Fixed values in points: how far a line may be off its axis; seams of pieces; least lengths of rulings, as a share of the
#: table and absolute, of which the smaller holds; tolerances of row and column coordinates; least size of a table.
STRAIGHT = 1.0
SEAM = 3.0
LEAST_ROW = (0.20, 25.0)
LEAST_COLUMN = (0.15, 18.0)
ROW_TOLERANCES = (2.0, 10.0)
COLUMN_TOLERANCE = 6.0
LEAST_WIDTH, LEAST_HEIGHT = 60.0, 20.0
#: Gaps between rulings that end a table: absolute, times the median gap (if over a least one); and the widest
#: gap that an outer upright line bridges.
TABLE_GAP, MEDIAN_GAPS, LEAST_GAP, BRIDGED_GAP = 80.0, 3.0, 20.0, 250.0
#: The share of a cell's side that a line must cover to be its wall.
WALL = 0.5
#: Pages of more pieces, or of more pairs of a level and an upright one, go through windows; as many pairs are held at a time.
PAIRS = 1_000_000
CELL = {"table": "long", "row": "int", "col": "int", "row_span": "long", "col_span": "long", "x0": "double", "y0": "double", "x1": "double", "y1": "double"}


def _pieces(segments: DataFrame, page: str) -> DataFrame:
    """(page, level, at, low, high): the segments that are level or upright."""
    width, height = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    level = (height <= STRAIGHT) & (width > height)
    upright = (width <= STRAIGHT) & (height > width)
    mean = lambda a, b: (F.col(a) + F.col(b)) / 2
    return segments.filter(level | upright).select(
        page,
        level.alias("level"),
        F.when(level, mean("y0", "y1")).otherwise(mean("x0", "x1")).alias("at"),
        F.when(level, F.least("x0", "x1")).otherwise(F.least("y0", "y1")).alias("low"),
        F.when(level, F.greatest("x0", "x1")).otherwise(F.greatest("y0", "y1")).alias("high"),
    )


def rulings(segments: DataFrame, page: str = "page") -> DataFrame:
    """(page, level, at, low, high): whole lines. Pieces at one rounded coordinate with seams of at most SEAM are one."""
    return _joined(by_key(_pieces(segments, page), page), page)


def _joined(pieces: DataFrame, page: str) -> DataFrame:
    line = [page, "level", "_at"]
    placed = pieces.withColumn("_at", F.round("at"))
    reach = F.max("high").over(Window.partitionBy(*line).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    islands = gap_groups(placed.withColumn("_reach", reach), line, ["low", "high"], F.col("low") > F.col("_reach") + SEAM)
    return islands.groupBy(*line, "group").agg(F.min("at").alias("at"), F.min("low").alias("low"), F.max("high").alias("high")).drop("_at", "group")


def tables(lines: DataFrame, page: str = "page") -> DataFrame:
    """(page, table, level, at, low, high): the lines of each table, from ``rulings``.

    Level lines are split where the gap to the one above is too wide, unless an upright line at the left or right end of the
    lines above spans the gap. An upright line belongs to every table whose height it meets.
    """
    by, order, whole = [page, "level"], ["at", "low", "high"], Window.partitionBy(page)
    rows = gap_groups(lines, by, order, F.col("at") - prev("at", by, order) > ROW_TOLERANCES[0])
    rows = rows.withColumn("_mean", F.avg("at").over(Window.partitionBy(*by, "group")))
    # one gap between neighbouring rows, at the first line of the second; of an even number the wider one in the middle counts
    rows = rows.withColumn("_gap", F.when(prev("group", by, order) != F.col("group"), F.col("_mean") - prev("_mean", by, order)))
    rows = rows.withColumn("_median", F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY _gap DESC) OVER (PARTITION BY `{page}`, level)"))

    before = prev("at", by, order)
    gap = F.col("at") - before
    wide = (gap > TABLE_GAP) | ((F.coalesce("_median", F.lit(0.0)) > 0) & (gap > MEDIAN_GAPS * F.col("_median")) & (gap > LEAST_GAP))
    stretches = gap_groups(rows.withColumns({"_first": before.isNull() | wide, "_wide": wide}), by, order, F.col("_wide"))
    own = Window.partitionBy(*by, "group")
    edges = stretches.withColumn("_edge", F.struct("group", F.min("low").over(own).alias("left"), F.max("high").over(own).alias("right"), F.min("at").over(own).alias("first"), F.max("at").over(own).alias("last")))
    edges = edges.withColumn("_edges", F.array_sort(F.collect_list(F.when(F.col("level") & F.col("_first"), F.col("_edge"))).over(whole)))

    def spanned(edge: Column, k: Column) -> Column:
        """Whether an upright line bridges the gap above a stretch."""
        above = F.get("_edges", k - 1)
        outer = (F.abs(F.col("at") - above["left"]) < 10) | (F.abs(F.col("at") - above["right"]) < 10)
        return (k > 0) & outer & (F.col("low") <= above["last"] + 2) & (F.col("high") >= edge["first"] - 2) & (edge["first"] - above["last"] <= BRIDGED_GAP)

    bridges = F.when(~F.col("level"), F.filter("_edges", spanned)["group"])
    bridged = edges.withColumn("_bridged", F.flatten(F.collect_set(bridges).over(whole)))
    # a table begins with each stretch that no line ties to the one above; both ends of stretches grow down the page
    table = lambda group: group - F.size(F.array_distinct(F.filter("_bridged", lambda b: b <= group)))
    passed = F.size(F.filter("_edges", lambda e: F.col("low") > e["last"] + 2)).cast("long")
    begun = F.size(F.filter("_edges", lambda e: F.col("high") >= e["first"] - 2)).cast("long")
    met = (passed < F.size("_edges")) & (begun > 0) & (table(passed) <= table(begun - 1))
    beside = F.when(met, F.sequence(table(passed), table(begun - 1)))
    of = F.when(F.col("level"), F.array(table(F.col("group")))).otherwise(beside)
    return bridged.select(page, F.explode(of).alias("table"), "level", "at", "low", "high")


def separators(lines: DataFrame, page: str = "page") -> DataFrame:
    """The lines that can part rows or columns: long enough, measured by the table; all lines, if one kind has none."""
    w = Window.partitionBy(page, "table")
    of = lambda kind, low, high: F.when(F.col("level"), F.col(low)).otherwise(F.col(high)) if kind == "x" else F.when(F.col("level"), F.col(high)).otherwise(F.col(low))
    width = F.max(of("x", "high", "at")).over(w) - F.min(of("x", "low", "at")).over(w)
    height = F.max(of("y", "high", "at")).over(w) - F.min(of("y", "low", "at")).over(w)
    least = F.when(F.col("level"), F.least(width * LEAST_ROW[0], F.lit(LEAST_ROW[1]))).otherwise(F.least(height * LEAST_COLUMN[0], F.lit(LEAST_COLUMN[1])))
    marked = lines.withColumn("_long", F.col("high") - F.col("low") >= least)
    both = F.max(F.col("_long") & F.col("level")).over(w) & F.max(F.col("_long") & ~F.col("level")).over(w)
    return marked.withColumn("_both", both).filter("_long OR NOT _both").drop("_long", "_both")


def axes(lines: DataFrame, page: str = "page") -> DataFrame:
    """(page, table, level, k, at, next, walls): the row and column coordinates of tables, numbered from 0, with the next one
    and the extents (low, high) of the lines within the tolerance of that.

    Coordinates lie further apart than the tolerance, but for tables of two, so that such lines are of the coordinate before,
    the next one or the one behind it.
    """
    by = [page, "table", "level"]
    apart = F.col("at") - prev("at", by, ["at"]) > F.when(F.col("level"), ROW_TOLERANCES[0]).otherwise(COLUMN_TOLERANCE)
    near = gap_groups(lines, by, ["at"], apart).withColumn("_mean", F.avg("at").over(Window.partitionBy(*by, "group")))
    near = near.withColumns({"_new": ~F.coalesce(prev("group", by, ["at"]) == F.col("group"), F.lit(False)), "_many": F.max("group").over(Window.partitionBy(*by)) + 1})
    # a second, wider pass over the means of rows, only where more than two are left
    wide = F.when(~F.col("level"), 0.0).when(F.col("_many") > 2, ROW_TOLERANCES[1]).otherwise(ROW_TOLERANCES[0])
    ends = gap_groups(near, by, ["at"], F.col("_new") & (F.col("_mean") - prev("_mean", by, ["at"]) > wide))
    placed = ends.groupBy(*by, F.col("group").alias("k")).agg(F.avg(F.when(F.col("_new"), F.col("_mean"))).alias("place"), F.collect_list(F.struct("at", "low", "high")).alias("_lines"))
    w = Window.partitionBy(*by).orderBy("k")
    ahead = lambda c, n: F.lead(c, n).over(w)
    seen = placed.withColumns({"next": ahead("place", 1), "_lines": F.concat("_lines", ahead("_lines", 1), F.coalesce(ahead("_lines", 2), F.array()))}).filter("next IS NOT NULL")
    off = F.when(F.col("level"), ROW_TOLERANCES[1]).otherwise(COLUMN_TOLERANCE)
    walls = F.filter("_lines", lambda line: F.abs(F.col("next") - line["at"]) <= off)
    return seen.select(*by, "k", F.col("place").alias("at"), "next", F.transform(walls, lambda line: F.struct(line["low"].alias("low"), line["high"].alias("high"))).alias("walls"))


def cells(segments: DataFrame, page: str = "page", several: Column | None = None) -> DataFrame:
    """(page, table, row, col, row_span, col_span, x0, y0, x1, y1): the cells of all tables, merged where no wall parts them.

    Cells of a row without a wall between them are one; such runs of the same columns in consecutive rows are one where no
    wall below parts any of their columns. Rows may hold ``several`` segments, an array of (x0, y0, x1, y1) that is worked out
    when they have been dealt and sorted: a row costs more on its way to Python than its segments do.
    """
    several = (F.array(F.struct("x0", "y0", "x1", "y1")) if several is None else several).cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    packed = lambda rows: rows.select(F.col(page).alias("page"), several.alias("segments"))
    dealt = by_key(segments, page)
    apart = _apart(packed(dealt))
    if apart is None:
        return _in_pages(packed(dealt.sortWithinPartitions(page))).withColumnRenamed("page", page)
    few, many = (by_key(dealt.join(apart, F.col(page).eqNullSafe(F.col("_apart")), how), page) for how in ("left_anti", "left_semi"))
    found = _in_pages(packed(few.sortWithinPartitions(page))).union(_by_windows(_pieces(packed(many).select("page", F.inline("segments")), "page"), "page"))
    return found.withColumnRenamed("page", page)


def _apart(rows: DataFrame) -> DataFrame | None:
    """The pages that go through windows: those with too many pieces or pairs, the null one, and those with coordinates that
    aren't finite; None if there are none."""
    ends = [F.abs(of(f"segments.{c}")) for c in ("x0", "y0", "x1", "y1") for of in (F.array_min, F.array_max)]
    odd = F.greatest(*ends) >= float("inf")
    of = rows.groupBy(F.col("page").alias("_apart")).agg(F.sum(F.greatest(F.size("segments"), F.lit(0))).alias("_n"), F.max(odd).alias("_odd"))
    seen = cut(of.filter(f"_n * _n > {4 * PAIRS} OR _odd OR _apart IS NULL"))
    if seen.isEmpty():
        return None
    large = rows.join(seen.filter(f"_n * _n > {4 * PAIRS}").select(F.col("_apart").alias("page")), "page", "left_semi")
    kinds = _pieces(large.select("page", F.inline("segments")), "page").groupBy(F.col("page").alias("_apart")).agg(F.count(F.when(F.col("level"), 1)).alias("_level"), F.count("*").alias("_n"))
    found = cut(seen.filter("_odd OR _apart IS NULL").select("_apart").union(kinds.filter(f"_n > {PAIRS} OR _level * (_n - _level) > {PAIRS}").select("_apart")).distinct())
    return None if found.isEmpty() else found


def _in_pages(rows: DataFrame) -> DataFrame:
    """``cells`` of sorted pages that are held whole, many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, "page"):
            number, several = held.column("_g").to_numpy(), held.column("segments").combine_chunks()
            # null segments, and null coordinates, are NaN and thus neither level nor upright
            x0, y0, x1, y1 = (v.to_numpy(zero_copy_only=False) for v in several.flatten().flatten())
            page = np.repeat(number, pc.fill_null(pc.list_value_length(several), 0).to_numpy())
            width, height = np.abs(x1 - x0), np.abs(y1 - y0)
            level, upright = (height <= STRAIGHT) & (width > height), (width <= STRAIGHT) & (height > width)
            at, (a, b) = np.where(level, y0 + y1, x0 + x1) / 2, np.where(level, (x0, x1), (y0, y1))
            lines = _whole_lines(*(v[level | upright] for v in (page, level, at, np.minimum(a, b), np.maximum(a, b))))
            for part in _parts(*lines[:2]):
                found = _cells_of(*(v[part] for v in lines))
                if found:
                    pages = held.column("page").take(pa.array(np.searchsorted(number, found[0])))
                    yield from pa.table([pages, *map(pa.array, found[1:])], names=["page", *CELL]).combine_chunks().to_batches(max_chunksize=50_000)

    bounded_batches(rows.sparkSession)
    kind = rows.schema["page"].dataType.simpleString()
    return rows.mapInArrow(run, f"page {kind}, " + ", ".join(f"{c} {t}" for c, t in CELL.items()))


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where a group of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _gap(at: np.ndarray) -> np.ndarray:
    return np.diff(at, prepend=at[:1])


def _sizes(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.r_[first, n])


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with low[i] <= j < high[i]."""
    n = high - low
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n - low, n)


def _whole_lines(page: np.ndarray, level: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """The lines of ``rulings`` from pieces, in order of pages."""
    if not len(page):
        return page, level, at, low, high
    spot = np.trunc(at)
    spot += np.copysign(np.abs(at - spot) >= 0.5, at)
    line, place, wide = 2 * (page - page[0]) + level, spot - spot.min(), np.ptp(spot) + 1
    if not (line[-1] + 2) * wide < 2.0**53:
        place, wide = np.unique(spot, return_inverse=True)[1], len(spot)
    line = line * wide + place
    order = np.lexsort((low, line))
    page, level, at, low, high, line = (v[order] for v in (page, level, at, low, high, line))
    new = _new(line)
    # how far the pieces of a line reach so far, as the running maximum of their ranks
    by_end = np.argsort(high)
    rank = np.empty_like(by_end)
    rank[by_end] = np.arange(len(high))
    before = np.cumsum(new) * len(high)
    reach = high[by_end][np.maximum.accumulate(rank + before) - before]
    new[1:] |= low[1:] > reach[:-1] + SEAM
    first = np.flatnonzero(new)
    return page[first], level[first], np.minimum.reduceat(at, first), low[first], np.maximum.reduceat(high, first)


def _parts(page: np.ndarray, level: np.ndarray) -> Iterator[slice]:
    """Whole pages with some PAIRS pairs of level and upright lines."""
    first = np.flatnonzero(_new(page))
    rows, lines = np.add.reduceat(level, first, dtype=np.int64), _sizes(first, len(page))
    pairs = rows * (lines - rows)
    ends = [*first[_new((np.cumsum(pairs) - pairs) // PAIRS)].tolist(), len(page)]
    return map(slice, ends, ends[1:])


def _tables_of(page: np.ndarray, level: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(page of each table, table of each line, line), as ``tables`` finds them; tables are numbered down all pages."""
    rows, uprights = np.flatnonzero(level), np.flatnonzero(~level)
    rows = rows[np.lexsort((low[rows], at[rows], page[rows]))]
    p, a, up = page[rows], at[rows], page[uprights]
    first = np.flatnonzero(_new(p) | (_gap(a) > ROW_TOLERANCES[0]))
    mean, of = np.add.reduceat(a, first) / _sizes(first, len(a)), p[first]
    gap, of = (mean[1:] - mean[:-1])[of[1:] == of[:-1]], of[1:][of[1:] == of[:-1]]
    gap = gap[np.lexsort((gap, of))]
    known, start, n = np.unique(of, return_index=True, return_counts=True)
    median = np.zeros(page[-1] - page[0] + 1)
    median[known - page[0]] = gap[start + n // 2]

    gap, median = _gap(a), median[p - page[0]]
    first = np.flatnonzero(_new(p) | (gap > TABLE_GAP) | ((median > 0) & (gap > MEDIAN_GAPS * median) & (gap > LEAST_GAP)))
    of, left, right = p[first], np.minimum.reduceat(low[rows], first), np.maximum.reduceat(high[rows], first)
    top, foot = a[first], a[np.r_[first[1:], len(a)] - 1]
    near = 1 + np.flatnonzero((of[1:] == of[:-1]) & (top[1:] - foot[:-1] <= BRIDGED_GAP))
    i, j = _spread(np.searchsorted(up, of[near]), np.searchsorted(up, of[near], side="right"))
    k, v = near[i], uprights[j]
    outer = (np.abs(at[v] - left[k - 1]) < 10) | (np.abs(at[v] - right[k - 1]) < 10)
    begins = np.ones(len(first), bool)
    begins[k[outer & (low[v] <= foot[k - 1] + 2) & (high[v] >= top[k] - 2)]] = False

    head = np.flatnonzero(begins)
    of, top, foot = of[head], top[head], foot[np.r_[head[1:], len(first)] - 1]
    i, j = _spread(np.searchsorted(of, up), np.searchsorted(of, up, side="right"))
    v = uprights[i]
    met = (low[v] <= foot[j] + 2) & (high[v] >= top[j] - 2)
    return of, np.r_[np.repeat(np.cumsum(begins) - 1, _sizes(first, len(a))), j[met]], np.r_[rows, v[met]]


def _separating(table: np.ndarray, level: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which lines ``separators`` keeps, of lines in order of tables."""
    first = np.flatnonzero(_new(table))
    n = _sizes(first, len(table))
    span = lambda kind: np.maximum.reduceat(np.where(kind, high, at), first) - np.minimum.reduceat(np.where(kind, low, at), first)
    least = [np.repeat(np.minimum(span(kind) * share, most), n) for kind, (share, most) in ((level, LEAST_ROW), (~level, LEAST_COLUMN))]
    long = high - low >= np.where(level, *least)
    both = np.logical_or.reduceat(long & level, first) & np.logical_or.reduceat(long & ~level, first)
    return long | ~np.repeat(both, n)


def _sides(key: np.ndarray, level: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, at, next) of the sides of ``axes``, and (side, line) of their walls, from lines in order of their keys and places."""
    first = np.flatnonzero(_new(key) | (_gap(at) > np.where(level, ROW_TOLERANCES[0], COLUMN_TOLERANCE)))
    mean, of = np.add.reduceat(at, first) / _sizes(first, len(at)), key[first]
    n = _sizes(np.flatnonzero(_new(of)), len(of))
    wide = np.where(np.repeat(n, n) > 2, ROW_TOLERANCES[1], ROW_TOLERANCES[0])
    group = np.flatnonzero(_new(of) | (_gap(mean) > wide) | ~level[first])
    place, of = np.add.reduceat(mean, group) / _sizes(group, len(mean)), of[group]
    begin, end = np.r_[first[group], len(at)], np.searchsorted(of, of, side="right")
    side = np.flatnonzero(of[1:] == of[:-1])
    i, j = _spread(begin[side], begin[np.minimum(side + 3, end[side])])
    off = np.where(level[j], ROW_TOLERANCES[1], COLUMN_TOLERANCE)
    walls = np.abs(place[side + 1][i] - at[j]) <= off
    return of[side], place[side], place[side + 1], i[walls], j[walls]


def _cells_of(page: np.ndarray, level: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(page, *CELL) of whole lines; None if there are none."""
    if not level.any():
        return None
    of, table, line = _tables_of(page, level, at, low, high)
    # the rows of a table before its columns
    order = np.lexsort((at[line], 2 * table + ~level[line]))
    table, level, at, low, high = table[order], *(v[line[order]] for v in (level, at, low, high))
    kept = _separating(table, level, at, low, high)
    table, level, at, low, high = (v[kept] for v in (table, level, at, low, high))
    key, start, stop, side, wall = _sides(2 * table + ~level, level, at)

    # grids: of the sides, r0 to r1 are the rows of a table and r1 to c1 its columns
    t = np.unique(key // 2)
    r0, r1, c1 = np.searchsorted(key, 2 * t), np.searchsorted(key, 2 * t + 1), np.searchsorted(key, 2 * t + 2)
    grid = (r0 < r1) & (r1 < c1)
    t, r0, r1, c1 = (v[grid] for v in (t, r0, r1, c1))
    grid = (stop[c1 - 1] - start[r1] >= LEAST_WIDTH) & (stop[r1 - 1] - start[r0] >= LEAST_HEIGHT)
    t, r0, r1, c1 = (v[grid] for v in (t, r0, r1, c1))
    if not len(t):
        return None
    g, row = _spread(r0, r1)
    k, col = _spread(r1[g], c1[g])
    cell = np.zeros(len(key), np.int64)  # that of a row's column c is cell[row] + c
    cell[row] = np.cumsum(c1[g] - r1[g]) - c1[g]
    g, row = g[k], row[k]

    # the walls of a column lie along the rows of its table, those of a row along the columns
    own = np.full(of.size, -1)
    own[t] = np.arange(len(t))
    own = own[key[side] // 2]
    side, wall, own = (v[own >= 0] for v in (side, wall, own))
    upright = key[side] % 2 == 1
    i, j = _spread(np.where(upright, r0[own], r1[own]), np.where(upright, r1[own], c1[own]))
    covered = np.minimum(stop[j], high[wall[i]]) - np.maximum(start[j], low[wall[i]]) >= WALL * (stop[j] - start[j])
    i, j = i[covered], j[covered]
    upright, i = upright[i], side[i]
    right, below = np.zeros((2, len(col)), bool)
    right[cell[j[upright]] + i[upright]] = True
    below[cell[i[~upright]] + j[~upright]] = True

    new = _new(row)
    new[1:] |= right[:-1]
    first = np.flatnonzero(new)
    width, below = _sizes(first, len(col)), np.logical_or.reduceat(below, first)
    g, row, col = g[first], row[first], col[first]
    order = np.lexsort((row, width, col))
    g, row, col, width, below = (v[order] for v in (g, row, col, width, below))
    new = _new(col, width)
    new[1:] |= (row[1:] != row[:-1] + 1) | below[:-1]
    first = np.flatnonzero(new)
    height = _sizes(first, len(row))
    g, row, col, width = (v[first] for v in (g, row, col, width))
    table = t[g] - np.searchsorted(of, of[t[g]])
    return of[t[g]], table, (row - r0[g]).astype(np.int32), (col - r1[g]).astype(np.int32), height, width, start[col], start[row], stop[col + width - 1], stop[row + height - 1]


def _by_windows(pieces: DataFrame, page: str) -> DataFrame:
    """``cells`` of pages of any size, by windows and groups."""
    ends = axes(separators(tables(_joined(pieces, page), page), page), page)
    side = F.struct("k", "at", "next", "walls")
    grid = ends.groupBy(page, "table").agg(*(F.array_sort(F.collect_list(F.when(F.col("level") if level else ~F.col("level"), side))).alias(name) for name, level in (("_rows", True), ("_columns", False))))
    size = lambda sides: F.get(sides, F.size(sides) - 1)["next"] - F.get(sides, F.lit(0))["at"]
    grid = grid.filter((size("_columns") >= LEAST_WIDTH) & (size("_rows") >= LEAST_HEIGHT))
    grid = grid.select(page, "table", F.explode("_rows").alias("r"), "_columns").select(page, "table", "r", F.explode("_columns").alias("c"))
    y0, y1, x0, x1 = F.col("r.at"), F.col("r.next"), F.col("c.at"), F.col("c.next")
    covered = lambda walls, low, high: F.exists(walls, lambda wall: F.least(high, wall["high"]) - F.greatest(low, wall["low"]) >= WALL * (high - low))
    marked = grid.select(page, "table", F.col("r.k").alias("row"), F.col("c.k").alias("col"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), covered("c.walls", y0, y1).alias("right"), covered("r.walls", x0, x1).alias("below"))

    across = [page, "table", "row"]
    runs = gap_groups(marked, across, ["col"], prev("right", across, ["col"]))
    wide = runs.groupBy(*across, "group").agg(F.min("col").alias("col"), F.count("*").alias("col_span"), F.max("below").alias("_walls"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")).drop("group")
    stack = [page, "table", "col", "col_span"]
    open_above = (prev("row", stack, ["row"]) == F.col("row") - 1) & ~prev("_walls", stack, ["row"])
    tall = gap_groups(wide, stack, ["row"], ~F.coalesce(open_above, F.lit(False)))
    merged = tall.groupBy(*stack, "group").agg(F.min("row").alias("row"), F.count("*").alias("row_span"), *[f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))])
    return merged.select(page, "table", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "row_span", "col_span", "x0", "y0", "x1", "y1")
