import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paperloom.operators import deident, graph, layout, quantiles, regions, registry, ruled_tables, search_index

# ---- inverted index

REGISTRY = [
    ("11111111", "節省工具有限公司", "台北市大同區", "王小明", "有限公司", "超級市場"),
    ("22222222", "大同電器行", "臺北市中山區", "張三", "獨資", "家電零售"),
    ("33333333", "台中科技股份有限公司", "臺中市西屯區", "李四", "股份有限公司", "半導體"),
    ("44444444", "節省超商 Save Mart", "雲林縣斗六市", "陳五", "有限公司", "便利商店 / 超級市場"),
    ("55555555", "同大電器行", None, None, None, None),
]


@pytest.fixture
def shop(spark, tmp_path):
    rows = spark.createDataFrame(REGISTRY, "vat string, name string, address string, owner string, org_type string, industries string").withColumn("category", F.lit(None).cast("string"))
    return rows, search_index.build(rows, str(tmp_path / "index"), buckets=8)


def found(rows, index, text, *fields, **filters):
    return [r.vat for r in search_index.search(rows, index, text, fields or None, **filters).collect()]


def test_index_search(shop):
    rows, index = shop
    assert sorted(found(rows, index, "大同")) == ["11111111", "22222222"]  # characters in order, not 同大
    assert found(rows, index, "大同", "name") == ["22222222"] and found(rows, index, "大同", "address") == ["11111111"]
    assert sorted(found(rows, index, "台北")) == ["11111111", "22222222"] == sorted(found(rows, index, "臺北"))
    assert found(rows, index, "節省 超級市場 save") == ["44444444"] and found(rows, index, "sav") == []
    assert sorted(found(rows, index, "公司", org_type="有限公司")) == ["11111111", "44444444"]
    assert found(rows, index, " \t!! ") == [] and found(rows, index, "nowhere") == []
    facets = {(r.facet, r.value): r["count"] for r in search_index.totals(search_index.matching(rows, index, "節省")).collect()}
    assert facets == {("total", ""): 2, ("city", "台北市"): 1, ("city", "雲林縣"): 1, ("org", "有限公司"): 2, ("industry", "超級市場"): 2, ("industry", "便利商店"): 1}


def test_index_reads_only_the_buckets_of_a_query(spark, shop):
    rows, index = shop
    lists = search_index.read_postings(spark, index, ["同"])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(", "").replace("(bucket", "bucket") or "bucket" in plan.split("PartitionFilters")[1][:80]
    assert {r.token for r in lists.collect()} == {"同"}
    assert len({f.split("bucket=")[1].split("/")[0] for f in lists.inputFiles()}) >= 1
    read = {r.f.split("bucket=")[1].split("/")[0] for r in lists.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(read) == 1


def test_index_agrees_with_a_scan(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"{k:08d}", "".join(rng.choice("大同電器行") for _ in range(rng.randrange(7))) or None, "x" + rng.choice("台臺") + "北") for k in range(150)]
    frame = spark.createDataFrame(rows, "vat string, name string, address string").repartition(3)
    index = search_index.build(frame, str(tmp_path / "i"), buckets=4)
    for text in ("大", "大同", "電器 同", "大同大", "台北 行"):
        want = sorted(v for v, name, address in rows if all(any(w in (t or "").replace("臺", "台") for t in (name, address)) for w in text.split()))
        assert sorted(r.vat for r in search_index.matching(frame, index, text).collect()) == want


def test_most_frequent_ranks_over_groups(spark):
    rows = [("city", f"v{k:03d}", k // 3) for k in range(300)] + [("org", "a", 1)]
    got = registry.most_frequent(spark.createDataFrame(rows, "facet string, value string, count long"), 4)
    assert sorted(tuple(r) for r in got.collect()) == [("city", "v294", 98), ("city", "v297", 99), ("city", "v298", 99), ("city", "v299", 99), ("org", "a", 1)]


# ---- ruled tables


def lines(*segments, page=1):
    return [(page, *map(float, s)) for s in segments]


SEGMENT = "page long, x0 double, y0 double, x1 double, y1 double"


def box(x0, y0, x1, y1):
    return [(x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1)]


def test_pieces_are_one_ruling(spark):
    rows = lines((0, 10, 50, 10), (52, 10.2, 90, 10.2), (95, 10, 99, 10), (0, 10, 20, 10), (5, 0, 5, 30), (0, 0, 30, 30))
    got = sorted((r.level, r.at, r.low, r.high) for r in ruled_tables.rulings(spark.createDataFrame(rows, SEGMENT)).collect())
    assert got == [(False, 5.0, 0.0, 30.0), (True, 10.0, 0.0, 90.0), (True, 10.0, 95.0, 99.0)]


def test_cells_merge_where_a_wall_is_absent(spark):
    rows = lines(*box(0, 0, 300, 90), (0, 30, 300, 30), (100, 60, 300, 60), (100, 0, 100, 90), (200, 30, 200, 90))
    got = sorted((r.row, r.col, r.row_span, r.col_span) for r in ruled_tables.cells(spark.createDataFrame(rows, SEGMENT)).collect())
    assert got == [(0, 0, 1, 1), (0, 1, 1, 2), (1, 0, 2, 1), (1, 1, 1, 1), (1, 2, 1, 1), (2, 1, 1, 1), (2, 2, 1, 1)]


def test_far_rulings_are_two_tables_unless_bridged(spark):
    first, second = box(0, 0, 200, 40), box(0, 200, 200, 240)
    rows = lines(*first, (0, 20, 200, 20), *second, (0, 220, 200, 220)) + lines(*first, (0, 20, 200, 20), *second, (0, 0, 0, 240), page=2)
    got = defaultdict(set)
    for r in ruled_tables.cells(spark.createDataFrame(rows, SEGMENT)).collect():
        got[r.page].add(r.table)
    assert len(got[1]) == 2 and len(got[2]) == 1
    assert ruled_tables.cells(spark.createDataFrame([], SEGMENT)).count() == 0


# ---- rasters


def flood(pixels):
    left, out = set(pixels), []
    while left:
        todo, area = [left.pop()], []
        while todo:
            p, x, y = todo.pop()
            area.append((x, y))
            for q in ((p, x + 1, y), (p, x - 1, y), (p, x, y + 1), (p, x, y - 1)):
                if q in left:
                    left.discard(q)
                    todo.append(q)
        xs, ys = zip(*area)
        out.append((p, len(area), min(xs), min(ys), max(xs), max(ys)))
    return sorted(out)


@pytest.mark.parametrize("tile, share", [(4, 0.6), (64, 0.45), (1, 0.7)])
def test_components_by_flood_fill(spark, tile, share):
    rng = random.Random(tile)
    pixels = {(p, x, y) for p in range(3) for x in range(25) for y in range(30) if rng.random() < share}
    frame = spark.createDataFrame(sorted(pixels) + sorted(pixels)[:5], "page long, x long, y long")
    got = regions.boxes(regions.connected(regions.runs_of(frame), tile_rows=tile))
    assert sorted((r.page, r.area, r.x0, r.y0, r.x1, r.y1) for r in got.collect()) == flood(pixels)


def test_dilation_by_brute_force(spark):
    rng = random.Random(2)
    pixels = {(0, x, y) for x in range(20) for y in range(15) if rng.random() < 0.1}
    grown = set(pixels)
    for _ in range(2):
        grown |= {(0, x + dx, y + dy) for _, x, y in grown for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= x + dx < 20 and 0 <= y + dy < 15}
    runs = regions.dilated(regions.runs_of(spark.createDataFrame(sorted(pixels), "page long, x long, y long")), 2, F.lit(20), F.lit(15))
    assert {(r.page, x, r.y) for r in runs.collect() for x in range(r.x0, r.x1 + 1)} == grown


def test_regions_join_aligned_boxes(spark):
    cards = [(1, x, y) for x in list(range(5, 20)) + list(range(26, 40)) for y in range(10, 30)] + [(1, x, y) for x in range(80, 95) for y in range(60, 75)] + [(1, 1, 1)]
    frame = regions.runs_of(spark.createDataFrame(cards, "page long, x long, y long"))
    got = [(r.place, r.x0, r.y0, r.x1, r.y1) for r in regions.regions(frame, 120, 100).orderBy("place").collect()]
    assert got == [(1, 5, 10, 40, 30), (2, 80, 60, 95, 75)]


def test_graph_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7), (None, 3)]
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: root(k) for k in parent}


# ---- rows, frames, cells


def test_rows_printed_over_one_another(spark):
    def chars(line, text, x, y):
        return [(1, line, k, c, x + 6.0 * k, 6.0, float(y), 8.0) for k, c in enumerate(text)]

    rows = chars(1, "ab", 0, 0) + chars(2, "abcdef", 0.5, 0.4) + chars(3, "def", 18, 0) + chars(4, "efgh", 24, 1) + chars(5, "far", 80, 0) + chars(6, "next", 0, 20) + chars(7, "  ", 0, 40)
    got = layout.merged_rows(spark.createDataFrame(rows, "page long, line long, pos long, ch string, x double, width double, y double, height double"))
    assert sorted((r.row, r.segment, r.text) for r in got.collect()) == [(0, 0, "abcdefgh"), (0, 1, "far"), (1, 0, "next")]


def test_overprints_across_squares(spark):
    rows = [(1, 1, 3.9, 9.0, "word"), (1, 2, 4.1, 9.0, "word"), (1, 3, 200.0, 80.0, "x"), (1, 4, 203.9, 83.9, "x"), (1, 5, 207.9, 80.0, "x"), (1, 6, 50.0, 50.0, "鄉鄉"), (1, 7, 50.0, 51.0, "鄉"), (1, 8, 90.0, 9.0, "part of"), (1, 9, 91.0, 9.0, "part"), (1, 10, 4.0, 9.0, "")]
    got = layout.overprints(spark.createDataFrame(rows, "page long, frame long, x0 double, y0 double, text string"))
    assert sorted(r.frame for r in got.collect()) == [2, 4, 6, 9]


@pytest.mark.parametrize("swept", [200_000, 10])
def test_nearest_cells_by_brute_force(spark, monkeypatch, swept):
    monkeypatch.setattr(layout, "SWEPT_CELLS", swept)
    rng = random.Random(swept)
    cells = []
    for k in range(150):
        x, y = rng.randrange(60) * 10.0, rng.randrange(40) * 5.0
        cells.append((k % 3, k, x, x + rng.choice([10, 25, 80]), y, y + rng.choice([8.0, 15.0, 120.0])))
    frame = spark.createDataFrame([*cells, (0, 999, None, 1.0, 1.0, 1.0)], "page long, cell long, x0 double, x1 double, y0 double, y1 double").repartition(3)

    def nearest(a, gap, fits):
        best = min(((gap(a, b), b[1]) for b in cells if b[0] == a[0] and b[1] != a[1] and fits(a, b)), default=None)
        return best and best[1]

    right = {a[1]: nearest(a, lambda a, b: b[2] - a[3], lambda a, b: 0 <= b[2] - a[3] <= 300 and min(a[5], b[5]) - max(a[4], b[4]) >= 0.5 * min(a[5] - a[4], b[5] - b[4])) for a in cells}
    below = {a[1]: nearest(a, lambda a, b: b[4] - a[5], lambda a, b: 0 <= b[4] - a[5] <= 1.6 * (a[5] - a[4]) and min(a[3], b[3]) - max(a[2], b[2]) >= 0.3 * min(a[3] - a[2], b[3] - b[2])) for a in cells}
    assert {r.cell: r.right for r in layout.nearest_right(frame).collect()} == {k: v for k, v in right.items() if v is not None}
    assert {r.cell: r.below for r in layout.nearest_below(frame).collect()} == {k: v for k, v in below.items() if v is not None}


def test_labels_beside_their_values(spark):
    rows = [(1, 1, "出生日期", 0.0, 0.0), (1, 2, "1998/12/28", 60.0, 0.0), (1, 3, "生日", 0.0, 40.0), (1, 4, "1998.12.20", 0.0, 52.0), (1, 5, "出生日期 1990-01-02", 300.0, 200.0), (1, 6, "a@b.com", 360.0, 200.0), (2, 7, "出生日期", 0.0, 0.0), (2, 8, "1998/12/18", 900.0, 0.0), (2, 9, None, 60.0, 0.0)]
    cells = spark.createDataFrame([(p, c, t, x, y, x + 50, y + 10) for p, c, t, x, y in rows], "page long, cell long, text string, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.page, r.cell, r.type, r.value) for r in deident.across_cells(cells, ("dob", "email")).collect())
    assert got == [(1, 2, "dob", "1998/12/28"), (1, 4, "dob", "1998.12.20"), (1, 5, "dob", "1990-01-02"), (1, 6, "email", "a@b.com")]


# ---- quantiles


@pytest.mark.parametrize("few, bins", [(10_000, 4096), (5, 4), (1, 3)])
def test_quantiles_are_exact(spark, monkeypatch, few, bins):
    import numpy as np

    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = random.Random(few)
    groups = {"a": [rng.gauss(0, 1e6) for _ in range(101)], "b": [1.0] * 40 + [1e300, -1e300, 1e-300], "c": [5.0], None: [float(k % 7) for k in range(50)], "d": [None], "e": [rng.random() * 1e-9 for _ in range(30)], "f": [0.0, 5e-324, 1e-323] * 9, "g": [1.0, 1.0000000000000002] * 8}
    frame = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double").repartition(3)
    got = {r.g: (r.low, r.mid, r.high) for r in quantiles.quantiles(frame, "g", "v", {"low": 0.05, "mid": 0.5, "high": 0.99}).collect()}
    assert got.keys() == groups.keys() and got["d"] == (None, None, None)
    for g, values in groups.items():
        if g != "d":
            assert got[g] == pytest.approx([float(np.quantile(values, q)) for q in (0.05, 0.5, 0.99)], rel=1e-9, abs=1e-300)


# ---- form fields


def form(spark, spans, cells=(), lines_=()):
    from paperloom.operators import form_fields

    box_ = "x0 double, y0 double, x1 double, y1 double"
    synonyms = spark.createDataFrame([("company", ["公司名稱"]), ("tax", ["統一編號", "統編"]), ("phone", ["電話"])], "key string, synonyms array<string>")
    found = form_fields.fields(
        spark.createDataFrame([(1, k, t, *map(float, b)) for k, (t, b) in enumerate(spans)], f"page long, span long, text string, {box_}"),
        synonyms,
        spark.createDataFrame([(1, k, *map(float, b)) for k, b in enumerate(cells)], f"page long, cell long, {box_}"),
        spark.createDataFrame([(1, level, *map(float, v)) for level, *v in lines_], "page long, level boolean, at double, low double, high double"),
    )
    return {(r.span, r.part, r.key): (r.kind, r.slot_x0, r.slot_x1, r.occupied) for r in found.collect()}


def test_slots_in_cells(spark):
    cells = [(0, 0, 80, 20), (80, 0, 90, 20), (90, 0, 300, 20), (0, 20, 300, 40), (0, 40, 60, 60), (0, 60, 60, 90)]
    got = form(spark, [("公司名稱:", (2, 4, 50, 14)), ("統編/身分證", (2, 24, 50, 34)), ("電 話", (2, 44, 50, 54)), ("note", (100, 5, 140, 15))], cells)
    assert got[0, -1, "company"] == ("right-adj", 93.0, 297.0, True)  # past the marker column
    assert got[1, -1, "tax"] == ("inline", 53.0, 297.0, False)
    assert got[2, -1, "phone"] == ("below-adj", 3.0, 57.0, False)


def test_slots_outside_cells(spark):
    rulings_ = [(True, 20, 60, 200), (True, 100, 0, 300), (True, 140, 0, 300), (False, 0, 100, 140), (False, 300, 100, 140)]
    got = form(spark, [("公司名稱", (2, 4, 50, 14)), ("電話", (20, 110, 60, 120)), ("統一編號", (2, 300, 50, 310))], (), rulings_)
    assert got == {(0, -1, "company"): ("underline", 60.0, 199.0, False), (1, -1, "phone"): ("inline", 63.0, 297.0, False), (2, -1, "tax"): ("unbounded", 53.0, 595.0, False)}


def test_labels_of_one_span_and_covered_slots(spark):
    got = form(spark, [("公司名稱:   電話:    ", (0, 0, 180, 10)), ("統編", (0, 50, 40, 60)), ("電話", (100, 50, 140, 60))])
    assert {k for k in got if k[0] == 0} == {(0, 0, "company"), (0, 1, "phone")}
    assert got[1, -1, "tax"][0] is None and got[2, -1, "phone"][0] == "unbounded"  # a value would stand on the other label
