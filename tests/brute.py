"""Plain Python for the registered queries that SQL can't express: (rows, spark) -> None, raising where they are wrong."""

import difflib
import hashlib
import re
from collections import Counter, defaultdict

from paperloom.operators import deident
from paperloom.plans import page_queries, region_queries
from tests.conftest import SMALL
from tests.test_alignment import recovered_by_hand


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def spans_of(text):
    out = []
    for name in deident.DEFAULT:
        p = deident.PATTERNS[name]
        check = deident.CHECKS.get(p.check or "", lambda v: True)
        own = {(*m.span(p.value_group), m[p.value_group]) for m in re.finditer(p.expression, text, p.flags) if m[p.value_group] and check(m[p.value_group])}
        out += [(a, b, name, v) for a, b, v in own if not any((c, d) != (a, b) and c <= a and b <= d for c, d, _ in own)]
    return out


def pii_findings(rows, spark):
    want = sorted((i, a, b, name, v) for i, text in documents(spark).items() for a, b, name, v in spans_of(text))
    assert sorted((r["doc_id"], r["start"], r["end"], r["type"], r["value"]) for r in rows) == want
    numbers = defaultdict(list)
    for r in rows:
        numbers[r["doc_id"]].append(r["number"])
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values())


def pii_masked_texts(rows, spark):
    texts = documents(spark)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text, spans = texts[r["doc_id"]], spans_of(texts[r["doc_id"]])
        assert r["n_spans"] == len(spans)
        # without spans nothing changes; spans that meet no other are replaced by their masks
        alone = [s for s in spans if not any(o is not s and o[0] < s[1] and s[0] < o[1] for o in spans)]
        if len(alone) == len(spans):
            masked, at = "", 0
            for a, b, name, v in sorted(alone):
                masked += text[at:a] + deident.mask_value(deident.PATTERNS[name].mask, v)
                at = b
            assert r["masked_sha256"] == hashlib.sha256((masked + text[at:]).encode()).hexdigest()


def turns(spark):
    return {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()}


def turn_line_diff(rows, spark):
    known = turns(spark)
    want = {f"{c}:{t}": (x, known[c, t + 1]) for (c, t), x in known.items() if (c, t + 1) in known}
    assert sorted(r["pair_id"] for r in rows) == sorted(want)
    for r in rows:
        a, b = (x.splitlines() for x in want[r["pair_id"]])
        codes = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        sizes = [(i2 - i, j2 - j) for tag, i, i2, j, j2 in codes if tag != "equal"]
        changed, removed, added = sum(map(min, sizes)), sum(max(0, x - y) for x, y in sizes), sum(max(0, y - x) for x, y in sizes)
        equal = sum(i2 - i for tag, i, i2, _, _ in codes if tag == "equal")
        assert (r["changed"], r["removed"], r["added"], r["rows"]) == (changed, removed, added, equal + changed + removed + added)


def recovered_lines(rows, spark):
    lines, known = [], []
    for i, text in documents(spark).items():
        parts = re.split("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", text)
        for pos, line in enumerate(parts if parts[-1] else parts[:-1]):
            lines.append((i, pos // 40, pos % 40 * 20.0, 800.0, line))
            if pos % 9 != 4:
                known.append((i, line))
    assert sorted((r["doc_id"], r["page"], r["y"], r["text"]) for r in rows) == sorted(recovered_by_hand(lines, known))


def fixed_lines(rows, spark):
    want = []
    for i, text in documents(spark).items():
        parts = re.split("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", text)
        parts = parts if parts[-1] else parts[:-1]
        lines = []
        for pos, line in enumerate(parts):
            if pos % 20 == 0:
                lines.append((pos // 20, 2 * pos + 1, 0.0, f"page of {i}"))
            lines.append((pos // 20, 2 * pos + 2, (pos % 20 + 1) * 40.0, line))
        cleaned = []
        for page, pos, y, line in lines:
            line = re.sub("[\ue000-\uf8ff\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", line)
            n, extra = max(1, len(line)), len(re.findall("[\u00c0-\u024f]", line))
            letters, vowels = len(re.findall("[A-Za-z]", line)), len(re.findall("[AEIOUaeiou]", line))
            if (extra >= 5 and extra > 0.1 * n) or (letters >= 8 and vowels < 0.12 * letters and not re.search("[\u4e00-\u9fff]", line)):
                line = ""
            if not re.fullmatch(r"[_.·…\s]+", line, re.A):
                cleaned.append((page, pos, y, line))
        pages, edges = {p for p, _, _, t in cleaned if t}, defaultdict(set)
        for page, _, y, line in cleaned:
            if line and (y < 100 or y > 900):
                edges[line].add(page)
        common = {t for t, p in edges.items() if len(p) >= max(2, len(pages) // 2)}
        before = None
        for page, pos, y, line in cleaned:
            if line in common and (y < 100 or y > 900):
                continue
            if not line or line != before:
                want.append((i, page, pos, line))
            before = line or before
    assert sorted((r["doc_id"], r["page"], r["pos"], r["text"]) for r in rows) == sorted(want)


def paragraphs_aligned(rows, spark):
    left, right = (Counter(), Counter())
    tidy = lambda t: " ".join(re.sub("[\ufeff\u200b\u200c\u200d]", "", t or "").split())
    frames = [[(r.doc_id, r.pos, tidy(r.text)) for r in f.select("doc_id", "pos", "text").collect()] for f in page_queries._paragraphs(spark, SMALL)]
    sides = [{(d, p): t for d, p, t in f if d is not None and t} for f in frames]
    for side, count in zip(sides, (left, right)):
        count.update((d, t) for (d, _), t in side.items())
    used = [Counter(), Counter()]
    for r in rows:
        used[0][r["doc_id"], r["left_pos"]] += 1
        used[1].update((r["doc_id"], p) for p in r["right_pos"])
        if r["method"] == "equal":
            assert sides[0][r["doc_id"], r["left_pos"]] == sides[1][r["doc_id"], r["right_pos"][0]] and r["confidence"] == 1
        assert 0 <= r["confidence"] <= 1 and (r["method"] == "place" or r["confidence"] >= 0.85)
    assert all(n == 1 for u in used for n in u.values()) and used[0].keys() <= sides[0].keys() and used[1].keys() <= sides[1].keys()
    assert sum(r["method"] == "equal" for r in rows) == sum((left & right).values())


def raster_regions(rows, spark):
    from tests.test_tables_and_regions import flood

    pixels = {(r.page, r.x, r.y) for r in region_queries._pixels(spark, SMALL).collect()}
    width, height = region_queries.WIDTH, region_queries.HEIGHT
    grown = {(p, x + dx, y + dy) for p, x, y in pixels for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= x + dx < width and 0 <= y + dy < height}
    pages = defaultdict(list)
    for p, *box in flood(grown):
        pages[p].append(box)
    want = []
    for p, boxes in pages.items():
        while True:  # a round joins all that can be joined
            root = list(range(len(boxes)))

            def top(k):
                while root[k] != k:
                    k = root[k]
                return k

            for i, (_, ax0, ay0, ax1, ay1) in enumerate(boxes):
                for j, (_, bx0, by0, bx1, by1) in enumerate(boxes[:i]):
                    least = min(ay1 - ay0, by1 - by0) + 1
                    if min(ay1, by1) - max(ay0, by0) + 1 >= 0.5 * least and max(ax0, bx0) - min(ax1, bx1) - 1 <= 0.6 * least:
                        a, b = sorted((top(i), top(j)))
                        root[b] = a
            groups = defaultdict(list)
            for k, box in enumerate(boxes):
                groups[top(k)].append(box)
            if len(groups) == len(boxes):
                break
            boxes = [[sum(b[0] for b in g), min(b[1] for b in g), min(b[2] for b in g), max(b[3] for b in g), max(b[4] for b in g)] for g in groups.values()]
        own = []
        for area, x0, y0, x1, y1 in boxes:
            if area >= 0.002 * width * height:
                inside = [(x, y) for q, x, y in pixels if q == p and x0 <= x <= x1 and y0 <= y <= y1]
                xs, ys = zip(*inside)
                own.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1))
        want += [(p, k, *box) for k, box in enumerate(sorted(own, key=lambda b: (b[1], b[0], b[2], b[3])), 1)]
    assert sorted((r["page"], r["place"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows) == sorted(want)


BRUTE = {f.__name__: f for f in (pii_findings, pii_masked_texts, turn_line_diff, recovered_lines, paragraphs_aligned, raster_regions, fixed_lines)}
