"""Detection, masking and replacement of personal data and secrets in texts.

Spans are found by the catalogue's expressions on Arrow batches (look-around and Unicode classes are Python's); checks,
containment, masks and rewriting happen beside them, so a text crosses to Python once.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import checks
from paperloom.functions.pii_patterns import CATALOGUE
from paperloom.operators import layout
from paperloom.session import bounded_batches


@dataclass(frozen=True)
class Pattern:
    id: str
    label: str
    group: str
    default_on: bool
    value_group: int
    check: str | None
    mask: str
    flags: int
    expression: str

    @functools.cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.expression, self.flags)


PATTERNS = {row[0]: Pattern(*row) for row in CATALOGUE}
DEFAULT = tuple(p.id for p in PATTERNS.values() if p.default_on)

#: Patterns of which every match holds a digit; most texts have none, and one search for it replaces theirs.
WITH_DIGITS = frozenset("tw_id tw_arc dob hic mobile landline addr cc bank_account bank_code bank_branch tw_biz tw_einvoice order_num ip plate gps flight".split())
DIGIT = re.compile(r"\d")

CHECKS = {
    "tw_id": checks.is_national_id,
    "tw_arc": lambda v: bool(re.fullmatch(r"[A-Z][A-D89]\d{8}", v.upper())),
    "tw_biz": checks.is_business_id,
    "luhn": checks.is_card,
    "bank_account": lambda v: 8 <= sum(c.isdecimal() for c in v) <= 20,
}


def custom_patterns(text: str) -> list[Pattern]:
    """Own rules, one ``label | expression`` a line; comments and bad lines are skipped."""
    out = []
    for n, line in enumerate(text.splitlines()):
        label, bar, expression = (x.strip() for x in line.partition("|"))
        if not bar or not expression or label.startswith("#"):
            continue
        try:
            re.compile(expression)
        except re.error:
            continue
        out.append(Pattern(f"custom_{n}", label or expression, "自訂", True, 0, None, "edges:1:1", 0, expression))
    return out


# ---- masks


def keep_edges(value: str, head: int, tail: int, mark: str = "*") -> str:
    hidden = len(value) - head - tail
    return mark * len(value) if hidden <= 0 else value[:head] + mark * hidden + value[len(value) - tail :]


def refill(value: str, digits: str) -> str:
    """The value with its digits replaced one by one, punctuation where it was."""
    fresh = iter(digits)
    return "".join(next(fresh, c) if c.isdigit() else c for c in value)


def mask_value(kind: str, value: str) -> str:
    name, *args = kind.split(":")
    digits = re.sub(r"\D", "", value)
    if name == "text":
        return kind.removeprefix("text:")
    if name == "edges":
        return keep_edges(value, int(args[0]), int(args[1]))
    if name == "id":
        return keep_edges(value, 2, 2)
    if name == "phone":
        return refill(value, keep_edges(digits, 4, 3) if len(digits) >= 10 else keep_edges(digits, 2, 2))
    if name == "digits":
        head, tail, least = map(int, args)
        if len(digits) < least:
            return keep_edges(value, 2, 2) if least == 8 else "*" * len(value)
        return refill(value, digits[:head] + "*" * (len(digits) - head - tail) + digits[len(digits) - tail :])
    if name == "email":
        local, at, domain = value.partition("@")
        return keep_edges(value, 2, 2) if not at else ("*" * len(local) if len(local) <= 2 else local[:2] + "***") + at + domain
    if name == "ip":
        return value.split(".")[0] + ".***.***.***" if value.count(".") == 3 else keep_edges(value, 3, 0)
    if name == "name":
        value = value.strip()
        return "O" if len(value) <= 1 else value[0] + "O" if len(value) == 2 else value[0] + "O" * (len(value) - 2) + value[-1]
    if name == "scheme":
        return re.match("https?://", value)[0] + "***"
    if name == "user_path":
        return re.sub(r"(/home/|/Users/|C:\\Users\\|%USERPROFILE%\\?)[^/\\]+", r"\1USER", value)
    if name == "ssh":
        return value.split(None, 1)[0] + " [SSH-PUBKEY-REDACTED]"
    raise ValueError(f"unknown mask {kind}")


def fake_value(pattern_id: str, value: str) -> str:
    """A made-up value of the same shape, the same for equal values; ids and cards keep a valid checksum."""
    noise = hashlib.sha256(f"{pattern_id}\0{value}".encode()).digest() * (len(value) // 16 + 1)
    out = "".join(
        str(noise[k] % 10) if c.isdigit() else chr((65 if c.isupper() else 97) + noise[k] % 26) if c.isascii() and c.isalpha() else c for k, c in enumerate(value)
    )
    if pattern_id == "tw_id":
        out = value[0] + value[1] + out[2:9]
        return next(out + d for d in "0123456789" if checks.is_national_id(out + d))
    if pattern_id in ("tw_biz", "cc"):
        fits = checks.is_business_id if pattern_id == "tw_biz" else checks.is_card
        last = max(k for k, c in enumerate(out) if c.isdigit())
        for first in "0123456789":
            for d in "0123456789":
                trial = out[: last - 1] + (first if out[last - 1].isdigit() else out[last - 1]) + d + out[last + 1 :]
                if fits(trial):
                    return trial
    if pattern_id == "ip":
        return f"192.0.2.{noise[0]}"
    if pattern_id == "email":
        return f"user{int.from_bytes(noise[:3], 'big')}@example.com"
    return out


# ---- spans


def possible(text: str, patterns: Iterable[Pattern]) -> list[tuple[int, Pattern]]:
    """The patterns, with their places, that a text can hold a match of, by the characters each needs."""
    lacking = frozenset() if DIGIT.search(text) else WITH_DIGITS
    lacking |= frozenset() if "@" in text else {"email"}
    return [(n, p) for n, p in enumerate(patterns) if p.id not in lacking]


def find_spans(text: str, patterns: Iterable[Pattern]) -> list[tuple]:
    """(type, label, group, value, masked, start, end): valid values, without what another of its type contains."""
    found = []
    for n, p in possible(text, patterns):
        check = CHECKS.get(p.check or "")
        for m in p.regex.finditer(text):
            value = m[p.value_group]
            if value and (check is None or check(value)):
                found.append((m.start(p.value_group), -m.end(p.value_group), n, p, value))
    found.sort(key=lambda x: x[:3])
    kept, reach = [], {}
    for start, minus_end, _, p, value in found:
        if reach.get(p.id, -1) >= -minus_end:
            continue
        reach[p.id] = -minus_end
        kept.append((p.id, p.label, p.group, value, mask_value(p.mask, value), start, -minus_end))
    return kept


def disjoint(spans: list[tuple], size: int) -> list[tuple[int, int, list[tuple]]]:
    """(start, end, spans) of each run of spans that overlap, in order; spans outside the text are left out."""
    runs: list[tuple[int, int, list[tuple]]] = []
    for span in sorted((s for s in spans if 0 <= s[5] < s[6] <= size), key=lambda s: (s[5], -s[6])):
        if runs and span[5] < runs[-1][1]:
            start, end, of = runs[-1]
            runs[-1] = start, max(end, span[6]), [*of, span]
        else:
            runs.append((span[5], span[6], [span]))
    return runs


def rewrite(text: str, spans: list[tuple], mode: str) -> str:
    """Spans replaced: redact, mask or fake. Of spans that overlap, one that covers all of them decides, else their whole
    run is blacked out, so that nothing of any span stays in clear."""
    out, at = [], 0
    for start, end, of in disjoint(spans, len(text)):
        kind, _, _, value, masked, first, last = of[0]
        if mode == "redact" or (first, last) != (start, end):
            fresh = "█" * (end - start)
        else:
            fresh = masked if mode == "mask" else fake_value(kind, value)
            if mode == "mask" and any(s[3] in fresh for s in of[1:]):  # the outer mask lets an inner value show
                fresh = "█" * (end - start)
        out += [text[at:start], fresh]
        at = end
    return "".join([*out, text[at:]])


SPANS = "array<struct<type:string,label:string,grp:string,value:string,masked:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([*((n, pa.string()) for n in ("type", "label", "grp", "value", "masked")), ("start", pa.int32()), ("end", pa.int32())]))
_SPAN_NAMES = ("type", "label", "grp", "value", "masked", "start", "end")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ids: Iterable[str] = DEFAULT, custom: str = "", mode: str | None = None) -> DataFrame:
    """(id, spans) of every row, with the rewritten text if a mode is given; null text has no spans."""
    chosen = [PATTERNS[i] for i in ids] + custom_patterns(custom)
    bounded_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans = [find_spans(t, chosen) for t in texts]
            columns = [batch.column(0), pa.array([[dict(zip(_SPAN_NAMES, s)) for s in row] for row in spans], _SPAN_TYPE)]
            if mode:
                columns.append(pa.array([rewrite(t, s, mode) for t, s in zip(texts, spans)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "spans", "text"][: len(columns)])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"{id_col} {kind}, spans {SPANS}" + ", text string" * bool(mode))


def findings(detected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each span, numbered in order of place."""
    return detected.select(id_col, F.posexplode("spans").alias("number", "s")).select(id_col, "number", "s.*")


def label_counts(detected: DataFrame) -> DataFrame:
    """(type, label, count), the most frequent first."""
    spans = detected.select(F.explode("spans").alias("s")).select("s.type", "s.label")
    return spans.groupBy("type", "label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")


def drop_overlapping(spans: DataFrame, taken: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spans (id, start, end) that overlap none of ``taken``: an anti-join on the document and overlap."""
    t = taken.select(F.col(id_col).alias("_id"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    return spans.join(t, (spans[id_col] == t["_id"]) & (spans["start"] < t["_b"]) & (t["_a"] < spans["end"]), "left_anti")


# ---- values that stand in the cell beside their label


def straddling(first: str, second: str, patterns: Iterable[Pattern]) -> list[tuple]:
    """(type, label, group, value, masked, in second) of labelled values that only the two texts together show: the match
    begins in one and ends in the other."""
    text, junction = f"{first} {second}", len(first)
    found = []
    for _, p in possible(text, patterns):
        check = CHECKS.get(p.check or "")
        for m in p.regex.finditer(text):
            value = m[p.value_group]
            if value and m.start() < junction < m.end() and (check is None or check(value)):
                found.append((p.id, p.label, p.group, value, mask_value(p.mask, value), m.start(p.value_group) > junction))
    return found


#: Pages of more cells are cut into bands, which tasks share.
PAGE_CELLS = 1_000
#: How cells answer for one another: along, across, and how far (see ``layout.sweep``).
BESIDE = ((("x0", "x1"), ("y0", "y1"), 300.0, 0.5, 0.0, 2.0), (("y0", "y1"), ("x0", "x1"), None, 0.3, 1.6, 0.0))
FOUND = ("type", "label", "grp", "value", "masked")


def across_cells(cells: DataFrame, ids: Iterable[str] = DEFAULT, page: str = "page") -> DataFrame:
    """(page, cell, type, label, grp, value, masked): personal data of cells (page, cell, text, x0, y0, x1, y1), by itself or
    with a label in the cell at its left or above it.

    A cell is paired with its nearest one to the right and its nearest one below, so that pairs are two a cell at most. Only
    patterns with a label are tried on pairs, and only matches that straddle the border count; ``cell`` is where the value
    stands. Each value of a type counts once a cell. Null texts hold nothing. Cells are dealt by page once, and a task goes
    through its pages; pages of over PAGE_CELLS are cut into bands and their pairs joined.
    """
    chosen = [PATTERNS[i] for i in ids]
    bounded_batches(cells.sparkSession)
    box = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    rows = cells.select(F.col(page).alias("page"), "cell", F.coalesce("text", F.lit("")).alias("text"), *box)
    large = layout.large_pages(PAGE_CELLS, "page", rows.filter("page IS NOT NULL"))
    counted = rows.filter("page IS NOT NULL").withColumn("_n", F.count("*").over(layout.Window.partitionBy("page")))
    found = _in_pages(counted.filter(F.col("_n") <= PAGE_CELLS).drop("_n").sortWithinPartitions("page"), chosen)
    found = found.union(_alone(rows.filter("page IS NULL"), chosen).distinct())
    if large is not None:
        found = found.union(_in_bands(rows.join(large, "page", "left_semi"), chosen))
    return found.withColumnRenamed("page", page)


def _shown(cells: DataFrame) -> str:
    kinds = {c: cells.schema[c].dataType.simpleString() for c in ("page", "cell")}
    return f"page {kinds['page']}, cell {kinds['cell']}, type string, label string, grp string, value string, masked string"


def _spread(found: list[list[tuple]], of: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """(row, place) of each finding of rows that have those of ``found[of]``, and the findings one after the other."""
    sizes = np.array([len(f) for f in found], np.int64)
    n, starts = sizes[of], (np.cumsum(sizes) - sizes)[of]
    rows = np.repeat(np.arange(len(of)), n)
    return rows, np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(len(rows)), [t for f in found for t in f]


def _in_pages(cells: DataFrame, chosen: list[Pattern]) -> DataFrame:
    """``across_cells`` of rows that are sorted by page, with all cells of a page in one task; each text, and each pair of
    texts, is read once in some 200,000 cells."""
    labelled = [p for p in chosen if p.value_group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in layout.whole_groups(batches, "page"):
            table = table.combine_chunks()
            texts = table.column("text").combine_chunks().dictionary_encode()
            of, texts = texts.indices.to_numpy().astype(np.int64), texts.dictionary.to_pylist()
            at, pick, flat = _spread([[s[:5] for s in find_spans(t, chosen)] for t in texts], of)
            out = [(at, pick, flat)]
            whole = functools.reduce(pc.and_, (pc.is_valid(table.column(c)) for c in ("cell", "x0", "y0", "x1", "y1")))
            whole = np.flatnonzero(whole.to_numpy())
            placed = {c: table.column(c).take(pa.array(whole)).to_numpy() for c in ("_g", "cell", "x0", "y0", "x1", "y1")}
            for along, across, reach, share, heights, slack in BESIDE:
                first, _, second = sweep_(placed, along, across, reach, share, heights, slack)
                first, second = whole[first], whole[second]
                pairs, which = np.unique(of[first] * len(texts) + of[second], return_inverse=True)
                at, pick, flat = _spread([straddling(texts[p // len(texts)], texts[p % len(texts)], labelled) for p in pairs.tolist()], which)
                behind = np.array([f[5] for f in flat], bool)[pick]
                out.append((np.where(behind, second[at], first[at]), pick, flat))
            parts = [pa.table([*(table.column(c).take(pa.array(at)) for c in ("page", "cell")), *(pa.array(v, pa.string()).take(pa.array(pick)) for v in (zip(*(f[:5] for f in flat)) if flat else [()] * 5))], names=["page", "cell", *FOUND]) for at, pick, flat in out]
            yield from pa.concat_tables(parts).group_by(["page", "cell", *FOUND]).aggregate([]).combine_chunks().to_batches(max_chunksize=10_000)

    def sweep_(placed: dict, along: tuple, across: tuple, *how) -> tuple[np.ndarray, ...]:
        return layout.sweep(placed["_g"], placed["cell"], tuple(placed[c] for c in along), tuple(placed[c] for c in across), *how)

    return cells.mapInArrow(run, _shown(cells))


def _alone(cells: DataFrame, chosen: list[Pattern]) -> DataFrame:
    spans = detect(cells.select(F.struct("page", "cell").alias("_id"), "text"), "_id", "text", [p.id for p in chosen])
    return spans.select("_id.page", "_id.cell", F.explode("spans").alias("s")).select("page", "cell", *(f"s.{c}" for c in FOUND))


def _in_bands(cells: DataFrame, chosen: list[Pattern]) -> DataFrame:
    """``across_cells`` of pages of any size, by joins."""
    labelled = [p for p in chosen if p.value_group]
    texts = cells.select("page", "cell", "text")
    near = [layout._near(cells, "page", along, across, share, reach, heights, slack).withColumnRenamed("hit", "beside") for along, across, reach, share, heights, slack in BESIDE]
    other = texts.select("page", F.col("cell").alias("beside"), F.col("text").alias("second"))
    pairs = near[0].union(near[1]).join(texts, ["page", "cell"]).join(other, ["page", "beside"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = batch.column("text").to_pylist(), batch.column("second").to_pylist()
            rows = [(k, *found) for k, (a, b) in enumerate(zip(first, second)) for found in straddling(a, b, labelled)]
            if rows:
                at, *values, behind = zip(*rows)
                at = pa.array(at)
                place = pc.if_else(pa.array(behind), batch.column("beside").take(at), batch.column("cell").take(at))
                yield pa.RecordBatch.from_arrays([batch.column("page").take(at), place, *(pa.array(v, pa.string()) for v in values)], names=["page", "cell", *FOUND])

    joined = pairs.select("page", "cell", "beside", "text", "second").mapInArrow(run, _shown(cells))
    return _alone(cells, chosen).union(joined).distinct()
