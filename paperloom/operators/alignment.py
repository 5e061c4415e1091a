"""Paragraphs of two versions of a document, matched in four rounds: equal, alike, one against several, by place.

Equal texts are matched by a join on (document, text, occurrence). Only what that leaves goes, by document, to a Python
helper; a document's left-over paragraphs are compared with one another, never with those of other documents. Most pairs
are told apart by their lengths or by the characters that they share, before their common subsequence is looked for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

#: Least likeness of a match, longest run of paragraphs held against one, most that a place alone is worth.
LEAST_ALIKE = 0.85
LONGEST_RUN = 5
PLACE_CONFIDENCE = 0.5

SCHEMA = "left_pos long, right_pos array<long>, method string, confidence double"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table held in the bits of one integer."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty texts. 0 where lengths, or the characters that both
    hold, show that it is under ``least``, without looking for the subsequence."""
    size = len(a) + len(b)
    if not size:
        return 1.0
    if least and (2 * min(len(a), len(b)) < least * size or 2 * (Counter(a) & Counter(b)).total() < least * size):
        return 0.0
    return 2 * common_length(a, b) / size


def token_set_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Likeness of two sets of words: the shared ones against the shared ones with each side's own; 0 if under ``least``."""
    x, y = set(a.split()), set(b.split())
    shared, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and not (only_x and only_y):
        return 1.0
    with_x, with_y = f"{shared} {only_x}".strip(), f"{shared} {only_y}".strip()
    # the shared words stand in front of both, so that their own ratios are told by lengths
    found = [2 * len(shared) / (len(shared) + len(t)) for t in (with_x, with_y)] if shared else [0.0]
    best = max(found) if max(found) >= least else 0.0
    return max(best, ratio(with_x, with_y, max(best, least)))


def partial_ratio(a: str, b: str) -> float:
    """The shorter text against its best stretch of the longer one; stretches at the ends may be cut. An empty text is like none."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    return max(ratio(short, long[max(0, k) : k + n]) for k in range(1 - n, len(long))) if short else 0.0


def likest(text: str, choices: list[tuple[list[int], list[str]]], likeness: Callable[[str, list[str]], float]) -> tuple[float, list[int]]:
    """The first of the choices with the greatest likeness."""
    best, where = 0.0, []
    for places, texts in choices:
        score = likeness(text, texts)
        if score > best:
            best, where = score, places
    return best, where


def against_run(text: str, run: list[str]) -> float:
    """A text against several in a row, with and without spaces; 0 if under LEAST_ALIKE."""
    return max(ratio(text, " ".join(run), LEAST_ALIKE), ratio(text.replace(" ", ""), "".join(run).replace(" ", ""), LEAST_ALIKE))


def match_rest(left: list[tuple[int, str]], right: list[tuple[int, str]]) -> list[tuple]:
    """(left_pos, right_pos, method, confidence) of paragraphs (pos, text) without an equal; each is used once."""
    out: list[tuple] = []

    def one_by_one(method: str, sizes: range, likeness: Callable[[str, list[str]], float]) -> None:
        nonlocal left, right
        kept = []
        for pos, text in left:
            runs = [right[k : k + n] for n in sizes for k in range(len(right) - n + 1)]
            score, places = likest(text, [([p for p, _ in r], [t for _, t in r]) for r in runs], likeness)
            if score < LEAST_ALIKE:
                kept.append((pos, text))
                continue
            out.append((pos, places, method, score))
            right = [r for r in right if r[0] not in places]
        left = kept

    one_by_one("alike", range(1, 2), lambda text, run: token_set_ratio(text, run[0], LEAST_ALIKE))
    one_by_one("joined", range(2, LONGEST_RUN + 1), against_run)
    for (pos, text), (place, other) in zip(left, right):
        out.append((pos, [place], "place", min(PLACE_CONFIDENCE, partial_ratio(text, other))))
    return out


def _numbered(rows: DataFrame, doc: str, pos: str, text: str, side: str) -> DataFrame:
    tidy = rows.select(F.col(doc).alias("doc_id"), F.col(pos).cast("long").alias(side), T.without_zero_width(F.col(text)).alias("text")).filter("doc_id IS NOT NULL AND text <> ''")
    return tidy.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(side)))


def paired(left: DataFrame, right: DataFrame, doc: str = "doc_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """(doc_id, text, nth, left, right): equal paragraphs in pairs, the first with the first; others with one side null."""
    return _numbered(left, doc, pos, text, "left").join(_numbered(right, doc, pos, text, "right"), ["doc_id", "text", "nth"], "full")


def align_paragraphs(left: DataFrame, right: DataFrame, doc: str = "doc_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """(doc_id, left_pos, right_pos, method, confidence) of each left paragraph that found a partner.

    Texts are compared without zero-width marks and repeated space. Blank or null texts and rows without a document take no
    part; positions are unique in a document. Ties go to the shorter run and the earlier paragraph.
    """
    pairs = paired(left, right, doc, pos, text)
    kind = pairs.schema["doc_id"].dataType.simpleString()
    equal = pairs.filter("left IS NOT NULL AND right IS NOT NULL").select("doc_id", F.col("left").alias("left_pos"), F.array("right").alias("right_pos"), F.lit("equal").alias("method"), F.lit(1.0).alias("confidence"))

    def rest(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [sorted((int(p), t) for p, t in zip(rows[s], rows["text"]) if not pd.isna(p)) for s in ("left", "right")]
        found = match_rest(*sides)
        return pd.DataFrame([(rows["doc_id"].iloc[0], *f) for f in found], columns=["doc_id", "left_pos", "right_pos", "method", "confidence"])

    open_rows = pairs.filter("left IS NULL OR right IS NULL").select("doc_id", "text", "left", "right")
    return equal.unionByName(open_rows.groupBy("doc_id").applyInPandas(rest, f"doc_id {kind}, {SCHEMA}"))


#: Fixed values of the recovery: longest line, share of missing lines at which a page is given up, most lines of a page
#: and of a document, and the bands at a page's top and bottom.
RECOVERED_CHARS = 100
GIVEN_UP = 0.5
RECOVERED_OF_PAGE = 5
RECOVERED_OF_DOCUMENT = 20
TOP_BAND = 0.15
BOTTOM_BAND = 0.6
FORM_BLANKS = r"^[_\s]+$|^[年月日]+[_\s年月日]*$|^[\s_]*年[\s_]*月[\s_]*日[\s_]*$"


def recovered_lines(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, page, y, text): short lines of a page's top or bottom that the known texts of the document lack.

    ``lines`` holds (doc_id, page, y, height, text), ``known`` (doc_id, text); whitespace doesn't count, and what is part of
    a known text isn't missing. A recovered line is known from then on; pages are taken in order, a page's lines from its
    top. Pages that miss half of their lines or more are given up, and blanks of forms are no lines to recover. The limits
    for a page and a document are part of the operation. Blank lines, lines without y and rows without a document take no
    part; without a height nothing is recovered; equal places go by text.
    """
    key = T.without_space(F.col("text"))
    share = F.col("y") / F.when(F.col("height") > 0, F.col("height"))
    fits = F.coalesce((share < TOP_BAND) | (share > BOTTOM_BAND), F.lit(False)) & (F.length("text") <= RECOVERED_CHARS) & ~F.col("text").rlike(FORM_BLANKS)
    tidy = lines.withColumn("text", T.strip(F.col("text"))).filter("doc_id IS NOT NULL AND y IS NOT NULL AND text <> ''")
    # most lines equal a known text: a join tells, and only the others are looked for inside the known texts
    equal = known.select(F.col("doc_id").alias("_doc"), key.alias("_key")).distinct().withColumn("_same", F.lit(True))
    keyed = tidy.withColumns({"key": key, "fits": fits}).join(equal, (F.col("doc_id") == F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    rows = keyed.select("doc_id", "page", F.struct(F.col("y").cast("double").alias("y"), "text", "key", "fits", F.col("_same").isNotNull().alias("same")).alias("line"))
    pages = rows.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    docs = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "lines"))).alias("pages"))
    texts = known.groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list(key)).alias("known"))

    def of_page(state, page):
        absent = F.size(F.filter(page["lines"], lambda line: F.when(line["same"], False).otherwise(~F.contains(state["known"], line["key"]))))

        def of_line(now, line):
            wanted = ~line["same"] & line["fits"] & (now["n"] < RECOVERED_OF_PAGE) & (F.size(now["kept"]) < RECOVERED_OF_DOCUMENT) & ~F.contains(now["known"], line["key"])
            more = F.concat(now["kept"], F.array(F.struct(page["page"].alias("page"), line["y"].alias("y"), line["text"].alias("text"))))
            grown = F.struct(F.concat(now["known"], F.lit("\n"), line["key"]).alias("known"), more.alias("kept"), (now["n"] + 1).alias("n"))
            return F.when(wanted, grown).otherwise(now)

        start = F.struct(state["known"].alias("known"), state["kept"].alias("kept"), F.lit(0).alias("n"))
        done = F.aggregate(page["lines"], start, of_line, lambda now: F.struct(now["known"].alias("known"), now["kept"].alias("kept")))
        return F.when(absent >= GIVEN_UP * F.size(page["lines"]), state).otherwise(done)

    page_type = lines.schema["page"].dataType.simpleString()
    nothing = F.array().cast(f"array<struct<page:{page_type},y:double,text:string>>")
    start = F.struct(F.coalesce("known", F.lit("")).alias("known"), nothing.alias("kept"))
    found = docs.join(texts, "doc_id", "left").select("doc_id", F.explode(F.aggregate("pages", start, of_page, lambda state: state["kept"])).alias("x"))
    return found.select("doc_id", "x.*")
