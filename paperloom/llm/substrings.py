"""Exact substring deduplication over words: remove every word of a passage of WINDOW words that also starts elsewhere.

The passages are the deep internal nodes of a suffix tree over all texts: a window that starts twice is a node at least
WINDOW words deep with two leaves. The tree is never built whole; its suffixes are split by prefixes of different lengths:

1. every window holds one anchor, the prefix of PREFIX words with the least hash (the leftmost, if equal ones meet). It
   depends on the window's words only, so equal windows have equal anchors. Neighbouring windows share theirs: they form a
   segment, which is dealt, counted and compared as one. An anchor found once in all texts leads to no inner node, and its
   suffixes are leaves: most of the text is done with after this count, which moves one number a segment;
2. segments of equal words are one segment with a count, whichever document they come from; a segment counted twice
   repeats with all of its windows;
3. the other segments of an anchor are a subtree, built by one task: suffixes are ranked by 1, 2, 4, … and finally WINDOW
   words, so that equal ranks are the leaves of one deep node. Tasks take as many subtrees at a time as fit a bound;
4. an anchor with more different segments than CROWD has its prefixes lengthened to the whole window: its suffixes fall
   into groups that are deep nodes themselves, and only their leaves are counted, with partial counts before the shuffle.

Texts that occur twice are removed whole by a count of text hashes (if they have WINDOW words), and only one copy of each
takes part in the rest, so that a group of copies is no hot key.

Words are maximal runs of other than ASCII white space, unchanged. Null and empty texts have none. Texts with fewer than
WINDOW words lose nothing. Repeated rows are copies; rows without doc_id are rows like others. Very long texts are cut into
overlapping pieces for hashing, which changes no window. Anchors and segments are told apart by 64-bit hashes together, 128
bits; windows of crowded anchors by 128 bits; texts by 128 bits. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import forget_since, materialise, small_batches, steps, trim
from paperloom.llm.jaccard import bounded, hot_keys, join_hot, mix, word_hashes

WINDOW, PREFIX = 35, 8
GRAMS = WINDOW - PREFIX + 1
#: Words that a task hashes together; places are kept in PLACE_BITS bits beside the hashes.
PIECE_WORDS, PLACE_BITS = 1 << 19, 22
#: Different segments of one anchor beyond which its suffixes are split by longer prefixes.
CROWD = 1000
#: Words of the subtrees that a task builds together.
TREE_WORDS = 400_000
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
PLACES = np.uint64((1 << PLACE_BITS) - 1)


class Spans:
    """Hashes of any span of a list of words, from running sums: a span's sum is scaled to its own start."""

    def __init__(self, words: list[bytes], base: int = BASES[0]) -> None:
        n = len(words)
        hashes = word_hashes(words) if n else np.zeros(0, np.uint64)
        up, down = (np.r_[np.uint64(1), np.full(n, b, np.uint64)].cumprod() for b in (base, pow(base, -1, 1 << 64)))
        self.down, self.sums = down, np.r_[np.uint64(0), (hashes * up[:n]).cumsum()]

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.down[first])


def segments(words: list[bytes], sizes: list[int]) -> tuple[np.ndarray, ...]:
    """(piece, first, shape, anchor, content) of the segments of some pieces of text, whose words stand in one list.

    ``first`` is where the segment's first window starts within all words; ``shape`` is 64 times the number of windows plus
    the place of the anchor behind ``first``.
    """
    size = np.array(sizes, np.int64)
    count = np.maximum(size - WINDOW + 1, 0)
    piece = np.repeat(np.arange(len(size)), count)
    if not len(piece):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    start = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + (np.cumsum(size) - size)[piece]
    with np.errstate(over="ignore"):
        spans = Spans(words)
        at = np.arange(len(words) - PREFIX + 1)
        grams = spans.of(at, at + PREFIX)
        low = grams & ~PLACES | at.astype(np.uint64)
        width = 1
        while 2 * width <= GRAMS:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - GRAMS + width], low[GRAMS - width :])
        anchor = (low[start] & PLACES).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        first, windows, anchor = start[cut], np.diff(np.r_[cut, len(start)]), anchor[cut]
        shape = windows * 64 + anchor - first
        content = mix(spans.of(first, first + windows + WINDOW - 1) ^ mix(shape.astype(np.uint64)))
    return piece[cut], first, shape, grams[anchor].view(np.int64), content.view(np.int64)


def pieces(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[int], list[int], list[int]]]:
    """(words, sizes, text number of each piece, place of each piece in its text), of about PIECE_WORDS words at a time."""
    words: list[bytes] = []
    sizes, owners, places = [], [], []
    for k, text in enumerate(texts):
        own = text.split()
        for at in range(0, max(1, len(own) - WINDOW + 1), PIECE_WORDS):
            part = own if len(own) <= PIECE_WORDS else own[at : at + PIECE_WORDS + WINDOW - 1]
            if len(part) < WINDOW:
                continue
            words += part
            sizes.append(len(part))
            owners.append(k)
            places.append(at)
            if len(words) >= PIECE_WORDS:
                yield words, sizes, owners, places
                words, sizes, owners, places = [], [], [], []
    if words:
        yield words, sizes, owners, places


def all_segments(units: DataFrame) -> DataFrame:
    """(doc_id, mark, anchor, content, first, shape) of every segment of the units (doc_id, mark, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, sizes, owners, places in pieces(batch.column(2).cast(pa.binary()).to_pylist()):
                piece, first, shape, anchor, content = segments(words, sizes)
                size = np.array(sizes, np.int64)
                first = first - (np.cumsum(size) - size)[piece] + np.array(places, np.int64)[piece]
                row = pa.array(np.array(owners)[piece])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(anchor), pa.array(content), pa.array(first), pa.array(shape.astype(np.int32))], names=["doc_id", "mark", "anchor", "content", "first", "shape"])
        trim()

    return units.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark long, anchor long, content long, first long, shape int")


# ---- words of the segments that have to be compared


def segment_words(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, content, n, words) of the wanted segments (doc_id, mark, first, shape, anchor, content, n, crowded); those of
    crowded anchors as a row (anchor, content, n, place, high, low) for each window instead."""
    lists = wanted.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "shape", "anchor", "content", "n", "crowded")).alias("parts"))
    lists = lists.withColumnsRenamed({"doc_id": "of", "mark": "of_mark"})
    found = units.join(lists, (units.mark == F.col("of_mark")) & units.doc_id.eqNullSafe(F.col("of"))).select("text", "parts")
    kinds = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("place", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, parts in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1)):
                words = text.split()
                first, shape, anchor, content, n, crowded = (parts.values.field(k).to_numpy(zero_copy_only=False) for k in range(6))
                end = first + (shape >> 6) + WINDOW - 1
                few = np.flatnonzero(~crowded)
                if len(few):
                    own = [b" ".join(words[a:b]) for a, b in zip(first[few].tolist(), end[few].tolist())]
                    none = [pa.nulls(len(few), t) for t in (pa.int32(), pa.int64(), pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[few]), pa.array(content[few]), pa.array(n[few]), pa.array(own, pa.binary()), *none], schema=kinds)
                many = np.flatnonzero(crowded)
                if len(many):
                    row = np.repeat(many, shape[many] >> 6)
                    place = np.arange(len(row)) - np.repeat(np.cumsum(shape[many] >> 6) - (shape[many] >> 6), shape[many] >> 6)
                    start = first[row] + place
                    with np.errstate(over="ignore"):
                        high, low = (Spans(words, b).of(start, start + WINDOW).view(np.int64) for b in BASES)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[row]), pa.array(content[row]), pa.array(n[row]), pa.nulls(len(row), pa.binary()), pa.array(place.astype(np.int32)), pa.array(high), pa.array(low)], schema=kinds)
        trim()

    return found.mapInArrow(run, "anchor long, content long, n long, words binary, place int, high long, low long")


# ---- subtrees


def ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix by its first ``depth`` tokens, where there are so many: equal ranks, equal tokens."""
    rank, width = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while width < depth:
        step = min(width, depth - width)
        rank = np.unique(rank[:-step] << 32 | rank[step:], return_inverse=True)[1]
        width += step
    return rank


def deep_nodes(words: list[list[bytes]], counts: list[int]) -> np.ndarray:
    """A bit mask for each segment: bit k is set if its window k is a leaf of a node with two leaves at least."""
    names: dict[bytes, int] = {}
    tokens = np.fromiter((names.setdefault(w, len(names)) for own in words for w in own), np.int64)
    size = np.array([len(own) for own in words])
    windows = size - WINDOW + 1
    owner = np.repeat(np.arange(len(size)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    leaf = ranks(tokens, WINDOW)[(np.cumsum(size) - size)[owner] + place]
    twice = np.bincount(leaf, weights=np.array(counts, np.float64)[owner])[leaf] >= 2
    return np.bitwise_or.reduceat(np.where(twice, np.int64(1) << place, 0), np.cumsum(windows) - windows)


def subtree_masks(found: DataFrame) -> DataFrame:
    """(anchor, content, mask): which windows of each segment repeat; a task builds the subtrees of its anchors in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, size = None, 0
        held: tuple[list, ...] = ([], [], [], [])

        def flush() -> pa.RecordBatch:
            mask = deep_nodes(held[3], held[2])
            out = pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array(mask)], names=["anchor", "content", "mask"])
            for own in held:
                own.clear()
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last and size >= TREE_WORDS:
                    yield flush()
                    size = 0
                last = row[0]
                for own, value in zip(held, (*row[:3], row[3].split(b" "))):
                    own.append(value)
                size += len(held[3][-1])
        if held[0]:
            yield flush()
        trim()

    return found.select("anchor", "content", "n", "words").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, content long, mask long")


def window_masks(found: DataFrame) -> DataFrame:
    """The same for crowded anchors, whose windows are groups of their own."""
    twins = materialise(found.groupBy("high", "low").agg(F.sum("n").alias("n")).filter("n > 1").select("high", "low"), "twins")
    return found.join(bounded(twins), ["high", "low"], "left_semi").groupBy("anchor", "content").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))


# ---- the whole


def tag_copies(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, text, copied), and the units (doc_id, mark, text): each text once."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.xxhash64(F.lit(1), text).alias("check"), text.alias("text"))
    each = plain.groupBy("mark", "check", "doc_id").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rows")).alias("first")
    copies = each.groupBy("mark", "check").agg(F.sum("rows").alias("n"), first).filter("n > 1")
    copies = materialise(copies.select(F.col("mark").alias("of"), F.col("check").alias("of_check"), F.col("first.doc_id").alias("keeper"), F.col("first.rows").alias("keepers")), "copies")
    tagged = plain.join(bounded(copies), (F.col("mark") == F.col("of")) & (F.col("check") == F.col("of_check")), "left")
    tagged = tagged.select("doc_id", "mark", "text", F.col("of").isNotNull().alias("copied"), "keeper", "keepers")
    units = tagged.filter("NOT copied OR (doc_id <=> keeper AND keepers = 1)").select("doc_id", "mark", "text")
    if not copies.filter("keepers > 1").isEmpty():  # rows that repeat whole: one of them
        units = units.union(tagged.filter("copied AND doc_id <=> keeper AND keepers > 1").select("doc_id", "mark", "text").dropDuplicates(["doc_id", "mark"]))
    return tagged.select("doc_id", "mark", "text", "copied"), units


def repeated_windows(units: DataFrame) -> DataFrame:
    """(doc_id, mark, spans), written: for each unit the segments (first, mask) that hold repeated windows, by bit masks."""
    began = steps()
    rows = materialise(all_segments(units), "segments")
    anchors = materialise(rows.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "anchors")
    if anchors.count() <= 1_000_000:
        some = rows.join(bounded(anchors.select("anchor")), "anchor", "left_semi")
    else:
        some = join_hot(rows, anchors.select("anchor"), "anchor", "mark", hot_keys(anchors.select(F.lit("anchor").alias("end"), F.col("anchor").alias("key"), "n")))
    some = materialise(some.select("doc_id", "mark", "anchor", "content", "first", "shape"), "inner")

    # a segment repeats whole if it is counted twice; if it's the only one of its anchor, there is nothing to compare it with
    kinds = materialise(some.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "first", "shape")).alias("one")), "kinds")
    crowds = materialise(kinds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", (F.col("n") > CROWD).alias("crowded")), "crowds")
    wanted = kinds.join(bounded(crowds), "anchor").select("one.*", "anchor", "content", "n", "crowded")
    found = materialise(segment_words(units, wanted), "words")
    masks = subtree_masks(found.filter("words IS NOT NULL"))
    windows = found.filter("words IS NULL")
    if not windows.isEmpty():
        masks = masks.union(window_masks(windows))
    whole = kinds.filter("n > 1").select("anchor", "content", F.expr("shiftleft(1L, shiftright(one.shape, 6)) - 1").alias("mask"))
    lone = kinds.filter("n = 1").select("anchor", "content")
    masks = materialise(whole.union(masks.filter("mask <> 0").join(lone, ["anchor", "content"], "left_semi")), "masks")

    held = some.join(bounded(masks), ["anchor", "content"])
    spans = held.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "mask")).alias("spans"))
    out = materialise(spans, "spans")
    forget_since(began, out)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; ``kept``: the words that stay, joined by one space."""
    small_batches(docs.sparkSession)
    tagged, units = tag_copies(docs, id_col, text_col)
    spans = repeated_windows(units).withColumnsRenamed({"doc_id": "of", "mark": "of_mark"})
    single = tagged.filter("NOT copied")
    single = single.join(spans, (single.mark == F.col("of_mark")) & single.doc_id.eqNullSafe(F.col("of")), "left").select("doc_id", "text", "copied", "spans")
    both = single.union(tagged.filter("copied").select("doc_id", "text", "copied", F.lit(None).cast(single.schema["spans"].dataType).alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, copied, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                words = text.split()
                n_words.append(len(words))
                if copied and len(words) >= WINDOW:
                    words = []
                elif spans.is_valid and len(spans):
                    first, mask = (spans.values.field(k).to_numpy() for k in range(2))
                    row, place = np.nonzero(mask[:, None] >> np.arange(GRAMS) & 1)
                    start = first[row] + place
                    change = np.bincount(start, minlength=len(words) + 1) - np.bincount(start + WINDOW, minlength=len(words) + 1)
                    words = [words[k] for k in np.flatnonzero(change[: len(words)].cumsum() == 0).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
        trim()

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def digest(removed: DataFrame) -> DataFrame:
    """The rows with a digest in place of the text."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
