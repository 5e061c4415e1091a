"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once.

Normal form: UTF-8 bytes, A-Z lower-cased, every other ASCII byte that is no letter or digit is a separator, so words are
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. The patterns are an item's windows of ten consecutive words (the whole item, if it
has fewer); a text's word inside any occurrence of a window is hit, and hits are mapped to offsets of the original.

Null or empty texts have no words; items without words have no window. Items with equal windows are all reported; an item
without item_id hits words but isn't named. Repeated rows give repeated rows, repeated items count once.

Items are broadcast in blocks of bounded size, as texts; a test set of up to BLOCK_BYTES is one automaton, built once for a
worker. Beyond that a worker holds back documents of HOLD_BYTES and passes them through one block after the other, so that
one automaton is in memory at a time, besides the items' texts; each block is built once for the documents held back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import keep, settle, small_batches

WINDOW_WORDS = 10
#: Bytes of item text in one automaton; its memory is about 60 times that for each worker.
BLOCK_BYTES = 2 << 20
#: Bytes of document text that a worker holds back where there are more blocks than one.
HOLD_BYTES = 64 << 20

NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")

Patterns = tuple[tuple[str, tuple[str, ...]], ...]


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows_of(items: list[tuple[str | None, bytes]], size: int = WINDOW_WORDS) -> Patterns:
    """(window with borders, names of the items that hold it); bytes are written as Latin-1 characters."""
    found: dict[str, set[str]] = {}
    for name, text in items:
        words = normal_words(text)
        for k in range(max(1, len(words) - size + 1) if words else 0):
            window = (b" " + b" ".join(words[k : k + size]) + b" ").decode("latin-1")
            found.setdefault(window, set()).update([] if name is None else [name])
    return tuple((w, tuple(sorted(names))) for w, names in found.items())


#: The automaton that a worker built last, by its key: it stays for the next task, and gives way to another block's.
_resident: dict[str, ahocorasick.Automaton] = {}


def automaton(key: str, items: list[tuple[str | None, bytes]]) -> ahocorasick.Automaton:
    if key not in _resident:
        _resident.clear()
        found = ahocorasick.Automaton()
        for window, names in windows_of(items):
            found.add_word(window, (window.count(" ") - 1, len(window), names))
        found.make_automaton()
        _resident[key] = found
        keep("decontaminate", _resident.clear)
    return _resident[key]


class Scan:
    """Word spans [first, end) that a text's windows cover, and the items they belong to."""

    def __init__(self, key: str, items: list[tuple[str | None, bytes]]) -> None:
        found = automaton(key, items)
        self.automaton = found if len(found) else None

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        if not self.automaton or not words:
            return [], set()
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
        spans, items, at, word = [], set(), 0, 0
        for end, (n, size, names) in self.automaton.iter(joined):
            start = end - size + 1
            if start > at:
                word += joined.count(" ", at, start)
            elif start < at:
                word -= joined.count(" ", start, at)
            at = start
            spans.append((word, word + n))
            items.update(names)
        return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def original_offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets (end exclusive) in the original text of word spans."""
    if not spans:
        return []
    places = [m.span() for m in WORD.finditer(text.translate(NORMAL))]
    out, at, chars = [], 0, 0
    for first, end in spans:
        ends = []
        for byte in (places[first][0], places[end - 1][1]):
            chars += len(text[at:byte].decode("utf-8", "replace"))
            at = byte
            ends.append(chars)
        out.append((ends[0], ends[1]))
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[tuple[str, Broadcast]]:
    """(key, items) in blocks of bounded size, broadcast; the driver holds one block of item texts at a time."""
    rows = items.select(F.col(id_col).cast("string").alias("name"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("text")).distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("name", "text"), F.lit(n))
    out = []
    for k in range(n):
        held = sorted(((r.name, bytes(r.text)) for r in rows.filter(block == k).toLocalIterator()), key=repr)
        out.append((hashlib.sha256(repr(held).encode()).hexdigest(), items.sparkSession.sparkContext.broadcast(held)))
    return out


Found = tuple[list[tuple[int, int]], set[str]]


def scanned(batches: Iterator[pa.RecordBatch], at: int, blocks: list[tuple[str, Broadcast]]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None], list[int], list[Found]]]:
    """(batch, texts, number of words, hits) of every batch, whose texts stand in column ``at``; one automaton at a time."""

    def through(held: list[tuple[pa.RecordBatch, list[bytes | None]]]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None], list[int], list[Found]]]:
        words = [[normal_words(t or b"") for t in texts] for _, texts in held]
        found: list[list[Found]] = [[([], set()) for _ in texts] for _, texts in held]
        for key, items in blocks:
            one = Scan(key, items.value)
            for of, out in zip(words, found):
                for k, w in enumerate(of):
                    spans, names = one.hits(w)
                    if spans:
                        out[k] = (merge(out[k][0] + spans), out[k][1] | names)
        for (batch, texts), of, out in zip(held, words, found):
            yield batch, texts, [len(w) for w in of], out

    held, size = [], 0
    for batch in batches:
        texts = batch.column(at).cast(pa.binary()).to_pylist()
        held.append((batch, texts))
        size += sum(len(t or b"") for t in texts)
        if len(blocks) == 1 or size >= HOLD_BYTES:
            yield from through(held)
            held, size = [], 0
    if held:
        yield from through(held)


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, items (sorted as strings), spans (original code points)."""
    small_batches(docs.sparkSession)
    blocks = item_blocks(items, item_id_col, item_text_col, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("decontaminate")
        for batch, texts, n_words, found in scanned(batches, 1, blocks):
            rows = []
            for doc_id, text, n, (spans, names) in zip(batch.column(0).to_pylist(), texts, n_words, found):
                places = [{"start": a, "end": b} for a, b in original_offsets(text or b"", spans)]
                rows.append((doc_id, n, sum(b - a for a, b in spans), sorted(names), places))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
NAMES = ["doc_id", "n_words", "n_hit", "items", "spans"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def digest(scanned: DataFrame) -> DataFrame:
    """The figures of a scan without texts or spans."""
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, in which no window occurs."""
    small_batches(docs.sparkSession)
    blocks = item_blocks(items, item_id_col, item_text_col, block_bytes)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("decontaminate")
        for batch, _, _, found in scanned(batches, at, blocks):
            yield batch.filter(pa.array([not spans for spans, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
