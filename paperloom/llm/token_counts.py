"""Token counts of a SentencePiece vocabulary by a two-tier look-up on the map side.

In a vocabulary whose pieces never hold the space mark behind another character, merges can't cross such a border, so a
text's count is the sum over its pre-tokens (a run of spaces and the word behind it). Tier one is a compact broadcast table
of frequent pre-tokens and their lengths; tier two is each worker's cache, filled by the library itself. No pre-token
is shuffled: tasks hand on only their heavy pre-tokens, a bounded number each.

Null text counts as empty (0 bytes, 0 tokens). Repeated rows give repeated rows.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import BATCH_ROWS, map_texts, small_batches

MARK = "▁"
#: A task reports the pre-tokens that make up this share of its own at least, so 4,096 at most.
HEAVY_SHARE = 4096
#: Rows of the broadcast table at most, and characters of a pre-token in it: under 4 MB.
TABLE_ROWS = 32_768
TABLE_CHARS = 24
CACHE_ENTRIES = 300_000
COUNTS = "doc_id long, n_bytes long, n_tokens long"
RUNS = re.compile(r" *[^ ]+| +$")


class PretokenLengths(dict):
    """Pre-token -> number of tokens; misses are encoded by the library and kept until the cache is full."""

    def __init__(self, path: str, table: dict[str, int]) -> None:
        #: What a text ends in beyond its last word: one space mark, where the library would add none to an empty text.
        self.table = {**table, "": 1}
        super().__init__(self.table)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces that cross a space border can't be counted pre-token by pre-token")
        # the library adds one space mark before a text; a probe behind a fixed first character shows its own share
        if self.library.encode(" ") != self.library.encode(MARK):
            raise ValueError("the vocabulary's normalizer must keep spaces")

    def __missing__(self, pretoken: str) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
            self.update(self.table)
        self[pretoken] = n = len(self.library.encode(pretoken, num_threads=1))
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, pretokens(text)))


def pretokens(text: str) -> list[str]:
    """Pre-tokens without their first space mark, which the library puts before whatever it encodes.

    A mark character in the text is a space to the library. A text of n spaces, or one that ends in n, has n marks there.
    """
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in RUNS.findall(" " + text)]


@functools.lru_cache(maxsize=1)
def lengths(path: str, table: tuple) -> PretokenLengths:
    """The worker process's cache, for one vocabulary and broadcast table at a time."""
    return PretokenLengths(path, dict(table))


def heavy_pretokens(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(pretoken, n) over all rows: counts of the pre-tokens that are heavy in some task, summed."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = pretokens(text or "")
                total += len(found)
                seen.update(found)
            if len(seen) > 8 * HEAVY_SHARE:  # lossy counting: what is light so far is let go
                least = total // (4 * HEAVY_SHARE)
                seen = Counter({w: n for w, n in seen.items() if n > least})
        heavy = [(w, n) for w, n in seen.items() if n * HEAVY_SHARE >= total and len(w) <= TABLE_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in heavy], pa.string()), pa.array([n for _, n in heavy], pa.int64())], names=["pretoken", "n"])

    rows = df.select(df[text_col].cast("string").alias("text")).mapInArrow(run, "pretoken string, n long")
    return rows.groupBy("pretoken").agg(F.sum("n").alias("n"))


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_bytes (UTF-8), n_tokens."""
    top = heavy_pretokens(df, text_col).orderBy(F.desc("n"), "pretoken").limit(TABLE_ROWS).collect()
    library = PretokenLengths(vocabulary, {})
    table = df.sparkSession.sparkContext.broadcast(tuple((r.pretoken, library[r.pretoken]) for r in top))

    def make():
        known = lengths(vocabulary, table.value)

        def work(ids, texts):
            counts = [known.count(t.decode("utf-8", "replace")) if t else 0 for t in texts]
            columns = [pa.array(ids, pa.int64()), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])

        return work

    return map_texts(df, id_col, text_col, COUNTS, make)
