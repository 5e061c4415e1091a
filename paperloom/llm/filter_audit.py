"""Audit of how filters interact: what does each filter remove, alone, in each order, and on average over all orders?

Duplicates are found by sorting, without gathering a group: rows are dealt by ranges of (text fingerprint, doc_id) and
sorted in each range by fingerprint, full text and doc_id, so that a text which makes up a third of the table spans many
ranges. Each row is held against its predecessors in the range. What a range can't know is whether its first text has a
smaller doc_id in a range before; the first and last text of each range with their least doc_ids, two rows a range, settle
it. Each row becomes a bit mask of the filters it fails; masks are counted by part, and all figures of all orders follow
from these counts, since counts of (part, mask) add up.

Null texts are empty texts. A text is a duplicate if an equal text has a smaller doc_id: rows without doc_id neither are
duplicates nor make others so, and repeated rows of one doc_id don't make each other so. A doc_id with several label rows
counts as good (toxic) if any of them says so; one without labels is neither. A null part is the empty string. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialise, small_batches, trim

FILTERS = "ABCDE"
MIN_WORDS = 50
#: Per cent of distinct words that a text has at least, and of capitals that it has at most.
DISTINCT_WORDS, CAPITALS = 65, 5
SIGNS = re.compile(rb"[#$%&*|]")
DUPLICATE = 16
#: Label rows up to which they are broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000


def text_mask(text: bytes) -> int:
    """The failed filters of one text, all but the duplicates': a bit each, in the order of FILTERS."""
    words = text.split()
    codes = np.frombuffer(text, np.uint8)
    points = np.count_nonzero((codes & 0xC0) != 0x80)
    capitals = np.count_nonzero((codes >= 65) & (codes <= 90))
    few, same, loud = len(words) < MIN_WORDS, 100 * len(set(words)) < DISTINCT_WORDS * len(words), 100 * capitals > CAPITALS * points
    return few | same << 1 | loud << 2 | (SIGNS.search(text) is not None) << 3


COLUMNS = "range int, doc_id long, part string, mask int, pending boolean, edge binary, least long, first boolean"


def judge_ranges(docs: DataFrame) -> DataFrame:
    """From (doc_id, part, text): a row (range, doc_id, part, mask, pending) for each row, and two rows (range, edge, least,
    first) for each range. ``pending``: a duplicate if, and only if, a range before holds the text with a smaller doc_id.
    """
    keyed = docs.select(F.unhex(F.sha2("text", 256)).alias("print"), "text", "doc_id", "part")
    dealt = keyed.repartitionByRange("print", "doc_id").sortWithinPartitions("print", "text", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        print_, text, mask, least, first = None, None, 0, None, True

        def edge() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"range": here, "edge": print_, "least": least, "first": first}], KINDS)

        for batch in batches:
            masks, pending = [], []
            for own_print, own_text, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                if own_print != print_ or own_text != text:
                    if print_ is not None and first:
                        yield edge()
                    first = print_ is None
                    print_, text, mask, least = own_print, own_text, text_mask(own_text), None
                if least is None:
                    least = doc_id
                later = doc_id is not None and doc_id > least
                masks.append(mask | DUPLICATE * later)
                pending.append(first and doc_id is not None and not later)
            n = len(masks)
            yield pa.RecordBatch.from_arrays(
                [pa.array([here] * n, pa.int32()), batch.column(2), batch.column(3).cast(pa.string()), pa.array(masks, pa.int32()), pa.array(pending, pa.bool_()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())],
                schema=KINDS,
            )
        if print_ is not None:
            yield edge()
        trim()

    return dealt.mapInArrow(run, COLUMNS)


KINDS = pa.schema([("range", pa.int32()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("pending", pa.bool_()), ("edge", pa.binary()), ("least", pa.int64()), ("first", pa.bool_())])


def failure_masks(docs: DataFrame, part_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, mask) of every row."""
    small_batches(docs.sparkSession)
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    judged = materialise(judge_ranges(plain), "ranges")
    edges = judged.filter("edge IS NOT NULL")
    before = edges.groupBy("edge").agg(F.min("least").alias("before"))
    late = edges.filter("first").join(before, "edge").filter("before < least").select("range", F.lit(True).alias("late"))
    # a row a range at most: their number is that of the tasks
    rows = judged.filter("edge IS NULL").join(F.broadcast(late), "range", "left")
    return rows.select("doc_id", "part", F.when(F.col("pending") & F.col("late"), F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the additive counters, at most 32 of each part."""
    known = labels.groupBy(labels["doc_id"].cast("long").alias("of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = materialise(known.filter("of IS NOT NULL AND (good OR toxic)"), "labels")
    side = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    joined = masks.join(side, F.col("doc_id") == F.col("of"), "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)


def interactions(counts: DataFrame) -> DataFrame:
    """All figures of every part, order and step, from the counters of (part, mask)."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    own = bit(F.expr("substr(filter_order, step, 1)"))
    before = sum((F.when(F.col("step") > k, bit(F.substring("filter_order", k, 1))).otherwise(0) for k in range(1, len(FILTERS))), F.lit(0))
    steps = steps.withColumns({"fails": F.col("mask").bitwiseAND(own) != 0, "gone": F.col("mask").bitwiseAND(before) != 0, "only": F.col("mask") == own, "failed": F.bit_count("mask")})
    removed = F.col("fails") & ~F.col("gone")

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")

    return steps.groupBy("part", "filter_order", "step").agg(
        total(~F.col("fails") & ~F.col("gone")).alias("kept"),
        total(removed).alias("removed"),
        total(F.col("fails") & F.col("gone")).alias("redundant"),
        total(F.col("only")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        # of the 120 orders, each filter that a row fails is the first of these in 120 / their number
        F.sum(F.when(F.col("fails"), F.expr("n * 120 div failed")).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return interactions(materialise(mask_counts(failure_masks(docs, part_col, id_col, text_col), labels), "counters"))
