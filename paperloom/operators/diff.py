"""Line and character differences of two texts, side by side in one row each: no shuffle is needed to align them."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import bounded_batches

ROWS = "array<struct<row:int,a:string,a_tag:string,b:string,b_tag:string>>"
_ROW_TYPE = pa.list_(pa.struct([("row", pa.int32()), ("a", pa.string()), ("a_tag", pa.string()), ("b", pa.string()), ("b_tag", pa.string())]))


def align(a: str, b: str) -> tuple[list[tuple], dict[str, int]]:
    """Aligned rows and counters: blocks replaced line by line, the longer side's rest added or removed."""
    left, right = a.splitlines(), b.splitlines()
    rows: list[tuple] = []
    n = dict.fromkeys(("added", "removed", "changed", "chars_added", "chars_removed"), 0)
    for tag, i, i2, j, j2 in difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if tag == "equal":
            rows += [(x, "equal", y, "equal") for x, y in zip(left[i:i2], right[j:j2])]
            continue
        both = min(i2 - i, j2 - j)
        for x, y in zip(left[i : i + both], right[j : j + both]):
            rows.append((x, "replace", y, "replace"))
            n["changed"] += 1
            for kind, p, p2, q, q2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                if kind != "equal":
                    n["chars_removed"] += p2 - p
                    n["chars_added"] += q2 - q
        for x in left[i + both : i2]:
            rows.append((x, "delete", "", "blank"))
            n["removed"] += 1
            n["chars_removed"] += len(x)
        for y in right[j + both : j2]:
            rows.append(("", "blank", y, "insert"))
            n["added"] += 1
            n["chars_added"] += len(y)
    return rows, n


def line_diff(pairs: DataFrame, id_col: str = "pair_id", a_col: str = "text_a", b_col: str = "text_b") -> DataFrame:
    """(id, added, removed, changed, chars_added, chars_removed, rows) of each pair; null texts count as empty."""
    bounded_batches(pairs.sparkSession)
    source = pairs.select(pairs[id_col].alias(id_col), pairs[a_col].cast("string").alias("a"), pairs[b_col].cast("string").alias("b"))
    counters = ("added", "removed", "changed", "chars_added", "chars_removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [align(a or "", b or "") for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rows = [[dict(zip(("row", "a", "a_tag", "b", "b_tag"), (k, *r))) for k, r in enumerate(x)] for x, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([n[c] for _, n in found], pa.int32()) for c in counters), pa.array(rows, _ROW_TYPE)], names=[id_col, *counters, "rows"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{c} int" for c in counters) + f", rows {ROWS}")


def key_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b) where the values of two key-value tables differ, a missing key counting as empty."""
    x, y = a.select(F.col(key).alias("key"), F.col(value).alias("a")), b.select(F.col(key).alias("key"), F.col(value).alias("b"))
    joined = x.join(y, "key", "full_outer").select("key", F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"))
    return joined.filter("a <> b")
