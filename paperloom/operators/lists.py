"""The ordered line-list algebra on (doc_id, pos, line): position is data, every operator keeps it explicit.

Lists of different documents are independent, so every window is partitioned by document, and windows in a row share one
shuffle; a dedup combines partial results before its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

Op = dict[str, object]
PATTERN_CHARS = 1000


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line; null and empty texts have none."""
    return docs.select(docs[id_col].alias("doc_id"), F.posexplode(T.lines(docs[text_col])).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def _ranked(df: DataFrame, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).cast("long") - 1


def trim(df: DataFrame) -> DataFrame:
    return df.withColumn("line", T.strip(F.col("line")))


def drop_empty(df: DataFrame) -> DataFrame:
    return df.filter(~T.blank(F.col("line")))


def dedup(df: DataFrame, keep: str = "first", case_insensitive: bool = False) -> DataFrame:
    """keep first, last, or count (``n<TAB>line`` in order of first occurrence)."""
    key = F.lower("line") if case_insensitive else F.col("line")
    grouped = df.groupBy("doc_id", key.alias("key"))
    if keep == "count":
        out = grouped.agg(F.min_by("line", "pos").alias("line"), F.count("*").alias("n"), F.min("pos").alias("pos"))
        return out.select("doc_id", "pos", F.concat_ws("\t", F.col("n").cast("string"), "line").alias("line"))
    pick, at = (F.max_by, F.max) if keep == "last" else (F.min_by, F.min)
    return grouped.agg(at("pos").alias("pos"), pick("line", "pos").alias("line")).select("doc_id", "pos", "line")


def sort(df: DataFrame, descending: bool = False, case_insensitive: bool = False, natural: bool = False) -> DataFrame:
    """By code point, without case, or by digit value; stable both ways."""
    key = T.natural_key(F.col("line")) if natural else F.lower("line") if case_insensitive else F.col("line")
    return df.withColumn("pos", _ranked(df, key.desc() if descending else key.asc(), F.col("pos").asc()))


def reverse(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", _ranked(df, F.col("pos").desc()))


def shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    """The same order for the same seed, whatever the partitioning."""
    return df.withColumn("pos", _ranked(df, F.xxhash64("line", "pos", F.lit(seed)), F.col("pos")))


def case(df: DataFrame, mode: str = "lower") -> DataFrame:
    modes = {"lower": F.lower, "upper": F.upper, "title": T.title_case}
    return df.withColumn("line", modes[mode](F.col("line"))) if mode in modes else df


def filter_lines(df: DataFrame, pattern: str = "", exclude: bool = False, regex: bool = False, case_insensitive: bool = False) -> DataFrame:
    return df.filter(_kept(F.col("line"), pattern, exclude, regex, case_insensitive)) if pattern else df


def _kept(line: Column, pattern: str, exclude: bool, regex: bool, case_insensitive: bool) -> Column:
    if len(pattern) > PATTERN_CHARS:
        raise ValueError(f"a pattern has at most {PATTERN_CHARS} characters")
    if regex:
        try:
            re.compile(pattern)
        except re.error as error:
            raise ValueError(f"bad pattern: {error}") from error
        hit = line.rlike(("(?i)" if case_insensitive else "") + pattern)
    elif case_insensitive:
        hit = F.lower(line).contains(pattern.lower())
    else:
        hit = line.contains(pattern)
    return ~hit if exclude else hit


def head(df: DataFrame, n: int = 10) -> DataFrame:
    if n < 0:
        raise ValueError("n must not be negative")
    return df.withColumn("_k", _ranked(df, F.col("pos").asc())).filter(F.col("_k") < n).drop("_k")


def tail(df: DataFrame, n: int = 10) -> DataFrame:
    if n < 0:
        raise ValueError("n must not be negative")
    return df.withColumn("_k", _ranked(df, F.col("pos").desc())).filter(F.col("_k") < n).drop("_k")


def wrap(df: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    return df.withColumn("line", F.concat(F.lit(prefix), "line", F.lit(suffix))) if prefix or suffix else df


OPS: dict[str, Callable[..., DataFrame]] = {
    "trim": trim,
    "drop_empty": drop_empty,
    "dedup": dedup,
    "sort": sort,
    "reverse": reverse,
    "shuffle": shuffle,
    "case": case,
    "filter": filter_lines,
    "head": head,
    "tail": tail,
    "wrap": wrap,
}


def register(name: str, op: Callable[..., DataFrame]) -> None:
    """Add an operator to the algebra."""
    OPS[name] = op


def simplify(ops: Sequence[Op]) -> list[Op]:
    """Leave out what does nothing: unknown operators, empty filters and wraps, a trim or reverse undone by the next."""
    out: list[Op] = []
    for op in ops:
        if not isinstance(op, dict) or op.get("op") not in OPS:
            continue
        name = op["op"]
        if name == "filter" and not op.get("pattern") or name == "wrap" and not (op.get("prefix") or op.get("suffix")):
            continue
        if out and name in ("trim", "drop_empty") and out[-1] == op:
            continue
        if out and name == "reverse" and out[-1]["op"] == "reverse":
            out.pop()
            continue
        out.append(op)
    return out


def pipeline(df: DataFrame, ops: Sequence[Op]) -> tuple[DataFrame, list[str]]:
    """The list after all operators, and the names of those known, in order."""
    applied = [str(o["op"]) for o in ops if isinstance(o, dict) and o.get("op") in OPS]
    for op in simplify(ops):
        df = OPS[str(op["op"])](df, **{k: v for k, v in op.items() if k != "op"})
    return df, applied


# ---- lists as arrays: a document's lines stay in its row, so nothing is shuffled


def _array_sort(lines: Column, descending: bool = False, case_insensitive: bool = False, natural: bool = False) -> Column:
    key = T.natural_key if natural else F.lower if case_insensitive else lambda x: x
    rows = F.transform(lines, lambda x, k: F.struct(key(x).alias("key"), (-k if descending else k).alias("k"), x.alias("line")))
    return F.transform(F.sort_array(rows, asc=not descending), lambda r: r["line"])


def _array_case(lines: Column, mode: str = "lower") -> Column:
    modes = {"lower": F.lower, "upper": F.upper, "title": T.title_case}
    return F.transform(lines, modes[mode]) if mode in modes else lines


def _array_end(lines: Column, n: int, last: bool) -> Column:
    if n < 0:
        raise ValueError("n must not be negative")
    return F.slice(lines, F.greatest(F.size(lines) - n, F.lit(0)) + 1 if last else F.lit(1), F.lit(n))


#: The operators that work on one document's array; a counting dedup and one without case need groups of rows.
ARRAY_OPS: dict[str, Callable[..., Column]] = {
    "trim": lambda lines: F.transform(lines, T.strip),
    "drop_empty": lambda lines: F.filter(lines, lambda x: ~T.blank(x)),
    "dedup": lambda lines, keep="first", case_insensitive=False: F.reverse(F.array_distinct(F.reverse(lines))) if keep == "last" else F.array_distinct(lines),
    "sort": _array_sort,
    "reverse": F.reverse,
    "case": _array_case,
    "filter": lambda lines, pattern="", exclude=False, regex=False, case_insensitive=False: F.filter(lines, lambda x: _kept(x, pattern, exclude, regex, case_insensitive)),
    "head": lambda lines, n=10: _array_end(lines, n, False),
    "tail": lambda lines, n=10: _array_end(lines, n, True),
    "wrap": lambda lines, prefix="", suffix="": F.transform(lines, lambda x: F.concat(F.lit(prefix), x, F.lit(suffix))),
}


def on_array(op: Op) -> bool:
    return op["op"] in ARRAY_OPS and not (op["op"] == "dedup" and (op.get("keep") == "count" or op.get("case_insensitive")))


def of_documents(docs: DataFrame, ops: Sequence[Op], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, line): what the operators make of each document's lines, numbered from 0.

    Where all operators work on arrays, each row of ``docs`` is a list of its own and no row leaves its task; else lines
    become rows, lists go by doc_id and are shuffled. Null and empty texts have no lines.
    """
    ops = simplify(ops)
    if not all(map(on_array, ops)):
        out = pipeline(explode_lines(docs, id_col, text_col), ops)[0]
        return out.withColumn("pos", _ranked(out, F.col("pos").asc()))
    lines = T.lines(docs[text_col])
    for op in ops:
        lines = ARRAY_OPS[str(op["op"])](lines, **{k: v for k, v in op.items() if k != "op"})
    return docs.select(docs[id_col].alias("doc_id"), F.posexplode(lines).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def envelope(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, original_count, count, dropped) of every document that had a line."""
    old = before.groupBy("doc_id").agg(F.count("*").alias("original_count"))
    new = after.groupBy("doc_id").agg(F.count("*").alias("count"))
    joined = old.join(new, "doc_id", "left").fillna(0, ["count"])
    return joined.withColumn("dropped", F.col("original_count") - F.col("count"))
