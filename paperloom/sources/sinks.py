"""Exports: line lists, tables in several formats, and the swap that makes a rewritten table visible at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T

BOM = "﻿"


def export(df: DataFrame, path: str, kind: str) -> None:
    """csv (with mark of order, cells safe for spreadsheets), json (raw values), xml, txt, md; written in parallel."""
    shown = [T.spreadsheet_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    if kind == "csv":
        df.select(*shown).toDF(*[BOM * (k == 0) + c for k, c in enumerate(df.columns)]).write.option("header", "true").csv(path)
    elif kind == "json":
        df.write.option("ignoreNullFields", "false").json(path)
    elif kind == "xml":
        df.write.option("rowTag", "row").option("rootTag", "rows").xml(path)
    elif kind == "txt":
        df.select(padded_row(df.columns).alias("value")).write.text(path)
    elif kind == "md":
        df.select(markdown_row(df.columns).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown format {kind}")


def padded(value: Column, width: int) -> Column:
    """A cell filled with spaces to a width in terminal columns."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(v, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - T.display_width(v))))


def padded_row(columns: Sequence[str], width: int = 16) -> Column:
    return F.rtrim(F.concat_ws("  ", *[padded(F.col(c), width) for c in columns]))


def markdown_row(columns: Sequence[str]) -> Column:
    cells = [T.markdown_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def list_rows(lines: DataFrame) -> DataFrame:
    """A list for a spreadsheet: two columns at the first tab."""
    parts = F.split("line", "\t", 2)
    return lines.orderBy("doc_id", "pos").select("doc_id", T.spreadsheet_safe(F.get(parts, F.lit(0))).alias("a"), T.spreadsheet_safe(F.get(parts, F.lit(1))).alias("b"))


def swap_table(df: DataFrame, name: str, folder: str, stamp: str) -> None:
    """Write a new version beside the old and point the view at it: readers see one or the other, never half of one."""
    path = f"{folder.rstrip('/')}/{name}-{stamp}"
    df.write.parquet(path)
    df.sparkSession.read.parquet(path).createOrReplaceTempView(name)
