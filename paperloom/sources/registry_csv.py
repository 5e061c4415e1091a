"""Registry exports read in parallel: CSV files with quoted cells over several lines, in UTF-8 or Big5, by byte ranges.

Spark's text source deals the lines of a file to byte ranges. Whether a line begins inside a quoted cell depends on all
quotes before it, but only on whether their number is odd: each range counts its quotes and the records that would begin in
it under either answer, sums over the ranges before (a row a range) tell which one holds, and each line finds its record.
Lines that are records by themselves, nearly all, stay where they are; only records of several lines are gathered. The
quote is no second byte of a Big5 character, so counting needs no decoding; a file is UTF-8 if all its lines are.

Blank records are left out; the first other one of a file is its header. A quote that is never closed makes the rest of its
file one record, as for any CSV reader. Files without records give no rows. Archives aren't splittable: ``files`` reads them.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.session import cut

#: Ranges up to which their sums are broadcast to the lines; beyond it the join shuffles.
RANGES_BROADCAST = 200_000


LINE = "path string, range long, id long, raw binary, valid boolean, quotes long, odd_before boolean, even long, odd long"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files, with the number of their own quotes, whether those before them in their range are odd, and how
    many lines of the range up to this one had an even and an odd number before them."""
    text = spark.read.option("lineSep", "\n").text(path)
    numbered = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("raw"), F.is_valid_utf8("value").alias("valid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, odd_quotes, counts = None, False, [0, 0]
        for batch in batches:
            quotes, before, even, odd = [], [], [], []
            for path, start, line in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (path, start) != here:
                    here, odd_quotes, counts = (path, start), False, [0, 0]
                counts[odd_quotes] += 1
                before.append(odd_quotes)
                even.append(counts[0])
                odd.append(counts[1])
                quotes.append(line.count(b'"'))
                odd_quotes ^= bool(quotes[-1] % 2)
            columns = [pa.array(quotes, pa.int64()), pa.array(before, pa.bool_()), pa.array(even, pa.int64()), pa.array(odd, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "quotes", "odd_before", "even", "odd"])

    return numbered.mapInArrow(run, LINE)


def ranges(found: DataFrame) -> DataFrame:
    """(path, range, inside, before, utf8): does a range begin inside a quoted cell, and how many records begin before it?"""
    sums = found.groupBy("path", "range").agg((F.sum("quotes") % 2).alias("odd_quotes"), F.max("even").alias("even"), F.max("odd").alias("odd"), F.every("valid").alias("valid"))
    earlier = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    told = sums.withColumn("inside", F.coalesce(F.sum("odd_quotes").over(earlier), F.lit(0)) % 2 == 1)
    told = told.withColumn("begins", F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even")))
    return told.select("path", "range", "inside", F.coalesce(F.sum("begins").over(earlier), F.lit(0)).alias("before"), F.every("valid").over(Window.partitionBy("path")).alias("utf8"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, utf8, raw) of every record, quotes and line ends included; ``pos`` counts a file's records from 1."""
    found = lines(spark, path)
    told = cut(ranges(found).withColumnsRenamed({"path": "_path", "range": "_range"}))
    side = F.broadcast(told) if told.count() <= RANGES_BROADCAST else told
    placed = found.join(side, (F.col("path") == F.col("_path")) & (F.col("range") == F.col("_range")))
    begins = F.col("odd_before") == F.col("inside")
    placed = placed.withColumns({"alone": begins & (F.col("quotes") % 2 == 0), "pos": F.col("before") + F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even"))})
    parts = F.array_sort(F.collect_list(F.struct("range", "id", F.base64("raw").alias("raw"))))
    gathered = placed.filter("NOT alone").groupBy("path", "pos", "utf8").agg(parts.alias("parts"))
    end = F.lit("\n").cast("binary")
    joined = F.aggregate("parts", F.lit(None).cast("binary"), lambda all_, p: F.coalesce(F.concat(all_, end, F.unbase64(p["raw"])), F.unbase64(p["raw"])))
    return placed.filter("alone").select("path", "pos", "utf8", "raw").union(gathered.select("path", "pos", "utf8", joined.alias("raw")))


def cells_of(found: DataFrame) -> DataFrame:
    """(path, pos, cells) of the records that aren't blank: decoded, and split by the rules of quoted cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for utf8, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = raw.decode("utf-8") if utf8 else raw.decode("big5", "replace")
                text = text.removeprefix("\ufeff")
                rows.append(next(csv.reader(io.StringIO(text, newline="")), []) if '"' in text else text.rstrip("\r").split(",") if text.strip("\r") else [])
            keep = pa.array([bool(r) for r in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.string()))], names=["path", "pos", "cells"]).filter(keep)

    return found.mapInArrow(run, "path string, pos long, cells array<string>")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, header, cells): the records behind each file's header."""
    rows = cells_of(records(spark, path))
    heads = rows.groupBy("path").agg(F.min(F.struct("pos", "cells")).alias("head"))
    heads = cut(heads.select(F.col("path").alias("_path"), F.col("head.pos").alias("_first"), F.transform("head.cells", F.trim).alias("header")))
    # a row a file
    side = F.broadcast(heads) if heads.count() <= RANGES_BROADCAST else heads
    return rows.join(side, (F.col("path") == F.col("_path")) & (F.col("pos") > F.col("_first"))).select("path", "pos", "header", "cells")


def cell(name: str) -> Column:
    """The record's cell under the first header of that name; null where there is none."""
    return F.when(F.array_contains("header", name), F.get("cells", (F.array_position("header", name) - 1).cast("int")))


def named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """(path, pos, …): cells as columns, from the names of columns to headers."""
    return rows.select("path", "pos", *(cell(header).alias(column) for column, header in names.items()))
