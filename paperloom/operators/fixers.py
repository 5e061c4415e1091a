"""Fixers of converted documents in a fixed order, each by itself: one that fails is left out and reported, the others go on.

Lines are (doc_id, page, pos, y, height, text); ``pos`` orders the lines of a document over all pages. A fixer takes lines
and gives lines, of which it may change texts and leave out rows. Each result is checkpointed before it counts, so that an
error of a fixer, in its plan or in its tasks, loses only that fixer's work. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import layout
from paperloom.session import cut

Fixer = Callable[[DataFrame], DataFrame]
COLUMNS = ("doc_id", "page", "pos", "y", "height", "text")


def private_signs(lines: DataFrame) -> DataFrame:
    """Without private and control characters; lines of noise become empty."""
    return lines.withColumn("text", T.clean(F.col("text")))


def cjk_spaces(lines: DataFrame) -> DataFrame:
    """Without the spaces that layouts put between CJK characters."""
    return lines.withColumn("text", T.joined_cjk(F.col("text")))


def repeated_edges(lines: DataFrame) -> DataFrame:
    """Without headers and footers: texts at the edges of at least two, and half, of a document's pages."""
    at_edge = layout.at_edge(F.col("y"), F.col("height"))
    found = layout.repeated_lines(lines.filter("text <> ''"), where=at_edge).select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    return lines.join(found, (F.col("doc_id") == F.col("_doc")) & (F.col("text") == F.col("_text")) & at_edge, "left_anti")


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Without lines equal to the one before, blank ones aside."""
    filled = layout.drop_repeats(lines.filter("text <> ''"), ["doc_id"], ["pos"], "text")
    return filled.unionByName(lines.filter("text = ''"))


def form_blanks(lines: DataFrame) -> DataFrame:
    """Without lines of underscores and other fillers only."""
    return lines.filter(~F.col("text").rlike(r"^[_.·…\s]+$"))


#: The order matters: texts are cleaned before they are compared, and edges go before neighbours are.
FIXERS: tuple[tuple[str, Fixer], ...] = (
    ("private_signs", private_signs),
    ("cjk_spaces", cjk_spaces),
    ("form_blanks", form_blanks),
    ("repeated_edges", repeated_edges),
    ("repeated_lines", repeated_lines),
)


def run(lines: DataFrame, fixers: Sequence[tuple[str, Fixer]] = FIXERS, skip: Sequence[str] = ()) -> tuple[DataFrame, list[tuple[str, int, int, str]]]:
    """The lines behind all fixers, and for each fixer (name, rows before, rows after, error); ``skip`` names those not to run."""
    now = cut(lines.select(*COLUMNS).withColumn("text", F.coalesce("text", F.lit(""))))
    count, report = now.count(), []
    for name, fixer in fixers:
        if name in skip:
            continue
        try:
            fixed = fixer(now)
            if sorted(fixed.columns) != sorted(COLUMNS):
                raise ValueError(f"{name} changed the columns")
            fixed = cut(fixed.select(*COLUMNS))
        except (PySparkException, ValueError) as error:
            report.append((name, count, count, str(error).splitlines()[0]))
            continue
        after = fixed.count()
        report.append((name, count, after, ""))
        now, count = fixed, after
    return now, report
