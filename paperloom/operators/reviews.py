"""Reports on marks in documents, and texts beside their translations: one line or block for each row, in a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T

#: What stands for a missing author, and for a mark without content.
UNSIGNED, NO_CONTENT = "(未署名)", "(無內容)"


def _or(value: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), other)


def page_name(page: Column) -> Column:
    return F.concat(F.lit("第 "), page.cast("string"), F.lit(" 頁"))


def group_name(by: str) -> Column:
    """Heading under which a mark (page, kind, author) stands: its author, its kind, or else its page."""
    if by == "author":
        return _or(F.col("author"), F.lit(UNSIGNED))
    return F.col("kind") if by == "kind" else page_name(F.col("page"))


def review_entry() -> Column:
    """A mark's entry in a review: page, kind and author, then its content as a quotation, line by line."""
    head = F.concat(F.lit("- **"), page_name(F.col("page")), F.lit("** · "), F.col("kind"), F.lit(" · "), _or(F.col("author"), F.lit(UNSIGNED)))
    quoted = F.transform(T.lines(_or(F.col("content"), F.lit(NO_CONTENT))), lambda x: F.concat(F.lit("  > "), x))
    return F.array_join(F.concat(F.array(head), quoted), "\n")


def review(marks: DataFrame, by: str = "page", order: str = "place") -> DataFrame:
    """(group, first, place, entry): entries under their headings; sorted by first and place they are the report.

    ``first`` is where a group begins, since groups come in order of appearance.
    """
    rows = marks.select(group_name(by).alias("group"), F.col(order).alias("place"), review_entry().alias("entry"))
    return rows.join(rows.groupBy("group").agg(F.min("place").alias("first")), "group")


def todo_body() -> Column:
    return _or(F.col("content"), _or(F.col("subject"), F.col("kind")))


def todo_line() -> Column:
    """A mark as an open task of a list in Markdown."""
    return F.concat(F.lit("- [ ] **"), page_name(F.col("page")), F.lit("**: "), todo_body(), F.lit(" _(來源:"), _or(F.col("author"), F.lit("?")), F.lit(" · "), F.col("kind"), F.lit(")_"))


def todo_row() -> list[Column]:
    """A mark as a row of a task table, its cells safe for spreadsheets."""
    cells = {
        "status": F.lit("[ ]"),
        "page": F.col("page"),
        "todo": T.spreadsheet_safe(todo_body()),
        "assignee": T.spreadsheet_safe(F.col("author")),
        "priority": F.lit(""),
        "type": T.spreadsheet_safe(F.col("kind")),
        "notes": F.lit(""),
    }
    return [c.alias(n) for n, c in cells.items()]


def pair_text(source: Column, target: Column) -> Column:
    """A text and its translation, a blank line behind them."""
    end = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x1c-\x1f]+$", "")
    return F.concat_ws("\n", end(source), end(target), F.lit(""))


def pair_row(source: Column, target: Column) -> Column:
    """A text and its translation as a row of a table in Markdown."""
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    return F.concat(F.lit("| "), cell(source), F.lit(" | "), cell(target), F.lit(" |"))
