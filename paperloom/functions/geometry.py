"""Lengths and boxes on pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MM_PER_INCH, POINTS_PER_INCH = 25.4, 72.0


def mm_to_points(mm: Column) -> Column:
    return mm * POINTS_PER_INCH / MM_PER_INCH


def points_to_mm(points: Column) -> Column:
    return points * MM_PER_INCH / POINTS_PER_INCH


def points_to_pixels(points: Column, dpi: float = 96.0) -> Column:
    return F.round(points * dpi / POINTS_PER_INCH).cast("long")


def overlap_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Common area of two boxes (x0, y0, x1, y1)."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def cover(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Share of the smaller box that the other one covers; 0 for a box without area."""
    least = F.least((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return F.when(least > 0, overlap_area(a, b) / least).otherwise(0.0)


def center(box: tuple[Column, ...]) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def luminance(red: Column, green: Column, blue: Column) -> Column:
    """Brightness of a pixel, 0 to 255."""
    return 0.299 * red + 0.587 * green + 0.114 * blue


def saturation(red: Column, green: Column, blue: Column) -> Column:
    """Colourfulness of a pixel, 0 to 1; 0 for black and grey."""
    most, least = F.greatest(red, green, blue), F.least(red, green, blue)
    return F.when(most > 0, (most - least) / most).otherwise(0.0)
