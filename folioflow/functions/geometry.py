"""Boxes ``[x1, y1, x2, y2)`` as structs, and arithmetic on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def overlap(a: Column, b: Column) -> Column:
    """Common area."""
    side = lambda low, high: F.greatest(F.least(a[high], b[high]) - F.greatest(a[low], b[low]), F.lit(0))
    return side("x1", "x2") * side("y1", "y2")


def min_ratio(a: Column, b: Column) -> Column:
    """Common area over the smaller box."""
    return overlap(a, b) / F.greatest(F.least(area(a), area(b)), F.lit(1))


def max_ratio(a: Column, b: Column) -> Column:
    """Common area over the larger box."""
    return overlap(a, b) / F.greatest(F.greatest(area(a), area(b)), F.lit(1))


def clamp(b: Column, width: Column, height: Column) -> Column:
    """Inside an image, at least one pixel wide and high."""
    x1 = F.greatest(F.lit(0), F.least(b["x1"], width - 1))
    y1 = F.greatest(F.lit(0), F.least(b["y1"], height - 1))
    return box(x1, y1, F.greatest(x1 + 1, F.least(b["x2"], width)), F.greatest(y1 + 1, F.least(b["y2"], height)))


def safe_area(b: Column, ratio: float) -> Column:
    """Shrunk about its centre by a ratio of its sides."""
    cx, cy = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    w, h = (b["x2"] - b["x1"]) * ratio / 2, (b["y2"] - b["y1"]) * ratio / 2
    return box(*(c.cast("int") for c in (cx - w, cy - h, cx + w, cy + h)))


def inscribed_box(b: Column) -> Column:
    """The largest box in the ellipse that fills ``b``."""
    return safe_area(b, 2**-0.5)


def shortening_target(original: Column, translated: Column, ratio: Column) -> Column:
    """Characters to aim at when a translation's font is ``ratio`` of the original's."""
    n = F.char_length(translated)
    return F.greatest((n * ratio * ratio).cast("int"), (F.char_length(original) * 0.9).cast("int"), (n * 0.6).cast("int"))


def split_words(words: Column, share: Column) -> Column:
    """Two texts, the first with about ``share`` of the words; each has one at least."""
    n = F.size(words)
    first = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * share).cast("int")))
    return F.struct(
        F.array_join(F.slice(words, 1, first), " ").alias("first"),
        F.array_join(F.slice(words, first + 1, F.greatest(n - first, F.lit(0))), " ").alias("second"),
    )
