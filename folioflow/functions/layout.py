"""Text layout by advance widths: wrapping and fitting.

A table gives the width of characters in thousandths of the font size; others
count ``WIDE``. Widths grow with the size and there is no kerning, so a line of
``width`` pixels at ``size`` holds ``1000 * width / size`` of these units. Line
counts and sizes are found by built-in functions; only the final lines of a
text are set in Python, by Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import text as t
from folioflow.functions.profile import let

#: Units of a character that the table does not name.
WIDE = 600
ELLIPSIS = "…"
#: What the layout of a text reads, and what it adds.
HELPERS = ("_words", "_units", "_size", "_width", "_height")
LAID = {"size": pa.int32(), "lines": pa.list_(pa.string()), "overflow": pa.bool_()}


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(t.strip(F.coalesce(text, F.lit(""))), f"(?U){t.WHITE}+"), lambda w: w != "")


def units(found: Column, table: dict[str, int]) -> Column:
    """The width of each word: all its characters as ``WIDE``, then what those of each other width differ by."""
    by_width: dict[int, str] = {}
    for c, wide in table.items():
        if len(c) == 1 and wide != WIDE:
            by_width[wide] = by_width.get(wide, "") + c

    def width(w):
        whole = F.char_length(w) * WIDE
        for wide, chars in by_width.items():
            whole = whole + (F.char_length(w) - F.char_length(F.translate(w, chars, ""))) * (wide - WIDE)
        return whole.cast("int")

    return F.transform(found, width)


def room(width: Column, size: Column) -> Column:
    """Whole units of a line."""
    return F.floor(1000 * width / size).cast("int")


def line_starts(widths: Column, space: int, limit: Column) -> Column:
    """Index of the first word of each line when lines are filled one after another.

    A word wider than the limit has a line of its own.
    """
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("used"))

    def add(line, w):
        joined = line["used"] + space + w
        stays = F.coalesce(joined <= limit, F.lit(False))
        return F.struct(
            F.when(stays, line["starts"]).otherwise(F.array_append(line["starts"], line["i"])).alias("starts"),
            (line["i"] + 1).alias("i"), F.when(stays, joined).otherwise(w).alias("used"),
        )

    return F.aggregate(widths, start, add, lambda line: line["starts"])


def n_lines(widths: Column, space: int, limit: Column) -> Column:
    """How many lines ``line_starts`` would give, without keeping them."""
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("used"))

    def add(line, w):
        joined = line["used"] + space + w
        stays = F.coalesce(joined <= limit, F.lit(False))
        return F.struct((line["n"] + F.when(stays, 0).otherwise(1)).alias("n"), F.when(stays, joined).otherwise(w).alias("used"))

    return F.aggregate(widths, start, add, lambda line: line["n"])


def join_lines(found: Column, starts: Column) -> Column:
    """The text of each line."""
    ends = F.slice(F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(found))), 1, F.size(starts))
    return F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(found, a + 1, b - a), " "))


def wrap(text: Column, table: dict[str, int], width: Column, size: Column) -> Column:
    """Lines of at most ``width`` pixels, each filled as far as it goes."""
    found = words(text)
    return join_lines(found, line_starts(units(found, table), table.get(" ", WIDE), room(width, size)))


def fit_size(widths: Column, space: int, width: Column, height: Column, smallest: int, largest: int, spacing: float) -> Column:
    """The largest size at which a text fits a box without broken words, else null; a text without words fits at any.

    Balanced lines are as many as filled ones, so counting the latter is enough. What
    fits at one size fits at every smaller one, so the sizes are halved, not gone through.
    """
    widest = F.coalesce(F.array_max(widths), F.lit(0))

    def fits(size):
        limit = room(width, size)
        return F.coalesce((widest <= limit) & (size.cast("double") * spacing * n_lines(widths, space, limit) <= height), F.lit(False))

    # ``low`` fits, or is below all sizes; what is above ``high`` does not fit.
    start = F.struct(F.lit(smallest - 1).alias("low"), F.lit(largest).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(max(largest - smallest + 1, 1).bit_length()))

    def halve(s, _):
        def tried(size):
            ok = (s["low"] < s["high"]) & fits(size)
            return let(ok, lambda ok: F.struct(F.when(ok, size).otherwise(s["low"]).alias("low"), F.when(ok | (s["low"] >= s["high"]), s["high"]).otherwise(size - 1).alias("high")))

        return let(F.ceil((s["low"] + s["high"]) / 2).cast("int"), tried)

    return F.aggregate(steps, start, halve, lambda s: F.when(s["low"] >= smallest, s["low"]))


def balanced_starts(widths: list[int], space: int, limit: float) -> list[int]:
    """Line starts with the least sum of squared slack among those of the fewest lines; of equal ones the later starts.

    Every word must fit. ``table[k][j]`` is the least cost of the first j words on k lines.
    """
    n = len(widths)
    if not n:
        return []
    edge = np.concatenate([[0], np.cumsum(np.asarray(widths, dtype=np.float64) + space)])  # where word j would begin
    lowest = np.searchsorted(edge, edge[1:] - space - limit, side="left")  # first word of the longest last line
    lines, at = 0, n
    while at > 0:  # as few lines from the end as from the start
        at, lines = lowest[at - 1], lines + 1
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    came = np.zeros((lines, n + 1), dtype=np.int32)
    for k in range(lines):
        following = np.full(n + 1, np.inf)
        for j in range(k + 1, n + 1):
            first = np.arange(lowest[j - 1], j)[::-1]
            total = cost[first] + (limit - (edge[j] - space - edge[first])) ** 2
            best = int(np.argmin(total))
            following[j], came[k, j] = total[best], first[best]
        cost = following
    starts, at = [], n
    for k in reversed(range(lines)):
        at = int(came[k, at])
        starts.append(at)
    return starts[::-1]


class Ruler:
    """Widths of pieces of text, and where words may break."""

    def __init__(self, table: dict[str, int], breaks: Callable[[str], list[int]] | None = None):
        self.table, self.breaks = table, breaks

    def __call__(self, piece: str) -> int:
        return sum(self.table.get(c, WIDE) for c in piece)

    def head(self, word: str, limit: float) -> int:
        """The last break point before the first whose part, with its hyphen, is too wide; 0 if there is none."""
        points = self.breaks(word) if self.breaks else []
        wide = [self(word[:p] + "-") > limit for p in points]
        fitting = wide.index(True) if True in wide else len(wide)
        return points[fitting - 1] if fitting else 0

    def broken_lines(self, found: list[str], limit: float, most: float = float("inf")) -> list[str]:
        """Filled lines; a word too wide for a line is broken where it may be. Ends when there are more than ``most``."""
        lines, line, used = [], "", 0
        queue, space = list(reversed(found)), self(" ")
        while queue and len(lines) <= most:
            word = queue.pop()
            wide = self(word)
            joined = used + space + wide if line else wide
            if joined <= limit:
                line, used = f"{line} {word}" if line else word, joined
                continue
            if line:
                lines.append(line)
                line, used = "", 0
                queue.append(word)
                continue
            cut = self.head(word, limit)
            lines.append(word[:cut] + "-" if cut else word)
            if cut:
                queue.append(word[cut:])
        return [*lines, line] if line else lines

    def shortened(self, line: str, limit: float) -> str:
        """The line, or as much of it as fits before an ellipsis; at least three characters stay."""
        if self(line) <= limit or len(line) <= 3:
            return line
        lengths = range(3, len(line))
        fitting = bisect_left(lengths, True, key=lambda k: self(line[:k]) + self(ELLIPSIS) > limit)
        return line[: lengths[fitting - 1]] + ELLIPSIS if fitting else line[:3]


def fit_box(
    rows: DataFrame, text: str, width: Column, height: Column, table: dict[str, int], smallest: int = 8, largest: int = 32,
    spacing: float = 1.15, breaks: Callable[[str], list[int]] | None = None,
) -> DataFrame:
    """Adds ``size, lines, overflow``: each text set in its box of whole pixels.

    Lines are balanced at the largest size that needs no broken word. If there is
    none, words may break at the rising points that ``breaks`` gives, again at the
    largest size that fits; else the text is cut to the box at the smallest.
    """
    space, ruler = table.get(" ", WIDE), Ruler(table, breaks)

    def lay(found, widths, size, width, height):
        if size is not None:
            starts = balanced_starts([w * size for w in widths], space * size, 1000.0 * width)
            return size, [" ".join(found[a:b]) for a, b in zip(starts, [*starts[1:], len(found)])], False
        for tried in range(largest, smallest - 1, -1):
            limit = 1000 * width / tried
            lines = ruler.broken_lines(found, limit, height / (tried * spacing))
            if tried * spacing * len(lines) <= height and all(ruler(x) <= limit for x in lines):
                return tried, lines, False
        limit = 1000 * width / smallest
        most = max(1, int(height / (smallest * spacing)))
        lines = ruler.broken_lines(found, limit, most)[:most]
        return smallest, [ruler.shortened(x, limit) for x in lines], True

    def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.Table.from_batches([batch])
            given = [kept[c].to_pylist() for c in HELPERS]
            laid = [lay(*row) for row in zip(*given)]
            kept = kept.drop_columns(list(HELPERS))
            for i, (name, kind) in enumerate(LAID.items()):
                kept = kept.append_column(name, pa.array([x[i] for x in laid], kind))
            yield from kept.to_batches()

    widths = units(F.col("_words"), table)
    asked = rows.withColumns({"_words": words(F.col(text)), "_width": width.cast("int"), "_height": height.cast("int")})
    asked = asked.withColumn("_units", widths)
    asked = asked.withColumn("_size", fit_size(F.col("_units"), space, F.col("_width"), F.col("_height"), smallest, largest, spacing))
    schema = T.StructType(rows.schema.fields + [
        T.StructField("size", T.IntegerType()), T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("overflow", T.BooleanType()),
    ])
    return asked.select(*rows.columns, *HELPERS).mapInArrow(set_batches, schema)
