"""Texts set inside the shape of a mask: each line as wide as the rows that it lies on.

A mask's body is its widest run in each row, without tapering ends where asked.
With a waist, the words are dealt out to the two lobes near the share of their
room; else the body is one zone. In a zone the number of lines is guessed from the
width at its middle; the block of that many lines is centred, and the lines are
filled again, each within the narrowest of the rows at its top, middle and bottom.
Bodies, waists and the final lines are found by built-in functions over arrays of a
mask's rows; sizes and line starts by Arrow batches, a step a line instead of a word.

Text is measured by advance widths (``layout``); ink is taken to be as high as the
font size. Words are not broken.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import layout, profile
from folioflow.operators import masks as m
from folioflow.operators import rounds
from folioflow.operators import runs as r

#: Pixels that a line stays narrower than its rows; the margin taken off a mask, as a share of its shorter
#: side and in pixels at least; the gaps that are closed before.
SLACK, MARGIN_SHARE, MARGIN, SMOOTHED = 4, 0.05, 2, 9


def text_area(masks: DataFrame, sizes: DataFrame | None = None, page: str = "page_id") -> DataFrame:
    """Masks with small gaps closed, then shrunk by a share of the shorter side of their box."""
    closed = m.close(masks, SMOOTHED, page, sizes)
    box = r.measure(masks, page)
    side = F.least(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"))
    by = F.greatest(F.lit(MARGIN), F.floor(side * MARGIN_SHARE)).cast("int")
    return m.erode(closed.join(box.select(page, "mask_id", by.alias("by")), [page, "mask_id"]), F.col("by"), page, sizes)


def shapes(masks: DataFrame, page: str = "page_id") -> DataFrame:
    """Each mask's rows: ``page, mask_id, top, wide, middle``: the first widest run's width less one, and its middle;
    ``centre``: the middle column of its box.

    Rows without pixels between others are 0 wide and have no middle.
    """
    merged = r.union(masks.select(page, "mask_id", "y", "x0", "x1"), [page, "mask_id"])
    row = F.struct("y", (F.col("x1") - F.col("x0") - 1).alias("w"), ((F.col("x0") + F.col("x1") - 1) / 2).alias("c"))
    by_row = Window.partitionBy(page, "mask_id", "y")
    wide = r.widest_runs(merged.withColumns({"_left": F.min("x0").over(by_row), "_right": F.max("x1").over(by_row)}), page)
    centre = F.floor((F.min("_left") + F.max("_right")) / 2).cast("double")
    found = wide.groupBy(page, "mask_id").agg(F.min("y").alias("top"), F.max("y").alias("_end"), F.collect_list(row).alias("_rows"), centre.alias("centre"))
    # Rows without gaps stand at their place. The others are looked up in a map, which must be built once, not for each row.
    at = F.map_from_entries(F.transform("_rows", lambda x: F.struct(x["y"], x)))
    looked_up = profile.let(at, lambda at: F.transform(F.sequence("top", "_end"), lambda y: F.try_element_at(at, y)))
    gaps = F.size("_rows") < F.col("_end") - F.col("top") + 1
    filled = found.withColumn("_each", F.when(gaps, looked_up).otherwise(F.array_sort("_rows")))
    wide, middle = F.transform("_each", lambda x: F.coalesce(x["w"], F.lit(0)).cast("int")), F.transform("_each", lambda x: x["c"])
    return filled.select(page, "mask_id", "top", wide.alias("wide"), middle.alias("middle"), "centre")


class _Text:
    """Widths of words: how many fit a line, from the front or from the back."""

    def __init__(self, units: list[int], space: int):
        self.units, self.space = units, space
        self.edge = [0, *accumulate(w + space for w in units)]  # where each word would begin
        self.widest = max(units, default=0)

    def line_end(self, start: int, last: int, limit: int) -> int:
        """The word behind a line that begins with word ``start``; that word itself if it is too wide."""
        return min(bisect_right(self.edge, self.edge[start] + self.space + limit) - 1, last)

    def reach(self, lines: int, limit: int) -> int:
        """Words that so many lines hold."""
        at = 0
        while lines > 0 and at < len(self.units) and (end := self.line_end(at, len(self.units), limit)) > at:
            at, lines = end, lines - 1
        return at

    def reach_back(self, lines: int, limit: int) -> int:
        """The first of the last words that so many lines hold; filled from the back they are no more."""
        at = len(self.units)
        while lines > 0 and at > 0:
            # A line of words j to at: edge[at] - edge[j] - space <= limit.
            first = bisect_right(self.edge, self.edge[at] - self.space - limit - 1)
            if first >= at:
                break
            at, lines = first, lines - 1
        return at


class _Shape:
    """A mask's rows at one font size."""

    def __init__(self, wide: list[int], top: int, size: int, spacing: float):
        self.wide, self.top, self.size, self.line = wide, top, size, size * spacing

    def width(self, y: float) -> int:
        at = round(y) - self.top
        return self.wide[at] if 0 <= at < len(self.wide) else 0

    def room(self, width: int) -> int:
        """Units of a line in that many pixels."""
        return 1000 * max(width - SLACK, 0) // self.size

    def middle_room(self, top: int, extent: int) -> int:
        return self.room(self.width(top + extent / 2))

    def most_lines(self, extent: int) -> int:
        n = max(int(extent / self.line), 0)
        while (n + 1) * self.line <= extent:
            n += 1
        while n and n * self.line > extent:
            n -= 1
        return n

    def fill(self, text: _Text, first: int, last: int, start: float) -> list[int] | None:
        """Line starts when each line is filled within its own room; None if a word or a line has none."""
        starts, at = [], first
        while at < last:
            top = start + len(starts) * self.line
            limit = self.room(min(self.width(top), self.width(top + self.line / 2), self.width(top + self.line)))
            if limit <= 0 or text.units[at] > limit:
                return None
            starts.append(at - first)
            at = text.line_end(at, last, limit)
        return starts

    def zone(self, text: _Text, first: int, last: int, top: int, extent: int) -> tuple[list[int], float] | None:
        """The lines of a zone for words ``first`` to ``last`` and where the first line begins, or None."""
        limit, most, n, at = self.middle_room(top, extent), self.most_lines(extent), 0, first
        while at < last:  # the number of lines is guessed from the width at the middle
            if n == most or limit <= 0 or text.units[at] > limit:
                return None
            at, n = text.line_end(at, last, limit), n + 1
        starts = self.fill(text, first, last, top + (extent - n * self.line) / 2)
        if starts is None or len(starts) > most:
            return None
        return starts, top + extent / 2 - ((len(starts) - 1) * self.line + self.size) / 2


def lobe_words(n: int, first: int, second: int, least: int, most: int) -> list[int]:
    """Ways to deal ``n`` words out to two lobes of that much room: words of the first, the nearest to its share first.

    Both lobes get a word; of two equally near ways the smaller comes first. Only ways
    from ``least`` to ``most`` are asked for.
    """
    target = max(1, min(n - 1, round(n * first / (first + second))))
    return sorted(range(max(least, 1), min(most, n - 1) + 1), key=lambda s: abs(s - target))


def _fitted(units, wide, top, bottom, waist, first, second, trusted, largest, smallest, spacing, space) -> dict | None:
    """The largest size at which a text fits a mask: in two lobes if it can, else in one zone of a trusted mask."""
    text = _Text(units, space)
    sizes = [_Shape(wide, top[0], size, spacing) for size in range(largest, smallest - 1, -1)]
    as_zone = lambda z: z and {"starts": z[0], "y": z[1]}
    y0, y1 = top[1], bottom
    if waist is not None and len(units) > 1:
        for shape in sizes:
            # What the middle of either lobe does not hold need not be tried.
            most = text.reach(shape.most_lines(waist - y0), shape.middle_room(y0, waist - y0))
            least = text.reach_back(shape.most_lines(y1 - waist), shape.middle_room(waist, y1 - waist))
            for n in lobe_words(len(units), first, second, least, most):
                a = shape.zone(text, 0, n, y0, waist - y0)
                b = a and shape.zone(text, n, len(units), waist, y1 - waist)
                if b:
                    return {"size": shape.size, "words": n, "a": as_zone(a), "b": as_zone(b)}
    if trusted:
        for shape in sizes:
            a = shape.zone(text, 0, len(units), y0, y1 - y0)
            if a:
                return {"size": shape.size, "words": len(units), "a": as_zone(a), "b": None}
    return None


def fit_mask(
    rows: DataFrame, masks: DataFrame, text: str, table: dict[str, int], trusted: Column | bool = True,
    smallest: int = 8, largest: int = 32, spacing: float = 1.15, page: str = "page_id",
) -> DataFrame:
    """Adds ``size`` and ``lines`` (``text, cx, y``: the middle and the top of each line); null where a text fits at no size.

    ``masks`` are runs of ``page, mask_id``, already shrunk (``text_area``). ``trusted``
    says whether a mask is that of the balloon: if so its tapering ends are left out,
    and a mask without a waist is used as well; a mask of the text alone is used for
    two lobes only. Texts without words or mask get nulls.
    """
    space = table.get(" ", layout.WIDE)
    known = shapes(masks, page)
    sound = trusted if isinstance(trusted, Column) else F.lit(trusted)
    whole = F.struct(F.lit(0).alias("first"), (F.size("wide") - 1).alias("last"))
    named = rows.withColumn("_trusted", sound).withColumn("_words", layout.words(F.col(text))).withColumn("_units", layout.units(F.col("_words"), table))
    met = rounds.spread(named.join(known, [page, "mask_id"], "left"), page, "mask_id")
    met = met.withColumn("_body", F.when(F.col("_trusted"), profile.trim_taper(profile.smooth(F.col("wide")))).otherwise(whole))
    first, last = F.col("_body.first"), F.col("_body.last")
    inner = F.slice("wide", first + 1, last - first + 1)
    met = met.withColumn("_waist", F.when(F.array_max("wide") > 0, profile.waist(profile.let(inner, lambda w: profile.smooth(w)), F.col("top") + first)))
    room = lambda a, b: F.greatest(F.aggregate(F.slice("wide", a - F.col("top") + 1, b - a + 1), F.lit(0), lambda n, w: n + w), F.lit(1))
    top, bottom, waist = F.col("top") + first, F.col("top") + last, F.col("_waist")
    zone_kind = "struct<starts:array<int>,y:double>"
    both_kind = f"struct<size:int,words:int,a:{zone_kind},b:{zone_kind}>"
    zone_type = pa.struct([("starts", pa.list_(pa.int32())), ("y", pa.float64())])
    both_type = pa.struct([("size", pa.int32()), ("words", pa.int32()), ("a", zone_type), ("b", zone_type)])

    def fits(*given: pa.Array) -> pa.Array:
        found = []
        for units, wide, low, top, bottom, waist, first, second, trusted in zip(*(c.to_pylist() for c in given)):
            usable = units and wide and top is not None and bottom > top and max(wide) > 0
            found.append(_fitted(units, wide, (low, top), bottom, waist, first, second, trusted, largest, smallest, spacing, space) if usable else None)
        return pa.array(found, both_type)

    given = (F.col("_units"), F.col("wide"), F.col("top"), top, bottom, waist, room(top, waist).cast("long"), room(waist, bottom).cast("long"), F.col("_trusted"))
    met = met.withColumn("_fit", F.arrow_udf(fits, both_kind)(*given))
    size = F.col("_fit.size")
    line = size * F.lit(spacing)

    def line_middle(start, k):
        top = start + k * line
        middle = lambda y: F.coalesce(F.get("middle", (F.bround(y) - F.col("top")).cast("int")), F.col("centre"))
        return (middle(top) + middle(top + line / 2) + middle(top + line)) / 3

    def placed(words, zone):
        said = layout.join_lines(words, zone["starts"])
        return F.transform(said, lambda s, k: F.struct(s.alias("text"), line_middle(zone["y"], k).alias("cx"), (zone["y"] + k * line).alias("y")))

    n = F.col("_fit.words")
    ahead = placed(F.slice("_words", F.lit(1), n), F.col("_fit.a"))
    behind = placed(F.slice("_words", n + 1, F.greatest(F.size("_words"), F.lit(1))), F.col("_fit.b"))
    lines = F.when(F.col("_fit").isNotNull(), F.concat(ahead, F.coalesce(behind, F.slice(ahead, 1, 0))))
    return met.select(*(F.col(c) for c in rows.columns), size.alias("size"), lines.alias("lines"))
