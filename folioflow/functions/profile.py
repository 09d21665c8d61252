"""Width profiles: arrays with the number of foreground pixels of each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def smooth(widths: Column, window: int = 7) -> Column:
    """Centred moving average, cut at the ends, rounded half to even."""
    half = window // 2

    def mean(_, i):
        start = F.greatest(i - half, F.lit(0))
        part = F.slice(widths, start + 1, F.least(i + half, F.size(widths) - 1) - start + 1)
        return F.bround(F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)).cast("int")

    return F.transform(widths, mean)


def _first_cut(widths: Column, ratio: float, descent: float) -> Column:
    """First index that reaches ``ratio`` of the outermost peak; a fall below ``descent`` ends the rise."""
    start = F.struct(F.lit(-1).alias("peak"), F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(False).alias("over"))

    def step(a, w):
        fell = a["over"] | (w < a["peak"] * descent)
        higher = ~fell & (w >= a["peak"])
        return F.struct(
            F.when(higher, w).otherwise(a["peak"]).alias("peak"), F.when(higher, a["i"]).otherwise(a["at"]).alias("at"),
            (a["i"] + 1).alias("i"), fell.alias("over"),
        )

    def reaching(found):
        hits = F.filter(F.sequence(F.lit(0), F.size(widths) - 1), lambda i: (F.get(widths, i) >= found["peak"] * ratio) & (i <= found["at"]))
        return F.coalesce(F.try_element_at(hits, F.lit(1)), found["at"])

    return let(F.aggregate(widths, start, step), reaching)


def trim_taper(widths: Column, ratio: float = 0.5, descent: float = 0.6) -> Column:
    """First and last index of the body, without tapering ends."""
    def trimmed(w):
        n = F.size(w)
        ends = F.struct(_first_cut(w, ratio, descent).alias("first"), (n - 1 - let(F.reverse(w), lambda back: _first_cut(back, ratio, descent))).alias("last"))

        def held(e):
            whole = e["first"] >= e["last"]
            return F.struct(F.when(whole, 0).otherwise(e["first"]).alias("first"), F.when(whole, n - 1).otherwise(e["last"]).alias("last"))

        return let(ends, held)

    return let(widths, trimmed)


def _longest_run(widths: Column, least: Column) -> Column:
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a, w):
        run = F.when(w >= least, a["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(widths, start, step)["best"]


def waist(widths: Column, y0: Column, run_ratio: float = 0.08, dip: float = 0.7, lobe: float = 0.3) -> Column:
    """Row of a narrow place between two lobes, or null."""

    def found(w):
        n = F.size(w)
        margin = F.floor(n * 0.15).cast("int")
        inner = F.slice(w, margin + 1, F.greatest(n - 2 * margin, F.lit(0)))
        return let(F.array_min(inner), lambda low: let(margin + F.array_position(inner, low).cast("int") - 1, lambda at: sound(w, n, low, at)))

    def sound(w, n, low, at):
        left, right = F.slice(w, 1, at), F.slice(w, at + 2, F.greatest(n - at - 1, F.lit(0)))
        peak, run = lobe * F.array_max(w), F.greatest(F.lit(3), F.floor(n * run_ratio))
        sides = [(F.array_max(s) >= peak) & (_longest_run(s, low / dip) >= run) for s in (left, right)]
        return F.when((n >= 20) & (low > 0) & sides[0] & sides[1], y0 + at)

    return let(widths, found)
