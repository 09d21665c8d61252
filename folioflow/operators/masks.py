"""Mask shape operators on runs ``page, mask_id, y, x0, x1`` (half-open).

Growing, shrinking, neighbours and bodies are joins, windows and grouping by
page and row. The subtraction of overlaps goes page by page, on cells or pixels of its
masks, or in rounds of these. Connected parts are found by mask, on arrays of its runs.
Pages end where their size is given; else nothing is set beyond the runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import geometry as g
from folioflow.functions import profile
from folioflow.operators import rounds
from folioflow.operators import runs as r
from folioflow.operators.runs import steps

#: The share of the smaller mask from which an overlap is taken off the larger, the one from which it
#: counts as a copy, and what a part must keep of its mask, as a share and in pixels.
PARTIAL, COPY, LEAST_SHARE, LEAST_PART = 0.25, 0.8, 0.15, 300
#: Pixels in the boxes of a page's masks up to which the page is cut in one task.
MOST_PIXELS = 1 << 26
#: Bands up to which a page is cut on its cells, and cells that are held together.
MOST_BANDS, MOST_CELLS = 24, 1 << 21


def _cut_to_pages(found: DataFrame, sizes: DataFrame | None, page: str) -> DataFrame:
    """Bands without what lies outside their page; without ``sizes`` (``page, width, height``) pages have no end."""
    if sizes is None:
        return found
    ends = {
        "x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", F.col("width")),
        "y0": F.greatest("y0", F.lit(0)), "y1": F.least("y1", F.col("height")),
    }
    return found.join(sizes.select(page, "width", "height"), page).withColumns(ends).drop("width", "height").where("x0 < x1 and y0 < y1")


def round_width(by: Column, row: Column) -> Column:
    """Half the width, in whole pixels, of a round kernel of radius ``by``, ``row`` rows off its centre."""
    inside = F.greatest(by * by - row * row, F.lit(0)).cast("double")
    return F.bround(F.sqrt(inside)).cast("int")


def dilated(masks: DataFrame, by: int | Column, page: str = "page_id", sizes: DataFrame | None = None, round_kernel: bool = False) -> DataFrame:
    """Runs or bands grown by ``by`` pixels on all sides, by a square or a round kernel, as merged bands.

    ``by`` may be a column of the page or the mask that ``masks`` has as ``by``. With
    ``sizes`` nothing grows beyond its page. A band grows to one, or for a round kernel
    to one for each width of it, the wide ones low and the narrow ones high.
    """
    extra = ["by"] if isinstance(by, Column) else []
    reach = by if extra else F.lit(by)
    given = r.bands(masks.select(page, "mask_id", *(c for c in ("y", "y0", "y1") if c in masks.columns), "x0", "x1"), page)
    if extra:
        given = given.join(masks.select(page, "mask_id", "by").distinct(), [page, "mask_id"])
    high, wide = reach, reach
    if round_kernel:  # of equal widths the highest covers the others
        given = given.withColumn("_off", F.explode(F.sequence(F.lit(0), reach)))
        off = F.col("_off")
        given = given.where((off == reach) | (round_width(reach, off) != round_width(reach, off + 1)))
        high, wide = off, round_width(reach, off)
    grown = given.select(
        page, "mask_id", (F.col("y0") - high).alias("y0"), (F.col("y1") + high).alias("y1"), (F.col("x0") - wide).alias("x0"), (F.col("x1") + wide).alias("x1")
    )
    return r.union_bands(_cut_to_pages(grown, sizes, page), [page, "mask_id"])


def dilate(masks: DataFrame, by: int | Column, page: str = "page_id", sizes: DataFrame | None = None, round_kernel: bool = False) -> DataFrame:
    """The runs of ``dilated``."""
    return r.rows(dilated(masks, by, page, sizes, round_kernel))


def _turned(found: DataFrame) -> DataFrame:
    """Bands with rows and columns exchanged."""
    names = {"y0": "x0", "y1": "x1", "x0": "y0", "x1": "y1"}
    return found.select(*(F.col(c).alias(names.get(c, c)) for c in found.columns))


def eroded(masks: DataFrame, by: int | Column, page: str = "page_id", sizes: DataFrame | None = None, border: bool = True) -> DataFrame:
    """Runs or bands shrunk by ``by`` pixels on all sides, as bands that share no pixel.

    With ``sizes``, ``border`` says whether what lies outside a page counts as set, so
    that nothing is lost at its edge. Without, it counts as unset. Merged rows are
    narrowed; what they leave is merged by columns, which are shortened in turn.
    """
    extra = ["by"] if isinstance(by, Column) else []
    held = sizes is not None and border
    key = [page, "mask_id"]
    given = r.bands(masks.select(*key, *(c for c in ("y", "y0", "y1") if c in masks.columns), "x0", "x1"), page)
    reach = masks.select(*key, "by").distinct() if extra else None

    def narrowed(found, low, high, end):
        by_ = F.col("by") if extra else F.lit(by)
        left, right = F.col(low) + by_, F.col(high) - by_
        found = found.join(reach, key) if extra else found
        if held:  # a run keeps its end at the page's edge
            found = found.join(sizes.select(page, F.col(end).alias("_end")), page)
            left = F.when(F.col(low) <= 0, 0).otherwise(left)
            right = F.when(F.col(high) >= F.col("_end"), F.col("_end")).otherwise(right)
        return found.withColumns({low: left.cast("int"), high: right.cast("int")}).where(F.col(low) < F.col(high)).select(*key, "y0", "y1", "x0", "x1")

    along = narrowed(r.union_bands(given, key), "x0", "x1", "width")
    return narrowed(_turned(r.union_bands(_turned(along), key)), "y0", "y1", "height")


def erode(masks: DataFrame, by: int | Column, page: str = "page_id", sizes: DataFrame | None = None, border: bool = True) -> DataFrame:
    """The merged runs of ``eroded``."""
    return r.union(r.rows(eroded(masks, by, page, sizes, border)), [page, "mask_id"])


def closed(masks: DataFrame, by: int, page: str = "page_id", sizes: DataFrame | None = None) -> DataFrame:
    """Gaps of up to 2 ``by`` pixels filled: grown, then shrunk, as bands; with ``sizes``, gaps to the page's edge as well."""
    return eroded(dilated(masks, by, page, sizes), by, page, sizes)


def close(masks: DataFrame, by: int, page: str = "page_id", sizes: DataFrame | None = None) -> DataFrame:
    """The merged runs of ``closed``."""
    return erode(dilated(masks, by, page, sizes), by, page, sizes)


def label_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, corners: bool = True) -> np.ndarray:
    """The part of each run, from 0 in order of first appearance by (y, x0); runs are sorted and disjoint.

    Each run hangs on the first it touches in the row above; runs that touch several join what hangs on these.
    """
    if not len(y):
        return np.zeros(0, np.int64)
    reach, low = int(corners), int(x0.min())
    wide = int(x1.max()) - low + 3  # so that no place beside a row's ends lies in another row
    row = y.astype(np.int64) * wide + 1 - low
    first = np.searchsorted(row + x1, row + (x0 - wide - reach), "right")
    above = np.searchsorted(row + x0, row + (x1 - wide + reach), "left") - first
    parent = np.where(above > 0, first, np.arange(len(y)))
    while True:
        higher = parent[parent]
        if (higher == parent).all():
            break
        parent = higher
    joins = np.flatnonzero(above > 1)
    if len(joins):
        own = {k: k for k in np.flatnonzero(above <= 0).tolist()}

        def root(k):
            while own[k] != k:
                own[k] = own[own[k]]
                k = own[k]
            return k

        pair, other = r.steps(first[joins] + 1, above[joins] - 1)
        for a, b in zip(parent[joins[pair]].tolist(), parent[other].tolist()):
            a, b = root(a), root(b)
            own[max(a, b)] = min(a, b)
        final = np.arange(len(y))
        final[list(own)] = [root(k) for k in own]
        parent = final[parent]
    return np.cumsum(parent == np.arange(len(y)))[parent] - 1


def components(masks: DataFrame, corners: bool = True, page: str = "page_id") -> DataFrame:
    """Runs with ``part``: the connected part of their mask, from 0 in order of first appearance.

    ``corners``: pixels that touch at a corner are connected.
    """
    merged = r.union(masks.select(page, "mask_id", "y", "x0", "x1"), [page, "mask_id"]).select(page, "mask_id", "y", "x0", "x1")

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x0"])
        return rows.assign(part=label_runs(rows["y"].to_numpy(), rows["x0"].to_numpy(), rows["x1"].to_numpy(), corners))

    schema = ", ".join(f"{name} {kind}" for name, kind in merged.dtypes) + ", part long"
    return rounds.spread(merged, page, "mask_id").groupBy(page, "mask_id").applyInPandas(label, schema)


def largest_parts(parts: DataFrame, n: int, page: str = "page_id") -> DataFrame:
    """The ``n`` largest parts of each mask, with their ``area``; of equal ones the first."""
    sized = parts.groupBy(page, "mask_id", "part").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
    order = Window.partitionBy(page, "mask_id").orderBy(F.desc("area"), "part")
    return sized.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def subtract_overlaps(masks: DataFrame, page: str = "page_id") -> DataFrame:
    """The runs of ``subtracted``."""
    return r.rows(subtracted(masks, page)).select(page, "mask_id", "y", "x0", "x1")


def subtracted(masks: DataFrame, page: str = "page_id") -> DataFrame:
    """Masks of a page without what a smaller one that overlaps them in part covers, as bands that share no pixel.

    From the smallest mask on (of equal ones the first), each takes its pixels off every
    larger one that holds ``PARTIAL`` to ``COPY`` of it. Of what is left only parts with
    ``LEAST_SHARE`` of the mask's first area and ``LEAST_PART`` pixels stay; a mask
    without any goes. Takes runs or bands.

    Pages of up to ``MOST_BANDS`` bands are cut many at a time, on the cells between the
    ends of their bands; others whose masks' boxes hold up to ``MOST_PIXELS`` one after
    another on the pixels of their masks; larger ones go in rounds.
    """
    given = r.as_bands(masks).select(page, "mask_id", "y0", "y1", "x0", "x1").where("y0 < y1 and x0 < x1")
    # A page's bands, each as large as their common box, hold at least the pixels of its masks' boxes: few pages need a closer look.
    most = F.count("*") * (F.max("y1") - F.min("y0")).cast("long") * (F.max("x1") - F.min("x0"))
    vast = given.groupBy(page).agg(most.alias("n")).where(F.col("n") > MOST_PIXELS).select(page)
    if vast.isEmpty():
        return _subtracted_by_page(given, page)
    boxes = given.groupBy(page, "mask_id").agg(((F.max("y1") - F.min("y0")).cast("long") * (F.max("x1") - F.min("x0"))).alias("n"))
    large = boxes.groupBy(page).agg(F.sum("n").alias("n")).where(F.col("n") > MOST_PIXELS).select(page)
    if large.isEmpty():
        return _subtracted_by_page(given, page)
    large = rounds.written(large, "large")
    same = given[page].eqNullSafe(large[page])
    small = _subtracted_by_page(given.join(large, same, "left_anti"), page)
    return small.unionByName(r.as_bands(_subtracted_in_rounds(r.rows(given.join(large, same, "left_semi")), page)))


def _painted(band: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Pixels of bands (one a row) in their box, and its corner."""
    top, left = int(band[:, 0].min()), int(band[:, 2].min())
    grid = np.zeros((int(band[:, 1].max()) - top, int(band[:, 3].max()) - left), bool)
    for y0, y1, x0, x1 in (band - [top, top, left, left]).tolist():
        grid[y0:y1, x0:x1] = True
    return grid, top, left


def _runs_of(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edges = np.diff(np.pad(grid, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (y, x0), x1 = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
    return y, x0, x1


def _large_parts(grid: np.ndarray, least: int) -> np.ndarray:
    """The pixels of connected parts of ``least`` pixels, corners joined."""
    y, x0, x1 = _runs_of(grid)
    joined = (np.diff(y) == 1) & (x0[1:] <= x1[:-1]) & (x1[1:] >= x0[:-1])
    label = np.zeros(len(y), np.int64) if joined.all() else label_runs(y, x0, x1)
    small = np.bincount(label, weights=x1 - x0)[label] < least if len(y) else np.zeros(0, bool)
    left = grid.copy()
    for row, a, b in zip(y[small].tolist(), x0[small].tolist(), x1[small].tolist()):
        left[row, a:b] = False
    return left


def _cut_page(found: list[tuple]) -> list[tuple]:
    """A page's masks (id, grid, top, left), in order of their ids, after all subtractions."""
    found = sorted(found, key=lambda m: int(np.count_nonzero(m[1])))
    grids, area = [m[1] for m in found], [int(np.count_nonzero(m[1])) for m in found]
    least = [max(int(np.floor(n * LEAST_SHARE)), LEAST_PART) for n in area]
    ends = [(t, x, t + g_.shape[0], x + g_.shape[1]) for _, g_, t, x in found]
    for i, (t, x, b, e) in enumerate(ends):
        for j, (u, v, c, f) in enumerate(ends):
            y0, x0, y1, x1 = max(t, u), max(x, v), min(b, c), min(e, f)
            if not area[i] or area[j] <= area[i] or y0 >= y1 or x0 >= x1:
                continue
            mine, other = grids[i][y0 - t : y1 - t, x0 - x : x1 - x], grids[j][y0 - u : y1 - u, x0 - v : x1 - v]
            if PARTIAL * area[i] <= np.count_nonzero(mine & other) < COPY * area[i]:
                cut = grids[j].copy()
                cut[y0 - u : y1 - u, x0 - v : x1 - v] &= ~mine
                grids[j] = _large_parts(cut, least[j])
                area[j] = int(np.count_nonzero(grids[j]))
    return [(m[0], grid, m[2], m[3]) for m, grid, n in zip(found, grids, area) if n]


def _ends(pages: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of bands' ends among all ends of their page, and these as a table: a row a page, filled up with the last."""
    least = int(low.min())
    room = int(high.max()) - least + 1
    cuts, place = np.unique(np.concatenate([pages * room + low - least, pages * room + high - least]), return_inverse=True)
    page = cuts // room
    start = np.searchsorted(page, np.arange(n))
    at = np.arange(len(cuts)) - start[page]
    table = np.full((n, int(at.max()) + 1), least)
    table[page, at] = cuts % room + least
    first, last = np.split(place - start[np.tile(pages, 2)], 2)
    return first, last, np.maximum.accumulate(table, axis=1)


def _large_cells(grid: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Of each grid of cells, the connected parts of ``least`` pixels, corners joined: the largest label spreads until none changes."""
    n, high, wide = grid.shape
    label = np.zeros((n, high + 2, wide + 2), np.int32)
    label[:, 1:-1, 1:-1] = grid * np.arange(1, high * wide + 1, dtype=np.int32).reshape(high, wide)
    todo = np.arange(n)
    while len(todo):
        here = label[todo]
        near = np.maximum(np.maximum(here[:, :-2], here[:, 1:-1]), here[:, 2:])
        near = np.maximum(np.maximum(near[:, :, :-2], near[:, :, 1:-1]), near[:, :, 2:]) * grid[todo]
        spread = (near != here[:, 1:-1, 1:-1]).any(axis=(1, 2))
        todo = todo[spread]
        label[todo, 1:-1, 1:-1] = near[spread]
    own = label[:, 1:-1, 1:-1] + np.arange(n)[:, None, None] * (high * wide + 1)
    whole = np.bincount(own.ravel(), weights=size.ravel())
    return grid & (whole[own] >= least[:, None, None])


def _cut_pages(pages: np.ndarray, masks: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``subtracted`` on pages with the same number of masks, both counted from 0: the page, mask and bands of what is left.

    A page's bands cut its plane into cells, which each mask holds whole or not at all, before and after each cut.
    """
    n, count = int(pages[-1]) + 1, int(masks.max()) + 1
    (ya, yb, ys), (xa, xb, xs) = _ends(pages, band[0], band[1], n), _ends(pages, band[2], band[3], n)
    corners = np.zeros((n, count, ys.shape[1], xs.shape[1]), np.int32)
    for y, x, step in ((ya, xa, 1), (yb, xb, 1), (ya, xb, -1), (yb, xa, -1)):
        np.add.at(corners, (pages, masks, y, x), step)
    grid = corners.cumsum(axis=2).cumsum(axis=3)[:, :, :-1, :-1] > 0
    size = np.diff(ys)[:, :, None] * np.diff(xs)[:, None]
    area = (grid * size[:, None]).sum(axis=(2, 3))
    order = np.argsort(area, axis=1, kind="stable")
    grid, area = np.take_along_axis(grid, order[:, :, None, None], 1), np.take_along_axis(area, order, 1)
    least = np.maximum(np.floor(area * LEAST_SHARE).astype(np.int64), LEAST_PART)
    cells = grid.reshape(n, count, -1).astype(np.float64)
    common = (cells * size.reshape(n, 1, -1)) @ cells.transpose(0, 2, 1)  # of each two masks
    for i in range(count):
        for j in range(count):
            own, shared = area[:, i], common[:, i, j]
            hit = np.flatnonzero((own > 0) & (area[:, j] > own) & (shared >= PARTIAL * own) & (shared < COPY * own))
            if len(hit):
                left = _large_cells(grid[hit, j] & ~grid[hit, i], size[hit], least[hit, j])
                grid[hit, j] = left
                area[hit, j] = (left * size[hit]).sum(axis=(1, 2))
                common[hit, j] = common[hit, :, j] = ((grid[hit] & left[:, None]) * size[hit, None]).sum(axis=(2, 3))
    # Equal rows of cells that follow each other are one band.
    opens = np.concatenate([np.ones_like(grid[:, :, :1, 0]), (grid[:, :, 1:] != grid[:, :, :-1]).any(axis=3)], axis=2)
    page, mask, top = np.nonzero(opens)
    bottom = np.r_[top[1:], 0]
    bottom[np.r_[(page[1:] != page[:-1]) | (mask[1:] != mask[:-1]), True]] = grid.shape[2]
    row, left, right = _runs_of(grid[opens])
    page, mask, top, bottom = page[row], mask[row], top[row], bottom[row]
    return page, order[page, mask], np.stack([ys[page, top], ys[page, bottom], xs[page, left], xs[page, right]])


def _cut_on_pixels(masks: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``subtracted`` on one page: the mask and bands of what is left."""
    names, out = [np.empty(0, np.int64)], [np.empty((4, 0), np.int64)]
    parts = np.split(band.T, np.flatnonzero(np.diff(masks)) + 1)
    for name, grid, top, left in _cut_page([(k, *_painted(part)) for k, part in enumerate(parts)]):
        starts = np.flatnonzero(np.r_[True, (grid[1:] != grid[:-1]).any(axis=1)])
        row, x0, x1 = _runs_of(grid[starts])
        ends = np.r_[starts[1:], len(grid)]
        out.append(np.stack([starts[row] + top, ends[row] + top, x0 + left, x1 + left]))
        names.append(np.full(len(row), name))
    return np.concatenate(names), np.concatenate(out, axis=1)


def _subtracted_by_page(given: DataFrame, page: str) -> DataFrame:
    """``subtracted``, batches of whole pages at a time."""
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        opens = r.changes(batch.column(0))
        named = opens | r.changes(batch.column(1))
        pages, first = np.cumsum(opens) - 1, np.flatnonzero(named)
        starts = np.cumsum(named)[opens] - 1  # the number of each page's first mask
        masks = np.cumsum(named) - 1 - starts[pages]
        band = np.stack([batch.column(c).to_numpy() for c in ("y0", "y1", "x0", "x1")]).astype(np.int64).reshape(4, -1)
        bands, count = np.bincount(pages), np.bincount(pages[first])
        kind = np.where(bands > MOST_BANDS, -1 - np.arange(len(bands)), count * MOST_BANDS + bands // 4)  # pages of about the same size
        names, out = [np.empty(0, np.int64)], [np.empty((4, 0), np.int64)]
        rank = np.zeros(len(bands), np.int64)
        for k in np.unique(kind).tolist():
            alike = np.flatnonzero(kind == k)
            each = max(MOST_CELLS // int(count[alike[0]] * 4 * bands[alike].max() ** 2), 1)
            for some in np.split(alike, range(each, len(alike), each)):
                rows = np.concatenate([np.arange(a, a + n) for a, n in zip(np.flatnonzero(opens)[some].tolist(), bands[some].tolist())])
                rank[some] = np.arange(len(some))
                if k < 0:
                    where, (mask, left) = np.zeros(1, np.int64), _cut_on_pixels(masks[rows], band[:, rows])
                else:
                    where, mask, left = _cut_pages(rank[pages[rows]], masks[rows], band[:, rows])
                names.append(first[starts[some][where] + mask])
                out.append(left)
        rows = pa.array(np.concatenate(names))
        columns = [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(c) for c in np.concatenate(out, axis=1).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=[page, "mask_id", "y0", "y1", "x0", "x1"])

    kinds = dict(given.dtypes)
    return r.page_by_page(given, page, ["mask_id"], cut, f"{page} {kinds[page]}, mask_id {kinds['mask_id']}, y0 int, y1 int, x0 int, x1 int")


def _subtracted_in_rounds(masks: DataFrame, page: str) -> DataFrame:
    """``subtract_overlaps`` on runs, all pages at once.

    A round finds, for all pages at once, the first pair in that order that meets the test
    with the shapes as they are: those before it do not, and nothing changes until its
    turn. It is cut, and the next round goes on behind it. A page without such a pair is
    done, so rounds are as many as the most cuts of one page.
    """
    merged = r.union(masks.select(page, "mask_id", "y", "x0", "x1"), [page, "mask_id"]).select(page, "mask_id", "y", "x0", "x1")
    rank = F.row_number().over(Window.partitionBy(page).orderBy("area", "mask_id"))
    least = F.greatest(F.floor(F.col("area") * LEAST_SHARE), F.lit(LEAST_PART))
    ranks = rounds.written(r.measure(merged, page).select(page, "mask_id", rank.alias("rank"), least.alias("least")), "ranks")
    now, behind, done = rounds.written(merged, "masks"), ranks.select(page).distinct().withColumns({"i": F.lit(0), "j": F.lit(0)}), []
    turn = lambda side, name: ranks.select(page, F.col("mask_id").alias(f"{side}_mask"), F.col("rank").alias(name))
    while True:
        met = r.overlaps(now, now, page, once=True)
        both = F.explode(F.array(
            F.struct("a_mask", "b_mask", "a_area", "b_area"),
            F.struct(F.col("b_mask").alias("a_mask"), F.col("a_mask").alias("b_mask"), F.col("b_area").alias("a_area"), F.col("a_area").alias("b_area")),
        ))
        pairs = met.select(page, both.alias("p"), "common").select(page, "p.*", "common").where("b_area > a_area")
        pairs = pairs.where((F.col("common") >= PARTIAL * F.col("a_area")) & (F.col("common") < COPY * F.col("a_area")))
        placed = pairs.join(turn("a", "r"), [page, "a_mask"]).join(turn("b", "s"), [page, "b_mask"]).join(behind, page)
        later = placed.where((F.col("r") > F.col("i")) | (F.col("r") == F.col("i")) & (F.col("s") > F.col("j")))
        first = rounds.written(later.groupBy(page).agg(F.min(F.struct("r", "s", "a_mask", "b_mask")).alias("p")).select(page, "p.*"), "first")
        done.append(now.join(first.select(page), page, "left_anti"))
        if first.isEmpty():
            break
        open_pages = now.join(first.select(page, "a_mask", "b_mask"), page)
        small, large = (open_pages.where(F.col("mask_id") == F.col(side)).select(page, "mask_id", "y", "x0", "x1") for side in ("a_mask", "b_mask"))
        parts = components(r.difference(large, small, page), page=page)
        sized = parts.groupBy(page, "mask_id", "part").agg(F.sum(F.col("x1") - F.col("x0")).alias("area")).join(ranks, [page, "mask_id"])
        kept = parts.join(sized.where("area >= least").select(page, "mask_id", "part"), [page, "mask_id", "part"], "left_semi")
        others = open_pages.where(F.col("mask_id") != F.col("b_mask")).select(page, "mask_id", "y", "x0", "x1")
        now = rounds.written(others.unionByName(kept.select(page, "mask_id", "y", "x0", "x1")), "masks")
        behind = first.select(page, F.col("r").alias("i"), F.col("s").alias("j"))
    left = done[0]
    for rows in done[1:]:
        left = left.unionByName(rows)
    return left.select(page, "mask_id", "y", "x0", "x1")


def seeds(points: DataFrame, masks: DataFrame, page: str = "page_id") -> DataFrame:
    """All points (``pos, cx, cy``; cut to whole pixels) inside each mask, given as runs or bands, in list order."""
    whole = points.select(page, "pos", F.col("cx").cast("int").alias("cx"), F.col("cy").cast("int").alias("cy"))
    met = r.points_in(whole, masks.select(page, "mask_id", *(c for c in ("y", "y0", "y1") if c in masks.columns), "x0", "x1"), page)
    return met.groupBy(page, "mask_id").agg(F.array_sort(F.collect_set(F.struct("pos", "cx", "cy"))).alias("seeds"))


def _cover(masks: DataFrame, by: int, page: str, sizes: DataFrame | None) -> DataFrame:
    """Spans ``page, y0, y1, x0, x1`` of the masks, grown by a round kernel, with how many cover them and the sum of their numbers.

    ``number`` counts the masks of a page by ``mask_id``; where one mask covers a span, ``who`` is its number.
    """
    number = F.dense_rank().over(Window.partitionBy(page).orderBy("mask_id")).cast("long")
    grown = dilated(masks, by, page, sizes, round_kernel=True).withColumn("number", number)
    edge = F.explode(F.array(
        F.struct(F.col("x0").alias("x"), F.lit(1).alias("step"), F.col("number").alias("m")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("step"), (-F.col("number")).alias("m"))
    ))
    cut = r.cut_bands(grown.select(page, "y0", "y1", "x0", "x1", "number"), [page]).select(page, "y0", "y1", edge.alias("e"))
    edges = cut.groupBy(page, "y0", "y1", F.col("e.x").alias("x0")).agg(F.sum("e.step").alias("n"), F.sum("e.m").alias("h"))
    along = Window.partitionBy(page, "y0", "y1").orderBy("x0")
    return edges.select(page, "y0", "y1", "x0", F.lead("x0").over(along).alias("x1"), F.sum("n").over(along).alias("cover"), F.sum("h").over(along).alias("who")).where("cover > 0")


def _numbered(masks: DataFrame, by: int, page: str, sizes: DataFrame | None) -> DataFrame:
    """The masks with the numbers of ``_cover``: those that have pixels when grown."""
    number = F.dense_rank().over(Window.partitionBy(page).orderBy("mask_id")).cast("long")
    return dilated(masks, by, page, sizes, round_kernel=True).select(page, "mask_id", number.alias("number")).distinct()


def neighbour_runs(masks: DataFrame, by: int = 3, page: str = "page_id", sizes: DataFrame | None = None) -> DataFrame:
    """For each mask, the pixels that other masks of its page cover, grown by a round kernel, as merged runs.

    The grown masks are cut into spans once; a span counts for all masks but one if that one alone covers it.
    """
    ids = masks.select(page, "mask_id").distinct().join(_numbered(masks, by, page, sizes), [page, "mask_id"], "left")
    own = (F.col("cover") == 1) & F.coalesce(F.col("who") == F.col("number"), F.lit(False))
    others = _cover(masks, by, page, sizes).join(ids, page).where(~own)
    return r.rows(r.union_bands(others.select(page, "mask_id", "y0", "y1", "x0", "x1"), [page, "mask_id"]))


#: Runs, of bands cut at each other's ends, that are looked at together.
MOST_RUNS = 1 << 21


def _grown(band: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Bands (rows ``y0, y1, x0, x1``) grown by a round kernel as bands that share no pixel, and the number of the band each comes from."""
    off = np.arange(by + 1)
    wide = np.rint(np.sqrt(by * by - off * off)).astype(np.int64)
    y0, y1, x0, x1 = band
    high = int(np.flatnonzero(wide == wide[0])[-1])  # rows beyond the middle that are as wide
    parts = [(y0 - high, y1 + high, wide[0])]
    for d in range(high + 1, by + 1):
        parts += [(y0 - d, y0 - d + 1, wide[d]), (y1 + d - 1, y1 + d, wide[d])]
    return np.concatenate([np.stack([a, b, x0 - w, x1 + w]) for a, b, w in parts], axis=1), np.tile(np.arange(len(y0)), len(parts))


def covered_areas(pages: np.ndarray, masks: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels that the masks of each page cover, and those that each mask covers alone; pages and masks are counted from 0."""
    every, alone = np.zeros(int(pages.max(initial=-1)) + 1, np.int64), np.zeros(int(masks.max(initial=-1)) + 1, np.int64)
    low = int(band[0].min(initial=0))
    height = int(band[1].max(initial=0)) - low + 1
    cuts, place = np.unique(np.concatenate([pages * height + band[0] - low, pages * height + band[1] - low]), return_inverse=True)
    first, last = np.split(place, 2)
    # Bands cut at the ends of all bands of their page; so many cuts at a time that their runs stay few.
    held = np.cumsum(np.cumsum(np.bincount(first, minlength=len(cuts)) - np.bincount(last, minlength=len(cuts))))
    start = 0
    while start < len(cuts):
        end = max(int(np.searchsorted(held, (held[start - 1] if start else 0) + MOST_RUNS, "right")), start + 1)
        here = np.flatnonzero((first < end) & (last > start))
        own, cut = steps(np.maximum(first[here], start), np.minimum(last[here], end) - np.maximum(first[here], start))
        own, start = here[own], end
        if not len(own):
            continue
        mask, x0, x1 = masks[own], band[2][own], band[3][own]
        order = r.sorted_by(cut, mask, x0)  # each mask's runs become disjoint
        cut, mask, x0, x1 = cut[order], mask[order], x0[order], x1[order]
        other = np.r_[True, (cut[1:] != cut[:-1]) | (mask[1:] != mask[:-1])]
        room = int(x1.max() - x0.min()) + 1
        shift = np.cumsum(other) * room
        reach = np.maximum.accumulate(x1 + shift) - shift
        opens = np.flatnonzero(other | np.r_[True, x0[1:] > reach[:-1]])
        cut, mask, x0, x1 = cut[opens], mask[opens], x0[opens], reach[np.r_[opens[1:], len(reach)] - 1]
        cut, x, sign, mask = np.tile(cut, 2), np.r_[x0, x1], np.repeat([1, -1], len(x0)), np.tile(mask, 2)
        order = r.sorted_by(cut, x)
        cut, x, sign, mask = cut[order], x[order], sign[order], mask[order]
        cover, who = np.cumsum(sign)[:-1], np.cumsum(sign * mask)[:-1]  # nothing covers the place behind a cut's last run
        area = np.where(cover > 0, x[1:] - x[:-1], 0) * (cuts[np.minimum(cut[:-1] + 1, len(cuts) - 1)] - cuts[cut[:-1]])
        every += _summed(cuts[cut[:-1]] // height, area, len(every))
        alone += _summed(who[cover == 1], area[cover == 1], len(alone))
    return every, alone


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=values, minlength=n).astype(np.int64)


def neighbour_areas(masks: DataFrame, by: int = 3, page: str = "page_id", sizes: DataFrame | tuple[int, int] | None = None) -> DataFrame:
    """The ``area`` of what ``neighbour_runs`` gives for each mask, where there is any: all that is covered less what the mask alone covers.

    Takes runs or bands; ``sizes`` may be the width and height of all pages. Masks
    without an id or a page are left out. Pages come in batches, each page whole; the pixels they
    share are counted on their bands.
    """
    given = r.as_bands(masks).select(page, "mask_id", "y0", "y1", "x0", "x1").where(F.col(page).isNotNull()).where("mask_id is not null and y0 < y1 and x0 < x1")
    if isinstance(sizes, DataFrame):
        given = given.join(sizes.select(page, "width", "height"), page)
    elif sizes is not None:
        given = given.withColumns({"width": F.lit(sizes[0]), "height": F.lit(sizes[1])})
    ended = sizes is not None

    def areas(batch: pa.RecordBatch) -> pa.RecordBatch:
        opens = r.changes(batch.column(0))
        named = opens | r.changes(batch.column(1))
        pages, names = np.cumsum(opens) - 1, np.cumsum(named) - 1
        band = np.stack([batch.column(c).to_numpy() for c in ("y0", "y1", "x0", "x1")]).astype(np.int64).reshape(4, -1)
        grown, own = _grown(band, by)
        if ended:
            ends = [batch.column(c).to_numpy()[own] for c in ("height", "width")]
            for i in (0, 1):
                grown[2 * i], grown[2 * i + 1] = np.maximum(grown[2 * i], 0), np.minimum(grown[2 * i + 1], ends[i])
        kept = (grown[0] < grown[1]) & (grown[2] < grown[3])
        every, alone = (np.zeros(n, np.int64) for n in (opens.sum(), named.sum()))
        for whole, part in zip((every, alone), covered_areas(pages[own[kept]], names[own[kept]], grown[:, kept])):
            whole[: len(part)] = part
        first = np.flatnonzero(named)
        area = every[pages[first]] - alone
        rows = pa.array(first[area > 0])
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(area[area > 0])], names=[page, "mask_id", "area"])

    kinds = dict(given.dtypes)
    return r.page_by_page(given, page, ["mask_id"], areas, f"{page} {kinds[page]}, mask_id {kinds['mask_id']}, area long")


def swallows(before: Column, after: Column, others: Column, least: float = 0.5, growth: float = 0.3) -> Column:
    """Whether a box grown from ``before`` to ``after`` swallows any of the boxes ``others``: it covers half and 0.3 more than it did."""
    covered = lambda box, o: g.overlap(box, o) / F.greatest(g.area(o), F.lit(1))
    return F.coalesce(F.exists(others, lambda o: (covered(after, o) >= least) & (covered(after, o) - covered(before, o) >= growth)), F.lit(False))


def bodies(masks: DataFrame, page: str = "page_id") -> DataFrame:
    """Each mask without its tapering ends: ``top, bottom`` (exclusive), and ``cx, cy``, the middle of its first widest row.

    Rows without pixels between the first and the last count as 0 wide.
    """
    wide = r.widest_runs(masks, page)
    row = F.struct("y", (F.col("x1") - F.col("x0")).alias("w"), "x0", "x1")
    by_mask = wide.groupBy(page, "mask_id").agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.collect_list(row).alias("_rows"))
    known = F.map_from_arrays(F.transform("_rows", lambda x: x["y"]), F.transform("_rows", lambda x: x["w"]))
    # The map is built once, not for each row.
    widths = profile.let(known, lambda known: F.transform(F.sequence("_y0", "_y1"), lambda y: F.coalesce(F.try_element_at(known, y), F.lit(0))))
    filled = by_mask.withColumn("widths", widths)
    trimmed = filled.withColumn("_body", profile.trim_taper(profile.smooth(F.col("widths"))))
    inside = F.filter("_rows", lambda x: (x["y"] >= F.col("_y0") + F.col("_body.first")) & (x["y"] <= F.col("_y0") + F.col("_body.last")))
    best = F.array_sort(F.transform(inside, lambda x: F.struct((-x["w"]).alias("w"), x["y"].alias("y"), F.floor((x["x0"] + x["x1"] - 1) / 2).alias("cx"))))
    return trimmed.select(
        page, "mask_id", (F.col("_y0") + F.col("_body.first")).alias("top"), (F.col("_y0") + F.col("_body.last") + 1).alias("bottom"), F.get(best, 0)["cx"].alias("cx"), F.get(best, 0)["y"].alias("cy")
    )


def column_profile(masks: DataFrame, page: str = "page_id") -> DataFrame:
    """Foreground pixels of each column."""
    return masks.select(page, "mask_id", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x")).groupBy(page, "mask_id", "x").agg(F.count("*").alias("height"))


def lobe_share(widths: Column, cut: Column) -> Column:
    """The share of a shape before row ``cut``; an empty side counts as one pixel."""
    total = lambda a: F.greatest(F.aggregate(a, F.lit(0).cast("long"), lambda n, w: n + w), F.lit(1))
    first, second = total(F.slice(widths, 1, cut)), total(F.slice(widths, cut + 1, F.size(widths)))
    return first / (first + second)
