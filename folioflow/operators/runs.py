"""Masks as run-length rows ``mask_id, y, x0, x1`` (half-open), with algebra on them.

Joins always carry the page and the row, so they are hash joins with a residual
overlap test.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators import rounds


def from_boxes(boxes: DataFrame, page: str = "page_id", mask: str = "mask_id") -> DataFrame:
    """The runs of filled boxes."""
    y = F.explode(F.sequence(F.col("bbox.y1"), F.col("bbox.y2") - 1))
    return boxes.where("bbox.x2 > bbox.x1 and bbox.y2 > bbox.y1").select(page, mask, y.alias("y"), F.col("bbox.x1").alias("x0"), F.col("bbox.x2").alias("x1"))


def bands(masks: DataFrame, page: str = "page_id", mask: str = "mask_id") -> DataFrame:
    """Masks as bands ``y0, y1, x0, x1``: equal runs of successive rows become one. Bands pass through."""
    if "y" not in masks.columns:
        return masks.select(page, mask, "y0", "y1", "x0", "x1")
    along = Window.partitionBy(page, mask, "x0", "x1").orderBy("y")
    numbered = masks.select(page, mask, "y", "x0", "x1").distinct().withColumn("island", F.col("y") - F.row_number().over(along))
    return numbered.groupBy(page, mask, "x0", "x1", "island").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1")).drop("island")


def bands_from_boxes(boxes: DataFrame, page: str = "page_id", mask: str = "mask_id") -> DataFrame:
    """Filled boxes, each one band."""
    b = F.col("bbox")
    return boxes.where("bbox.x2 > bbox.x1 and bbox.y2 > bbox.y1").select(
        page, mask, b["y1"].alias("y0"), b["y2"].alias("y1"), b["x1"].alias("x0"), b["x2"].alias("x1")
    )


def measure(runs: DataFrame, page: str = "page_id", mask: str = "mask_id") -> DataFrame:
    """Area and bounding box of each mask, given as runs or as bands that share no pixel."""
    return as_bands(runs).groupBy(page, mask).agg(
        F.sum((F.col("y1") - F.col("y0")).cast("long") * (F.col("x1") - F.col("x0"))).alias("area"), F.min("x0").alias("left"), F.min("y0").alias("top"),
        F.max("x1").alias("right"), F.max("y1").alias("bottom"),
    )


def union(runs: DataFrame, by: list) -> DataFrame:
    """Merged runs of all masks of a key: overlapping or touching runs become one."""
    order = ["x0", "x1", *(["mask_id"] if "mask_id" in runs.columns else [])]
    along = Window.partitionBy(*by, "y").orderBy(*order)
    reach = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("opens", F.coalesce(F.col("x0") > reach, F.lit(True)).cast("int"))
    numbered = marked.withColumn("run", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "y", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


#: Rows of a tile: bands are cut at each other's ends, and met by points, within tiles.
TILE = 64


def rows(found: DataFrame) -> DataFrame:
    """The runs of bands: one for each of their rows."""
    names = [c for c in found.columns if c not in ("y0", "y1", "x0", "x1")]
    return found.select(*names, F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "x0", "x1")


def tiled(found: DataFrame) -> DataFrame:
    """Bands with each ``tile`` of ``TILE`` rows that they reach."""
    return found.withColumn("tile", F.explode(F.sequence(F.floor(F.col("y0") / TILE), F.floor((F.col("y1") - 1) / TILE))))


def cut_bands(found: DataFrame, by: list) -> DataFrame:
    """Bands cut at the ends of all bands of their key, so that two of them share all rows or none; bounded by tiles.

    A band counts one row for each end inside it, where its runs would count one for each row.
    """
    low, high = F.greatest("y0", (F.col("tile") * TILE).cast("int")), F.least("y1", ((F.col("tile") + 1) * TILE).cast("int"))
    placed = tiled(found).select("*", low.alias("_low"), high.alias("_high"))
    along = Window.partitionBy(*by, "tile")
    ends = F.array_sort(F.array_union(F.collect_set("_low").over(along), F.collect_set("_high").over(along)))
    at = lambda c: F.array_position("_ends", F.col(c)).cast("int")
    n = at("_high") - at("_low")
    spans = F.arrays_zip(F.slice("_ends", at("_low"), n).alias("a"), F.slice("_ends", at("_low") + 1, n).alias("b"))
    kept = [c for c in found.columns if c not in ("y0", "y1")]
    cut = placed.withColumn("_ends", ends).select(*kept, F.explode(spans).alias("_s"))
    return cut.select(*kept, F.col("_s.a").alias("y0"), F.col("_s.b").alias("y1"))


def union_bands(found: DataFrame, by: list) -> DataFrame:
    """Merged bands of all masks of a key, ``by, y0, y1, x0, x1``: no two share a pixel, and those side by side do not touch."""
    cut = cut_bands(found.select(*by, "y0", "y1", "x0", "x1"), by)
    along = Window.partitionBy(*by, "y0", "y1").orderBy("x0", "x1")
    reach = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = cut.withColumn("opens", F.coalesce(F.col("x0") > reach, F.lit(True)).cast("int"))
    numbered = marked.withColumn("run", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "y0", "y1", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def as_bands(masks: DataFrame) -> DataFrame:
    """Runs as bands of one row; bands pass through."""
    return masks if "y" not in masks.columns else masks.withColumns({"y0": F.col("y"), "y1": F.col("y") + 1}).drop("y")


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value of a column differs from the one before, nulls being equal; the first one does."""
    if not len(column):
        return np.zeros(0, bool)
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
    gone = column.is_null().to_numpy(zero_copy_only=False)
    return np.r_[True, differs | (gone[1:] != gone[:-1])]


#: Rows from which whole pages go on as a batch.
BATCH = 1 << 15


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, put together or cut so that no value of it lies in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = changes(batch.column(0))
        if held and batch.num_rows:
            starts[0] = held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py()
        if starts.any():  # all before the last start is whole
            last = int(np.flatnonzero(starts)[-1])
            if last:
                held.append(batch.slice(0, last))
            if sum(b.num_rows for b in held) >= BATCH:
                yield pa.concat_batches(held)
                held = []
            batch = batch.slice(last)
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def page_by_page(found: DataFrame, page: str, order: list, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, placed: bool = False) -> DataFrame:
    """What ``each`` gives for batches of whole pages; ``found`` is dealt out and sorted by page, then ``order``.

    ``placed``: it is dealt out by page already.
    """
    given = found.select(page, *(c for c in found.columns if c != page))
    rows = (given if placed else rounds.spread(given, page)).sortWithinPartitions(page, *order)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(each, _whole_pages(batches))

    return rows.mapInArrow(pages, schema)


def sorted_by(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by whole numbers, the first key counting most; one sort of a packed key where that fits."""
    packed, room = np.zeros(len(keys[0]), np.int64), 1
    for key in keys:
        low = int(key.min(initial=0))
        size = int(key.max(initial=0)) - low + 1
        room *= size
        if room >= 1 << 62:
            return np.lexsort(keys[::-1])
        packed = packed * size + (key - low)
    return np.argsort(packed)


def steps(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``n`` numbers from ``first`` on, for each row: the row and the number."""
    return np.repeat(np.arange(len(n)), n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def points_in(points: DataFrame, masks: DataFrame, page: str = "page_id") -> DataFrame:
    """Points (``cx, cy``) with each run or band of ``masks`` that holds them: they meet by page and tile."""
    held = tiled(as_bands(masks))
    asked = points.withColumn("tile", F.floor(F.col("cy") / TILE))
    return asked.join(held, [page, "tile"]).where("cy >= y0 and cy < y1 and cx >= x0 and cx < x1").drop("tile", "y0", "y1", "x0", "x1")


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Common area of masks as arrays of sorted, disjoint ``y0, y1, x0, x1``, one number after the other."""
    def rows_of(flat):
        lengths = np.asarray([len(v) for v in flat], dtype=np.int64) // 4
        band = np.concatenate([*flat, np.empty(0, np.int64)]).astype(np.int64).reshape(-1, 4)
        pair, high = np.repeat(np.arange(len(flat)), lengths), band[:, 1] - band[:, 0]
        step = np.arange(high.sum()) - np.repeat(np.cumsum(high) - high, high)
        return np.repeat(pair, high), np.repeat(band[:, 0], high) + step, np.repeat(band[:, 2], high), np.repeat(band[:, 3], high)

    (ap, ay, a0, a1), (bp, by, b0, b1) = rows_of(a), rows_of(b)
    if not len(ay) or not len(by):
        return pd.Series(np.zeros(len(a), np.int64))
    low = min(ay.min(), by.min())
    height = max(ay.max(), by.max()) - low + 1
    key, asked = bp * height + by - low, ap * height + ay - low
    order = np.argsort(key, kind="stable")
    key, b0, b1 = key[order], b0[order], b1[order]
    first, last = np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")
    n = last - first
    met = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    shared = np.minimum(np.repeat(a1, n), b1[met]) - np.maximum(np.repeat(a0, n), b0[met])
    return pd.Series(np.bincount(np.repeat(ap, n), weights=np.maximum(shared, 0), minlength=len(a)).astype(np.int64))


def _outlined(placed: DataFrame, side: str, page: str, whole: bool) -> DataFrame:
    """Each mask's box, area and number of bands; with ``whole``, all of its bands as one array of numbers."""
    named = {"top": F.min("y0"), "bottom": F.max("y1"), "left": F.min("x0"), "right": F.max("x1"), "bands": F.count("*"), "area": F.sum((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")))}
    if whole:
        named["flat"] = F.flatten(F.collect_list(F.array("y0", "y1", "x0", "x1")))
    return placed.groupBy(page, F.col("mask_id").alias(f"{side}_mask")).agg(*(c.alias(f"{side}_{n}") for n, c in named.items()))


def overlaps(a: DataFrame, b: DataFrame, page: str = "page_id", once: bool = False, placed: bool = False) -> DataFrame:
    """Common area of masks of ``a`` and ``b`` on one page: ``page, a_mask, b_mask, a_area, b_area, common``.

    Masks meet by their boxes first. Those of one band each, rectangles, are done with
    that; of the others, the rows of pairs whose boxes meet are compared, many pairs at
    once. ``once``: only pairs in rising order of their ids. ``placed``: the rows are
    dealt out by page already and stay where they are.
    """
    first, second = (bands(side, page) if placed else bands(side, page).repartition(page) for side in (a, b))
    test = "a_top < b_bottom and b_top < a_bottom and a_left < b_right and b_left < a_right" + (" and a_mask < b_mask" if once else "")
    side = lambda low, high: F.least(f"a_{high}", f"b_{high}") - F.greatest(f"a_{low}", f"b_{low}")
    found = [page, "a_mask", "b_mask", "a_area", "b_area"]

    def met(whole):
        plain = (F.col("a_bands") == 1) & (F.col("b_bands") == 1)
        return _outlined(first, "a", page, whole).join(_outlined(second, "b", page, whole), page).where(test).where(~plain if whole else plain)

    flat = met(False).select(*found, (side("top", "bottom") * side("left", "right")).cast("long").alias("common"))
    curved = met(True).select(*found, _common("a_flat", "b_flat").alias("common")).where("common > 0")
    return flat.unionByName(curved)


#: Rows of pairs of shapes that are compared together.
MOST_ROWS = 1 << 20


def shape_overlaps(boxes: DataFrame, row_of: Callable[..., tuple[np.ndarray, np.ndarray]], page: str = "page_id", placed: bool = False) -> DataFrame:
    """Common area of each two shapes of a page that meet, in rising order of their ids: ``page, a_mask, b_mask, common``.

    A shape fills its box ``bbox`` with one run a row, which ``row_of`` gives (NumPy:
    ``x1, y1, x2, y2, y`` to ``x0, x1``); it may be empty. No shape becomes rows of a
    table: pages come in batches, shapes meet by their boxes, and the rows both have
    are compared, so many pairs at a time that their rows stay few. Shapes without a
    page or an id meet none. ``placed``: the boxes are dealt out by page already.
    """
    names = ("x1", "y1", "x2", "y2")
    given = boxes.select(page, "mask_id", *(F.col(f"bbox.{c}").alias(c) for c in names)).where("x2 > x1 and y2 > y1 and mask_id is not null").where(F.col(page).isNotNull())

    def met(batch: pa.RecordBatch) -> pa.RecordBatch:
        opens = changes(batch.column(0))
        left, top, right, bottom = (batch.column(c).to_numpy().astype(np.int64) for c in names)
        end = np.r_[np.flatnonzero(opens)[1:], len(opens)][np.cumsum(opens) - 1]  # of each shape's page
        pairs = np.cumsum(end - np.arange(len(end)) - 1)  # with the shapes behind it
        found, start = [(np.empty(0, np.int64),) * 3], 0
        while start < len(end):
            stop = max(int(np.searchsorted(pairs, (pairs[start - 1] if start else 0) + MOST_ROWS, "right")), start + 1)
            some = np.arange(start, stop)
            i, b = steps(some + 1, end[some] - some - 1)
            a, start = some[i], stop
            near = (top[a] < bottom[b]) & (top[b] < bottom[a]) & (left[a] < right[b]) & (left[b] < right[a])
            a, b = a[near], b[near]
            low, high = np.maximum(top[a], top[b]), np.minimum(bottom[a], bottom[b])
            tall = np.cumsum(high - low)
            for few in np.split(np.arange(len(a)), np.searchsorted(tall, np.arange(MOST_ROWS, tall[-1] if len(tall) else 0, MOST_ROWS))):
                pair, y = steps(low[few], high[few] - low[few])
                (a0, a1), (b0, b1) = (row_of(*(c[side[few]][pair] for c in (left, top, right, bottom)), y) for side in (a, b))
                common = np.bincount(pair, weights=np.maximum(np.minimum(a1, b1) - np.maximum(a0, b0), 0), minlength=len(few)).astype(np.int64)
                share = common > 0
                found.append((a[few][share], b[few][share], common[share]))
        first, second, common = (np.concatenate(c) for c in zip(*found))
        columns = [batch.column(0).take(pa.array(first)), batch.column(1).take(pa.array(first)), batch.column(1).take(pa.array(second)), pa.array(common)]
        return pa.RecordBatch.from_arrays(columns, names=[page, "a_mask", "b_mask", "common"])

    kinds = dict(given.dtypes)
    return page_by_page(given, page, ["mask_id"], met, f"{page} {kinds[page]}, a_mask {kinds['mask_id']}, b_mask {kinds['mask_id']}, common long", placed)


def difference(a: DataFrame, b: DataFrame, page: str = "page_id") -> DataFrame:
    """Runs of ``a`` without what ``b`` covers on the page."""
    cover = union(b.select(page, "y", "x0", "x1"), [page]).groupBy(page, "y").agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("cut"))
    joined = a.join(cover, [page, "y"], "left")
    hit = F.filter("cut", lambda c: (c["x0"] < F.col("x1")) & (c["x1"] > F.col("x0")))
    edges = joined.withColumn("hit", F.coalesce(hit, F.array().cast("array<struct<x0:int,x1:int>>")))
    starts = F.concat(F.array("x0"), F.transform("hit", lambda c: c["x1"]))
    ends = F.concat(F.transform("hit", lambda c: c["x0"]), F.array("x1"))
    parts = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda p: p["s"] < p["e"])
    return edges.select(page, "mask_id", "y", F.explode(parts).alias("p")).select(page, "mask_id", "y", F.col("p.s").alias("x0"), F.col("p.e").alias("x1"))


def widest_runs(runs: DataFrame, page: str = "page_id") -> DataFrame:
    """The first widest run of each row of each mask."""
    order = Window.partitionBy(page, "mask_id", "y").orderBy(F.desc(F.col("x1") - F.col("x0")), "x0")
    return runs.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def row_profile(runs: DataFrame, page: str = "page_id") -> DataFrame:
    """Foreground pixels of each row."""
    return runs.groupBy(page, "mask_id", "y").agg(F.sum(F.col("x1") - F.col("x0")).alias("width"))


def assign_points(points: DataFrame, runs: DataFrame, page: str = "page_id") -> DataFrame:
    """The first mask (by ``mask_pos``) that holds each point, and whether the point (by ``pos``) claims it first.

    ``points``: ``page, pos, cx, cy``; ``runs``, or bands, with ``mask_pos``.
    """
    met = points_in(points, runs.select(page, *(c for c in ("y", "y0", "y1") if c in runs.columns), "x0", "x1", "mask_id", "mask_pos"), page)
    first = Window.partitionBy(page, "pos").orderBy("mask_pos")
    taken = met.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    claim = F.row_number().over(Window.partitionBy(page, "mask_id").orderBy("pos")) == 1
    return taken.withColumn("claims", claim)


def best_overlap(texts: DataFrame, bubbles: DataFrame, least: float = 0.8, page: str = "page_id") -> DataFrame:
    """The bubble that holds most of each text mask, if it holds ``least`` of it."""
    best = Window.partitionBy(page, "a_mask").orderBy(F.desc("common"), "b_mask")
    top = overlaps(texts, bubbles, page).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    return top.where(F.col("common") >= least * F.col("a_area"))


def contained(masks: DataFrame, page: str = "page_id", placed: bool = False) -> DataFrame:
    """For each pair of masks of a page that meet, the share of the first that lies in the second."""
    both = F.explode(F.array(
        F.struct("a_mask", "b_mask", "a_area", "b_area"),
        F.struct(F.col("b_mask").alias("a_mask"), F.col("a_mask").alias("b_mask"), F.col("b_area").alias("a_area"), F.col("a_area").alias("b_area")),
    ))
    pairs = overlaps(masks, masks, page, once=True, placed=placed).select(page, both.alias("p"), "common").select(page, "p.*", "common")
    return pairs.withColumn("share", F.col("common") / F.col("a_area"))


def drop_contained(runs: DataFrame, least: float = 0.8, page: str = "page_id", placed: bool = False) -> DataFrame:
    """Masks left after dropping, one after another, those that a kept larger one holds.

    Pairs are found by joins; those of one page are folded in list order. A dropped
    mask cannot absorb another; of an equal pair the later one stays.
    """
    pairs = contained(runs, page, placed).where(F.col("share") >= least).where("b_area >= a_area")
    none = F.array().cast(f"array<{dict(runs.dtypes)['mask_id']}>")
    kept = lambda gone, p: ~F.array_contains(gone, p["a_mask"]) & ~F.array_contains(gone, p["b_mask"])
    fold = F.aggregate("pairs", none, lambda gone, p: F.when(kept(gone, p), F.array_append(gone, p["a_mask"])).otherwise(gone))
    by_page = pairs.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("a_mask", "b_mask"))).alias("pairs"))
    gone = by_page.select(page, F.explode(fold).alias("a_mask"))
    return runs.select(page, "mask_id").distinct().join(gone.withColumnRenamed("a_mask", "mask_id"), [page, "mask_id"], "left_anti")
