"""Mask operators against brute force on small grids."""

from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import geometry as g
from folioflow.operators import masks, runs

SIZE = 24


def grids():
    random, found = Random(3), {}
    for page in ("a", "b", "c"):
        for mask in range(4):
            grid = np.zeros((SIZE, SIZE), bool)
            for _ in range(random.randint(1, 6)):
                y, x = random.randint(4, 16), random.randint(4, 16)
                grid[y:y + random.randint(1, 4), x:x + random.randint(1, 4)] = True
            found[page, mask] = grid
    return found


def as_runs(spark, found):
    rows = []
    for (page, mask), grid in found.items():
        for y, row in enumerate(grid):
            edges = np.flatnonzero(np.diff(np.r_[False, row, False].astype(int)))
            rows += [(page, mask, y, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
    return spark.createDataFrame(rows, "page_id string, mask_id int, y int, x0 int, x1 int")


def as_grids(df, size=SIZE):
    found = {}
    for r in df.collect():
        found.setdefault((r["page_id"], r["mask_id"]), np.zeros((size, size), bool))[r["y"], r["x0"]:r["x1"]] = True
    return found


def around(grid, by, test):
    return np.array([[test(grid[max(0, y - by):y + by + 1, max(0, x - by):x + by + 1]) for x in range(grid.shape[1])] for y in range(grid.shape[0])])


def flood(grid, corners=True):
    left, parts = {(int(y), int(x)) for y, x in zip(*np.nonzero(grid))}, []
    while left:
        todo, part = [min(left)], set()
        while todo:
            y, x = todo.pop()
            if (y, x) in left:
                left.remove((y, x))
                part.add((y, x))
                todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if corners or not (dy and dx)]
        parts.append(part)
    return parts


def same(a, b):
    assert a.keys() == {k for k, v in b.items() if v.any()}
    for k in a:
        assert (a[k] == b[k]).all(), k


def test_grow_and_shrink(spark):
    found = grids()
    given = as_runs(spark, found)
    same(as_grids(masks.dilate(given, 2)), {k: around(v, 2, np.any) for k, v in found.items()})
    same(as_grids(masks.erode(given, 1)), {k: around(v, 1, np.all) for k, v in found.items()})
    same(as_grids(masks.close(given, 1)), {k: around(around(v, 1, np.any), 1, np.all) for k, v in found.items()})


@pytest.mark.parametrize("corners", [True, False])
def test_components(spark, corners):
    found = grids()
    labelled = masks.components(as_runs(spark, found), corners)
    parts = {}
    for r in labelled.collect():
        parts.setdefault((r["page_id"], r["mask_id"]), {}).setdefault(r["part"], set()).update((r["y"], x) for x in range(r["x0"], r["x1"]))
    for k, grid in found.items():
        assert [parts[k][i] for i in range(len(parts[k]))] == sorted(flood(grid, corners), key=min), k
    top = {(r["page_id"], r["mask_id"]): r["area"] for r in masks.largest_parts(labelled, 1).collect()}
    assert top == {k: max(map(len, flood(v, corners))) for k, v in found.items()}


def test_subtraction(spark):
    random, found = Random(8), {}
    for page in ("a", "b", "c", "d"):
        for mask in range(5):
            grid = np.zeros((90, 90), bool)
            y, x = random.randint(0, 50), random.randint(0, 50)
            grid[y:y + random.randint(15, 39), x:x + random.randint(15, 39)] = True
            found[page, mask] = grid
    expected = {}
    for page in ("a", "b", "c", "d"):
        now = {m: found[page, m].copy() for m in range(5)}
        first = {m: v.sum() for m, v in now.items()}
        order = sorted(now, key=lambda m: first[m])
        for i in order:
            for j in order:
                if i in now and j in now and now[j].sum() > now[i].sum() and masks.PARTIAL <= (now[i] & now[j]).sum() / now[i].sum() < masks.COPY:
                    left = np.zeros_like(now[j])
                    for part in flood(now[j] & ~now[i]):
                        if len(part) >= max(int(first[j] * masks.LEAST_SHARE), masks.LEAST_PART):
                            left[tuple(zip(*part))] = True
                    now[j] = left
                    if not left.any():
                        del now[j]
        expected |= {(page, m): v for m, v in now.items()}
    assert any((v != found[k]).any() for k, v in expected.items())
    same(as_grids(masks.subtract_overlaps(as_runs(spark, found)), 90), expected)


def rounded(grid):
    """Grown by the round kernel of 7 by 7 pixels."""
    out = np.zeros_like(grid)
    for dy, wide in zip(range(-3, 4), (0, 2, 3, 3, 3, 2, 0)):
        for y, x in np.argwhere(grid):
            if 0 <= y + dy < len(grid):
                out[y + dy, max(0, x - wide):x + wide + 1] = True
    return out


def test_neighbours(spark):
    found = grids()
    near = as_grids(masks.neighbour_runs(as_runs(spark, found)))
    same(near, {(p, m): np.any([rounded(v) for (q, n), v in found.items() if q == p and n != m], axis=0) for p, m in found})


def widest(row):
    """Start and end of the first longest run of set pixels."""
    edges = np.flatnonzero(np.diff(np.r_[False, row, False].astype(int)))
    return max(zip(edges[::2], edges[1::2]), key=lambda e: (e[1] - e[0], -e[0]), default=(0, 0))


def first_of_body(widths):
    peak, at = -1, 0
    for i, w in enumerate(widths):
        if w < peak * 0.6:
            break
        if w >= peak:
            peak, at = w, i
    return next((i for i in range(at + 1) if widths[i] >= peak * 0.5), at)


def test_bodies_and_shares(spark):
    found = grids()
    given = as_runs(spark, found)
    bodies = {(r["page_id"], r["mask_id"]): (r["top"], r["bottom"], r["cx"], r["cy"]) for r in masks.bodies(given).collect()}
    assert bodies.keys() == found.keys()
    for key, grid in found.items():
        rows = np.flatnonzero(grid.any(axis=1))
        spans = [widest(grid[y]) for y in range(rows[0], rows[-1] + 1)]
        widths = [int(b - a) for a, b in spans]
        smooth = [round(float(np.mean(widths[max(0, i - 3):i + 4]))) for i in range(len(widths))]
        first, last = first_of_body(smooth), len(widths) - 1 - first_of_body(smooth[::-1])
        if first >= last:
            first, last = 0, len(widths) - 1
        at = max(range(first, last + 1), key=lambda i: (widths[i], -i))
        assert bodies[key] == (rows[0] + first, rows[0] + last + 1, (spans[at][0] + spans[at][1] - 1) // 2, rows[0] + at), key
    columns = {(r["page_id"], r["mask_id"], r["x"]): r["height"] for r in masks.column_profile(given).collect()}
    assert columns == {(*k, x): int(n) for k, v in found.items() for x, n in enumerate(v.sum(axis=0)) if n}
    share = lambda a, cut: spark.range(1).select(masks.lobe_share(F.array(*map(F.lit, a)), F.lit(cut)).alias("s")).first()["s"]
    assert share([3, 3, 2], 1) == 3 / 8 and share([0, 0, 4], 2) == 1 / 5


def test_swallows(spark):
    box = lambda *b: g.box(*map(F.lit, b))
    ask = lambda after, others: spark.range(1).select(masks.swallows(box(0, 0, 10, 10), after, others).alias("s")).first()["s"]
    other = F.array(box(20, 0, 30, 10))
    assert ask(box(0, 0, 25, 10), other) and not ask(box(0, 0, 24, 10), other) and not ask(box(0, 0, 40, 40), F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>"))


def test_empty(spark):
    none = as_runs(spark, {})
    assert masks.dilate(none, 2).count() + masks.erode(none, 1).count() + masks.components(none).count() + masks.subtract_overlaps(none).count() + runs.measure(none).count() == 0
