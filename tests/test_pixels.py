"""Pixel operators against plain loops over small images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import masks, pixels
from folioflow.operators.splitting import grid_runs
from folioflow.plans.shapes import ellipses

BOX = "page_id string, mask_id int, bbox struct<x1:int,y1:int,x2:int,y2:int>"
RUNS = "page_id string, mask_id int, y int, x0 int, x1 int"


def grey(spark, images):
    rows = [(p, y, [int(v) for v in row]) for p, image in images.items() for y, row in enumerate(image)]
    return spark.createDataFrame(rows, "page_id string, y int, values array<int>").repartition(3)


def color(spark, images):
    rows = [(p, y, [tuple(int(c) for c in v) for v in row]) for p, image in images.items() for y, row in enumerate(image)]
    return spark.createDataFrame(rows, "page_id string, y int, values array<struct<r:int,g:int,b:int>>")


def runs_of(spark, grids):
    return spark.createDataFrame([(p, k, int(y), int(a), int(b)) for (p, k), g in grids.items() for y, a, b in zip(*grid_runs(g, 0, 0))], RUNS)


def grids_of(df, shape):
    out = {}
    for r in df.collect():
        out.setdefault((r["page_id"], r["mask_id"]), np.zeros(shape, bool))[r["y"], r["x0"] : r["x1"]] = True
    return out


def sizes_of(spark, images):
    return spark.createDataFrame([(p, i.shape[1], i.shape[0]) for p, i in images.items()], "page_id string, width int, height int")


def reach(grid, at, corners):
    found, todo = np.zeros(grid.shape, bool), [at]
    while todo:
        y, x = todo.pop()
        if 0 <= y < grid.shape[0] and 0 <= x < grid.shape[1] and grid[y, x] and not found[y, x]:
            found[y, x] = True
            todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if corners or not (i and j)]
    return found


def test_runs_and_histograms(spark):
    rng = np.random.default_rng(1)
    images = {"a": rng.integers(0, 256, (9, 13)), "b": rng.integers(0, 3, (5, 8)) * 100, "c": np.full((4, 4), 7)}
    image = grey(spark, images)
    back = {p: np.zeros(i.shape, int) for p, i in images.items()}
    for r in pixels.value_runs(image).collect():
        back[r["page_id"]][r["y"], r["x0"] : r["x1"]] = r["value"]
    assert all((back[p] == images[p]).all() for p in images)
    assert pixels.value_runs(image).where("page_id = 'c'").count() == 4
    for r in pixels.uniformity(image).collect():
        assert abs(r["uniformity"] - np.bincount(images[r["page_id"]].ravel() // 8).max() / images[r["page_id"]].size) < 1e-12
    for r in pixels.histograms(image).withColumn("cut", pixels.otsu(F.col("bins"))).collect():
        v = images[r["page_id"]].ravel()
        assert r["bins"] == np.bincount(v, minlength=256).tolist()
        apart = [0.0 if not (v <= t).any() or not (v > t).any() else (v <= t).sum() * (v > t).sum() * (v[v <= t].mean() - v[v > t].mean()) ** 2 for t in range(256)]
        assert r["cut"] == 0 if max(apart) == 0 else abs(apart[r["cut"]] - max(apart)) < 1e-6 * max(apart)
    odd = spark.createDataFrame([("a", 0, []), ("a", 1, None), ("b", 0, [None, None, 3])], "page_id string, y int, values array<int>")
    assert [(r["x0"], r["x1"], r["value"]) for r in pixels.value_runs(odd).orderBy("x0").collect()] == [(0, 2, None), (2, 3, 3)]


def test_text_likeness(spark):
    rng = np.random.default_rng(3)
    page, light = np.full((60, 120), 230), np.full((60, 120), 20)
    for row in range(3):
        for k in range(9):
            top, left = 8 + 16 * row, 6 + 12 * k
            page[top : top + 8, left : left + 5] = 15
            light[top : top + 8, left : left + 5] = 240
    images = {"dark": page, "light": light, "noise": rng.integers(0, 256, (60, 120)), "flat": np.full((60, 120), 99), "tiny": page[:11, :40], "few": page[:24, :70]}
    found = {r["page_id"]: r for r in pixels.text_likeness(grey(spark, images)).collect()}
    assert found.keys() == images.keys()
    for p in ("dark", "light"):
        assert found[p]["suspect"] and (found[p]["glyphs"], found[p]["dense_rows"], found[p]["spread"]) == (27, 3, 0.0)
    assert not found["noise"]["suspect"] and found["noise"]["uniformity"] < 0.2
    assert (found["flat"]["glyphs"], found["flat"]["uniformity"]) == (0, 1.0) and found["tiny"]["glyphs"] == 0
    assert (found["few"]["glyphs"], found["few"]["dense_rows"], found["few"]["suspect"]) == (6, 1, False)


def test_means_and_colors(spark):
    rng = np.random.default_rng(5)
    images = {"a": rng.integers(0, 256, (40, 50))}
    boxes = spark.createDataFrame([("a", 1, (2, 3, 40, 30)), ("a", 2, (5, 5, 15, 12)), ("a", 3, (4, 4, 4, 9))], BOX)
    held = grids_of(ellipses(boxes), (40, 50))
    found = {r["mask_id"]: r["mean"] for r in pixels.mean_values(grey(spark, images), boxes, ellipses(boxes)).collect()}
    assert held["a", 1].sum() >= 200 > held["a", 2].sum() and found.keys() == {1, 2}
    assert abs(found[1] - images["a"][held["a", 1]].mean()) < 1e-9 and abs(found[2] - images["a"][5:12, 5:15].mean()) < 1e-9
    rgb = rng.integers(0, 20, (200, 3))
    spots = spark.createDataFrame([("a", *(int(c) for c in v), 1) for v in rgb], "page_id string, r int, g int, b int, n int")
    best = pixels.dominant_colors(spots, ["page_id"]).first()
    keys = [tuple(v // 8) for v in rgb]
    top = min(set(keys), key=lambda k: (-keys.count(k), k))
    assert np.allclose([best[c] for c in "rgb"], rgb[[k == top for k in keys]].mean(axis=0))


def test_ray_extents(spark):
    rng = np.random.default_rng(7)
    images = {p: np.where(rng.random((70, 90)) < share, 50, 200) for p, share in (("a", 0.01), ("b", 0.03), ("c", 0.3))}
    rows = [(p, k, tuple(int(v) for v in (x, y, x + rng.integers(2, 60), y + rng.integers(2, 50)))) for p in images for k in range(60) for x, y in [rng.integers(-5, 60, 2)]]
    found = {(r["page_id"], r["mask_id"]): r["extent"] for r in pixels.ray_extents(grey(spark, images), spark.createDataFrame(rows, BOX), sizes_of(spark, images)).collect()}
    seen = set()
    for p, k, (a, b, c, d) in rows:
        image = images[p]
        x1, y1, x2, y2 = max(0, a), max(0, b), min(90, c), min(70, d)
        cx, cy = ((max(lo, min(hi - 1, (lo + hi) // 2))) for lo, hi in ((x1, x2), (y1, y2)))
        cx, cy = max(0, min(89, cx)), max(0, min(69, cy))

        def cast(sx1, sy1, sx2, sy2):
            left = right = cx
            top = bottom = cy
            while left > sx1 and image[cy, left] >= 110:
                left -= 1
            while right < sx2 - 1 and image[cy, right] >= 110:
                right += 1
            while top > sy1 and image[top, cx] >= 110:
                top -= 1
            while bottom < sy2 - 1 and image[bottom, cx] >= 110:
                bottom += 1
            ix, iy = min(10, max(0, (right - left) * 0.2)), min(10, max(0, (bottom - top) * 0.2))
            return left + ix, top + iy, right - ix, bottom - iy

        want = None
        if image[cy, cx] >= 110:
            e = cast(x1, y1, x2, y2)
            if min(e[2] - e[0], e[3] - e[1]) < 20:
                px, py = min(150, max(x2 - x1, 40)), min(150, max(y2 - y1, 40))
                f = cast(max(0, x1 - px), max(0, y1 - py), min(89, x2 + px), min(69, y2 + py))
                e = f if min(f[2] - f[0], f[3] - f[1]) >= 20 else e
            if min(e[2] - e[0], e[3] - e[1]) >= 8:
                want = tuple(int(v) for v in e)
        got = found[p, k]
        assert (None if got is None else tuple(got)) == want, (p, k)
        seen.add(want is None)
    assert seen == {True, False}


def test_flood(spark):
    rng = np.random.default_rng(9)
    images = {p: rng.integers(0, 2, (14, 18, 1)) * np.array([[[40, 5, 0]]]) + rng.integers(0, 6, (14, 18, 3)) for p in "ab"}
    seeds = [(p, k, int(x), int(y)) for p in images for k, (x, y) in enumerate(rng.integers(0, 14, (6, 2)))] + [("a", 9, 40, 3)]
    found = grids_of(pixels.flood(color(spark, images), spark.createDataFrame(seeds, "page_id string, mask_id int, cx int, cy int")), (14, 18))
    for p, k, x, y in seeds[:-1]:
        like = np.abs(images[p] - images[p][y, x]).sum(axis=2) <= 30
        assert (found[p, k] == reach(like, (y, x), False)).all()
    assert ("a", 9) not in found


def test_drawn_shapes(spark):
    image = np.full((60, 90, 3), 10)
    image[5:45, 5:35] = 200  # the drawn balloon, of which the mask holds the lower half
    image[5:55, 50:88] = 200
    grids = {("p", 1): np.zeros((60, 90), bool), ("p", 2): np.zeros((60, 90), bool), ("p", 3): np.zeros((60, 90), bool)}
    grids["p", 1][25:45, 5:35] = True
    grids["p", 2][30:34, 60:64] = True  # the area is more than 4 times as wide
    grids["p", 3][46:50, 10:20] = True  # on dark ground: the flood leaves the page's ground, far too wide
    boxes = spark.createDataFrame([("p", 1, (5, 25, 35, 45)), ("p", 2, (60, 30, 64, 34)), ("p", 3, (10, 46, 20, 50))], BOX)
    sizes = spark.createDataFrame([("p", 90, 60)], "page_id string, width int, height int")
    found = grids_of(pixels.drawn_shapes(color(spark, {"p": image}), runs_of(spark, grids), boxes, sizes), (60, 90))
    whole = np.zeros((60, 90), bool)
    whole[5:45, 5:35] = True
    near = np.zeros((60, 90), bool)
    wide = {-3: 0, -2: 2, -1: 3, 0: 3, 1: 3, 2: 2, 3: 0}
    for y in range(46, 50):
        for dy, w in wide.items():
            near[y + dy, 10 - w : 20 + w] = True
    assert (found["p", 1] == (whole & ~near | grids["p", 1])).all()
    assert (found["p", 2] == grids["p", 2]).all() and (found["p", 3] == grids["p", 3]).all()


def test_border_ink(spark):
    image = np.full((90, 90), 220)
    raw = np.zeros((90, 90), bool)
    raw[15:75, 15:75] = True
    image[12:18, 12:78] = 0  # the border, in and out of the mask
    image[12:60, 40:43] = 0  # a line that runs deep into the balloon, from the border
    image[50:56, 60:66] = 0  # a letter
    inner = raw.copy()
    inner[:21] = inner[69:] = False
    inner[:, :21] = inner[:, 69:] = False
    given = {("p", 1): raw}, {("p", 1): inner}
    sizes = sizes_of(spark, {"p": image})
    found = grids_of(pixels.without_border_ink(grey(spark, {"p": image}), *(runs_of(spark, g) for g in given), sizes), (90, 90))["p", 1]
    outside = np.argwhere(~raw)
    want = inner.copy()
    border = reach(image < 130, (13, 13), True)
    for y, x in np.argwhere(border & inner):
        dy = np.abs(outside[:, 0] - y)
        near = (dy <= 20) & (np.abs(outside[:, 1] - x) <= np.round(np.sqrt(np.maximum(400.0 - dy * dy, 0))))
        want[y, x] = not near.any()
    assert (found == want).all() and found[52, 62] and not found[25, 41] and found[50, 41]


def test_page_edges(spark):
    grid = np.zeros((12, 14), bool)
    grid[0:5, 0:5] = True
    grid[9:12, 8:14] = True
    dot = np.zeros((12, 14), bool)
    dot[2, 2] = True
    grids = {("p", 1): grid, ("p", 2): dot}
    given, sizes = runs_of(spark, grids), spark.createDataFrame([("p", 14, 12)], "page_id string, width int, height int")

    def window(g, by, test, outside):
        wide = np.pad(g, by, constant_values=outside)
        return np.array([[test(wide[y : y + 2 * by + 1, x : x + 2 * by + 1]) for x in range(14)] for y in range(12)])

    for by in (1, 2):
        grown, shrunk = grids_of(masks.dilate(given, by, sizes=sizes), (12, 14)), grids_of(masks.erode(given, by, sizes=sizes), (12, 14))
        bare, closed = grids_of(masks.erode(given, by, sizes=sizes, border=False), (12, 14)), grids_of(masks.close(given, by, sizes=sizes), (12, 14))
        for k, g in grids.items():
            assert (grown[k] == window(g, by, np.any, False)).all()
            for got, want in ((shrunk, window(g, by, np.all, True)), (bare, window(g, by, np.all, False)), (closed, window(window(g, by, np.any, False), by, np.all, True))):
                assert (got.get(k, np.zeros((12, 14), bool)) == want).all()
    assert grids_of(masks.close(given, 2, sizes=sizes), (12, 14))["p", 2][:3, :3].all()
    far = np.zeros((20, 20), bool)
    far[8, 9] = True
    round_one = grids_of(masks.dilate(runs_of(spark, {("p", 1): far}), 3, round_kernel=True), (20, 20))["p", 1]
    assert [int(row.sum()) for row in round_one[4:13]] == [0, 1, 5, 7, 7, 7, 5, 1, 0] and round_one[8, 6:13].all()
    both = masks.erode(given.withColumn("by", F.col("mask_id") * 0 + 1), F.col("by"), sizes=sizes)
    assert (grids_of(both, (12, 14))["p", 1] == window(grid, 1, np.all, True)).all()
