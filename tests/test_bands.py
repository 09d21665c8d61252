"""Bands against pixels, and what tall masks cost."""

from random import Random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.functions import geometry as g
from folioflow.operators import masks, runs
from folioflow.plans import shapes

BANDS = "page_id string, mask_id int, y0 int, y1 int, x0 int, x1 int"


def planted(spark, pages=3, count=5, size=150):
    """Overlapping bands across the ends of tiles, and the grid of each mask."""
    random, rows, grids = Random(5), [], {}
    for page in "abcdef"[:pages]:
        for mask in range(count):
            grid = grids[page, mask] = np.zeros((size, size), bool)
            for _ in range(3):
                y, x, h, w = random.randint(5, 80), random.randint(5, 80), random.randint(1, 60), random.randint(1, 60)
                rows.append((page, mask, y, y + h, x, x + w))
                grid[y : y + h, x : x + w] = True
    return spark.createDataFrame(rows, BANDS), grids


def painted(found, size=150):
    """Grids of bands, none of which covers a pixel twice."""
    out = {}
    for r in found.collect():
        spot = out.setdefault((r["page_id"], r["mask_id"]), np.zeros((size, size), int))[r["y0"] : r["y1"], r["x0"] : r["x1"]]
        spot += 1
    assert all(v.max() == 1 for v in out.values())
    return {k: v > 0 for k, v in out.items()}


def same(a, b):
    assert a.keys() == {k for k, v in b.items() if v.any()} and all((a[k] == b[k]).all() for k in a)


def shifted(grid, by, test):
    wide = np.pad(grid, by)
    return test([wide[i : i + len(grid), j : j + len(grid)] for i in range(2 * by + 1) for j in range(2 * by + 1)], axis=0)


def test_union_and_morphology(spark):
    given, grids = planted(spark)
    same(painted(runs.union_bands(given, ["page_id", "mask_id"])), grids)
    same(painted(masks.dilated(given, 2)), {k: shifted(v, 2, np.any) for k, v in grids.items()})
    same(painted(masks.eroded(given, 3)), {k: shifted(v, 3, np.all) for k, v in grids.items()})
    sizes = given.select("page_id").distinct().select("page_id", F.lit(90).alias("width"), F.lit(80).alias("height"))
    held = {k: shifted(np.pad(v[:80, :90], ((0, 70), (0, 60)), mode="edge"), 2, np.all) for k, v in grids.items()}
    got = painted(masks.eroded(given.selectExpr("page_id", "mask_id", "y0", "least(y1, 80) as y1", "x0", "least(x1, 90) as x1").where("y0 < y1 and x0 < x1"), 2, sizes=sizes))
    same(got, {k: np.pad(v[:80, :90], ((0, 70), (0, 60))) for k, v in held.items()})


def test_bands_are_not_cut_into_rows(spark):
    """A band has few rows in the cut whatever its height: 2 masks of 6,400 rows meet in 100 tiles."""
    tall = spark.createDataFrame([("a", 0, 0, 6400, 0, 9), ("a", 1, 30, 6400, 5, 20)], BANDS)
    assert runs.cut_bands(tall, ["page_id"]).count() <= 2 * 101


def test_neighbour_areas(spark):
    given, grids = planted(spark)
    near = {}
    for r in masks.neighbour_runs(given).collect():
        near[r["page_id"], r["mask_id"]] = near.get((r["page_id"], r["mask_id"]), 0) + r["x1"] - r["x0"]
    assert {(r["page_id"], r["mask_id"]): r["area"] for r in masks.neighbour_areas(given).collect()} == near
    lone = given.where("page_id = 'a' and mask_id = 0")
    assert masks.neighbour_areas(lone).count() == 0


@pytest.mark.parametrize("placed", [False, True])
def test_overlaps_of_bands(spark, placed):
    given, grids = planted(spark)
    apart = runs.union_bands(given, ["page_id", "mask_id"])
    apart = apart.repartition("page_id") if placed else apart
    got = {(r["page_id"], r["a_mask"], r["b_mask"]): (r["a_area"], r["b_area"], r["common"]) for r in runs.overlaps(apart, apart, once=True, placed=placed).collect()}
    expected = {}
    for (p, m), a in grids.items():
        for (q, n), b in grids.items():
            if p == q and m < n and (a & b).any():
                expected[p, m, n] = (a.sum(), b.sum(), (a & b).sum())
    assert got == expected


def test_points_in_bands(spark):
    given, grids = planted(spark)
    points = [(p, i, i * 7 % 140, i * 11 % 150) for p in "abc" for i in range(60)]
    df = spark.createDataFrame(points, "page_id string, pos int, cx int, cy int")
    seeds = {(r["page_id"], r["mask_id"]): [tuple(s) for s in r["seeds"]] for r in masks.seeds(df, given).collect()}
    expected = {k: [(i, x, y) for p, i, x, y in points if p == k[0] and v[y, x]] for k, v in grids.items()}
    assert seeds == {k: v for k, v in expected.items() if v}
    first = {(r["page_id"], r["pos"]): r["mask_id"] for r in runs.assign_points(df, given.withColumn("mask_pos", F.col("mask_id")).distinct()).collect()}
    assert first == {(p, i): min(m for m in range(5) if grids[p, m][y, x]) for p, i, x, y in points if any(grids[p, m][y, x] for m in range(5))}


def shuffles(df):
    """Exchanges of a query's plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_neighbour_areas_in_one_shuffle(spark, monkeypatch):
    """Pages are dealt out once, not once for each window; masks of several bands, page ends, small pieces at a time."""
    given, grids = planted(spark)
    sizes = given.select("page_id").distinct().select("page_id", F.lit(90).alias("width"), F.lit(80).alias("height"))
    near = {}
    for r in masks.neighbour_runs(given, sizes=sizes).collect():
        near[r["page_id"], r["mask_id"]] = near.get((r["page_id"], r["mask_id"]), 0) + r["x1"] - r["x0"]
    found = masks.neighbour_areas(given, sizes=(90, 80))
    assert shuffles(found) == 1 and near
    area = lambda df: {(r["page_id"], r["mask_id"]): r["area"] for r in df.collect()}
    assert area(found) == near == area(masks.neighbour_areas(given, sizes=sizes)) == area(masks.neighbour_areas(runs.rows(given), sizes=(90, 80)))
    nameless = spark.createDataFrame([(None, 1, 0, 9, 0, 9), ("a", None, 0, 9, 0, 9)], BANDS)
    assert area(masks.neighbour_areas(given.unionByName(nameless), sizes=(90, 80))) == near
    band = np.array([r[2:] for r in given.orderBy("page_id", "mask_id").collect()]).T
    pages, names = np.repeat([0, 1, 2], 15), np.repeat(np.arange(15), 3)
    whole = masks.covered_areas(pages, names, band)
    assert whole[0].tolist() == [int(np.any([g for k, g in grids.items() if k[0] == p], axis=0).sum()) for p in "abc"]
    monkeypatch.setattr(masks, "MOST_RUNS", 5)
    assert all((a == b).all() for a, b in zip(masks.covered_areas(pages, names, band), whole))


def test_batches_of_whole_pages(monkeypatch):
    monkeypatch.setattr(runs, "BATCH", 1)
    rows = [("a", 1), ("a", 2), ("b", 3), ("c", 4), ("c", 5), ("c", 6), ("c", 7), ("d", 8)]
    for size in range(1, 9):
        batches = [pa.RecordBatch.from_pylist([{"p": p, "v": v} for p, v in rows[i : i + size]]) for i in range(0, 8, size)]
        found = [[tuple(r.values()) for r in b.to_pylist()] for b in runs._whole_pages(iter([batches[0].slice(0, 0), *batches]))]
        assert sum(found, []) == rows and all(a[-1][0] != b[0][0] for a, b in zip(found, found[1:]))
    monkeypatch.setattr(runs, "BATCH", 4)
    assert [b.num_rows for b in runs._whole_pages(iter(batches * 2))] == [7, 8, 1]


def test_subtraction_on_cells(spark, monkeypatch):
    """Pages of few bands are cut on cells, as on pixels, many at a time, and stay bands however tall."""
    random, rows = Random(12), []
    for page in [None, *range(60)]:
        for mask in range(random.randint(1, 6)):
            for _ in range(random.randint(1, 3)):
                y, x = random.randint(-40, 40), random.randint(-40, 40)
                rows.append((page, mask, y, y + random.randint(5, 70), x, x + random.randint(5, 70)))
    given = spark.createDataFrame(rows, BANDS.replace("string", "int"))
    moved = lambda df: painted(df.selectExpr("page_id", "mask_id", "y0 + 40 as y0", "y1 + 40 as y1", "x0 + 40 as x0", "x1 + 40 as x1"))
    found = masks.subtracted(given)
    assert shuffles(found) == 1
    cells = moved(found)
    monkeypatch.setattr(masks, "MOST_CELLS", 1)
    few = moved(masks.subtracted(given))
    monkeypatch.setattr(masks, "MOST_BANDS", 0)
    pixels = moved(masks.subtracted(given))
    assert cells.keys() == few.keys() == pixels.keys() and all((v == pixels[k]).all() and (v == few[k]).all() for k, v in cells.items())
    before = moved(runs.union_bands(given.where("page_id is not null"), ["page_id", "mask_id"]))
    assert any(k not in cells or (v != cells[k]).any() for k, v in before.items())
    monkeypatch.undo()
    tall = spark.createDataFrame([("a", 0, 0, 6400, 0, 20), ("a", 1, 3000, 8000, 10, 90)], BANDS)
    assert sorted(map(tuple, masks.subtracted(tall).collect())) == [("a", 0, 0, 6400, 0, 20), ("a", 1, 3000, 6400, 20, 90), ("a", 1, 6400, 8000, 10, 90)]


def test_overlaps_of_shapes(spark, monkeypatch):
    """Ovals meet without becoming rows of a table: the rows read are their boxes, and the result is that of their runs."""
    random, rows = Random(21), []
    for page in range(40):
        for mask in range(random.randint(1, 9)):
            y, x = random.randint(-30, 60), random.randint(-30, 60)
            rows.append((page, f"m{mask}", x, y, x + random.randint(0, 70), y + random.randint(0, 70)))
    rows += [(None, "m", 0, 0, 50, 50), (None, "n", 0, 0, 50, 50), (1, None, 0, 0, 50, 50), (1, "q", None, 0, 50, 50)]
    boxes = spark.createDataFrame(rows, "page_id int, mask_id string, a int, b int, c int, d int").select("page_id", "mask_id", g.box(*map(F.col, "abcd")).alias("bbox"))
    ovals = shapes.ellipses(boxes.where("page_id is not null and mask_id is not null"))
    same_rows = lambda df: sorted(map(tuple, df.select("page_id", "a_mask", "b_mask", "common").collect()))
    expected = same_rows(runs.overlaps(ovals, ovals, once=True))
    found = runs.shape_overlaps(boxes, shapes.ellipse_rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert shuffles(found) == 1 and "Generate" not in plan and "Join" not in plan
    assert len(expected) > 100 and same_rows(found) == expected
    assert same_rows(runs.shape_overlaps(boxes.repartition("page_id"), shapes.ellipse_rows, placed=True)) == expected
    monkeypatch.setattr(runs, "MOST_ROWS", 7)
    assert same_rows(runs.shape_overlaps(boxes, shapes.ellipse_rows)) == expected
