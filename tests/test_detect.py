"""The chain from found masks to balloons on one planted page and an empty one."""

import numpy as np

from folioflow.operators.splitting import grid_runs
from folioflow.plans import detect

from .test_splitting import disc

SHAPE = (420, 420)
BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


def test_detect(spark):
    fused = disc(SHAPE, (90, 70, 60, 50), (100, 155, 60, 50))
    copy = disc(SHAPE, (90, 70, 58, 48), (100, 155, 58, 48))
    big, small = disc(SHAPE, (300, 90, 80, 60)), disc(SHAPE, (350, 120, 40, 30))  # they overlap in part
    lone = disc(SHAPE, (200, 330, 60, 40))
    grids = {0: fused, 1: copy, 2: big, 3: small, 4: lone}
    rows = [("p", k, int(y), int(a), int(b)) for k, g in grids.items() for y, a, b in zip(*grid_runs(g, 0, 0))] + [("q", 0, y, 5, 90) for y in range(10, 40)]
    found = spark.createDataFrame(rows, "page_id string, mask_id int, y int, x0 int, x1 int")
    box = lambda x, y: (x - 20, y - 8, x + 20, y + 8)
    texts = spark.createDataFrame([("p", 0, box(90, 68)), ("p", 1, box(100, 158)), ("p", 2, box(285, 80)), ("p", 3, box(286, 95)), ("p", 4, box(20, 400))], f"page_id string, pos int, bbox {BOX}")
    balloons, masks = detect.detect(found, texts)
    held = {}
    for r in masks.collect():
        held.setdefault((r["page_id"], r["mask_id"]), np.zeros(SHAPE, bool))[r["y"], r["x0"] : r["x1"]] = True
    assert {k[0] for k in held} == {"p", "q"} and len(held) == 6  # two halves, big, small, lone, and page q
    for (page, k), g in held.items():
        assert page == "q" or any((g <= whole).all() for whole in (fused, big, small, lone))
    assert not any((held["p", i] & held["p", j]).any() for i in range(5) for j in range(i))
    listed = sorted(balloons.collect(), key=lambda r: (r["page_id"], r["balloon_id"]))
    page = [r for r in listed if r["page_id"] == "p"]
    assert [r["balloon_id"] for r in page] == list(range(7)) and sorted(r["pos"] for r in page if r["pos"] is not None) == [0, 1, 2, 3, 4]
    by_pos = {r["pos"]: r for r in page if r["pos"] is not None}
    assert len({by_pos[k]["mask_id"] for k in (0, 1, 2)}) == 3 and by_pos[3]["mask_id"] is None and tuple(by_pos[4]["bbox"]) == box(20, 400)
    assert [r["mask_id"] is not None for r in page if r["pos"] is None] == [True, True]
    centre = [(r["bbox"]["y1"] + r["bbox"]["y2"]) / 2 for r in page]
    assert page[0]["pos"] == 0 and centre[-1] > 300
    assert [(r["pos"], r["mask_id"], tuple(r["bbox"])) for r in listed if r["page_id"] == "q"] == [(None, 0, (5, 10, 90, 40))]
