"""Fills of lettering on a planted page."""

import numpy as np

from folioflow.plans import cleaning

from .test_pixels import color, runs_of, sizes_of


def rows_of(df, shape):
    out = np.zeros((*shape, 3), int)
    for r in df.collect():
        out[r["y"]] = [tuple(v) for v in r["values"]]
    return out


def test_fills(spark):
    page = np.full((100, 160, 3), (190, 240, 160))
    light, dark, letters = (np.zeros((100, 160), bool) for _ in range(3))
    light[10:60, 10:70] = True
    dark[10:60, 90:150] = True
    page[8:62, 8:72] = 0  # border
    page[12:58, 12:68] = (250, 250, 240)
    page[30:36, 30:50] = (5, 5, 5)  # letters
    page[14:40, 60:62] = 0  # a stroke that hangs on the border? it does not touch it
    page[dark] = (20, 30, 40)
    page[30:36, 110:130] = (255, 255, 255)
    page[75:90, 20:60] = (200, 180, 160)  # a caption
    letters[80:84, 26:50] = True
    page[letters] = 0
    images = {"p": page}
    masks = runs_of(spark, {("p", 1): light, ("p", 2): dark, ("p", 3): letters})
    boxes = [("p", 1, (10, 10, 70, 60), True), ("p", 2, (90, 10, 150, 60), True), ("p", 3, (26, 80, 50, 84), False), ("p", 4, (0, 0, 0, 0), True)]
    balloons = spark.createDataFrame(boxes, "page_id string, mask_id int, bbox struct<x1:int,y1:int,x2:int,y2:int>, shaped boolean")
    image = color(spark, images)
    found = cleaning.fills(image, balloons, masks, sizes_of(spark, images))
    want = page.copy()
    want[16:54, 16:64] = (250, 250, 240)
    want[16:54, 96:144] = (20, 30, 40)
    want[76:88, 22:54] = (200, 180, 160)
    clean = cleaning.painted(image, found)
    assert (rows_of(clean, (100, 160)) == want).all()
    back = cleaning.restored(clean, image, masks.where("mask_id = 2"))
    want[10:60, 90:150] = page[10:60, 90:150]
    assert (rows_of(back, (100, 160)) == want).all()
    extra = np.zeros((100, 160), bool)
    extra[64:68, 30:40] = True
    more = cleaning.fills(image, balloons, masks, sizes_of(spark, images), runs_of(spark, {("p", 1): extra}))
    assert (rows_of(cleaning.painted(image, more), (100, 160))[64:68, 30:40] == (250, 250, 240)).all()
