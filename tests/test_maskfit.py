"""Texts inside masks against a plain version."""

import math
from random import Random

import numpy as np
import pytest

from folioflow.functions import layout
from folioflow.operators import maskfit

TABLE = {" ": 300, "i": 250, "m": 900}


def units(word):
    return sum(TABLE.get(c, layout.WIDE) for c in word)


def ellipse(cx, cy, a, b):
    return {y: (math.ceil(cx - a * math.sqrt(1 - ((y - cy) / b) ** 2)), math.floor(cx + a * math.sqrt(1 - ((y - cy) / b) ** 2)) + 1) for y in range(cy - b, cy + b + 1)}


def joined(*shapes):
    out = {}
    for shape in shapes:
        for y, (a, b) in shape.items():
            c, d = out.get(y, (a, b))
            out[y] = (min(a, c), max(b, d))
    return out


SHAPES = {
    "oval": ellipse(120, 80, 70, 45), "small": ellipse(40, 40, 14, 9), "two": joined(ellipse(100, 60, 60, 40), ellipse(130, 140, 70, 45)),
    "glass": {y: (60 - abs(y - 60), 140 + abs(y - 60)) for y in range(10, 111)}, "tail": joined(ellipse(120, 80, 70, 45), {y: (118, 122) for y in range(120, 170)}),
    "box": {y: (10, 150) for y in range(20, 90)},
}


def smooth(widths):
    return [round(float(np.mean(widths[max(0, i - 3) : i + 4]))) for i in range(len(widths))]


def body(widths):
    def first(w):
        peak, at = -1, 0
        for i, x in enumerate(w):
            if x < peak * 0.6:
                break
            if x >= peak:
                peak, at = x, i
        return next((i for i in range(at + 1) if w[i] >= peak * 0.5), at)

    a, b = first(widths), len(widths) - 1 - first(widths[::-1])
    return (0, len(widths) - 1) if a >= b else (a, b)


def waist(widths):
    n = len(widths)
    if n < 20:
        return None
    lo = int(n * 0.15)
    at = min(range(lo, n - lo), key=lambda i: widths[i])
    sides = widths[:at], widths[at + 1 :]
    run = lambda w: max(len(s) for s in "".join("x" if v >= widths[at] / 0.7 else " " for v in w).split(" "))
    if widths[at] <= 0 or any(max(s) < 0.3 * max(widths) or run(s) < max(3, int(n * 0.08)) for s in sides):
        return None
    return at


def plain(shape, words, trusted, smallest, largest, spacing=1.15):
    top = min(shape)
    at = lambda y: shape.get(round(y))
    width = lambda y: at(y)[1] - at(y)[0] - 1 if at(y) else 0
    wide = [width(y) for y in range(top, max(shape) + 1)]
    a, b = body(smooth(wide)) if trusted else (0, len(wide) - 1)
    centre = (min(x for x, _ in shape.values()) + max(x for _, x in shape.values())) // 2
    middle = lambda y: sum(at(y)[i] - i for i in (0, 1)) / 2 if at(y) else centre

    def zone(words, y0, extent, size):
        line = size * spacing
        room = lambda px: math.floor(1000 * max(px - 4, 0) / size)

        def fill(limit):
            lines = []
            for w in words:
                if lines and units(" ".join([*lines[-1], w])) <= limit(len(lines) - 1):
                    lines[-1].append(w)
                    continue
                if not 0 < units(w) <= limit(len(lines)):
                    return None
                lines.append([w])
            return lines

        lines = fill(lambda k: room(width(y0 + extent / 2)))
        if lines is None or len(lines) * line > extent:
            return None
        start = y0 + (extent - len(lines) * line) / 2
        lines = fill(lambda k: room(min(width(start + k * line + f * line) for f in (0, 0.5, 1))))
        if lines is None or len(lines) * line > extent:
            return None
        y = y0 + extent / 2 - ((len(lines) - 1) * line + size) / 2
        return [(" ".join(x), sum(middle(y + (k + f) * line) for f in (0, 0.5, 1)) / 3, y + k * line) for k, x in enumerate(lines)]

    cut = waist(smooth(wide[a : b + 1]))
    y0, y1 = top + a, top + b
    if cut is not None and len(words) > 1:
        cut += y0
        one, two = (sum(width(y) for y in range(*ends)) for ends in ((y0, cut + 1), (cut, y1 + 1)))
        target = max(1, min(len(words) - 1, round(len(words) * one / (one + two))))
        for size in range(largest, smallest - 1, -1):
            for n in sorted(range(1, len(words)), key=lambda n: abs(n - target)):
                parts = zone(words[:n], y0, cut - y0, size), zone(words[n:], cut, y1 - cut, size)
                if all(parts):
                    return size, parts[0] + parts[1]
    if trusted and words:
        for size in range(largest, smallest - 1, -1):
            if found := zone(words, y0, y1 - y0, size):
                return size, found
    return None, None


@pytest.mark.parametrize("trusted", [True, False])
def test_fit_mask(spark, trusted):
    random = Random(4)
    word = lambda: "".join(random.choice("aimxé") for _ in range(random.randint(1, 7)))
    texts = [" ".join(word() for _ in range(random.randint(0, 14))) for _ in range(12)] + ["", "x" * 40]
    runs = [("p", name, y, a, b) for name, shape in SHAPES.items() for y, (a, b) in shape.items()]
    rows = [("p", name, i, s) for name in [*SHAPES, "none"] for i, s in enumerate(texts)] + [("p", "oval", 99, None)]
    masks = spark.createDataFrame(runs, "page_id string, mask_id string, y int, x0 int, x1 int")
    given = spark.createDataFrame(rows, "page_id string, mask_id string, i int, said string")
    found, lobes = maskfit.fit_mask(given, masks, "said", TABLE, trusted, 8, 20).collect(), 0
    assert len(found) == len(rows)
    for r in found:
        words = (r["said"] or "").split()
        size, lines = plain(SHAPES[r["mask_id"]], words, trusted, 8, 20) if r["mask_id"] != "none" and words else (None, None)
        assert r["size"] == size, r
        assert (r["lines"] is None) == (lines is None)
        for ours, (text, cx, y) in zip(r["lines"] or [], lines or [], strict=True):
            assert ours["text"] == text and abs(ours["cx"] - cx) < 1e-6 and abs(ours["y"] - y) < 1e-6
        lobes += r["mask_id"] in ("two", "glass") and size is not None
    assert lobes > 5 and sum(r["size"] is not None for r in found) > (20 if trusted else 5)


def test_text_area(spark):
    runs = [("p", 1, y, a, b) for y, (a, b) in SHAPES["box"].items()]
    masks = spark.createDataFrame(runs, "page_id string, mask_id int, y int, x0 int, x1 int")
    rows = {r["y"]: (r["x0"], r["x1"]) for r in maskfit.text_area(masks).collect()}
    assert rows == {y: (13, 147) for y in range(23, 87)}


def test_long_text_in_two_lobes_is_not_tried_at_every_word(spark, monkeypatch):
    shape, asked = SHAPES["two"], []
    wide = [shape[y][1] - shape[y][0] - 1 for y in sorted(shape)]
    zone = maskfit._Shape.zone
    monkeypatch.setattr(maskfit._Shape, "zone", lambda *given: asked.append(1) or zone(*given))
    top, bottom = min(shape), max(shape)
    for n in (40, 5000):
        units = [units_ for units_ in (600, 1500, 2400, 900) for _ in range(n // 4)]
        asked.clear()
        found = maskfit._fitted(units, wide, (top, top), bottom, 95, 1000, 1200, True, 24, 8, 1.15, 300)
        assert len(asked) < 120 and (found is None) == (n == 5000)
    # the ways that are left are those of all that the middles of both lobes hold, in the same order
    random = Random(5)
    for _ in range(200):
        text = maskfit._Text([random.randint(0, 9) * 100 for _ in range(random.randint(2, 12))], 300)
        n, lines, limit = len(text.units), random.randint(0, 3), random.randint(0, 2500)

        def held(words):
            count, used = 0, None
            for w in words:
                if w > limit:
                    return False
                if used is None or used + 300 + w > limit:
                    count, used = count + 1, w
                else:
                    used += 300 + w
            return count <= lines

        assert text.reach(lines, limit) == max(k for k in range(n + 1) if held(text.units[:k]))
        assert text.reach_back(lines, limit) == min(k for k in range(n + 1) if held(text.units[k:]))
