"""Fused masks taken apart, against pixels and plain versions."""

import math
from itertools import product
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import profile
from folioflow.operators import masks, rounds, splitting

RUNS = "page_id string, mask_id int, y int, x0 int, x1 int"
SEEDS = "page_id string, mask_id int, seed int, cx double, cy double"


def disc(shape, *ovals):
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    return np.any([((xx - cx) / a) ** 2 + ((yy - cy) / b) ** 2 <= 1 for cx, cy, a, b in ovals], axis=0)


def rows_of(page, mask, grid):
    return [(page, mask, int(y), int(a), int(b)) for y, a, b in zip(*splitting.grid_runs(grid, 0, 0))]


def parts_of(df, shape):
    out = {}
    for r in df.collect():
        out.setdefault((r["page_id"], r["mask_id"], r["part"]), np.zeros(shape, bool))[r["y"], r["x0"] : r["x1"]] = True
    return out


def test_greedy_matching(spark):
    random = Random(2)
    rows = [(p, a, b, random.randint(0, 6)) for p in "xyz" for a in range(7) for b in range(5) if random.random() < 0.8]
    rows += [(None, 1, 1, 3), (None, 1, 2, 3), (None, 2, 1, 3), ("x", None, 1, 0), ("x", 1, 1, None), ("x", 0, 0, 0), ("x", 0, 0, 0)]
    pairs = spark.createDataFrame(rows, "page string, a int, b int, cost int")
    taken = rounds.greedy_matching(pairs, ["page"], "a", "b", "cost")
    expected = set()
    for page in ("x", "y", "z", None):
        used_a, used_b = set(), set()
        for cost, a, b in sorted((c, a, b) for p, a, b, c in rows if p == page and None not in (a, b, c)):
            if a not in used_a and b not in used_b:
                expected.add((page, a, b, cost))
                used_a.add(a)
                used_b.add(b)
    assert {tuple(r) for r in taken.collect()} == expected
    short = {tuple(r) for r in rounds.unmatched(pairs.where("page is not null"), taken, ["page"], "a").collect()}
    assert short == {(p, a) for p, a, _, _ in rows if p and a is not None} - {(p, a) for p, a, _, _ in expected} | {("x", None)}
    assert rounds.greedy_matching(pairs.limit(0), ["page"], "a", "b", "cost").count() == 0


def test_distance_and_growth():
    rng = np.random.default_rng(5)
    for _ in range(20):
        grid = np.zeros((14, 17), bool)
        for _ in range(4):
            y, x = rng.integers(1, 9, 2)
            grid[y : y + rng.integers(1, 5), x : x + rng.integers(1, 8)] = True
        grid[0] = grid[-1] = False
        grid[:, 0] = grid[:, -1] = False
        off = [(y, x) for y, x in zip(*np.nonzero(~grid))]
        plain = np.array([[min(max(abs(y - v), abs(x - u)) for v, u in off) for x in range(17)] for y in range(14)])
        assert (splitting.distance(grid) == plain).all()
        labels = np.zeros(grid.shape, int)
        for k, (y, x) in enumerate(rng.permutation(np.argwhere(grid))[:3], 1):
            labels[y, x] = k
        found, level = splitting.grown(grid, labels, plain), plain
        want = labels.copy()
        for depth in range(level.max(), 0, -1):
            while True:
                ring = {}
                for y, x in zip(*np.nonzero(grid & (want == 0) & (level >= depth))):
                    near = [want[y + i, x + j] for i, j in product((-1, 0, 1), repeat=2) if want[y + i, x + j]]
                    if near:
                        ring[y, x] = min(near)
                if not ring:
                    break
                for at, k in ring.items():
                    want[at] = k
        assert (found == want).all()


def test_parts_at_every_depth():
    rng = np.random.default_rng(6)
    for _ in range(30):
        d = rng.integers(0, 5, (9, 11))
        for depth, n in enumerate(splitting.falling_parts(d)):
            y, x0, x1 = splitting.grid_runs(d > depth, 0, 0)
            holes = splitting.grid_runs(np.pad(d <= depth, 1, constant_values=True), 0, 0)
            parts, outside = (masks.label_runs(*runs, corners=c) for runs, c in (((y, x0, x1), True), (holes, False)))
            assert n == len(set(parts)) - (len(set(outside)) - 1)


def test_concavities():
    grid = disc((200, 160), (80, 60, 50, 45), (80, 135, 50, 45))
    y, x0, x1 = splitting.grid_runs(grid, 0, 0)
    found = splitting.concavities(y, x0, x1)
    assert len(found) == 2 and {p[1] > 80 for p in found} == {True, False} and all(abs(p[2] - 97) <= 2 for p in found)
    # brute force: hull depth of every outer point over all pairs of points on its side
    right = {int(r): int(x1[y == r].max() - 1) for r in np.unique(y)}
    depth = 0.0
    for r, x in right.items():
        for a, b in product(right, repeat=2):
            if a < r < b:
                depth = max(depth, ((right[b] - right[a]) * (r - a) - (b - a) * (x - right[a])) / math.hypot(b - a, right[b] - right[a]))
    assert abs(max(p[0] for p in found if p[1] > 80) - depth) < 1e-9
    turned = splitting.concavities(*splitting.grid_runs(grid.T, 0, 0))
    assert sorted((round(p[0], 6), p[2], p[1]) for p in turned) == sorted((round(p[0], 6), p[1], p[2]) for p in found)
    assert splitting.concavities(*splitting.grid_runs(disc((120, 120), (60, 60, 50, 40)), 0, 0)) == []


def test_segment():
    for p, q in [((3, 4), (20, 9)), ((5, 5), (5, 5)), ((9, 2), (1, 17)), ((0, 0), (12, 0)), ((4, 9), (4, 1))]:
        want = set()
        for y, x in product(range(-5, 30), repeat=2):
            dx, dy = q[0] - p[0], q[1] - p[1]
            t = max(0, min(1, ((x - p[0]) * dx + (y - p[1]) * dy) / max(dx * dx + dy * dy, 1)))
            if (x - p[0] - t * dx) ** 2 + (y - p[1] - t * dy) ** 2 <= 2.25 + 1e-9:
                want.add((y, x))
        assert {(y, x) for y, a, b in zip(*splitting.segment_runs(p, q, 1.5)) for x in range(a, b)} == want


SHAPE = (320, 260)
THREE = [(90, 70, 60, 50), (100, 155, 60, 50), (90, 240, 60, 50)]


def test_cut_by_concavity(spark):
    grids = {
        ("a", 1): (disc(SHAPE, *THREE[:2]), THREE[:2]), ("a", 2): (disc(SHAPE, *THREE), THREE), ("b", 1): (disc(SHAPE, THREE[0]), [THREE[0], (100, 80, 0, 0)]),
        ("b", 2): (disc(SHAPE, *THREE[:2]), [THREE[0], (92, 66, 0, 0)]), ("c", 1): (disc(SHAPE, THREE[0]), THREE[:1]),
    }
    given = spark.createDataFrame([r for (p, k), (g, _) in grids.items() for r in rows_of(p, k, g)], RUNS)
    seeds = spark.createDataFrame([(p, k, i, float(s[0]), float(s[1])) for (p, k), (_, ss) in grids.items() for i, s in enumerate(ss)], SEEDS)
    parts, cuts = splitting.cut_by_concavity(given, seeds)
    found = parts_of(parts, SHAPE)
    assert {(k[0], k[1]) for k in found} == {("a", 1), ("a", 2)} and len(found) == 5
    for (p, k), (grid, ss) in grids.items():
        own = [v for key, v in found.items() if key[:2] == (p, k)]
        if own:
            assert sorted(i for v in own for i, s in enumerate(ss) if v[s[1], s[0]]) == list(range(len(ss)))
            assert (np.sum(own, axis=0) <= grid).all() and np.sum(own) > 0.95 * grid.sum()
    drawn = parts_of(cuts.withColumn("part", F.lit("")), SHAPE)
    # margins: no pixel of an assembled part lies within the margin of a cut
    final = parts_of(splitting.assembled(given, parts, cuts), SHAPE)
    assert final.keys() == found.keys()
    for key, v in final.items():
        ys, xs = np.nonzero(drawn[key[0], key[1], ""])
        box = np.nonzero(grids[key[:2]][0])
        reach = max(12, int(min(np.ptp(box[0]) + 1, np.ptp(box[1]) + 1) * 0.03))
        near = np.zeros(SHAPE, bool)
        for dy in range(-reach, reach + 1):
            wide = round(math.sqrt(reach * reach - dy * dy))
            for y, x in zip(ys, xs):
                if 0 <= y + dy < SHAPE[0]:
                    near[y + dy, max(0, x - wide) : x + wide + 1] = True
        assert (v == (found[key] & ~near)).all()


def test_split_by_erosion(spark):
    bar = disc(SHAPE, (60, 60, 45, 45), (190, 60, 45, 45))
    bar[55:66, 60:190] = True
    seeds = [("p", 1, 0, 62.0, 58.0), ("p", 1, 1, 185.0, 61.0), ("p", 2, 0, 62.0, 58.0), ("p", 2, 1, 60.0, 61.0), ("p", 3, 0, 1.0, 1.0)]
    given = spark.createDataFrame(rows_of("p", 1, bar) + rows_of("p", 2, disc(SHAPE, (60, 60, 45, 45))) + rows_of("p", 3, bar), RUNS)
    parts, borders = splitting.split_by_erosion(given, spark.createDataFrame(seeds, SEEDS))
    found = parts_of(parts, SHAPE)
    assert found.keys() == {("p", 1, "1"), ("p", 1, "2")}
    left, right = found["p", 1, "1"], found["p", 1, "2"]
    assert left[58, 62] and right[61, 185] and not (left & right).any() and ((left | right) == bar).all()
    edge = parts_of(borders.withColumn("part", F.lit("")), SHAPE)["p", 1, ""]
    ys, xs = np.nonzero(edge)
    assert 110 < xs.min() and xs.max() < 140 and set(ys) == set(range(55, 66))


def test_waist_split(spark):
    tall, flat = np.zeros(SHAPE, bool), np.zeros(SHAPE, bool)
    tall[10:60, 20:120], tall[60:70, 50:90], tall[70:130, 25:110] = True, True, True
    flat[:] = False
    flat[: SHAPE[1], : SHAPE[0]][: 120, : 131] = tall.T[:120, :131]
    round_ones = disc(SHAPE, (100, 60, 60, 40), (110, 130, 70, 40))
    grids = {1: tall, 2: flat, 3: round_ones, 4: disc(SHAPE, (100, 60, 60, 40))}
    found = parts_of(splitting.waist_split(spark.createDataFrame([r for k, g in grids.items() for r in rows_of("p", k, g)], RUNS)), SHAPE)
    assert {k[1] for k in found} == {1, 2, 3}
    for k, axis in ((1, 0), (2, 1), (3, 0)):
        a, b = found["p", k, "0"], found["p", k, "1"]
        whole = grids[k]
        first = np.nonzero(whole.any(axis=1 - axis))[0]
        gap = [i for i in range(first[0], first[-1] + 1) if not (a | b).any(axis=1 - axis)[i]]
        cut = (gap[0] + gap[-1] + 1) // 2
        half = max(6, int((first[-1] - first[0] + 1) * 0.03)) // 2
        assert gap == list(range(cut - half, cut + half)), (k, gap)
        expected = whole.copy()
        expected[gap if axis == 0 else slice(None), gap if axis == 1 else slice(None)] = False
        assert ((a | b) == expected).all()


def test_split_fused(spark):
    bar = disc(SHAPE, (60, 60, 45, 45), (190, 60, 45, 45))
    bar[55:66, 60:190] = True
    tall = np.zeros(SHAPE, bool)
    tall[10:60, 20:120], tall[60:70, 50:90], tall[70:130, 25:110] = True, True, True
    grids = {1: disc(SHAPE, *THREE), 2: bar, 3: tall, 4: disc(SHAPE, (100, 60, 60, 40))}
    seeds = [("p", 1, i, float(s[0]), float(s[1])) for i, s in enumerate(THREE)] + [("p", 2, 0, 62.0, 58.0), ("p", 2, 1, 185.0, 61.0)]
    given = spark.createDataFrame([r for k, g in grids.items() for r in rows_of("p", k, g)], RUNS)
    found = parts_of(splitting.split_fused(given, spark.createDataFrame(seeds, SEEDS)), SHAPE)
    n = {k: sum(key[1] == k for key in found) for k in grids}
    assert n == {1: 3, 2: 2, 3: 2, 4: 1} and (found["p", 4, ""] == grids[4]).all()
    none = given.limit(0)
    assert splitting.split_fused(none, spark.createDataFrame([], SEEDS)).count() == 0
    assert masks.seeds(spark.createDataFrame([("p", 0, 60.0, 60.0)], "page_id string, pos int, cx double, cy double"), given).count() == 4


def test_split_fused_in_one_pass(spark, monkeypatch):
    """No table is kept between the steps; runs may overlap, and lie left of or above the page's corner."""
    grids = {k: disc(SHAPE, *THREE[:n]) for k, n in ((1, 2), (2, 3), (3, 1))}
    seeds = [("p", k, i, float(s[0]), float(s[1])) for k, n in ((1, 2), (2, 3), (3, 1)) for i, s in enumerate(THREE[:n])]
    rows = [r for k, g in grids.items() for r in rows_of("p", k, g)]
    given, points = spark.createDataFrame(rows, RUNS), spark.createDataFrame(seeds, SEEDS)
    monkeypatch.setattr(rounds, "written", lambda df, label: pytest.fail(f"{label} is written"))
    plain = parts_of(splitting.split_fused(given, points), SHAPE)
    assert {k: sum(key[1] == k for key in plain) for k in grids} == {1: 2, 2: 3, 3: 1}
    back = {"y": F.col("y") - 400, "x0": F.col("x0") - 300, "x1": F.col("x1") - 300}
    twice = given.unionByName(given.withColumn("x1", F.floor((F.col("x0") + F.col("x1") + 1) / 2).cast("int"))).withColumns(back)
    moved = splitting.split_fused(twice, points.withColumns({"cx": F.col("cx") - 300, "cy": F.col("cy") - 400}))
    found = parts_of(moved.withColumns({"y": F.col("y") + 400, "x0": F.col("x0") + 300, "x1": F.col("x1") + 300}), SHAPE)
    assert found.keys() == plain.keys() and all((found[k] == v).all() for k, v in plain.items())


def test_masks_without_a_name_stay_whole(spark):
    tall = np.zeros(SHAPE, bool)
    tall[10:60, 20:120], tall[60:70, 50:90], tall[70:130, 25:110] = True, True, True
    given = spark.createDataFrame(rows_of(None, 1, tall) + rows_of("p", None, tall) + rows_of("p", 1, tall), RUNS)
    found = parts_of(splitting.split_fused(given, spark.createDataFrame([], SEEDS)), SHAPE)
    assert found.keys() == {(None, 1, ""), ("p", None, ""), ("p", 1, "0"), ("p", 1, "1")}
    assert (found[None, 1, ""] == tall).all() and (found["p", None, ""] == tall).all()


def test_waists_of_many_masks(spark):
    """As the built-in functions find them, mask by mask, but for those no narrower than most of the mask."""
    random = Random(30)
    lists = [[random.choice((0, 3, 9, 12, 40, 50)) + random.randint(0, 3) for _ in range(random.randint(1, 60))] for _ in range(150)]
    lists += [[random.randint(20, 24)] * a + [random.randint(0, 20)] * b + [random.randint(15, 24)] * c for a, b, c in ((random.randint(1, 30), random.randint(1, 14), random.randint(1, 30)) for _ in range(250))]
    n = np.array([len(w) for w in lists])
    sharp, place = splitting.waists(np.cumsum(n) - n, n, np.concatenate(lists))
    smooth = profile.smooth(F.col("w"))
    at = profile.let(smooth, lambda w: profile.waist(w, F.lit(0), dip=splitting.DIP))
    found = 0
    for r in spark.createDataFrame(list(enumerate(lists)), "i int, w array<int>").select("i", smooth.alias("s"), at.alias("at")).collect():
        low = r["at"] is not None and r["s"][r["at"]] <= np.median([w for w in r["s"] if w > 0]) * splitting.BELOW_MEDIAN
        assert (np.isfinite(sharp[r["i"]])) == low, r
        if low:
            found += 1
            assert place[r["i"]] == r["at"] and sharp[r["i"]] == r["s"][r["at"]] / max(r["s"])
    assert 50 < found < 350


def test_waists_of_bands(spark, monkeypatch):
    """Bands stay bands, in one shuffle and without joins; a mask without a name is left out."""
    bands = [(10, 60, 20, 120), (60, 70, 50, 90), (70, 130, 25, 110), (80, 90, 30, 60)]
    given = spark.createDataFrame([(p, k, *b) for p, k in (("p", 1), ("p", 2), ("q", 1), (None, 1), ("p", None)) for b in bands], "page_id string, mask_id int, y0 int, y1 int, x0 int, x1 int")
    found = splitting.waist_bands(given)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    got = sorted(map(tuple, found.collect()))
    assert got == sorted((p, k, *b) for p, k in (("p", 1), ("p", 2), ("q", 1)) for b in (("0", 10, 60, 20, 120), ("1", 66, 70, 50, 90), ("1", 70, 130, 25, 110)))
    monkeypatch.setattr(splitting, "MOST_ROWS", 100)
    assert sorted(map(tuple, splitting.waist_bands(given).collect())) == got
    assert splitting.waist_bands(given.limit(0)).count() == 0


def test_outlines_of_many_masks():
    """Masks looked at together have the concavities of each alone; no loop over single runs."""
    rng, given = np.random.default_rng(8), []
    for _ in range(40):
        grid = disc((220, 200), *[(*rng.integers(40, 160, 2), *rng.integers(20, 45, 2)) for _ in range(rng.integers(1, 5))])
        grid[rng.integers(0, 150) :][:3] = False
        if grid.any():
            y, x0, x1 = splitting.grid_runs(grid, *rng.integers(-300, 300, 2))
            given.append((y, x0, x1))
    each = [splitting.concavities(*own) for own in given]
    assert splitting.concavities_of(given) == each and sum(map(len, each)) > 50
    for (y, x0, x1), found in zip(given, each):
        columns = {x: [row for row, a, b in zip(y, x0, x1) if a <= x < b] for x in range(x0.min(), x1.max())}
        chain, t, v = splitting.outer_points(np.zeros(len(y), int), y, x0, x1)
        for k, pick in ((2, max), (3, min)):
            assert dict(zip(t[chain == k].tolist(), (v if k == 2 else -v)[chain == k].tolist())) == {x: pick(rows) for x, rows in columns.items() if rows}
        assert all(row in columns[x] for _, x, row in found)


def test_pieces_outside():
    rng = np.random.default_rng(9)
    for _ in range(60):
        parts, near = rng.integers(0, 3, (8, 14)), rng.random((8, 14)) < rng.random()
        runs = [splitting.grid_runs(parts == k, -3, 5) for k in (1, 2)]
        at = np.repeat([0, 1], [len(own[0]) for own in runs])
        if len(at):
            label, found = splitting.outside(at, tuple(np.concatenate(c) for c in zip(*runs)), splitting.grid_runs(near, -3, 5))
            for k in (1, 2):
                assert all((a[label == k - 1] == b).all() for a, b in zip(found, splitting.grid_runs((parts == k) & ~near, -3, 5)))


def test_parts_that_never_met(spark):
    """Two balloons of one mask that lie apart have no border between them and stay as they are."""
    grids = {1: disc(SHAPE, (60, 60, 45, 45), (190, 60, 45, 45))}
    seeds = [("p", 1, 0, 60.0, 60.0), ("p", 1, 1, 190.0, 60.0)]
    found = parts_of(splitting.split_fused(spark.createDataFrame(rows_of("p", 1, grids[1]), RUNS), spark.createDataFrame(seeds, SEEDS)), SHAPE)
    assert len(found) == 2 and (np.any(list(found.values()), axis=0) == grids[1]).all()
