"""Masks in which several balloons have grown together, taken apart.

A mask with several seeds (the centres of texts in it) is cut between two deep
concavities of its outline, again and again until each part has one seed. Where
that fails, it is eroded until it falls apart, parts and seeds are matched, and the
parts grow back. A mask without two seeds, or where both fail, is cut at its waist.

Spark deals the masks out and gathers each one's runs and seeds into a row of arrays;
what needs its outline or pixels (hull, cuts, components, growing back, margins) then
goes in one pass over the Arrow batches of a task, outlines of many masks together, and
no table is kept in between. Waists are found on the width profiles of all masks of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import masks as m
from folioflow.operators import rounds
from folioflow.operators import runs as r

#: The least depth of a concavity in pixels and as a share of the longer side; how many of the deepest
#: are tried; half the width of a cut; the share of a mask that a part must have; the largest distance of a seed from
#: its part; erosions at most and the least size of an eroded part; the margin beside a cut in pixels and as a share.
LEAST_DEPTH, LEAST_DEPTH_SHARE, DEEPEST, CUT_REACH = 8.0, 0.05, 6, 1.5
LEAST_PART, SEED_REACH, MOST_EROSIONS, LEAST_ERODED = 0.05, 20, 120, 150
MARGIN, MARGIN_SHARE = 12, 0.03
#: Fixed values of the waist: how far it falls below the lobes and below the median width, and the gap left open; the
#: ends where none is looked for; what a lobe must reach of the largest width, and over what share of the widths.
DIP, BELOW_MEDIAN, GAP = 0.85, 0.90, 6
MARGIN_WAIST, LOBE, LOBE_RUN = 0.15, 0.3, 0.08

KEY = ["page_id", "mask_id"]
RUN = ["y", "x0", "x1"]


def outer_points(at: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, ...]:
    """The outlines of masks as chains of points, four a mask: right and left ends of rows, bottom and top ends of columns.

    ``at`` counts the masks from 0, each has runs, sorted. Gives each point's chain (four
    times its mask and the number above), its place along the chain and how far out it lies.
    """
    edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    low, high = np.minimum.reduceat(x0, edge), np.maximum.reduceat(x1, edge)
    row = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (y[1:] != y[:-1])])
    right, left = np.maximum.reduceat(x1, row) - 1, x0[row]
    # A column begins and ends where the row above or below does not cover a run.
    start, top = np.cumsum(high - low) - (high - low), y[edge]
    line = y - top[at] + at * (int((y - top[at]).max()) + 3)  # rows of all masks, two free between them
    upper, lower = (np.full(int((high - low).sum()), -1) for _ in range(2))
    for ends, step in ((upper, 1), (lower, -1)):
        own, (rows, a, b) = outside(at, (line, x0, x1), (line + step, x0, x1))
        piece, x = r.steps(a - low[own] + start[own], b - a)
        ends[x[::-step]] = rows[piece][::-step]  # the last to be set counts
    column = np.flatnonzero(lower >= 0)
    own = np.searchsorted(start, column, "right") - 1
    shift = top[own] - own * (int((y - top[at]).max()) + 3)
    x, upper, lower = column - start[own] + low[own], upper[column] + shift, lower[column] + shift
    chain = np.r_[4 * at[row], 4 * at[row] + 1, 4 * own + 2, 4 * own + 3]
    return chain, np.r_[y[row], y[row], x, x], np.r_[right, -left, lower, -upper]


def hull_points(chain: np.ndarray, t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Indices of the upper hulls of chains of points that rise in ``t``.

    A point on or below the line between its neighbours is none of the hull's; all such
    go at once, until there are none.
    """
    at = np.arange(len(t))
    while True:
        k, p, w = chain[at], t[at], v[at]
        gone = np.zeros(len(at), bool)
        gone[1:-1] = (k[2:] == k[:-2]) & ((p[1:-1] - p[:-2]) * (w[2:] - w[:-2]) >= (w[1:-1] - w[:-2]) * (p[2:] - p[:-2]))
        if not gone.any():
            return at
        at = at[~gone]


#: Depth and place (x, y) of a concavity.
Deep = tuple[float, int, int]


def concavities(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> list[Deep]:
    """Depth and place (x, y) of the outline's concavities, the deepest first.

    Depth is the distance to the edge of the convex hull that spans the concavity. Of
    the points under one edge the deepest counts, the first by (y, x) if several do.
    """
    return concavities_of([(y, x0, x1)])[0] if len(y) else []


def concavities_of(masks: list[Runs]) -> list[list[Deep]]:
    """The concavities of each mask; none is empty."""
    if not masks:
        return []
    at = np.repeat(np.arange(len(masks)), [len(own[0]) for own in masks])
    runs = tuple(np.concatenate([own[c] for own in masks]) for c in range(3))
    chain, t, v = outer_points(at, *runs)
    order = r.sorted_by(chain, t)
    chain, t, v = chain[order], t[order], v[order]
    hull = hull_points(chain, t, v)
    last = np.r_[chain[1:] != chain[:-1], True]
    under = np.searchsorted(hull, np.arange(len(t)), "right") - 1  # the edge over each point but a chain's last
    start, end = hull[under], hull[np.minimum(under + 1, len(hull) - 1)]
    dt, dv = t[end] - t[start], v[end] - v[start]
    depth = np.where(last, -1.0, (dv * (t - t[start]) - dt * (v - v[start])) / np.where(last, 1.0, np.hypot(dt, dv)))
    peak = np.maximum.reduceat(depth, hull)
    size = [max(int(y[-1] - y[0]) + 1, int(x1.max() - x0.min())) for y, x0, x1 in masks]
    least = np.maximum(LEAST_DEPTH, LEAST_DEPTH_SHARE * np.asarray(size))
    found: list[dict[tuple, tuple]] = [{} for _ in masks]

    def place(i):
        k, along, out = int(chain[i]) % 4, int(t[i]), int(v[i])
        out = out if k % 2 == 0 else -out
        return (out, along) if k < 2 else (along, out)

    for i in np.flatnonzero((depth >= least[chain // 4]) & (depth == peak[under])).tolist():
        edge, (x, row), own = tuple(sorted((place(start[i]), place(end[i])))), place(i), found[int(chain[i]) // 4]
        rank = (-float(depth[i]), row, x)
        if rank < own.get(edge, (0.0,)):
            own[edge] = rank
    return [[(-d, x, row) for d, row, x in sorted(set(own.values()))] for own in found]


def segment_runs(p: tuple[int, int], q: tuple[int, int], reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pixels no farther than ``reach`` from a segment, as runs: one a row."""
    (ax, ay), (bx, by), pad = p, q, int(np.ceil(reach))
    ys, xs = np.arange(min(ay, by) - pad, max(ay, by) + pad + 1), np.arange(min(ax, bx) - pad, max(ax, bx) + pad + 1)
    dx, dy = bx - ax, by - ay
    share = np.clip(((xs[None] - ax) * dx + (ys[:, None] - ay) * dy) / max(dx * dx + dy * dy, 1), 0, 1)
    near = (xs[None] - ax - share * dx) ** 2 + (ys[:, None] - ay - share * dy) ** 2 <= reach * reach + 1e-9
    rows = near.any(axis=1)
    return ys[rows], xs[near[rows].argmax(axis=1)], xs[len(xs) - 1 - near[rows][:, ::-1].argmax(axis=1)] + 1


def without(y, x0, x1, cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs without a cut that has one run a row at most."""
    low = int(y.min())
    c0, c1 = np.full(int(y.max()) - low + 1, 1 << 30), np.full(int(y.max()) - low + 1, 1 << 30)
    inside = (cut[0] >= low) & (cut[0] <= y.max())
    c0[cut[0][inside] - low], c1[cut[0][inside] - low] = cut[1][inside], cut[2][inside]
    ys = np.concatenate([y, y])
    a, b = np.concatenate([x0, np.maximum(x0, c1[y - low])]), np.concatenate([np.minimum(x1, c0[y - low]), x1])
    order = np.lexsort((a, ys))
    keep = order[a[order] < b[order]]
    return ys[keep], a[keep], b[keep]


#: Sorted runs of a mask or a part: arrays ``y, x0, x1``. A seed: its number, whole coordinates, exact ones.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
Seed = tuple[int, int, int, float, float]


def size_of(runs: Runs) -> int:
    return int((runs[2] - runs[1]).sum())


def near_label(seed: Seed, label: np.ndarray, runs: Runs) -> int | None:
    """The label of the region in which, or near which, a seed lies.

    A window around the seed grows by 2 pixels up to ``SEED_REACH``; the first that
    meets a region gives the label, unless it meets two: that seed has none.
    """
    (_, x, row, _, _), (y, x0, x1) = seed, runs
    window = (np.maximum(np.maximum(x0 - x, x - x1 + 1), np.abs(y - row)) + 1) // 2 * 2
    first = window.min(initial=SEED_REACH + 1)
    met = set(label[window == first].tolist()) if first <= SEED_REACH else set()
    return met.pop() if len(met) == 1 else None


def best_cut(runs: Runs, seeds: list[Seed], least: float, deep: list[Deep]) -> tuple[Runs, list[tuple[int, Runs, list[Seed]]]] | None:
    """The best cut of a part between two of its concavities and its two halves, each with its label and its seeds, or None.

    Both halves keep ``least`` pixels and a seed; the shallower of the cut's two
    concavities is the deepest, of equal ones the first pair counts.
    """
    deep = deep[:DEEPEST]
    pairs = [(i, j) for i in range(len(deep)) for j in range(i + 1, len(deep))]
    for i, j in sorted(pairs, key=lambda p: -deep[p[1]][0]):  # the sort is stable
        line = segment_runs(deep[i][1:], deep[j][1:], CUT_REACH)
        y, x0, x1 = without(*runs, line)
        if not len(y):
            continue
        label = m.label_runs(y, x0, x1, corners=False)
        big = np.bincount(label, weights=x1 - x0) >= least
        if np.count_nonzero(big) != 2:
            continue
        kept = big[label]
        label, halves = label[kept], (y[kept], x0[kept], x1[kept])
        held = [near_label(s, label, halves) for s in seeds]
        if None in held or len(set(held)) != 2:
            continue
        own = [(k, label == k) for k in np.flatnonzero(big).tolist()]
        return line, [(k, tuple(c[at] for c in halves), [s for s, h in zip(seeds, held) if h == k]) for k, at in own]
    return None


Parts = list[tuple[str, Runs]]
#: A mask's parts, and the cuts or borders between them; None if it stays whole.
Apart = tuple[Parts, list[Runs]] | None


def cut_masks(masks: list[tuple[Runs, list[Seed]]]) -> list[Apart]:
    """Masks' parts, one for each seed, and their cuts; None if a part with several seeds has no cut.

    All parts that are still to be cut are looked at together.
    """
    least = [size_of(runs) * LEAST_PART for runs, _ in masks]
    done: list[Apart] = [([], []) for _ in masks]
    left = [(k, "", runs, seeds) for k, (runs, seeds) in enumerate(masks)]
    while left:
        deep = concavities_of([own for _, _, own, _ in left])
        later = []
        for (k, part, own, held), places in zip(left, deep):
            found = best_cut(own, held, least[k], places) if done[k] else None
            if found is None:
                done[k] = None
                continue
            done[k][1].append(found[0])
            for label, half, inside in found[1]:
                if len(inside) > 1:
                    later.append((k, f"{part}.{label}", half, inside))
                else:
                    done[k][0].append((f"{part}.{label}", half))
        left = [open_ for open_ in later if done[open_[0]]]
    return done


def as_grid(y, x0, x1) -> tuple[np.ndarray, int, int]:
    """Pixels of runs with one unset pixel around, and the place of the grid's corner."""
    top, left = int(y.min()) - 1, int(x0.min()) - 1
    grid = np.zeros((int(y.max()) - top + 2, int(x1.max()) - left + 1), bool)
    paint(grid, (y - top, x0 - left, x1 - left), True)
    return grid, top, left


def paint(grid: np.ndarray, runs: Runs, value) -> None:
    flat, wide = grid.reshape(-1), grid.shape[1]
    start = runs[0] * wide
    for a, b in zip((start + runs[1]).tolist(), (start + runs[2]).tolist()):
        flat[a:b] = value


def grid_runs(grid: np.ndarray, top: int, left: int) -> Runs:
    """Runs of the set pixels of a grid."""
    return _labelled_runs(grid, top, left)[1]


def _labelled_runs(grid: np.ndarray, top: int, left: int) -> tuple[np.ndarray, Runs]:
    """Runs of equal, set pixels of a grid, each with the value of its pixels."""
    wide = grid.shape[1] + 2
    flat = np.zeros(grid.shape[0] * wide + 1, grid.dtype)
    flat[:-1].reshape(-1, wide)[:, 1:-1] = grid
    at = np.flatnonzero(flat[1:] != flat[:-1])
    starts, ends = at[flat[at + 1] != 0] + 1, at[flat[at] != 0] + 1
    row = starts // wide
    shift = row * wide + 1 - left
    return flat[starts], (row + top, starts - shift, ends - shift)


#: The shorter side of a grid up to which distances are counted by erosions.
EROSIONS = 512


def distance(grid: np.ndarray) -> np.ndarray:
    """Steps, diagonal ones included, from each set pixel to the nearest unset one; the grid's edge must be unset.

    A pixel is as far as the number of times that the pixels beside unset ones can go
    before it goes. Very large grids, where that takes many times, go in two passes over
    their rows: in a row the smallest of d[k] + |x - k| is a running minimum of d[k] - k
    from the left and of d[k] + k from the right.
    """
    if min(grid.shape) <= EROSIONS:
        d = grid.astype(np.int16)
        left, i = grid, 0
        while left.any():
            i += 1
            left = left[:-2] & left[1:-1] & left[2:]
            left = left[:, :-2] & left[:, 1:-1] & left[:, 2:]
            d[i : len(d) - i, i : d.shape[1] - i] += left.view(np.int8)
        return d
    far = sum(grid.shape)
    d = np.where(grid, far, 0)
    place = np.arange(grid.shape[1])
    for rows in (range(1, len(d)), range(len(d) - 2, -1, -1)):
        step = 1 if rows.step == 1 else -1
        for i in rows:
            own, near = d[i], d[i - step] + 1
            np.minimum(own, near, out=own)
            np.minimum(own[1:], near[:-1], out=own[1:])
            np.minimum(own[:-1], near[1:], out=own[:-1])
            left = np.minimum.accumulate(own - place)
            right = np.minimum.accumulate((own + place)[::-1])[::-1]
            np.minimum(own, left + place, out=own)
            np.minimum(own, right - place, out=own)
    return d


def falling_parts(d: np.ndarray) -> np.ndarray:
    """Parts less holes of the pixels above each value from 0 on, corners joined, all in one pass.

    Pixels count as closed squares: corners less sides plus squares is the Euler number.
    """
    wide = np.pad(d, 1)
    across, down = np.maximum(wide[:, 1:], wide[:, :-1]), np.maximum(wide[1:], wide[:-1])
    corners = np.maximum(across[1:], across[:-1])
    top = int(d.max()) + 1
    above = lambda values: np.cumsum(np.bincount(values.ravel(), minlength=top)[::-1])[::-1]
    return (above(corners) - above(across) - above(down) + above(d))[1:]


def eroded_parts(runs: Runs, d: np.ndarray, top: int, left: int, wanted: int) -> list[Runs] | None:
    """The parts that a mask falls into at the fewest erosions that give as many as wanted, the largest if more.

    A mask without holes gets none when eroded, so the Euler number tells how many
    parts there are; only depths with enough are looked at, all depths if it has holes.
    """
    parts = falling_parts(d)
    holes = m.label_runs(*runs).max() + 1 > parts[0]
    for depth in range(1, min(MOST_EROSIONS + 1, len(parts))):
        if not holes and parts[depth] < wanted:
            continue
        found = grid_runs(d > depth, top, left)
        label = m.label_runs(*found)
        size = np.bincount(label, weights=found[2] - found[1])
        big = np.flatnonzero(size > LEAST_ERODED)
        if len(big) >= wanted:
            big = big[np.argsort(-size[big], kind="stable")][:wanted]
            return [tuple(c[label == k] for c in found) for k in sorted(big.tolist())]
    return None


def matched(parts: list[Runs], seeds: list[Seed]) -> dict[int, int]:
    """The part of each seed's number, each part once: nearest pairs of centre and seed first."""
    far = []
    for k, (y, x0, x1) in enumerate(parts):
        n = x1 - x0
        px, py = float((n * (x0 + x1 - 1) / 2).sum() / n.sum()), float((n * y).sum() / n.sum())
        far += [((px - cx) ** 2 + (py - cy) ** 2, k, number) for number, _, _, cx, cy in seeds]
    taken: dict[int, int] = {}
    for _, k, number in sorted(far):
        if number not in taken and k not in taken.values():
            taken[number] = k
    return taken


def grown(grid: np.ndarray, labels: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Labels spread over the set pixels: those of the highest level first, then lower ones, a ring at a time.

    A pixel takes the smallest label beside it, corners included. Only the pixels beside
    the last ring are looked at; those of a lower level wait for their turn. The grid's
    edge must be unset.
    """
    flat, wide, none = labels.copy().reshape(-1), grid.shape[1], labels.max() + 1
    near = np.array([i * wide + j for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    lasting = np.where(grid, level, 0).reshape(-1)
    met = np.where(flat > 0, True, lasting <= 0)  # labelled, waiting or not to be labelled

    def around(ring):
        fresh = (ring[:, None] + near).reshape(-1)
        fresh = np.unique(fresh[~met[fresh]])
        met[fresh] = True
        return fresh

    waiting: dict[int, list[np.ndarray]] = {}
    marked = np.flatnonzero(flat > 0)
    ring = around(marked[(marked > wide) & (marked < len(flat) - wide - 1)])
    for depth in range(int(level.max()), 0, -1):
        while True:
            high = lasting[ring]
            for low in np.unique(high[high < depth]).tolist():
                waiting.setdefault(low, []).append(ring[high == low])
            ring = np.concatenate([ring[high >= depth], *waiting.pop(depth, [])])
            if not len(ring):
                break
            beside = flat[ring[:, None] + near]
            flat[ring] = np.where(beside > 0, beside, none).min(axis=1)
            ring = around(ring)
    return flat.reshape(grid.shape)


def wear_mask(runs: Runs, seeds: list[Seed]) -> Apart:
    """A mask's parts, one for each seed, and the inner borders between them; None if it does not fall apart when eroded."""
    grid, top, left = as_grid(*runs)
    d = distance(grid)
    parts = eroded_parts(runs, d, top, left, len(seeds))
    if parts is None:
        return None
    taken = matched(parts, seeds)
    if len(taken) < len({s[0] for s in seeds}):
        return None
    labels = np.zeros(grid.shape, np.int64)
    for number, k in taken.items():
        y, x0, x1 = parts[k]
        paint(labels, (y - top, x0 - left, x1 - left), number)
    labels = grown(grid, labels, d)
    wide = np.pad(labels, 1)
    border = np.zeros(grid.shape, bool)
    for i in range(3):
        for j in range(3):
            other = wide[i : i + grid.shape[0], j : j + grid.shape[1]]
            border |= (labels > 0) & (other > 0) & (other != labels)
    label, found = _labelled_runs(labels, top, left)
    return [(str(k), tuple(c[label == k] for c in found)) for k in np.unique(label).tolist()], [grid_runs(border, top, left)]


def wear_masks(masks: list[tuple[Runs, list[Seed]]]) -> list[Apart]:
    return [wear_mask(*own) for own in masks]


def carved(runs: Runs, parts: Parts, lines: list[Runs]) -> Parts | None:
    """A mask's parts without a margin beside the cuts: within a round kernel of each of their pixels.

    None if a part is below ``LEAST_PART`` of the mask or the margin takes one whole.
    """
    y, x0, x1 = runs
    least, left, top = size_of(runs) * LEAST_PART, int(x0.min()), int(y.min())
    if any(size_of(own) < least for _, own in parts):
        return None
    high, wide = int(y.max()) - top + 1, int(x1.max()) - left
    reach = max(MARGIN, int(np.floor(min(high, wide) * MARGIN_SHARE)))
    off = np.arange(-reach, reach + 1)
    half = np.rint(np.sqrt(reach * reach - off * off)).astype(np.int64)
    cy, c0, c1 = (np.concatenate([line[i] for line in lines]) for i in range(3))
    if not len(cy):  # parts that never met
        return parts
    # Only the window around the cuts is looked at.
    top, left = max(top, int(cy.min()) - reach), max(left, int(c0.min()) - reach)
    high, wide = max(min(int(y.max()), int(cy.max()) + reach) - top + 1, 0), max(min(int(x1.max()), int(c1.max()) + reach) - left, 0)
    row = (cy[:, None] - top + off).reshape(-1)
    a, b = (np.clip(c, 0, wide).reshape(-1) for c in (c0[:, None] - left - half, c1[:, None] - left + half))
    inside = (row >= 0) & (row < high) & (a < b)
    at = row[inside] * (wide + 1)
    count = lambda ends: np.bincount(at + ends[inside], minlength=high * (wide + 1))
    near = grid_runs(np.cumsum((count(a) - count(b)).reshape(high, wide + 1), axis=1)[:, :-1] > 0, top, left)
    part = np.repeat(np.arange(len(parts)), [len(own[0]) for _, own in parts])
    label, found = outside(part, tuple(np.concatenate([own[c] for _, own in parts]) for c in range(3)), near)
    ends = np.searchsorted(label, np.arange(len(parts) + 1))
    final = [(name, tuple(c[ends[k] : ends[k + 1]] for c in found)) for k, (name, _) in enumerate(parts)]
    return final if all(len(own[0]) for _, own in final) else None


def outside(at: np.ndarray, runs: Runs, near: Runs) -> tuple[np.ndarray, Runs]:
    """What parts have outside ``near``, both sorted and merged: the part and the runs."""
    (y, x0, x1), (row, a, b) = runs, near
    if not len(row):
        return at, runs
    low = int(min(x0.min(), a.min()))
    wide = int(max(x1.max(), b.max())) - low + 1
    here, there = (y - y.min()) * wide - low, (row - y.min()) * wide - low
    first, last = np.searchsorted(there + b, here + x0, "right"), np.searchsorted(there + a, here + x1, "left")
    n = np.maximum(last - first, 0)  # so many of ``near`` meet a run: one piece more is left, some of them empty
    own, k = r.steps(first, n + 1)
    start = np.where(k == first[own], x0[own], b[np.maximum(k - 1, 0)])
    end = np.where(k == first[own] + n[own], x1[own], a[np.minimum(k, len(a) - 1)])
    kept = np.flatnonzero(start < end)
    return at[own[kept]], (y[own[kept]], start[kept], end[kept])


def taken_apart(masks: list[tuple[Runs, list[Seed]]]) -> list[Parts | None]:
    """Masks' parts by seeds: cut at concavities, else by erosion; None if both leave a mask whole."""
    final: list[Parts | None] = [None] * len(masks)
    for way in (cut_masks, wear_masks):
        left = [k for k, own in enumerate(final) if own is None]
        for k, apart in zip(left, way([masks[k] for k in left])):
            final[k] = carved(masks[k][0], *apart) if apart else None
    return final


def merged_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> Runs:
    """Sorted runs without empty ones; those of a row that overlap or touch are one."""
    return merged_by(np.zeros(len(y), np.int64), y, x0, x1)[1]


def merged_by(at: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, Runs]:
    """``merged_runs`` of many masks: each run's mask, and the runs."""
    order = r.sorted_by(at, y, x0)
    order = order[x0[order] < x1[order]]
    at, y, x0, x1 = at[order], y[order], x0[order], x1[order]
    if not len(y):
        return at, (y, x0, x1)
    other = np.r_[True, (at[1:] != at[:-1]) | (y[1:] != y[:-1])]
    shift = np.cumsum(other) * (int(x1.max() - x0.min()) + 1)
    reach = np.maximum.accumulate(x1 + shift) - shift  # of the runs of a row up to each
    opens = np.flatnonzero(other | np.r_[True, x0[1:] > reach[:-1]])
    return at[opens], (y[opens], x0[opens], reach[np.r_[opens[1:], len(reach)] - 1])


def gathered(masks: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """A row a mask, dealt out: ``page_id, mask_id, runs`` (``y, x0, x1``, one after the other) and ``seeds``, in order."""
    flat = F.flatten(F.collect_list(F.array("y", "x0", "x1"))).alias("runs")
    rows = rounds.spread(masks.select(*KEY, *RUN), *KEY).where("x0 < x1 and y is not null").groupBy(*KEY).agg(flat)
    if seeds is None:
        return rows
    point = F.struct("seed", F.bround("cx").cast("int").alias("x"), F.bround("cy").cast("int").alias("y"), F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
    return rows.join(seeds.groupBy(*KEY).agg(F.array_sort(F.collect_list(point)).alias("seeds")), KEY, "left")


def _seeds(found: list[dict] | None) -> list[Seed]:
    """Seeds with numbers from 1 in place of their names; none if one has no name or place."""
    found = found or []
    if any(s[c] is None for s in found for c in ("seed", "cx", "cy")):
        return []
    names: list = []
    for s in found:
        if not names or names[-1] != s["seed"]:
            names.append(s["seed"])
        s["number"] = len(names)
    return [(s["number"], s["x"], s["y"], s["cx"], s["cy"]) for s in found]


#: First row or column of each mask, where its widths begin, how many there are, and the widths of all.
Profile = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def width_profiles(at: np.ndarray, runs: Runs) -> tuple[Profile, Profile]:
    """Pixels of each row and of each column of masks' boxes; ``at`` counts the masks from 0, each has runs."""
    (y, x0, x1), edge = runs, np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    top, left = y[edge], np.minimum.reduceat(x0, edge)
    high, wide = y[np.r_[edge[1:], len(y)] - 1] + 1 - top, np.maximum.reduceat(x1, edge) - left
    start = np.cumsum(high) - high
    rows = np.bincount(start[at] + y - top[at], weights=x1 - x0, minlength=int(high.sum())).astype(np.int64)
    place = np.cumsum(wide + 1) - wide - 1  # one place more, behind the last column
    count = lambda x: np.bincount(place[at] + x - left[at], minlength=int((wide + 1).sum()))
    columns = np.delete(np.cumsum(count(x0) - count(x1)), place + wide)
    return (top, start, high, rows), (left, place - np.arange(len(place)), wide, columns)


def waists(start: np.ndarray, n: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sharpness (width to the largest one) and index of the waist of each mask's widths, smoothed; infinity if there is none.

    ``profile.waist`` on many masks at once, with a waist below the median width.
    """
    own = np.repeat(np.arange(len(n)), n)
    i, sums = np.arange(len(widths)) - start[own], np.r_[0, np.cumsum(widths)]
    low, high = np.maximum(i - 3, 0), np.minimum(i + 3, n[own] - 1)
    w = np.rint((sums[start[own] + high + 1] - sums[start[own] + low]) / (high - low + 1)).astype(np.int64)
    margin, far = np.floor(n * MARGIN_WAIST).astype(np.int64), int(w.max()) + len(w)
    inner = (i >= margin[own]) & (i < (n - margin)[own])
    least = np.minimum.reduceat(np.where(inner, w, far), start)
    place = np.minimum.reduceat(np.where(inner & (w == least[own]), i, far), start)
    most, wide = np.maximum.reduceat(w, start), w >= least[own] / DIP
    count = np.cumsum(wide)
    run = count - np.maximum.accumulate(np.where(wide, np.where(i == 0, count - 1, 0), count))
    sound = (n >= 20) & (least > 0)
    for side in (i < place[own], i > place[own]):
        peak, longest = (np.maximum.reduceat(np.where(side, v, -1), start) for v in (w, run))
        sound &= (peak >= LOBE * most) & (longest >= np.maximum(3, np.floor(n * LOBE_RUN)))
    rising, filled = w[r.sorted_by(own, w)], np.add.reduceat((w > 0).astype(np.int64), start)
    middle = [rising[start + n - filled + np.maximum(filled - k, 0) // 2 - (filled == 0)] for k in (1, 0)]
    sound &= least <= (middle[0] + middle[1]) / 2 * BELOW_MEDIAN
    return np.where(sound, least / np.maximum(most, 1), np.inf), place


def halved(at: np.ndarray, runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, Runs]:
    """Masks cut at their waist: which are, and the mask, side (0 or 1) and runs of their halves.

    ``at`` counts the masks from 0, each has runs, merged. Of two waists the sharper
    counts, of equally sharp ones the row's. Both halves keep ``LEAST_PART`` of the mask.
    """
    y, x0, x1 = runs
    (top, *rows), (left, *columns) = width_profiles(at, runs)
    (row, row_at), (column, column_at) = waists(*rows), waists(*columns)
    by_row = row <= column
    n, place, first = np.where(by_row, rows[1], columns[1]), np.where(by_row, row_at, column_at), np.where(by_row, top, left)
    half = np.maximum(GAP, np.floor(n * MARGIN_SHARE).astype(np.int64)) // 2
    opens, closes, across = (first + np.maximum(place - half, 0))[at], (first + np.minimum(place + half, n))[at], by_row[at]
    halves = [
        (np.where(across, y < opens, True), x0, np.where(across, x1, np.minimum(x1, opens))),
        (np.where(across, y >= closes, True), np.where(across, x0, np.maximum(x0, closes)), x1),
    ]
    size = lambda kept, a, b: np.bincount(at, weights=np.where(kept & (a < b), b - a, 0), minlength=len(n))
    least = size(True, x0, x1) * LEAST_PART
    cut = np.isfinite(np.minimum(row, column)) & np.all([size(*half) >= least for half in halves], axis=0)
    kept = [np.flatnonzero(keep & (a < b) & cut[at]) for keep, a, b in halves]
    side = np.repeat([0, 1], [len(k) for k in kept])
    found = tuple(np.concatenate([c[k] for c, k in zip(columns_, kept)]) for columns_ in ((y, y), (halves[0][1], halves[1][1]), (halves[0][2], halves[1][2])))
    return cut, at[np.concatenate(kept)], side, found


#: Masks whose outlines are looked at together.
TOGETHER = 64
PARTS = "part string, runs array<struct<y:int,x0:int,x1:int>>"


def _by_mask(rows: DataFrame, found: Callable[[list[tuple[Runs, dict]]], list[list[tuple[str | None, Runs]]]], halve: bool = False) -> DataFrame:
    """A row for each part that ``found`` gives for masks' runs and other columns: ``page_id, mask_id, part, runs``.

    ``halve``: the part '' of a mask with a name is cut at its waist, if it has one.
    """
    kinds = dict(rows.dtypes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs")
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 3), lists.offsets.to_numpy() // 3
            flat, ends = flat[ends[0] : ends[-1]], ends - ends[0]
            mask, merged = merged_by(np.repeat(np.arange(batch.num_rows), np.diff(ends)), *flat.T)
            ends = np.searchsorted(mask, np.arange(batch.num_rows + 1))
            others = batch.select([c for c in batch.schema.names if c not in (*KEY, "runs")]).to_pylist()
            given = [(tuple(c[ends[i] : ends[i + 1]] for c in merged), others[i] if others else {}) for i in range(batch.num_rows)]
            at, names, runs = [], [], []
            for start in range(0, len(given), TOGETHER):
                for i, parts in enumerate(found(given[start : start + TOGETHER]), start):
                    for name, own in parts:
                        at.append(i)
                        names.append(name)
                        runs.append(own)
            if halve:
                at, names, runs = _halve([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in KEY], at, names, runs)
            y, x0, x1 = (np.concatenate([own[c] for own in runs] or [np.empty(0, np.int64)]).astype(np.int32) for c in range(3))
            offsets = np.concatenate([[0], np.cumsum([len(own[0]) for own in runs])]).astype(np.int32)
            held = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in (y, x0, x1)], names=RUN))
            kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in KEY]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), held], names=[*KEY, "part", "runs"])

    return rows.mapInArrow(each, f"page_id {kinds['page_id']}, mask_id {kinds['mask_id']}, {PARTS}")


def _halve(named: list[np.ndarray], at: list, names: list, runs: list) -> tuple[list, list, list]:
    """Parts with their row and name; those named '' of masks with a name in halves, if they have a waist."""
    whole = [k for k, name in enumerate(names) if name == "" and len(runs[k][0]) and all(c[at[k]] for c in named)]
    if not whole:
        return at, names, runs
    lengths = [len(runs[k][0]) for k in whole]
    cut, mask, side, halves = halved(np.repeat(np.arange(len(whole)), lengths), tuple(np.concatenate([runs[k][c] for k in whole]) for c in range(3)))
    # Halves come by side, each mask's runs in one piece.
    edges = [np.searchsorted(mask[side == part], np.arange(len(whole) + 1)) + (part and int((side == 0).sum())) for part in (0, 1)]
    gone = {whole[k] for k in np.flatnonzero(cut).tolist()}
    kept = [k for k in range(len(names)) if k not in gone]
    at, names, runs, before = [at[k] for k in kept], [names[k] for k in kept], [runs[k] for k in kept], at
    for k in np.flatnonzero(cut).tolist():
        for part in (0, 1):
            here = slice(edges[part][k], edges[part][k + 1])
            at.append(before[whole[k]])
            names.append(str(part))
            runs.append(tuple(c[here] for c in halves))
    return at, names, runs


def _with_seeds(rows: list[tuple[Runs, dict]]) -> dict[int, tuple[Runs, list[Seed]]]:
    """Masks that have several seeds, by their places."""
    points = [_seeds(row["seeds"]) for _, row in rows]
    return {k: (runs, held) for k, ((runs, _), held) in enumerate(zip(rows, points)) if len(held) > 1 and len(runs[0])}


def _ways(masks: DataFrame, seeds: DataFrame, way: Callable) -> tuple[DataFrame, DataFrame]:
    """Parts and cuts of the masks with several seeds, by ``way``."""
    def found(rows):
        parts = [[] for _ in rows]
        several = _with_seeds(rows)
        for k, both in zip(several, way(list(several.values()))):
            parts[k] = [*both[0], *((None, line) for line in both[1])] if both else []
        return parts

    rows = rounds.written(_by_mask(gathered(masks, seeds), found), "apart")
    parts = rows.where("part is not null").select(*KEY, "part", F.inline("runs"))
    return parts, rows.where("part is null").select(*KEY, F.inline("runs"))


def cut_by_concavity(masks: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts and cuts of masks that fall into one part for each seed: ``page_id, mask_id, part, y, x0, x1`` and runs of the cuts.

    ``seeds``: ``page_id, mask_id, seed, cx, cy``. Every part with several seeds is cut
    along the best of its cuts: both sides keep ``LEAST_PART`` of the mask and a seed,
    the shallower of its two concavities is the deepest. A mask with a part that no cut
    divides is left out.
    """
    return _ways(masks, seeds, cut_masks)


def split_by_erosion(masks: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts and inner borders of masks that fall apart when eroded, as ``cut_by_concavity`` gives them.

    Each eroded part goes to one seed, nearest pairs first; a mask where one is left
    over is left out. The parts then grow back over the mask, from its middle outwards.
    """
    return _ways(masks, seeds, wear_masks)


def assembled(masks: DataFrame, parts: DataFrame, cuts: DataFrame) -> DataFrame:
    """Parts without a margin beside the cuts: ``page_id, mask_id, part, y, x0, x1``.

    Of a mask with a part below ``LEAST_PART`` of it, or with one that the margin takes
    whole, nothing comes out.
    """
    flat = F.flatten(F.collect_list(F.array("y", "x0", "x1")))
    own = parts.groupBy(*KEY, "part").agg(flat.alias("r")).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("part", "r"))).alias("parts"))
    rows = gathered(masks).join(own, KEY).join(cuts.groupBy(*KEY).agg(flat.alias("cuts")), KEY)
    as_runs = lambda numbers: tuple(np.asarray(numbers, dtype=np.int64).reshape(-1, 3).T)

    def found(rows):
        return [carved(runs, [(p["part"], merged_runs(*as_runs(p["r"]))) for p in row["parts"]], [as_runs(row["cuts"])]) or [] for runs, row in rows]

    return _by_mask(rows, found).select(*KEY, "part", F.inline("runs"))


#: Rows of masks that are looked at together.
MOST_ROWS = 1 << 20


def waist_bands(masks: DataFrame) -> DataFrame:
    """The two parts, ``0`` and ``1``, of each mask with a waist that leaves both ``LEAST_PART`` of it, as bands that share no pixel.

    Takes runs or bands; masks without a name are left out. Pages come in batches,
    whose masks are looked at together.
    """
    given = r.as_bands(masks).select(*KEY, "y0", "y1", "x0", "x1").where("page_id is not null and mask_id is not null and y0 < y1 and x0 < x1")

    def parts(batch: pa.RecordBatch) -> pa.RecordBatch:
        first = np.flatnonzero(r.changes(batch.column(0)) | r.changes(batch.column(1)))
        y0, y1, x0, x1 = (batch.column(c).to_numpy().astype(np.int64) for c in ("y0", "y1", "x0", "x1"))
        found = [(np.empty(0, np.int64),) * 6]
        high = np.cumsum(np.add.reduceat(y1 - y0, first)) if len(first) else np.zeros(0, np.int64)
        for some in np.split(np.arange(len(first)), np.flatnonzero(np.diff(high // MOST_ROWS)) + 1):
            if not len(some):
                continue
            low, end = first[some[0]], first[some[-1] + 1] if some[-1] + 1 < len(first) else len(y0)
            row, y = r.steps(y0[low:end], (y1 - y0)[low:end])
            at = np.searchsorted(first[some], np.arange(low, end), "right") - 1
            _, at, side, (y, a, b) = halved(*merged_by(at[row], y, x0[low:end][row], x1[low:end][row]))
            order = r.sorted_by(at, side, a, b, y)  # equal runs of successive rows are one band
            at, side, y, a, b = at[order], side[order], y[order], a[order], b[order]
            opens = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in (at, side, a, b)], axis=0) | (y[1:] != y[:-1] + 1)][: len(y)])
            bottom = y[np.r_[opens[1:], len(y)][: len(opens)] - 1] + 1
            found.append((first[some][at[opens]], side[opens], y[opens], bottom, a[opens], b[opens]))
        rows, side, *band = (np.concatenate(c) for c in zip(*found))
        kept = [batch.column(c).take(pa.array(rows)) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([*kept, pa.array(side).cast(pa.string()), *(pa.array(c.astype(np.int32)) for c in band)], names=[*KEY, "part", "y0", "y1", "x0", "x1"])

    kinds = dict(given.dtypes)
    return r.page_by_page(given, "page_id", ["mask_id"], parts, f"page_id {kinds['page_id']}, mask_id {kinds['mask_id']}, part string, y0 int, y1 int, x0 int, x1 int")


def waist_split(masks: DataFrame) -> DataFrame:
    """The runs of ``waist_bands``."""
    return r.rows(waist_bands(masks)).select(*KEY, "part", *RUN)


def split_fused(masks: DataFrame, seeds: DataFrame) -> DataFrame:
    """All masks, those of several balloons in parts: ``page_id, mask_id, part, y, x0, x1``; an undivided mask is part ``''``.

    Masks with several seeds are cut at concavities, else by erosion; what both leave
    whole, and masks without several seeds, at a waist, unless they have no name. Runs
    come out merged.
    """
    def found(rows):
        several = _with_seeds(rows)
        apart = dict(zip(several, taken_apart(list(several.values()))))
        return [apart.get(k) or [("", runs)] for k, (runs, _) in enumerate(rows)]

    parts = _by_mask(gathered(masks, seeds.select(*KEY, "seed", "cx", "cy")), found, halve=True)
    return parts.select(*KEY, "part", F.inline("runs"))
