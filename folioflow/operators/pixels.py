"""Operators on pixels: rows ``page_id, y, values`` with one array of grey values (0 to 255), or of ``r, g, b``, a row.

Neighbours of equal value become one run (``value_runs``), so that thresholds,
floods and rays are joins, windows and grouping on runs, as for masks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import geometry as g
from folioflow.operators import masks as m
from folioflow.operators import rounds
from folioflow.operators import runs as r

#: Bins of the histograms and of the colour buckets; of text: the share of ink above which it is none, bounds
#: of a glyph's height, width, shape and filling, and what makes rows of glyphs a text.
BINS, BUCKET = 32, 8
MOST_INK, GLYPH_HEIGHT, GLYPH_WIDTH, GLYPH_SHAPE, GLYPH_FILL, GLYPH_AREA = 0.45, (0.03, 0.40), (0.004, 0.30), (0.08, 3.0), 0.20, 0.15
SOME_GLYPHS, LEAST_GLYPHS, ROW_GLYPHS, DENSE_ROWS, LEAST_UNIFORM, MOST_VARIED, ROW_GAP, LEAST_SIDE = 5, 8, 3, 2, 0.20, 0.55, 0.8, 12
#: Fixed values of rays: what is dark, the inset in pixels and as a share, the sides below which the search is widened by
#: up to ``WIDENED`` pixels, and below which nothing is found.
DARK, INSET, INSET_SHARE, SHORT, TOO_SHORT, WIDENED, WIDEN_LEAST = 110, 10, 0.2, 20, 8, 150, 40
#: Ink beside a mask's border and how deep it is kept; the colour flood; the pixels that a mean needs.
BORDER_DARK, BORDER_PAD, BORDER_DEPTH, TOLERANCE, GAIN, MOST_GAIN, MEAN_PIXELS = 130, 30, 20, 30, 1.02, 4, 200


def value_runs(image: DataFrame, page: str = "page_id") -> DataFrame:
    """Runs of equal values: ``page, y, x0, x1, value``, without a shuffle."""
    n = F.size("values")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~F.get("values", i).eqNullSafe(F.get("values", i - 1)))
    some = image.where(n > 0).select(page, "y", "values", starts.alias("_s"))
    ends = F.concat(F.slice("_s", 2, F.size("_s")), F.array(n))
    pairs = F.zip_with("_s", ends, lambda a, b: F.struct(a.alias("x0"), b.alias("x1")))
    found = some.select(page, "y", "values", F.explode(pairs).alias("_r"))
    return found.select(page, "y", F.col("_r.x0").alias("x0"), F.col("_r.x1").alias("x1"), F.get("values", F.col("_r.x0")).alias("value"))


def threshold_runs(image: DataFrame, test, page: str = "page_id") -> DataFrame:
    """Runs ``page, y, x0, x1`` of the pixels whose value passes ``test``."""
    passing = value_runs(image, page).where(test(F.col("value"))).select(page, "y", "x0", "x1")
    return r.union(passing, [page]).drop("run")


def histograms(image: DataFrame, page: str = "page_id", width: int = 1) -> DataFrame:
    """Pixels in each bin of ``width`` values: ``page, bins`` (an array)."""
    counts = value_runs(image, page).groupBy(page, F.floor(F.col("value") / width).cast("int").alias("bin")).agg(F.sum(F.col("x1") - F.col("x0")).alias("n"))
    found = counts.groupBy(page).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"))
    return found.select(page, F.transform(F.sequence(F.lit(0), F.lit(255 // width)), lambda i: F.coalesce(F.try_element_at("_m", i.cast("int")), F.lit(0))).alias("bins"))


def uniformity(image: DataFrame, page: str = "page_id") -> DataFrame:
    """The largest share of pixels that one of ``BINS`` bins of values holds."""
    held = histograms(image, page, 256 // BINS)
    return held.select(page, (F.array_max("bins") / F.aggregate("bins", F.lit(0).cast("long"), lambda n, k: n + k)).alias("uniformity"))


def otsu(bins: Column) -> Column:
    """The value that parts a histogram of 256 values with the largest variance between both sides; up to it is dark."""
    zero = F.lit(0.0)
    total = F.aggregate(bins, zero, lambda n, k: n + k)
    weighted = F.aggregate(F.transform(bins, lambda k, i: k * i), zero, lambda n, k: n + k)
    start = F.struct(zero.alias("n"), zero.alias("s"), zero.alias("best"), F.lit(0).alias("at"), F.lit(0).alias("i"), total.alias("total"), weighted.alias("all"))

    def step(a, k):
        n, s = a["n"] + k, a["s"] + k * a["i"]
        rest = a["total"] - n
        apart = F.when((n > 0) & (rest > 0), n * rest * F.pow(s / n - (a["all"] - s) / rest, 2)).otherwise(zero)
        better = apart > a["best"]
        return F.struct(
            n.alias("n"), s.alias("s"), F.when(better, apart).otherwise(a["best"]).alias("best"), F.when(better, a["i"]).otherwise(a["at"]).alias("at"),
            (a["i"] + 1).alias("i"), a["total"].alias("total"), a["all"].alias("all"),
        )

    return F.aggregate(bins, start, step)["at"]


def text_likeness(crops: DataFrame, page: str = "page_id") -> DataFrame:
    """Whether each crop looks like text: ``page, suspect, glyphs, dense_rows, uniformity, spread``.

    Dark and light ink is tried, parted at the crop's own threshold; ink that covers
    most of a crop is none. Parts of a glyph's size and shape are counted, their middles
    form rows, and ``spread`` is the deviation of their heights to the mean. Of the two
    inks the one with more glyphs counts, the dark one if equal. Crops below
    ``LEAST_SIDE`` pixels a side, or without ``SOME_GLYPHS``, have 0 glyphs.
    """
    sides = crops.groupBy(page).agg(F.count("*").alias("h"), F.max(F.size("values")).alias("w"))
    parted = histograms(crops, page).select(page, otsu(F.col("bins")).alias("cut"))
    marked = value_runs(crops, page).join(parted, page).withColumn("mask_id", (F.col("value") > F.col("cut")).cast("int"))
    inks = marked.select(page, "mask_id", "y", "x0", "x1")
    n = F.sum(F.col("x1") - F.col("x0"))
    share = inks.groupBy(page, "mask_id").agg(n.alias("ink")).join(sides, page).where(F.col("ink") <= MOST_INK * F.col("h") * F.col("w"))
    share = share.where(F.least("h", "w") >= LEAST_SIDE).select(page, "mask_id", "h", "w")
    parts = m.components(inks.join(share.select(page, "mask_id"), [page, "mask_id"]), page=page)
    boxes = parts.groupBy(page, "mask_id", "part").agg(
        n.alias("area"), (F.max("y") - F.min("y") + 1).alias("ch"), (F.max("x1") - F.min("x0")).alias("cw"), F.min("y").alias("top")
    ).join(share, [page, "mask_id"])
    within = lambda v, side, ends: (v >= F.col(side) * ends[0]) & (v <= F.col(side) * ends[1])
    box = F.col("cw") * F.col("ch")
    glyph = within(F.col("ch"), "h", GLYPH_HEIGHT) & within(F.col("cw"), "w", GLYPH_WIDTH)
    glyph = glyph & (F.col("cw") / F.col("ch")).between(*GLYPH_SHAPE) & (F.col("area") >= GLYPH_FILL * box) & (F.col("area") <= GLYPH_AREA * F.col("h") * F.col("w"))
    each = Window.partitionBy(page, "mask_id")
    found = boxes.where(glyph).withColumns({"middle": F.col("top") + F.col("ch") / 2, "usual": F.median("ch").over(each), "n": F.count("*").over(each)}).where(F.col("n") >= SOME_GLYPHS)
    down = each.orderBy("middle", "part")
    opens = F.coalesce(F.col("middle") - F.lag("middle").over(down) > F.col("usual") * ROW_GAP, F.lit(False)).cast("int")
    rows = found.withColumn("opens", opens).withColumn("row", F.sum("opens").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    by_row = rows.groupBy(page, "mask_id", "row").agg(F.count("*").alias("k"))
    dense = by_row.groupBy(page, "mask_id").agg(F.count_if(F.col("k") >= ROW_GLYPHS).alias("dense_rows"))
    spread = found.groupBy(page, "mask_id").agg(F.count("*").alias("glyphs"), (F.stddev_pop("ch") / F.avg("ch")).alias("spread")).join(dense, [page, "mask_id"])
    best = spread.groupBy(page).agg(F.max_by(F.struct("glyphs", "dense_rows", "spread"), F.struct("glyphs", -F.col("mask_id"))).alias("b"))
    known = uniformity(crops, page).join(best, page, "left")
    suspect = (F.col("b.glyphs") >= LEAST_GLYPHS) & (F.col("b.dense_rows") >= DENSE_ROWS) & (F.col("uniformity") >= LEAST_UNIFORM) & (F.col("b.spread") <= MOST_VARIED)
    zero = F.lit(0).cast("long")
    return known.select(
        page, F.coalesce(suspect, F.lit(False)).alias("suspect"), F.coalesce("b.glyphs", zero).alias("glyphs"), F.coalesce("b.dense_rows", zero).alias("dense_rows"),
        "uniformity", F.col("b.spread").alias("spread"),
    )


def dominant_colors(pixels: DataFrame, by: list[str]) -> DataFrame:
    """The mean ``r, g, b`` of the most frequent bucket of colours (``BUCKET`` values a channel) of each key.

    ``pixels`` have ``r, g, b`` and ``n``, how many there are. Of equally frequent buckets the darkest by
    (red, green, blue) counts.
    """
    buckets = [F.floor(F.col(c) / BUCKET).alias(f"_{c}") for c in "rgb"]
    sums = pixels.groupBy(*by, *buckets).agg(F.sum("n").alias("n"), *(F.sum(F.col(c) * F.col("n")).alias(c) for c in "rgb"))
    order = F.struct(-F.col("n"), "_r", "_g", "_b")
    best = sums.groupBy(*by).agg(F.min_by(F.struct("n", "r", "g", "b"), order).alias("_p"))
    return best.select(*by, *((F.col(f"_p.{c}") / F.col("_p.n")).alias(c) for c in "rgb"))


def covered_runs(image: DataFrame, masks: DataFrame, page: str = "page_id") -> DataFrame:
    """Value runs under each mask: ``page, mask_id, y, x0, x1, value``."""
    under = value_runs(image, page).select(page, "y", F.col("x0").alias("_a"), F.col("x1").alias("_b"), "value")
    met = masks.select(page, "mask_id", "y", "x0", "x1").join(under, [page, "y"]).where("_a < x1 and x0 < _b")
    return met.select(page, "mask_id", "y", F.greatest("x0", "_a").alias("x0"), F.least("x1", "_b").alias("x1"), "value")


def mean_values(image: DataFrame, boxes: DataFrame, masks: DataFrame | None = None, page: str = "page_id") -> DataFrame:
    """The mean value under each mask, or of its whole box if the mask has few pixels there: ``page, mask_id, mean``."""
    b = F.col("bbox")
    rows = boxes.where("bbox.x2 > bbox.x1 and bbox.y2 > bbox.y1").select(page, "mask_id", F.explode(F.sequence(b["y1"], b["y2"] - 1)).alias("y"), b["x1"].alias("x0"), b["x2"].alias("x1"))
    n = F.col("x1") - F.col("x0")
    mean = lambda found, name: covered_runs(image, found, page).groupBy(page, "mask_id").agg(F.sum(n).alias(f"{name}_n"), (F.sum(n * F.col("value")) / F.sum(n)).alias(name))
    whole = mean(rows, "box")
    if masks is None:
        return whole.select(page, "mask_id", F.col("box").alias("mean"))
    inside = boxes.select(page, "mask_id", "bbox").join(masks.select(page, "mask_id", "y", "x0", "x1"), [page, "mask_id"])
    inside = inside.where("y >= bbox.y1 and y < bbox.y2").select(page, "mask_id", "y", F.greatest("x0", "bbox.x1").alias("x0"), F.least("x1", "bbox.x2").alias("x1")).where("x0 < x1")
    both = whole.join(mean(inside, "mask"), [page, "mask_id"], "left")
    return both.select(page, "mask_id", F.when(F.col("mask_n") >= MEAN_PIXELS, F.col("mask")).otherwise(F.col("box")).alias("mean"))


def ray_extents(image: DataFrame, boxes: DataFrame, sizes: DataFrame, page: str = "page_id") -> DataFrame:
    """The room around each box's centre: ``page, mask_id, extent``, a box or null.

    Rays go left, right, up and down to the first dark pixel or the end of the box, in a
    second try to that of a wider one. ``boxes`` may have ``cx, cy`` in place of the
    centre. A dark centre, or less than ``TOO_SHORT`` pixels of room, gives null. The
    nearest dark pixels are looked up once, by row and by tiles of columns.
    """
    tile = 5
    b, has = F.col("bbox"), {"cx", "cy"} <= set(boxes.columns)
    placed = boxes.join(sizes.select(page, "width", "height"), page).select(
        page, "mask_id", g.box(F.greatest(b["x1"], F.lit(0)), F.greatest(b["y1"], F.lit(0)), F.least(b["x2"], "width"), F.least(b["y2"], "height")).alias("bbox"),
        "width", "height", *((F.col(c) if has else F.lit(None).cast("int")).alias(f"_{c}") for c in ("cx", "cy")),
    )
    own = lambda c, low, high: F.coalesce(F.col(c), F.floor((b[low] + b[high]) / 2))
    placed = placed.withColumns({"_cx": own("_cx", "x1", "x2"), "_cy": own("_cy", "y1", "y2")})
    held = lambda c, low, high, side: F.greatest(F.lit(0), F.least(F.col(side) - 1, F.greatest(b[low], F.least(b[high] - 1, F.col(c))))).cast("int")
    placed = placed.withColumns({"cx": held("_cx", "x1", "x2", "width"), "cy": held("_cy", "y1", "y2", "height")}).drop("_cx", "_cy")
    dark = value_runs(image, page).where(F.col("value") < DARK).drop("value")
    along = placed.select(page, "mask_id", "cx", F.col("cy").alias("y")).join(dark, [page, "y"]).groupBy(page, "mask_id").agg(
        F.max(F.when(F.col("x1") <= F.col("cx"), F.col("x1") - 1)).alias("left"), F.min(F.when(F.col("x0") > F.col("cx"), F.col("x0"))).alias("right"),
        F.count_if((F.col("x0") <= F.col("cx")) & (F.col("x1") > F.col("cx"))).alias("covered"),
    )
    tiled = dark.withColumn("tile", F.explode(F.sequence(F.shiftright("x0", tile), F.shiftright(F.col("x1") - 1, tile))))
    across = placed.select(page, "mask_id", "cx", "cy", F.shiftright("cx", tile).alias("tile")).join(tiled, [page, "tile"]).where("x0 <= cx and cx < x1").groupBy(page, "mask_id").agg(
        F.max(F.when(F.col("y") < F.col("cy"), F.col("y"))).alias("up"), F.min(F.when(F.col("y") > F.col("cy"), F.col("y"))).alias("down")
    )
    met = placed.join(along, [page, "mask_id"], "left").join(across, [page, "mask_id"], "left")

    def cast(x1, y1, x2, y2):
        ends = [F.greatest(x1, "left"), F.greatest(y1, "up"), F.least(x2 - 1, "right"), F.least(y2 - 1, "down")]
        inset = [F.least(F.lit(float(INSET)), F.greatest(F.lit(0.0), (ends[i + 2] - ends[i]) * INSET_SHARE)) for i in (0, 1)]
        return g.box(ends[0] + inset[0], ends[1] + inset[1], ends[2] - inset[0], ends[3] - inset[1])

    pad = [F.least(F.lit(WIDENED), F.greatest(b[high] - b[low], F.lit(WIDEN_LEAST))) for low, high in (("x1", "x2"), ("y1", "y2"))]
    wider = cast(
        F.greatest(F.lit(0), b["x1"] - pad[0]), F.greatest(F.lit(0), b["y1"] - pad[1]), F.least(F.col("width") - 1, b["x2"] + pad[0]), F.least(F.col("height") - 1, b["y2"] + pad[1])
    )
    met = met.withColumns({"_near": cast(b["x1"], b["y1"], b["x2"], b["y2"]), "_wide": wider})
    short = lambda e, least: (e["x2"] - e["x1"] < least) | (e["y2"] - e["y1"] < least)
    near, wide = F.col("_near"), F.col("_wide")
    chosen = F.when(short(near, SHORT) & ~short(wide, SHORT), wide).otherwise(near)
    met = met.withColumn("_e", F.when(F.coalesce("covered", F.lit(0)) == 0, chosen))
    whole = g.box(*(F.col(f"_e.{c}").cast("int") for c in ("x1", "y1", "x2", "y2")))
    return met.select(page, "mask_id", F.when(F.col("_e").isNotNull() & ~short(F.col("_e"), TOO_SHORT), whole).alias("extent"))


def flood(image: DataFrame, seeds: DataFrame, tolerance: int = TOLERANCE, page: str = "page_id") -> DataFrame:
    """The pixels that hang together, side by side, with each seed (``mask_id, cx, cy``) and differ little from its colour.

    Runs ``page, mask_id, y, x0, x1``. The difference is summed over ``r, g, b``.
    """
    colors = value_runs(image, page)
    at = seeds.select(page, "mask_id", "cx", F.col("cy").alias("y")).join(colors, [page, "y"]).where("x0 <= cx and cx < x1").select(page, "mask_id", "cx", F.col("y").alias("cy"), F.col("value").alias("_seed"))
    apart = sum((F.abs(F.col(f"value.{c}") - F.col(f"_seed.{c}")) for c in "rgb"), F.lit(0))
    like = colors.join(at, page).where(apart <= tolerance).select(page, "mask_id", "y", "x0", "x1")
    parts = m.components(like, corners=False, page=page)
    hit = parts.join(at.select(page, "mask_id", "cx", F.col("cy").alias("y")), [page, "mask_id", "y"]).where("x0 <= cx and cx < x1").select(page, "mask_id", "part")
    return parts.join(hit, [page, "mask_id", "part"], "left_semi").drop("part")


def drawn_shapes(image: DataFrame, masks: DataFrame, boxes: DataFrame, sizes: DataFrame, page: str = "page_id") -> DataFrame:
    """Masks with the flat area around their box's centre, where it is a plausible part of the same shape.

    Left out of the area is what other masks, grown by 3 pixels, cover. A mask stays as
    it is unless it becomes wider or higher by more than 2 %, by 4 times at most, and swallows no other.
    """
    b = F.col("bbox")
    mid = lambda low, high, side: F.greatest(F.lit(0), F.least(F.col(side) - 1, F.floor((b[low] + b[high]) / 2))).cast("int")
    seeds = boxes.join(sizes, page).select(page, "mask_id", mid("x1", "x2", "width").alias("cx"), mid("y1", "y2", "height").alias("cy"))
    boxes = boxes.select(page, "mask_id", "bbox")
    own = lambda rows: rows.select(F.to_json(F.struct(page, "mask_id")).alias("_key"), page, "mask_id", "y", "x0", "x1")
    area = own(flood(image, seeds, page=page))
    near = own(m.neighbour_runs(masks, 3, page, sizes))
    free = r.difference(area.select("_key", "mask_id", "y", "x0", "x1"), near.select("_key", "mask_id", "y", "x0", "x1"), "_key")
    names = area.select("_key", page).distinct()
    found = rounds.written(free.join(names, "_key").select(page, "mask_id", "y", "x0", "x1"), "flat")
    both = r.union(masks.select(page, "mask_id", "y", "x0", "x1").unionByName(found), [page, "mask_id"])
    box = lambda rows, name: r.measure(rows, page).select(page, "mask_id", g.box(F.col("left"), F.col("top"), F.col("right"), F.col("bottom")).alias(name))
    sized = box(masks, "before").join(box(both, "after"), [page, "mask_id"]).join(found.select(page, "mask_id").distinct(), [page, "mask_id"])
    others = boxes.select(page, F.col("mask_id").alias("_m"), "bbox").groupBy(page).agg(F.collect_list(F.struct("_m", "bbox")).alias("_all"))
    sized = sized.join(others, page, "left")
    beside = F.transform(F.filter("_all", lambda o: o["_m"] != F.col("mask_id")), lambda o: o["bbox"])
    side = lambda name, low, high: F.col(f"{name}.{high}") - F.col(f"{name}.{low}") - 1
    ways = [(side("after", *e), side("before", *e)) for e in (("x1", "x2"), ("y1", "y2"))]
    gains = (ways[0][0] > ways[0][1] * GAIN) | (ways[1][0] > ways[1][1] * GAIN)
    sound = (ways[0][0] <= ways[0][1] * MOST_GAIN) & (ways[1][0] <= ways[1][1] * MOST_GAIN)
    taken = sized.where(gains & sound & ~m.swallows(F.col("before"), F.col("after"), F.coalesce(beside, F.array().cast(sized.select(F.transform("_all", lambda o: o["bbox"]).alias("x")).schema["x"].dataType)))).select(page, "mask_id")
    plain = masks.select(page, "mask_id", "y", "x0", "x1")
    return plain.join(taken, [page, "mask_id"], "left_anti").unionByName(both.select(*plain.columns).join(taken, [page, "mask_id"], "left_semi"))


def without_border_ink(image: DataFrame, raw: DataFrame, inner: DataFrame, sizes: DataFrame, page: str = "page_id") -> DataFrame:
    """``inner`` (masks shrunk from ``raw``) without the ink of the balloon's own border.

    Dark pixels around a mask fall into parts. One that reaches into ``inner`` and also
    out of the raw mask is border: its pixels within ``BORDER_DEPTH`` of the outside stay as they are.
    """
    by = [page, "mask_id"]
    box = r.measure(raw, page).join(sizes, page).select(
        *by, F.greatest(F.col("left") - BORDER_PAD, F.lit(0)).alias("_l"), F.greatest(F.col("top") - BORDER_PAD, F.lit(0)).alias("_t"),
        F.least(F.col("right") + BORDER_PAD, F.col("width")).alias("_r"), F.least(F.col("bottom") + BORDER_PAD, F.col("height")).alias("_b"),
    )
    key = F.to_json(F.struct(*by))
    rows = box.select(*by, F.explode(F.sequence("_t", F.col("_b") - 1)).alias("y"), F.col("_l").alias("x0"), F.col("_r").alias("x1"))
    window = covered_runs(image, rows, page).where(F.col("value") < BORDER_DARK)
    dark = rounds.written(m.components(window.select(*by, "y", "x0", "x1"), page=page).withColumn("_key", key), "dark")  # read several times
    keyed = lambda found: found.select(key.alias("_key"), "mask_id", "y", "x0", "x1")
    outside = rounds.written(r.difference(keyed(rows), keyed(raw), "_key"), "outside")

    def touched(cover: DataFrame) -> DataFrame:
        other = cover.select("_key", "y", F.col("x0").alias("_a"), F.col("x1").alias("_c"))
        return dark.join(other, ["_key", "y"]).where("_a < x1 and x0 < _c").select("_key", "part").distinct()

    border = rounds.written(dark.join(touched(keyed(inner)), ["_key", "part"], "left_semi").join(touched(outside), ["_key", "part"], "left_semi"), "border")
    shallow = m.dilate(outside, BORDER_DEPTH, "_key", round_kernel=True)
    deep = r.difference(border.select("_key", "mask_id", "y", "x0", "x1"), shallow, "_key")
    kept = r.difference(border.select("_key", "mask_id", "y", "x0", "x1"), deep, "_key")
    names = inner.select(*by).distinct().withColumn("_key", key)
    left = r.difference(keyed(inner), kept, "_key").drop("mask_id").join(names, "_key")
    return left.select(*by, "y", "x0", "x1")
