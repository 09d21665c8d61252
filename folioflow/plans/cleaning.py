"""Flat fills in place of lettering: which pixels of a page get which colour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import masks as m
from folioflow.operators import pixels, rounds
from folioflow.operators import runs as r

#: Pixels of a balloon's own border; the brightness below which its ground is dark; the padding of text boxes
#: as a share of the shorter side and its bounds.
BORDER, DARK_GROUND, PADDING, LEAST_PADDING, MOST_PADDING = 6, 150, 0.08, 4, 8
BY = ["page_id", "mask_id"]
RUN = ["y", "x0", "x1"]


def grey_rows(image: DataFrame) -> DataFrame:
    """Grey values of rows of colours."""
    grey = lambda v: F.bround(0.299 * v["r"] + 0.587 * v["g"] + 0.114 * v["b"]).cast("int")
    return image.select("page_id", "y", F.transform("values", grey).alias("values"))


def grounds(image: DataFrame, areas: DataFrame) -> DataFrame:
    """The dominant colour under each area: ``page_id, mask_id, r, g, b``."""
    covered = pixels.covered_runs(image, areas).select(*BY, *(F.col(f"value.{c}").alias(c) for c in "rgb"), (F.col("x1") - F.col("x0")).alias("n"))
    return pixels.dominant_colors(covered, BY)


def _joined(areas: DataFrame, extra: DataFrame | None, among: DataFrame) -> DataFrame:
    """Areas with the extra runs of those masks."""
    if extra is None:
        return areas.select(*BY, *RUN)
    more = extra.select(*BY, *RUN).join(among.select(*BY).distinct(), BY, "left_semi")
    return r.union(areas.select(*BY, *RUN).unionByName(more), BY).select(*BY, *RUN)


def _shape_fills(image: DataFrame, raw: DataFrame, sizes: DataFrame, extra: DataFrame | None) -> DataFrame:
    whole = rounds.written(grounds(image, raw), "grounds")  # these tables are read several times below
    dark = whole.where((F.col("r") + F.col("g") + F.col("b")) / 3 < DARK_GROUND)
    inner = rounds.written(m.erode(raw, BORDER, sizes=sizes).select(*BY, *RUN), "inner")
    on_dark = _joined(inner.join(dark.select(*BY), BY, "left_semi"), extra, dark).join(dark, BY)
    light = raw.join(dark.select(*BY), BY, "left_anti")
    grey = grey_rows(image)
    area = rounds.written(pixels.without_border_ink(grey, light, inner.join(dark.select(*BY), BY, "left_anti"), sizes), "area")
    color = rounds.written(grounds(image, area), "grounds")
    if extra is not None:  # ink outside the mask goes as well, unless it belongs to a border
        area = pixels.without_border_ink(grey, _joined(light, extra, color), _joined(area, extra, color), sizes)
    on_light = area.join(color, BY)
    return on_dark.unionByName(on_light.select(*on_dark.columns))


def _box_fills(image: DataFrame, balloons: DataFrame, masks: DataFrame, sizes: DataFrame) -> DataFrame:
    b = F.col("bbox")
    pad = F.greatest(F.lit(LEAST_PADDING), F.least(F.lit(MOST_PADDING), F.bround(PADDING * F.least(b["x2"] - b["x1"], b["y2"] - b["y1"])).cast("int")))
    ends = balloons.join(sizes, "page_id").select(
        *BY, F.greatest(b["x1"] - pad, F.lit(0)).alias("x0"), F.least(b["x2"] + pad, "width").alias("x1"), F.greatest(b["y1"] - pad, F.lit(0)).alias("top"),
        F.least(b["y2"] + pad, "height").alias("bottom"),
    ).where("x0 < x1 and top < bottom")
    boxes = ends.select(*BY, F.explode(F.sequence("top", F.col("bottom") - 1)).alias("y"), "x0", "x1")
    key = F.to_json(F.struct(*BY))
    keyed = lambda rows: rows.select(key.alias("_key"), "mask_id", *RUN)
    ground = r.difference(keyed(boxes), keyed(masks), "_key").drop("mask_id")
    named = ground.join(boxes.select(*BY).distinct().withColumn("_key", key), "_key").select(*BY, *RUN)
    return boxes.join(grounds(image, named), BY)


def fills(image: DataFrame, balloons: DataFrame, masks: DataFrame, sizes: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """What to paint: runs ``page_id, mask_id, y, x0, x1`` with whole numbers ``r, g, b``.

    ``balloons``: ``page_id, mask_id, bbox, shaped``; ``image`` has colours (``values`` of
    ``r, g, b``). A ``shaped`` mask is the balloon's: it is painted without its border; on
    light ground, ink that hangs together with the border stays. Another mask is that of
    the lettering: its padded box is painted in the colour beside the letters. ``extra``
    are runs of lettering outside a mask. Masks without pixels or ground are not painted.
    """
    shaped = balloons.where("shaped").select(*BY)
    raw = rounds.written(r.union(masks.select(*BY, *RUN).join(shaped, BY, "left_semi"), BY).select(*BY, *RUN), "raw")
    flat = _box_fills(image, balloons.where(~F.coalesce("shaped", F.lit(False))), masks, sizes)
    both = _shape_fills(image, raw, sizes, extra).unionByName(flat)
    return both.select(*BY, *RUN, *(F.col(c).cast("int").alias(c) for c in "rgb"))


def painted(image: DataFrame, found: DataFrame) -> DataFrame:
    """The image with fills over it; where several meet, that of the last mask by id stays."""
    color = F.struct("r", "g", "b")
    by_row = found.groupBy("page_id", "y").agg(F.array_sort(F.collect_list(F.struct(F.col("mask_id"), "x0", "x1", color.alias("c")))).alias("_f"))
    hit = lambda i: F.filter("_f", lambda f: (f["x0"] <= i) & (f["x1"] > i))
    over = F.transform("values", lambda v, i: F.coalesce(F.try_element_at(hit(i), F.lit(-1))["c"], v))
    return image.join(by_row, ["page_id", "y"], "left").select("page_id", "y", F.when(F.col("_f").isNull(), F.col("values")).otherwise(over).alias("values"))


def restored(cleaned: DataFrame, original: DataFrame, areas: DataFrame) -> DataFrame:
    """A cleaned image with the original's pixels back under ``areas`` (runs), as for balloons without a translation."""
    spans = r.union(areas.select("page_id", *RUN), ["page_id"]).groupBy("page_id", "y").agg(F.collect_list(F.struct("x0", "x1")).alias("_s"))
    both = cleaned.join(original.select("page_id", "y", F.col("values").alias("_old")), ["page_id", "y"]).join(spans, ["page_id", "y"], "left")
    back = F.transform("values", lambda v, i: F.when(F.exists("_s", lambda s: (s["x0"] <= i) & (s["x1"] > i)), F.get("_old", i)).otherwise(v))
    return both.select("page_id", "y", F.when(F.col("_s").isNull(), F.col("values")).otherwise(back).alias("values"))
