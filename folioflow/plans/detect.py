"""From found masks and text boxes to the balloons of a page, in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import geometry as g
from folioflow.operators import edits, masks, order, rounds, runs, splitting

RUN = ["page_id", "mask_id", "y", "x0", "x1"]


def clean_masks(found: DataFrame, points: DataFrame) -> DataFrame:
    """Masks without copies and partial overlaps, fused ones in parts: ``page_id, mask_id, parent, y, x0, x1``.

    ``points`` (``page_id, pos, cx, cy``) are the middles of texts; those inside a mask
    are its seeds. Masks get new ids from 0, in the order of their parents and parts.
    """
    def distinct(rows: DataFrame, label: str) -> DataFrame:
        kept = runs.drop_contained(rows.select(*RUN))
        return rounds.written(rows.join(kept, ["page_id", "mask_id"], "left_semi"), label)

    single = distinct(found.select(*RUN), "single")
    apart = rounds.written(masks.subtract_overlaps(single), "apart")
    inside = masks.seeds(points, apart).select("page_id", "mask_id", F.inline("seeds"))
    seeds = inside.select("page_id", "mask_id", F.col("pos").alias("seed"), F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
    parts = rounds.written(splitting.split_fused(apart, seeds), "parts")
    number = F.dense_rank().over(Window.partitionBy("page_id").orderBy("mask_id", "part")) - 1
    named = parts.withColumns({"parent": F.col("mask_id"), "new": number}).select("page_id", F.col("new").alias("mask_id"), "parent", "y", "x0", "x1")
    return distinct(rounds.written(named, "named"), "masks")


def balloons(cleaned: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of each page, numbered in reading order: ``page_id, balloon_id, pos, mask_id, bbox``.

    ``texts``: ``page_id, pos, bbox``. The first text whose middle lies in a mask takes
    it, and its box becomes the mask's; other texts keep their own. A mask that none takes is a row without a text.
    """
    b = F.col("bbox")
    mid = lambda low, high: F.floor((b[low] + b[high]) / 2).cast("int")
    points = texts.select("page_id", "pos", mid("x1", "x2").alias("cx"), mid("y1", "y2").alias("cy"))
    taken = runs.assign_points(points, cleaned.withColumn("mask_pos", F.col("mask_id"))).where("claims").select("page_id", "pos", "mask_id")
    shape = runs.measure(cleaned).select("page_id", "mask_id", g.box(F.col("left"), F.col("top"), F.col("right"), F.col("bottom")).alias("shape"))
    rows = texts.select("page_id", "pos", "bbox").join(taken, ["page_id", "pos"], "left").join(shape, ["page_id", "mask_id"], "left")
    rows = rows.select("page_id", "mask_id", "pos", F.coalesce("shape", "bbox").alias("bbox"))
    last = F.coalesce(F.max("pos").over(Window.partitionBy("page_id")), F.lit(-1))
    whole = edits.append_unclaimed(rows, shape.withColumnRenamed("shape", "bbox"), ["page_id", "mask_id"])
    # Masks without a text stand behind the texts in list order, which settles ties of the reading order.
    listed = whole.withColumn("_list", F.coalesce("pos", last + 1 + F.col("mask_id")))
    ordered = order.reading_order(listed.withColumnsRenamed({"pos": "_pos", "_list": "pos"}).withColumn("balloon_id", F.col("pos").cast("long")))
    return ordered.select("page_id", F.col("balloon_id").cast("long").alias("balloon_id"), F.col("_pos").alias("pos"), "mask_id", "bbox")


def detect(found: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole chain: masks without copies, overlaps and fusions, and the balloons that texts and masks make."""
    b = F.col("bbox")
    points = texts.select("page_id", "pos", ((b["x1"] + b["x2"]) / 2).alias("cx"), ((b["y1"] + b["y2"]) / 2).alias("cy"))
    cleaned = clean_masks(found, points)
    return balloons(cleaned, texts), cleaned
