"""Review edits on balloon rows: new ids, splits, confirmed texts, styles, renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import geometry as g
from folioflow.functions import text as t


def next_ids(rows: DataFrame, page: str = "page_id") -> DataFrame:
    """The id that a new balloon of each page gets: the largest and one more, or the number of rows without ids."""
    return rows.groupBy(page).agg(F.coalesce(F.max("balloon_id") + 1, F.count("*")).alias("next_id"))


def renumber(rows: DataFrame, page: str = "page_id", order: str = "pos") -> DataFrame:
    """Consecutive ids from 0 in list order, as after rows were dropped."""
    return rows.withColumn("balloon_id", (F.row_number().over(Window.partitionBy(page).orderBy(order)) - 1).cast("long"))


def halves(box: Column) -> Column:
    """The two halves of a box along its longer side."""
    tall = box["y2"] - box["y1"] >= box["x2"] - box["x1"]
    x, y = (F.bround((box[f"{c}1"] + box[f"{c}2"]) / 2).cast("int") for c in "xy")
    first = g.box(box["x1"], box["y1"], F.when(tall, box["x2"]).otherwise(x), F.when(tall, y).otherwise(box["y2"]))
    second = g.box(F.when(tall, box["x1"]).otherwise(x), F.when(tall, y).otherwise(box["y1"]), box["x2"], box["y2"])
    return F.array(first, second)


def split_in_two(rows: DataFrame, chosen: Column, names: list, page: str = "page_id", share: float = 0.5, order: tuple = ("pos",)) -> DataFrame:
    """Chosen balloons become two, each with half of the box and about ``share`` of the words of the texts ``names``.

    The second follows the first (``part`` 1 after 0) and gets a new id of its page; other columns are repeated.
    """
    marked = rows.withColumn("_chosen", F.coalesce(chosen, F.lit(False))).join(next_ids(rows, page), page)
    before = Window.partitionBy(page).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("_new", F.col("next_id") + F.coalesce(F.sum(F.col("_chosen").cast("int")).over(before), F.lit(0)))
    parts = marked.withColumn("part", F.explode(F.when(F.col("_chosen"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    second = F.col("part") == 1

    def half(name: str) -> Column:
        said = t.words(F.coalesce(name, F.lit("")))
        both = g.split_words(said, F.lit(share))
        few = F.when(second, F.lit("")).otherwise(F.col(name))
        return F.when(~F.col("_chosen"), F.col(name)).when(F.size(said) < 2, few).when(second, both["second"]).otherwise(both["first"])

    cut = {n: half(n) for n in names}
    cut["bbox"] = F.when(F.col("_chosen"), F.get(halves(F.col("bbox")), F.col("part"))).otherwise(F.col("bbox"))
    cut["balloon_id"] = F.when(second, F.col("_new")).otherwise(F.col("balloon_id")).cast("long")
    return parts.withColumns(cut).select(*rows.columns, "part")


def confirm_text(original: Column, said: Column) -> tuple[Column, Column]:
    """Original and translation after a reviewer's text: the mark ``-`` empties both."""
    leave = t.strip(said) == "-"
    return F.when(leave, "").otherwise(original), F.when(leave, "").otherwise(said)


def style_to_all(rows: DataFrame, source: Column, fields: list, page: str = "page_id") -> DataFrame:
    """The style fields of each page's source row (the first where there are several), for all rows of the page."""
    first = rows.where(source).groupBy(page).agg(F.min_by(F.struct(*fields), "pos").alias("_style"))
    joined = rows.join(first, page, "left")
    return joined.withColumns({f: F.when(F.col("_style").isNotNull(), F.col(f"_style.{f}")).otherwise(F.col(f)) for f in fields}).drop("_style")


def first_masks(rows: DataFrame, page: str = "page_id", order: tuple = ("pos",)) -> DataFrame:
    """Each mask once, at its first row: halves of one balloon share their parent's mask."""
    mask = F.coalesce("parent_mask_path", "mask_path")
    first = Window.partitionBy(page, mask).orderBy(*order)
    return rows.where(mask.isNotNull()).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def append_unclaimed(rows: DataFrame, bubbles: DataFrame, keys: list) -> DataFrame:
    """Rows, and bubbles that none of them has claimed; columns that a bubble lacks are null."""
    return rows.unionByName(bubbles.join(rows.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def reading_stats(rows: DataFrame, failed: DataFrame, page: str = "page_id") -> DataFrame:
    """One row: pages, failed pages, balloons, balloons without a text."""
    blank = t.strip(F.coalesce("original", F.lit(""))) == ""
    read = rows.agg(F.count_distinct(page).alias("read_pages"), F.count("*").alias("balloons"), F.count_if(blank).alias("blank_balloons"))
    lost = failed.agg(F.count_distinct(page).alias("failed_pages"))  # one row each, so the join makes one
    return read.withColumn("_k", F.lit(1)).join(lost.withColumn("_k", F.lit(1)), "_k").select(
        (F.col("read_pages") + F.col("failed_pages")).alias("pages"), "failed_pages", "balloons", "blank_balloons"
    )


def move_boxes(rows: DataFrame, moves: DataFrame, sizes: DataFrame, page: str = "page_id") -> DataFrame:
    """Rows with the boxes that a reviewer set (``moves``: ``page, pos, bbox``), cut to their page.

    A moved box is a manual one; it is no longer half of a split, and its text no longer follows a mask.
    """
    given = moves.select(page, "pos", F.col("bbox").alias("_moved"))
    joined = rows.join(given, [page, "pos"], "left").join(sizes.select(page, "width", "height"), page, "left")
    moved = F.col("_moved").isNotNull()
    flags = {"manual_text_box": True, "balloon_split": False, "manual_respect_shape": False}
    held = {f: F.col(f) if f in rows.columns else F.lit(None).cast("boolean") for f in flags}
    edited = joined.withColumns({f: F.when(moved, F.lit(v)).otherwise(held[f]) for f, v in flags.items()})
    whole = F.when(moved, g.clamp(F.col("_moved"), F.col("width"), F.col("height"))).otherwise(F.col("bbox"))
    return edited.withColumn("bbox", whole).select(*rows.columns, *(f for f in flags if f not in rows.columns))


def recreate_balloons(rows: DataFrame, chosen: Column) -> DataFrame:
    """Chosen balloons drawn anew: a white ellipse with a border, and a tail to the south if they have none."""
    hit = F.coalesce(chosen, F.lit(False))
    held = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    preset = {
        "manual_fill_color": F.when(hit, F.lit("#ffffff")).otherwise(held("manual_fill_color", "string")),
        "manual_border": F.when(hit, F.lit(True)).otherwise(held("manual_border", "boolean")),
        "manual_balloon_shape": F.when(hit, F.lit("ellipse")).otherwise(held("manual_balloon_shape", "string")),
        "manual_balloon_tail": F.when(hit, F.coalesce(held("manual_balloon_tail", "string"), F.lit("south"))).otherwise(held("manual_balloon_tail", "string")),
    }
    return rows.withColumns(preset)


def confirm_rows(rows: DataFrame, answers: DataFrame, page: str = "page_id") -> DataFrame:
    """Rows with the texts that a reviewer confirmed (``answers``: ``page, pos, said``, stripped here).

    The mark ``-`` empties both texts. A confirmed balloon is no longer suspect.
    """
    joined = rows.join(answers.select(page, "pos", t.strip(F.coalesce("said", F.lit(""))).alias("_said"), F.lit(True).alias("_seen")), [page, "pos"], "left")
    seen = F.coalesce("_seen", F.lit(False))
    original, translated = confirm_text(F.col("original"), F.col("_said"))
    edited = {"original": F.when(seen, original).otherwise(F.col("original")), "translated": F.when(seen, translated).otherwise(F.col("translated"))}
    if "ocr_suspect" in rows.columns:
        edited["ocr_suspect"] = F.when(seen, F.lit(False)).otherwise(F.col("ocr_suspect"))
    return joined.withColumns(edited).select(*rows.columns)


def save_table(rows: DataFrame, texts: DataFrame, page: str = "page_id") -> DataFrame:
    """Rows with the translations of an edited table: its n-th line (``line`` from 0, ``said``) is the page's n-th row.

    Lines beyond the rows are left out; the mark ``-`` empties both texts.
    """
    line = F.row_number().over(Window.partitionBy(page).orderBy("pos")) - 1
    joined = rows.withColumn("_line", line).join(texts.select(page, F.col("line").alias("_line"), F.coalesce("said", F.lit("")).alias("_said")), [page, "_line"], "left")
    given, leave = F.col("_said").isNotNull(), F.col("_said") == "-"
    return joined.withColumns({
        "original": F.when(given & leave, F.lit("")).otherwise(F.col("original")),
        "translated": F.when(given, F.when(leave, F.lit("")).otherwise(F.col("_said"))).otherwise(F.col("translated")),
    }).select(*rows.columns)


def copy_through(rows: DataFrame) -> DataFrame:
    """Stripped originals as translations, for pages that are already in the wanted language."""
    return rows.withColumn("translated", t.strip(F.coalesce("original", F.lit(""))))


def page_status(rows: DataFrame, page: str = "page_id") -> DataFrame:
    """What a reviewer sees of each page: balloons, those to transcribe and those with a cut text."""
    said = t.strip(F.coalesce("translated", F.lit(""))) != ""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return rows.groupBy(page).agg(
        F.count("*").alias("balloons"), F.count_if(flag("ocr_suspect") & ~said).alias("to_transcribe"), F.count_if(flag("overflow") & said).alias("truncated")
    )
