"""Translation audit: a page's problems as rows, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import geometry as g
from folioflow.functions import text as t

MIN_AREA = 20_000
MIN_RATIO = 0.75


def duplicates(rows: DataFrame, page: str = "page_id", least: float = 0.8, larger: float = 0.65) -> DataFrame:
    """Pairs of overlapping boxes with texts: equal texts, or nearly equal boxes.

    Reads ``pos, bbox, translated``. A hash join on the page; the overlap is a residual test.
    """
    kept = rows.where(t.strip(F.coalesce("translated", F.lit(""))) != "").select(page, "pos", "bbox", t.strip(F.col("translated")).alias("said"))
    a = kept.select(page, *(F.col(c).alias(f"a_{c}") for c in ("pos", "bbox", "said")))
    b = kept.select(page, *(F.col(c).alias(f"b_{c}") for c in ("pos", "bbox", "said")))
    A, B = F.col("a_bbox"), F.col("b_bbox")
    met = a.join(b, page).where(
        (F.col("a_pos") < F.col("b_pos")) & (A["x1"] < B["x2"]) & (B["x1"] < A["x2"]) & (A["y1"] < B["y2"]) & (B["y1"] < A["y2"])
    )
    same = F.lower("a_said") == F.lower("b_said")
    scored = met.withColumns({"ratio": g.min_ratio(A, B), "ratio_max": g.max_ratio(A, B), "same_text": same})
    return scored.where((F.col("ratio") >= least) & (F.col("same_text") | (F.col("ratio_max") >= larger)))


def too_long(original: Column, translated: Column, box_area: Column, size_ratio: Column) -> Column:
    """Characters to aim at where a translation's font is too small, else null."""
    tight = (box_area >= MIN_AREA) & (size_ratio < MIN_RATIO) & (original != "") & (translated != "")
    return F.when(tight, g.shortening_target(original, translated, size_ratio))


def issues(rows: DataFrame, page: str = "page_id") -> DataFrame:
    """``page, pos, kind, detail`` of every problem.

    Reads ``pos, bbox, original, translated, ocr_suspect, overflow, size_ratio``.
    An overflowing text is not also called too long. A suspect reading needs
    transcription, equal texts of more than one word were not translated.
    """
    original, said = (t.strip(F.coalesce(c, F.lit(""))) for c in ("original", "translated"))
    suspect, over = (F.coalesce(c, F.lit(False)) for c in ("ocr_suspect", "overflow"))
    cut = over & (said != "")
    target = F.when(~cut, too_long(original, said, g.area(F.col("bbox")), F.col("size_ratio")))
    issue = lambda test, kind, detail: F.when(test, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))
    found = F.array(
        issue(suspect & (said == ""), "to_transcribe", F.lit("no reading though the balloon holds text")),
        issue((original != "") & (original == said) & (F.size(t.words(said)) > 1), "untranslated", F.substring(said, 1, 60)),
        issue(cut, "truncated", F.substring(said, 1, 60)),
        issue(target.isNotNull(), "too_long", F.concat(F.char_length(said).cast("string"), F.lit(" characters, about "), target.cast("string"), F.lit(" fit"))),
    )
    single = rows.select(page, "pos", F.explode(F.array_compact(found)).alias("i")).select(page, "pos", "i.kind", "i.detail")
    twice = duplicates(rows, page).select(
        page, F.col("a_pos").alias("pos"), F.lit("duplicate").alias("kind"),
        F.concat(F.bround(100 * F.col("ratio")).cast("int").cast("string"), F.lit("% over "), F.col("b_pos").cast("string")).alias("detail"),
    )
    return single.unionByName(twice)


def totals(rows: DataFrame, page: str = "page_id") -> DataFrame:
    """One row for each page: balloons and problems by kind."""
    kinds = ("to_transcribe", "untranslated", "truncated", "too_long", "duplicate")
    counts = issues(rows, page).groupBy(page).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    return rows.groupBy(page).agg(F.count("*").alias("balloons")).join(counts, page, "left").na.fill(0, list(kinds))


def report(rows: DataFrame, page: str = "page_id") -> DataFrame:
    """The problems of each page as text, in list order."""
    line = F.concat(F.lit("  ["), F.col("pos").cast("string"), F.lit("] "), F.col("kind"), F.lit(": "), F.col("detail"))
    return issues(rows, page).groupBy(page).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind", line.alias("line")))), lambda x: x["line"]), "\n").alias("report")
    )


def incomplete_pages(pages: DataFrame, translated: DataFrame, cleaned: DataFrame, rendered: DataFrame | None = None, page: str = "page_id") -> DataFrame:
    """``page, kind``: pages without an artefact. One that was never translated is not asked for the others;
    without an output folder (``rendered`` None) no page lacks its rendering."""
    has = lambda found, name: found.select(page).distinct().withColumn(name, F.lit(True))
    rows = pages.select(page).distinct().join(has(translated, "_t"), page, "left").join(has(cleaned, "_c"), page, "left")
    rows = rows.join(has(rendered, "_r"), page, "left") if rendered is not None else rows.withColumn("_r", F.lit(True))
    lacks = lambda name, kind: F.when(F.col(name).isNull(), F.lit(kind))
    later = F.array_compact(F.array(lacks("_c", "missing_cleaned"), lacks("_r", "missing_render")))
    return rows.select(page, F.explode(F.when(F.col("_t").isNull(), F.array(F.lit("missing_translated"))).otherwise(later)).alias("kind"))


def grand_totals(rows: DataFrame, incomplete: DataFrame, page: str = "page_id") -> DataFrame:
    """One row: balloons, problems by kind, incomplete stages, and ``problems``, the sum of all but balloons."""
    kinds = ("to_transcribe", "untranslated", "truncated", "too_long", "duplicate")
    found = issues(rows, page).select("kind").unionByName(incomplete.select(F.lit("incomplete").alias("kind")))
    found = found.unionByName(rows.select(F.lit("balloon").alias("kind")))
    counts = found.agg(F.count_if(F.col("kind") == "balloon").alias("balloons"), *(F.count_if(F.col("kind") == k).alias(k) for k in (*kinds, "incomplete")))
    return counts.withColumn("problems", sum((F.col(k) for k in (*kinds, "incomplete")), F.lit(0)))


def totals_line(totals: DataFrame) -> DataFrame:
    """The report's last line, from ``grand_totals``."""
    shown = ("untranslated", "to_transcribe", "truncated", "too_long", "duplicate", "incomplete")
    said = F.concat_ws(", ", *(F.concat(F.col(k).cast("string"), F.lit(f" {k}")) for k in shown))
    some = F.concat(F.lit("Totals: "), said, F.lit(" (of "), F.col("balloons").cast("string"), F.lit(" balloons)"))
    return totals.select(F.when(F.col("problems") == 0, F.concat(F.lit("No problem in "), F.col("balloons").cast("string"), F.lit(" balloons."))).otherwise(some).alias("line"))
