"""Readers and writers of page folders, detector JSON, glossaries and review texts."""

from __future__ import annotations

import json
from hashlib import sha1

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGE_TYPES = ("png", "jpg", "jpeg", "webp")
DETECTIONS = (
    "page_id string, detections array<struct<balloon_id: int, bbox: array<int>, confidence: double, mask_path: string, "
    "balloon_source: string, bubble_group_id: int, testo_originale: string, testo_tradotto: string, ocr_empty_suspect: boolean, _overflow: boolean>>"
)
GLOSSARY = "note string, termini map<string,string>, vietate array<string>"


def list_pages(spark: SparkSession, root: str) -> DataFrame:
    """Image files below ``root``: ``comic, page_id, ordinal, path, ext``. Contents are not read.

    A comic is a subfolder; pages directly in the root belong to comic ``''``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    base = root.rstrip("/").rsplit("/", 1)[-1]
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    pages = files.withColumn("ext", ext).where(F.col("ext").isin(*IMAGE_TYPES)).select(
        F.when(folder == base, F.lit("")).otherwise(folder).alias("comic"),
        F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("page_id"), "path", "ext",
    )
    return pages.withColumn("ordinal", F.row_number().over(Window.partitionBy("comic").orderBy("path")) - 1)


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("comic").agg(F.count("*").alias("n_pages"))


def slice_pages(pages: DataFrame, limit: int = 0, start: int = 0, end: int | None = None) -> DataFrame:
    """First ``limit`` pages of a comic (0: all), then those from ``start`` to ``end`` (exclusive), from 0."""
    kept = pages.where(F.col("ordinal") < limit) if limit else pages
    kept = kept.where(F.col("ordinal") >= start)
    return kept.where(F.col("ordinal") < end) if end is not None else kept


def parse_range(text: str, style: str = "web") -> tuple[int, int | None]:
    """A page range as (start, end), from 0, end exclusive.

    ``web``: "n" is the first n pages, "a-b" counts from 0; ``desktop``: "n" is that
    page, "a-b" counts from 1 and includes b; ``export``: as ``desktop``, and either end
    of "a-b" may be left out.
    """
    text = text.strip()
    if not text:
        return 0, None
    first, dash, last = text.partition("-")
    if style == "export" and dash:
        return max(0, int(first) - 1) if first else 0, int(last) if last else None
    if style == "web":
        return (int(first), int(last)) if dash else (0, int(first))
    return (max(0, int(first) - 1), int(last)) if dash else (int(first) - 1, int(first))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """One row per balloon of detector or OCR JSON files, with list order ``pos``."""
    raw = spark.read.schema(DETECTIONS).json(path, multiLine=True)
    rows = raw.select("page_id", F.posexplode("detections").alias("pos", "d")).select("page_id", "pos", "d.*")
    at = lambda i: F.col("bbox")[i]
    return rows.withColumn("bbox", F.struct(at(0).alias("x1"), at(1).alias("y1"), at(2).alias("x2"), at(3).alias("y2")))


def write_detections(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document for each page, balloons in list order; a new snapshot, never in place."""
    b = F.col("bbox")
    box = F.array(b["x1"], b["y1"], b["x2"], b["y2"]).alias("bbox")
    fields = [box if c == "bbox" else F.col(c) for c in rows.columns if c not in ("page_id", "pos")]
    item = F.struct("pos", F.struct(*fields).alias("d"))
    rows.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["d"]).alias("detections")).write.mode(mode).json(path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """``comic``, its glossary and its ``fingerprint`` for cache keys; unreadable files count as none.

    The fingerprint is that of the whole document, keys sorted, so also of fields that are not read here.
    """
    raw = spark.read.text(path, wholetext=True)
    comic = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    held = F.from_json("value", GLOSSARY)
    glossary = F.struct(held["termini"].alias("terms"), held["note"].alias("note"), held["vietate"].alias("banned"))
    return raw.select(comic.alias("comic"), glossary.alias("glossary"), F.pandas_udf(_fingerprint, "string")("value").alias("fingerprint"))


def glossary_fingerprint(glossary: dict) -> str:
    """What a glossary adds to cache keys: a mark and eight hex digits of its sorted JSON; empty without one."""
    if not glossary:
        return ""
    return "\0" + sha1(json.dumps(glossary, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:8]


def _fingerprint(documents: pd.Series) -> pd.Series:
    """One short document for each comic."""

    def mark(text: str) -> str:
        try:
            return glossary_fingerprint(json.loads(text))
        except ValueError:
            return ""

    return documents.map(mark)


def export_text(rows: DataFrame, page: str, pos: str, texts: dict[str, str]) -> DataFrame:
    """The review text of each page: a page mark, then a line for each text of each balloon."""
    line = lambda label, c: F.concat(
        F.lit("["), F.col(pos).cast("string"), F.lit(f"] {label}: "), F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")
    )
    lines = F.array_join(F.array(*(line(label, c) for label, c in texts.items())), "\n")
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), lines.alias("lines")))), lambda x: x["lines"])
    mark = F.concat(F.lit("=== "), F.col(page).cast("string"), F.lit(" ===\n"))
    return rows.groupBy(page).agg(F.array_join(body, "\n").alias("body")).select(page, F.concat(mark, "body", F.lit("\n")).alias("exported"))


def parse_export(lines: DataFrame, file: str, number: str, line: str, labels: dict[str, str]) -> DataFrame:
    """Review lines read back: ``page, balloon`` and a column for each label.

    The last page mark above a line, within its file, names its page; lines before
    the first mark are ignored, and of repeated lines the last counts.
    """
    mark = F.nullif(F.regexp_extract(line, r"^===\s*(.+?)\s*===\s*$", 1), F.lit(""))
    above = Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    pattern = rf"^\[(.+?)\]\s+({'|'.join(labels)}):\s?(.*)$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    rows = lines.withColumn("page", F.last(mark, ignorenulls=True).over(above)).where(F.col(line).rlike(pattern) & F.col("page").isNotNull())
    rows = rows.select("page", part(1).alias("balloon"), part(2).alias("label"), part(3).alias("said"), number)
    return rows.groupBy("page", "balloon").agg(*(F.max_by("said", F.when(F.col("label") == k, F.col(number))).alias(v) for k, v in labels.items()))


def backup_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")
