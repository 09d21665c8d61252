"""Tables that stages hand on: masks, the translation cache, reading statistics, fonts.

Every write is a new snapshot of whole pages or of the table; nothing is edited
in place. A folder that is not there reads as an empty table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.operators import merge, runs
from folioflow.sources.snapshots import Snapshots

CACHE = "key string, translation string"
MASKS = "page_id string, mask_id long, y int, x0 int, x1 int"


def _parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def runs_of_pixels(pixels: DataFrame, above: int = 0) -> DataFrame:
    """Runs of the grey values ``page_id, mask_id, y, values`` (one array a row) that lie above a threshold: 127 or 0."""
    lit = F.filter(F.transform("values", lambda v, i: F.when(v > above, i)), lambda i: i.isNotNull())
    each = pixels.select("page_id", "mask_id", "y", F.posexplode(lit).alias("k", "x")).withColumn("run", F.col("x") - F.col("k"))
    found = each.groupBy("page_id", "mask_id", "y", "run").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    return found.drop("run")


def mask_table(spark: SparkSession, path: str) -> Snapshots:
    """The runs of all masks, in versions by page; page ids stay the strings that they are."""
    return Snapshots(spark, path, MASKS)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """The runs of all masks."""
    return mask_table(spark, path).read()


def write_masks(masks: DataFrame, path: str, pages: DataFrame | None = None) -> None:
    """Runs by page; pages that are written again lose their earlier masks, other pages keep theirs.

    ``pages`` names the pages that are written, so that one without any mask left becomes empty.
    """
    mask_table(masks.sparkSession, path).commit(masks, pages)


def add_masks(held: DataFrame, news: DataFrame) -> DataFrame:
    """All masks, the new ones numbered on from the largest id of their page, in the order of theirs."""
    last = held.groupBy("page_id").agg(F.max("mask_id").alias("_last"))
    number = F.dense_rank().over(Window.partitionBy("page_id").orderBy("mask_id"))
    numbered = news.withColumn("_n", number).join(last, "page_id", "left").withColumn("mask_id", F.coalesce("_last", F.lit(-1)) + F.col("_n"))
    return held.unionByName(numbered.select(*held.columns))


def mask_boxes(masks: DataFrame) -> DataFrame:
    """The bounding box of each mask that has a pixel."""
    found = runs.measure(masks.where("x0 < x1"))
    box = F.struct(F.col("left").alias("x1"), F.col("top").alias("y1"), F.col("right").alias("x2"), F.col("bottom").alias("y2"))
    return found.select("page_id", "mask_id", "area", box.alias("bbox"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """``key, translation``; no cache is an empty one."""
    return _parquet(spark, path, CACHE).select("key", "translation")


def import_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache of JSON files, each one object of keys and texts; files that are no such object count as empty."""
    raw = spark.read.text(path, wholetext=True)
    pairs = F.coalesce(F.from_json("value", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return raw.select(F.explode(pairs).alias("key", "translation"))


def write_cache(held: DataFrame, news: DataFrame, path: str) -> None:
    """A snapshot, in a new folder, of the cache with new entries in place of those with their keys."""
    merge.upsert(held, news.dropDuplicates(["key"]), ["key"]).select("key", "translation").write.mode("errorifexists").parquet(path)


def clear_cache(spark: SparkSession, path: str) -> None:
    """Leave an empty cache."""
    spark.createDataFrame([], CACHE).write.mode("overwrite").parquet(path)


def cache_stats(cache: DataFrame, path: str) -> DataFrame:
    return cache.agg(F.count("*").alias("entries")).withColumn("file", F.lit(path))


def write_stats(stats: DataFrame, path: str) -> None:
    """One JSON line of statistics: few rows, one file."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def fonts(spark: SparkSession, root: str) -> DataFrame:
    """Font files of a folder, ``pos, path``: TrueType before OpenType, each by name; empty files are none. One row a file, so one task sorts them."""
    files = spark.read.format("binaryFile").load(root).select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"))
    kept = files.where(F.col("ext").isin("ttf", "otf"))
    order = Window.orderBy(F.when(F.col("ext") == "ttf", 0).otherwise(1), "path")
    return kept.select((F.row_number().over(order) - 1).alias("pos"), "path")
