"""Reading order, batching, grouping and retention: window operators by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reading_order(boxes: DataFrame, page: str = "page_id") -> DataFrame:
    """Renumber ``balloon_id`` by bands of centres, then by x. A lone box keeps its id.

    Reads ``pos`` (list order, for ties), ``balloon_id`` and ``bbox``.
    """
    by_page = Window.partitionBy(page)
    cx, cy = (F.col("bbox.x1") + F.col("bbox.x2")) / 2, (F.col("bbox.y1") + F.col("bbox.y2")) / 2
    height = F.median(F.col("bbox.y2") - F.col("bbox.y1")).over(by_page)
    tolerance = F.greatest(F.lit(20), F.floor(0.6 * height))
    banded = boxes.withColumns({"_n": F.count("*").over(by_page), "_band": F.bround(cy / tolerance), "_cx": cx})
    order = by_page.orderBy("_band", "_cx", "pos")
    new = F.when(F.col("_n") > 1, F.row_number().over(order) - 1).otherwise(F.col("balloon_id"))
    return banded.withColumn("balloon_id", new.cast("long")).drop("_n", "_band", "_cx")


def batches(rows: DataFrame, page: str, order: str, size: int = 10) -> DataFrame:
    """Number runs of ``size`` rows of each page in ``batch``."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(page).orderBy(order)) - 1) / size))


def collapse_groups(rows: DataFrame, page: str, group: str, preferred: Column, order: list) -> DataFrame:
    """One row of each (page, group): the preferred one, else the first by ``order``. Rows without a group stay."""
    first = Window.partitionBy(page, group).orderBy(F.when(preferred, 0).otherwise(1), *order)
    ranked = rows.withColumn("_rank", F.when(F.col(group).isNull(), F.lit(1)).otherwise(F.row_number().over(first)))
    return ranked.where("_rank = 1").drop("_rank")


def keep_newest(rows: DataFrame, by: str, order: list, n: int = 20) -> DataFrame:
    """The newest ``n`` rows of each key."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def row_clusters(rows: DataFrame, by: str, order: list, start: Column, least: int = 3) -> DataFrame:
    """Runs of rows (gaps and islands): a run begins where ``start`` holds. Keeps runs of ``least`` rows.

    ``start`` may use ``previous``: a struct of the row before.
    """
    along = Window.partitionBy(by).orderBy(*order)
    marked = rows.withColumn("previous", F.lag(F.struct(*rows.columns)).over(along))
    runs = marked.withColumn("run", F.sum(F.when(start, 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, "run").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= least)


def uniform_size(sizes: DataFrame, page: str, size: str, ratio: float = 0.6) -> DataFrame:
    """One font size for each page: the smallest that is not below ``ratio`` of the median."""
    floor = ratio * F.median(size).over(Window.partitionBy(page))
    return sizes.withColumn("floor", floor).groupBy(page).agg(
        F.min(F.when(F.col(size) >= F.col("floor"), F.col(size))).alias("uniform_size"),
        F.count_if(F.col(size) < F.col("floor")).alias("n_free"),
    )
