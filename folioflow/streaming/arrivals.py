"""Pages that arrive as files (an extra): the batch transforms on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as t


def arriving_texts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows with ``page_id, pos, arrived, original`` from files as they come, cleaned and judged."""
    rows = spark.readStream.schema(schema).json(path)
    clean = t.clean(F.col("original"))
    return rows.withColumns({"clean": clean, "sound_effect": t.is_sound_effect(clean), "shout": t.is_shout(clean)})


def page_progress(rows: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Texts by window of arrival; rows later than ``delay`` are left out."""
    return rows.withWatermark("arrived", delay).groupBy(F.window("arrived", window), "page_id").agg(
        F.count("*").alias("n_texts"), F.count_if("sound_effect").alias("n_sounds")
    )


def run(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand every micro-batch to ``sink``; takes all that is there and stops."""
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
