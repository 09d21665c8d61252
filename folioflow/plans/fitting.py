"""Translations that are too long for their balloons, and shorter ones in their place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import geometry as g
from folioflow.functions import layout
from folioflow.functions import text as t

#: The least area of a balloon that is checked, the size ratio below which a text is too long, and
#: the share of the original's length that a shorter text keeps.
LEAST_AREA, LEAST_RATIO, LEAST_LENGTH = 20000, 0.75, 0.5


def natural_size(text: Column, box: Column, table: dict[str, int], inner: float = 0.75, smallest: int = 8, largest: int = 32, spacing: float = 1.15) -> Column:
    """The largest size of a text in the safe area of its box, the smallest if none fits; null if the text is blank.

    Runs of full stops count as one ellipsis. Words are not broken.
    """
    area = g.safe_area(box, inner)
    side = lambda low, high: F.greatest(area[high] - area[low], F.lit(1))
    widths = layout.units(layout.words(t.normalize_ellipsis(text)), table)
    size = layout.fit_size(widths, table.get(" ", layout.WIDE), side("x1", "x2"), side("y1", "y2"), smallest, largest, spacing)
    return F.when(F.size(widths) > 0, F.coalesce(size, F.lit(smallest)))


def too_long(rows: DataFrame, table: dict[str, int], **sizes) -> DataFrame:
    """Adds ``size_ratio`` (translation to original), ``too_long`` and ``target``, the characters to aim at.

    Small balloons and blank texts are never too long. A text that fits at no size counts with the smallest.
    """
    sized = rows.withColumns({
        "_before": natural_size(F.col("original"), F.col("bbox"), table, **sizes),
        "_after": natural_size(F.col("translated"), F.col("bbox"), table, **sizes),
    }).withColumn("size_ratio", F.col("_after") / F.col("_before"))
    over = (g.area(F.col("bbox")) >= LEAST_AREA) & (F.col("size_ratio") < LEAST_RATIO)
    target = g.shortening_target(t.strip(F.col("original")), t.strip(F.col("translated")), F.col("size_ratio"))
    found = sized.withColumn("too_long", F.coalesce(over, F.lit(False)))
    return found.withColumn("target", F.when(F.col("too_long"), target)).drop("_before", "_after")


def shorten(rows: DataFrame, client: Callable[[str, int, str], str], table: dict[str, int], page: str = "page_id", **sizes) -> DataFrame:
    """Rows with shorter translations where they help; ``shortened`` tells which.

    ``client`` gets a translation, its target and the original; it runs in tasks, for
    texts that are too long only. Its answer counts if it has text, differs, is at
    least half as long as the original and can be set larger. A call that fails
    leaves the translation as it is.
    """
    asked = too_long(rows, table, **sizes).where("too_long").select(page, "pos", "original", "translated", "target")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for said, target, original in zip(batch["translated"], batch["target"], batch["original"]):
                try:
                    answers.append(client(said, int(target), original))
                except Exception:  # noqa: BLE001 - any failure of a client keeps the text
                    answers.append(None)
            yield batch[[page, "pos"]].assign(answer=pd.Series(answers, index=batch.index, dtype=object))

    types = dict(rows.dtypes)
    answers = asked.mapInPandas(call, f"{page} {types[page]}, pos {types['pos']}, answer string")
    both = rows.join(answers, [page, "pos"], "left").withColumn("answer", t.strip(F.col("answer")))
    original = F.char_length(t.strip(F.coalesce("original", F.lit(""))))
    size = lambda c: natural_size(F.col(c), F.col("bbox"), table, **sizes)
    helps = (F.col("answer") != "") & (F.col("answer") != F.col("translated")) & (F.char_length("answer") >= LEAST_LENGTH * original)
    helps = F.coalesce(helps & (size("answer") > size("translated")), F.lit(False))
    chosen = both.withColumn("shortened", helps).withColumn("translated", F.when(F.col("shortened"), F.col("answer")).otherwise(F.col("translated")))
    return chosen.select(*rows.columns, "shortened")
