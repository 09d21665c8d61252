"""Versioned tables of pages: each commit replaces whole pages, and a page may be left without rows.

A commit writes its rows (``rows/<name>``), the ids of the pages that it replaces
(``pages/<name>``), and at last one line (``commits/<version>.json``) that names
both. A version is there once that line is; what failed commits leave is never
read. Rows are not parted into folders by page. A page's rows are those of its
latest commit, so a page that is committed without rows is empty.

``restore`` commits an earlier state again without copying it. ``retain`` gathers
all but the latest commits into one, marked ``whole``, before it removes them, so
that a stop at any point leaves every kept version readable. The driver reads the
log only, a few lines.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: versions that stay when a table is trimmed.
KEPT = 20
LOG = "version long, name string, restores long, whole boolean"


@dataclass
class Snapshots:
    """A table of ``schema`` whose rows belong to pages ``page``."""

    spark: SparkSession
    path: str
    schema: str
    page: str = "page_id"

    def log(self) -> list[tuple[int, str | None, int | None, bool]]:
        """The commits in order: version, name, the version that it restores, and whether it holds all pages."""
        try:
            found = self.spark.read.schema(LOG).json(f"{self.path}/commits/*").where("version is not null").orderBy("version", "whole").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return [(r["version"], r["name"], r["restores"], r["whole"]) for r in found]

    def _names(self, as_of: int | None = None) -> list[str]:
        """The commits, oldest first, whose pages make up a version."""
        states: dict[int, list[str]] = {}
        before: list[str] = []
        for version, name, restores, whole in self.log():
            if as_of is not None and version > as_of:
                break
            before = [name] if whole else states[restores] if restores is not None else [*before, name]
            states[version] = before
        if as_of is not None and as_of not in states:
            raise ValueError(f"no version {as_of}")
        return before

    def _kind(self) -> str:
        return self.spark.createDataFrame([], self.schema).schema[self.page].dataType.simpleString()

    def _pages(self, names: list[str]) -> DataFrame:
        """Each page with the latest of the commits that hold it."""
        each = [self.spark.read.schema(f"{self.page} {self._kind()}").parquet(f"{self.path}/pages/{n}").withColumn("_commit", F.lit(i)) for i, n in enumerate(names)]
        every = reduce(DataFrame.unionByName, each)
        return every.groupBy(self.page).agg(F.max("_commit").alias("_commit"))

    def read(self, as_of: int | None = None) -> DataFrame:
        """The rows of the latest version, or of an earlier one."""
        names = self._names(as_of)
        if not names:
            return self.spark.createDataFrame([], self.schema)
        each = [self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{n}").withColumn("_commit", F.lit(i)) for i, n in enumerate(names)]
        rows = reduce(DataFrame.unionByName, each)
        if len(names) == 1:
            return rows.drop("_commit")
        latest = self._pages(names).select(F.col(self.page).alias("_page"), F.col("_commit").alias("_last"))
        return rows.join(latest, F.col(self.page).eqNullSafe(F.col("_page")) & (F.col("_commit") == F.col("_last")), "left_semi").drop("_commit")

    def commit(self, rows: DataFrame, pages: DataFrame | None = None) -> int:
        """Replace the pages ``pages`` (those of ``rows``, if not given) by ``rows``; gives the new version.

        Rows of other pages are not written. A second commit of the same version fails.
        """
        version = self._next()
        name = f"{version:012d}-{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).schema
        plain = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in columns))
        if pages is None:
            held = plain.select(self.page)
        else:
            held = pages.select(F.col(self.page).cast(columns[self.page].dataType).alias(self.page))
            # A null id is a page as well.
            plain = plain.join(held.distinct().withColumnRenamed(self.page, "_page"), F.col(self.page).eqNullSafe(F.col("_page")), "left_semi")
        plain.write.parquet(f"{self.path}/rows/{name}")
        held.distinct().write.parquet(f"{self.path}/pages/{name}")
        self._record(version, name, None)
        return version

    def restore(self, version: int) -> int:
        """Make an earlier version the latest again."""
        self._names(version)
        new = self._next()
        self._record(new, None, version)
        return new

    def retain(self, keep: int = KEPT) -> None:
        """Leave the latest ``keep`` versions: older commits become one, unless a kept version restores an older one."""
        log = self.log()
        kept = log[-keep:]
        first = kept[0][0] if kept else 0
        older = log[:-keep]
        if not older or older[0][3] and len(older) == 1 or any(r is not None and r < first for _, _, r, _ in kept):
            return
        base = older[-1][0]
        name = f"{base:012d}-{uuid.uuid4().hex}"
        self.read(base).write.parquet(f"{self.path}/rows/{name}")
        self._pages(self._names(base)).select(self.page).write.parquet(f"{self.path}/pages/{name}")
        self._record(base, name, None, True)
        for version, old, _, whole in older:
            self._remove(self._line(version, whole))
            for part in ("rows", "pages") if old else ():
                self._remove(f"{self.path}/{part}/{old}")

    def history(self) -> DataFrame:
        """The pages of each commit: ``version, page``."""
        found = [(v, n) for v, n, _, _ in self.log() if n]
        none = self.spark.createDataFrame([], f"version long, {self.page} {self._kind()}")
        each = [self.spark.read.schema(f"{self.page} {self._kind()}").parquet(f"{self.path}/pages/{n}").select(F.lit(v).cast("long").alias("version"), self.page) for v, n in found]
        return reduce(DataFrame.unionByName, each, none)

    def versions_of(self, keep: int = KEPT) -> DataFrame:
        """The latest ``keep`` versions of each page, newest first: ``page, version, age``."""
        order = Window.partitionBy(self.page).orderBy(F.desc("version"))
        return self.history().withColumn("age", F.row_number().over(order) - 1).where(F.col("age") < keep).select(self.page, "version", "age")

    def _next(self) -> int:
        log = self.log()
        return log[-1][0] + 1 if log else 0

    def _line(self, version: int, whole: bool) -> str:
        return f"{self.path}/commits/{version:012d}{'-whole' if whole else ''}.json"

    def _record(self, version: int, name: str | None, restores: int | None, whole: bool = False) -> None:
        """One line in a folder of its own name: of two writers of one version the second fails."""
        line = self.spark.createDataFrame([(version, name, restores, whole)], LOG).coalesce(1)
        line.write.mode("errorifexists").json(self._line(version, whole))

    def _remove(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
