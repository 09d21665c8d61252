"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A joined side is broadcast only up to this many bytes, by its counted rows.
BROADCAST_BYTES = 16 << 20

#: Arrow batches that Python steps take in are no larger; a worker holds a few of them.
BATCH_BYTES = 2 << 20

#: A table of at most that many rows is written by one task, if this is known beforehand.
TASK_ROWS = 1 << 15

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, as in tests, may have none; a temporary folder is then
    made, once per application.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="folioflow-")
    return _own_dirs[app]


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/folio-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of ``df``.
    ``rows``, where it is known, is a number that the rows of ``df`` surely do not
    exceed: no more tasks than one for each ``task_rows`` of it then write a file. The
    few rows are dealt out anew for that, so the work before keeps its own tasks.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.repartition(rows // task_rows + 1)
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Remove a table of ``written`` that nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sized(table: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, to be broadcast if its counted rows are surely small enough,
    else to be merged after a sort, which holds no partition in memory."""
    return table.hint("broadcast" if table.count() * row_bytes <= most else "merge")


def small_batches(df: DataFrame, *columns: str) -> DataFrame:
    """The columns that a Python step reads, handed over in Arrow batches of a few MB."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.select(*columns)


def map_batches(df: DataFrame, step: Callable, schema) -> DataFrame:
    """``mapInArrow`` over small batches; a worker gives its free memory back after each task."""

    def tidy(batches: Iterator) -> Iterator:
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return small_batches(df, *df.columns).mapInArrow(tidy, schema)


_model: dict = {}


def worker_model(key: tuple, build: Callable):
    """What a Python worker builds once and keeps for later tasks; only the latest is kept."""
    if key not in _model:
        _model.clear()
        _model[key] = build()
    return _model[key]


def fresh(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, without building them: gaps between words plus one."""
    inner = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(inner == "", F.lit(0).cast("long")).otherwise(
        F.size(F.split(inner, r"[\x20\x09-\x0D]+")).cast("long")
    )


def is_held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of ids whose crc32, as text, leaves remainder 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
