"""Token ids in directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every
id; a bitmap beside it marks the ids that go on, whose next chunks stand in order
in level 1, and so on. The place of an id's next chunk is the number of marks
before it, which a rank directory (one count for each 512 marks) and one count of
bits give, so any id, or any span of ids, is read without decoding its
neighbours.

A file row is a segment of whole documents: about ``SEGMENT_IDS`` ids, or one
longer document. Documents are dealt out by ranges of their id, each range is a
shard, and segments of a shard carry the number of its ids before them; one
count for each shard, added up, gives the places of all ids.

Defined results: null and empty texts are the end id alone; null doc_ids come
first; rows of one doc_id follow by a hash of their text and each keeps its own
span, exact repeats in the order of reading; very long texts are one segment; an
empty table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, sized, worker_model, written
from .packing import END_ID, WordTokenizer

#: Ids after which a segment ends.
SEGMENT_IDS = 1 << 18
CHUNK, BLOCK = 8, 512
SEGMENT = (
    "shard int, segment long, start long, n_ids long, doc_ids array<long>, lengths array<long>, "
    "levels array<binary>, marks array<binary>, ranks array<binary>"
)
#: Parquet row groups of that many bytes: a task holds one of them.
GROUP_BYTES = 16 << 20


class Codes:
    """The ids of one segment: chunk levels, continuation marks and rank directories."""

    def __init__(self, levels: list[bytes], marks: list[bytes], ranks: list[bytes]):
        self.levels, self.marks = levels, marks
        self.chunks = [np.frombuffer(x, np.uint8) for x in levels]
        self.ranks = [np.frombuffer(x, "<u4") for x in ranks]

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        levels, marks, ranks, left = [], [], [], ids.astype("<u4")
        while True:
            levels.append(left.astype(np.uint8).tobytes())
            goes_on = left >= 1 << CHUNK
            if not goes_on.any():
                return cls(levels, marks, ranks)
            marks.append(np.packbits(goes_on, bitorder="little").tobytes())
            counts = np.add.reduceat(goes_on, np.arange(0, len(left), BLOCK), dtype="<u4")
            ranks.append((np.cumsum(counts, dtype="<u4") - counts).tobytes())
            left = left[goes_on] >> CHUNK

    def before(self, level: int, i: int) -> int:
        """Marks before place ``i`` of a level."""
        first = i // BLOCK
        if first == len(self.ranks[level]):  # just behind the last block
            return len(self.chunks[level + 1])
        bits = int.from_bytes(self.marks[level][first * BLOCK // 8 : i // 8 + 1], "little")
        return int(self.ranks[level][first]) + (bits & ((1 << i % BLOCK) - 1)).bit_count()

    def at(self, i: int) -> int:
        """The id at place ``i``."""
        found = int(self.chunks[0][i])
        for level, mark in enumerate(self.marks):
            if not mark[i // 8] >> i % 8 & 1:
                break
            i = self.before(level, i)
            found |= int(self.chunks[level + 1][i]) << CHUNK * (level + 1)
        return found

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids of places ``start`` to ``end`` (exclusive)."""
        found = self.chunks[0][start:end].astype("<u4")
        where = None
        for level in range(len(self.marks)):
            raw = np.frombuffer(self.marks[level], np.uint8, -(-end // 8) - start // 8, start // 8)
            goes_on = np.flatnonzero(np.unpackbits(raw, bitorder="little")[start % 8 :][: end - start])
            if not len(goes_on):
                break
            start = self.before(level, start)
            end = start + len(goes_on)
            where = goes_on if where is None else where[goes_on]
            found[where] |= self.chunks[level + 1][start:end].astype("<u4") << CHUNK * (level + 1)
        return found


def write_codes(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Write the ids of all documents, each with the end id, in ascending doc_id order to a new folder.

    ``tokenizer_path`` must exist on the executors.
    """
    order = ["doc_id", F.xxhash64("text"), "_row"]  # rows of one id are spread as well
    rows = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    names, end = [x.split()[0] for x in SEGMENT.split(", ")], np.array([END_ID], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_model(("words", tokenizer_path), lambda: WordTokenizer(tokenizer_path))
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        doc_ids: list = []
        held = 0

        def closed() -> pa.RecordBatch:
            codes = Codes.of(np.frombuffer(b"".join(ids), "<u4"))
            ranks = [x.tobytes() for x in codes.ranks]
            row = [shard, segment, start, held, doc_ids, [len(x) // 4 for x in ids], codes.levels, codes.marks, ranks]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.binary())] * 3]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i in range(0, len(keys), 512):
                for key, found in zip(keys[i : i + 512], tokenizer.texts(texts[i : i + 512])):
                    ids.append(found + end)
                    doc_ids.append(key)
                    held += len(ids[-1]) // 4
                    if held >= SEGMENT_IDS:
                        yield closed()
                        segment, start, held, ids, doc_ids = segment + 1, start + held, 0, [], []
        if ids:
            yield closed()

    files = map_batches(ranged, encode, SEGMENT).write.option("parquet.block.size", GROUP_BYTES)
    files.option("compression", "none").parquet(path)  # bytes stay where the directories say


def segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``shard, base``: the ids of all shards before. One row a shard, so one task adds them up."""
    totals = segments(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sized(written(totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "shards"), 32)


def spans(spark: SparkSession, path: str) -> DataFrame:
    """Of each document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(row["levels"], row["marks"], row["ranks"])
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                crcs = [zlib.crc32(codes.span(a, b)) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array([row["shard"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()), row["start"] + starts, row["lengths"], crcs]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = map_batches(segments(spark, path), read, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(shard_starts(spark, path), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """``positions`` with ``token_id``, the id at ``position`` of all ids; null where there is none.

    Only segments with a wanted place are opened, and only wanted ids are read there.
    """
    places = segments(spark, path).join(shard_starts(spark, path), "shard")
    first = F.col("base") + F.col("start")
    covered = places.where("n_ids > 0").select("shard", "segment", first.alias("_first"), (first + F.col("n_ids")).alias("_end"))
    cell = lambda c: F.floor(c / F.lit(SEGMENT_IDS))
    cells = covered.withColumn("_cell", F.explode(F.sequence(cell(F.col("_first")), cell(F.col("_end") - 1))))
    asked = positions.select("position").distinct().withColumn("_cell", cell(F.col("position")))
    met = asked.join(cells, "_cell").where("position >= _first and position < _end")
    wanted = met.groupBy("shard", "segment", "_first").agg(F.collect_list(F.col("position") - F.col("_first")).alias("places"))
    payload = segments(spark, path).select("shard", "segment", "levels", "marks", "ranks").join(wanted, ["shard", "segment"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(row["levels"], row["marks"], row["ranks"])
                columns = [[row["_first"] + i for i in row["places"]], [codes.at(i) for i in row["places"]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["position", "token_id"])

    found = map_batches(payload, pick, "position long, token_id long")
    return positions.join(found, "position", "left")
