"""Media columns: an archive data source with byte-range partitions.

``media_archive`` is a Spark data source (reader and writer). A folder holds
uncompressed zip archives, each of bounded size, and a manifest of the archives
that committed tasks wrote; what failed attempts left is never read.

Reading: the driver lists archives and plans byte ranges from their sizes alone.
A task owns the members whose local header starts in its range; it takes their
offsets from the archive's central directory, reads each at its own offset and
checks its CRC. A member that fails is read again, alone, over a new handle;
after ``retries`` attempts its row carries ``error`` instead of bytes, and the
other members are not touched. Payload goes out in Arrow batches of bounded size.

Media form: the text's UTF-8 bytes, zero-filled to a positive multiple of 64,
are the 8-bit samples of a greyscale PNG 64 wide, so storage is lossless.

Defined results: null and empty text give 64 zero bytes; null ids stay null;
repeated rows give repeated rows; an empty table gives an archive folder with an
empty manifest and no rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from .common import map_batches, small_batches

WIDTH = 64
MANIFEST = "_manifest.json"
SCHEMA = "doc_id long, media binary, archive string, offset long, error string"
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """Zero-fill to a positive multiple of ``WIDTH``."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """A greyscale PNG whose samples are the payload; keeps the unpadded length."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    scan = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter byte 0 before each row
    scan[:, 1:] = rows
    return b"".join((
        PNG_SIGNATURE,
        _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)),
        _chunk(b"tEXt", b"n_bytes\0" + str(n_bytes).encode()),
        _chunk(b"IDAT", zlib.compress(scan.tobytes(), 1)),
        _chunk(b"IEND", b""),
    ))


def decode_png(data: bytes) -> tuple[bytes, int]:
    """Samples and unpadded length of a PNG that ``encode_png`` made."""
    if data[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, n_bytes, width = 8, [], -1, 0
    while at < len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"tEXt":
            n_bytes = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    scan = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    return scan[:, 1:].tobytes(), n_bytes


def feature_of(samples: bytes) -> str:
    """Shape, mean, deviation, entropy and an 8-bin histogram of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    total, levels = len(samples), np.arange(256)
    mean = float((counts * levels).sum() / total)
    deviation = math.sqrt(float((counts * (levels - mean) ** 2).sum() / total))
    share = counts[counts > 0] / total
    entropy = abs(float((share * np.log2(share)).sum()))
    bins = ",".join(map(str, counts.reshape(8, 32).sum(axis=1)))
    return f"{WIDTH}x{total // WIDTH};mean={mean:.4f};std={deviation:.4f};entropy={entropy:.4f};hist={bins}"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    archives: list


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("archivebytes", 32 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        made, archive = [], None
        for batch in iterator:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    sink = store.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                    size = count = 0
                data = (text or "").encode()
                media = encode_png(padded(data), len(data))
                member = zipfile.ZipInfo(f"{count:08d}_{'' if doc_id is None else doc_id}.png")
                archive.writestr(member, media)
                size, count = size + len(media), count + 1
                if size >= self.most:
                    made.append([name, self._close(archive, sink)])
                    archive = None
        if archive is not None:
            made.append([name, self._close(archive, sink)])
        return Written(made)

    @staticmethod
    def _close(archive, sink) -> int:
        archive.close()
        size = sink.tell()
        sink.close()
        return size

    def commit(self, messages: list) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps([x for m in messages if m for x in m.archives]).encode())

    def abort(self, messages: list) -> None:
        store, root = _store(self.path)
        for name, _ in (x for m in messages if m for x in m.archives):
            store.delete_file(f"{root}/{name}")


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.step = int(options.get("rangebytes", 8 << 20))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        store, root = _store(self.path)
        with store.open_input_file(f"{root}/{MANIFEST}") as f:
            archives = json.loads(f.read())
        return [
            ByteRange(name, at, min(at + self.step, size))
            for name, size in archives
            for at in range(0, size, self.step)
        ] or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        store, root = _store(self.path)
        path = f"{root}/{part.archive}"
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            members = [m for m in z.infolist() if part.start <= m.header_offset < part.end]
        handle, rows, held = None, [], 0
        for m in members:
            media = error = None
            for _ in range(self.retries):
                try:
                    handle = handle or store.open_input_file(path)
                    media, error = read_member(handle, m), None
                    break
                except (OSError, ValueError, struct.error) as e:
                    error, handle = f"{type(e).__name__}: {e}", None
            doc_id = m.filename.partition("_")[2].removesuffix(".png")
            rows.append((int(doc_id) if doc_id else None, media, part.archive, m.header_offset, error))
            held += len(media or b"")
            if held >= self.batch_bytes:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        kinds = {"doc_id": pa.int64(), "media": pa.binary(), "archive": pa.string(), "offset": pa.int64(), "error": pa.string()}
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds.values())], names=list(kinds)
        )


def read_member(handle, member: zipfile.ZipInfo) -> bytes:
    """The stored bytes of one member, by its own offset; raises if its CRC differs."""
    handle.seek(member.header_offset)
    head = handle.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member at this offset")
    name_size, extra_size = struct.unpack("<HH", head[26:30])
    handle.seek(member.header_offset + 30 + name_size + extra_size)
    data = handle.read(member.compress_size)
    if zlib.crc32(data) != member.CRC:
        raise ValueError("the member's CRC differs")
    return data


class MediaArchiveSource(DataSource):
    """``format("media_archive")``; options: path, archiveBytes, rangeBytes, batchBytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaArchiveSource)


def store_texts(docs: DataFrame, path: str) -> DataFrame:
    """Write ``doc_id, text`` as archives under ``path`` and load them again.

    ``path`` must be readable by executors (a shared file system or an object store).
    """
    spark = docs.sparkSession
    register(spark)
    small_batches(docs, "doc_id", "text").write.format("media_archive").mode("append").save(path)
    return spark.read.format("media_archive").load(path)


FEATURE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored media. A member that could not be read fails the job."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data, error in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "media", "error"))):
                if error:
                    raise OSError(f"member of document {doc_id}: {error}")
                samples, n_bytes = decode_png(data)
                rows.append((
                    doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]),
                    len(data), hashlib.sha256(data).hexdigest(), feature_of(samples),
                ))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in FEATURE_SCHEMA.split(", ")]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return map_batches(media.select("doc_id", "media", "error"), of, FEATURE_SCHEMA)
