"""Media columns: lossless 8-bit images in archive directories, read back by a Spark
data source that plans byte ranges.

``write_archives`` stores each payload (UTF-8 text, zero-padded to a positive multiple
of 64) as a 64-pixel-wide greyscale PNG inside ZIP archives of bounded size.
``ArchiveSource`` (format ``newsloom_archive``) cuts the archives into byte ranges; a
range holds the members whose headers start in it, whose offsets come from the archive's
own directory.  A task streams them as Arrow batches, and reads each member by its
offset, checks its CRC and, on failure, tries that member again on a fresh handle.

Defined cases: a null text is an empty payload (64 zero bytes); null or repeated ids are
members of their own; an empty table makes no archive and an empty result; further
columns are not stored.
"""

from __future__ import annotations

import hashlib
import struct
import time
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom.llm._shared import open_fs, run_dir, small_batches
from newsloom.llm._text import TextBlock, blocks

UNIT, ARCHIVE_BYTES, SPLIT_BYTES, BATCH_BYTES, LEVEL = 64, 64 << 20, 16 << 20, 2 << 20, 1
_SIGN = b"\x89PNG\r\n\x1a\n"
_MANIFEST = "_MANIFEST"


def payload_of(text: bytes) -> bytes:
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes, n_bytes: int) -> bytes:
    """Greyscale PNG whose samples are the payload's bytes; ``n_bytes`` of them count."""
    rows = len(payload) // UNIT
    raw = np.zeros((rows, UNIT + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(
        b"IDAT", zlib.compress(raw.tobytes(), LEVEL)
    ) + _chunk(b"IEND", b"")


def png_samples(data: bytes) -> tuple[bytes, int]:
    """The samples of such a PNG, and its ``n_bytes``."""
    if data[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, parts, shape, n_bytes = 8, [], (0, 0), None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"damaged {kind.decode()} chunk")
        if kind == b"IHDR":
            width, rows, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, lace) != (8, 0, 0):
                raise ValueError("not a plain 8-bit greyscale PNG")
            shape = (rows, width)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[0], shape[1] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows are not supported")
    samples = raw[:, 1:].tobytes()
    return samples, len(samples) if n_bytes is None else n_bytes


def write_archives(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Fill ``folder`` with archives.  Names are unique to a task's attempt, and only
    those of the attempts that succeeded are in the folder's manifest."""
    small_batches(docs.sparkSession)
    out = pa.schema([("name", pa.string()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = open_fs(folder)
        fs.create_dir(inner, recursive=True)
        stem, made, to, sink, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", [], None, None, 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, e in blocks(batch.column(1)):
                b = TextBlock(batch.column(1).slice(a, e - a))
                for i in range(b.n):
                    if to is None:
                        name = f"{stem}-{len(made):04d}.zip"
                        sink = fs.open_output_stream(f"{inner}/{name}")
                        to = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                    raw = b.slice_bytes(i)
                    label = "" if keys[a + i] is None else "=" + urllib.parse.quote(keys[a + i], safe="")
                    to.writestr(zipfile.ZipInfo(f"{n:09d}{label}.png", (1980, 1, 1, 0, 0, 0)), png(payload_of(raw), len(raw)))
                    n += 1
                    if sink.tell() >= archive_bytes:
                        to.close()
                        made.append((name, sink.tell()))
                        sink.close()
                        to = None
        if to is not None:
            to.close()
            made.append((name, sink.tell()))
            sink.close()
        if made:
            yield pa.RecordBatch.from_pydict({"name": [m[0] for m in made], "size": [m[1] for m in made]}, schema=out)

    rows = docs.select(
        docs[key].cast("string").alias("k"), docs[text].alias("t")
    ).mapInArrow(run, "name string, size long").collect()  # a row for each archive
    fs, inner = open_fs(folder)
    fs.create_dir(inner, recursive=True)
    with fs.open_output_stream(f"{inner}/{_MANIFEST}") as f:
        f.write("".join(f"{r['name']}\t{r['size']}\n" for r in sorted(rows)).encode())


STORED = T.StructType([T.StructField("key", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("media", T.BinaryType())])


@dataclass
class ByteRange(InputPartition):
    name: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges over the archives in the manifest, or else in the folder."""
        fs, inner = open_fs(self.folder)
        if fs.get_file_info(f"{inner}/{_MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{inner}/{_MANIFEST}") as f:
                files = [(n, int(s)) for n, s in (line.split("\t") for line in f.read().decode().splitlines())]
        else:
            files = [(x.base_name, x.size) for x in fs.get_file_info(pafs.FileSelector(inner)) if x.base_name.endswith(".zip")]
        return [ByteRange(n, a, min(a + self.split, s)) for n, s in files for a in range(0, s, self.split)] or [ByteRange("", 0, 0)]

    def member(self, fs: pafs.FileSystem, path: str, info: zipfile.ZipInfo, handle: list) -> bytes:
        """One stored member by its offset; its own retries, on fresh handles."""
        for left in range(self.retries, -1, -1):
            try:
                if not handle:
                    handle.append(fs.open_input_file(path))
                handle[0].seek(info.header_offset)
                head = handle[0].read(30)
                if head[:4] != b"PK\x03\x04":
                    raise OSError(f"no member at {info.header_offset}")
                handle[0].seek(info.header_offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
                data = handle[0].read(info.compress_size)
                if len(data) != info.compress_size or (info.compress_type == zipfile.ZIP_STORED and zlib.crc32(data) != info.CRC):
                    raise OSError(f"{info.filename} is damaged")
                return data if info.compress_type == zipfile.ZIP_STORED else zlib.decompress(data, -15)
            except (OSError, zlib.error, zipfile.BadZipFile):
                if handle:
                    handle.pop().close()
                if not left:
                    raise
                time.sleep(0.1 * 2 ** (self.retries - left))
        raise AssertionError

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(STORED)
        if partition.end <= partition.start:
            return
        fs, inner = open_fs(self.folder)
        path = f"{inner}/{partition.name}"
        with fs.open_input_file(path) as f:
            mine = [x for x in zipfile.ZipFile(f).infolist() if partition.start <= x.header_offset < partition.end]
        handle: list = []
        rows, size = [], 0
        for info in mine:
            data = self.member(fs, path, info, handle)
            _, sep, label = info.filename.rpartition(".")[0].partition("=")
            rows.append((urllib.parse.unquote(label) if sep else None, info.header_offset, data))
            size += len(data)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        if handle:
            handle.pop().close()


class ArchiveSource(DataSource):
    """``spark.read.format("newsloom_archive").load(folder)``: key, offset, media."""

    @classmethod
    def name(cls) -> str:
        return "newsloom_archive"

    def schema(self) -> T.StructType:
        return STORED

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def histogram(samples: bytes) -> str:
    """The feature: share of samples in 16 equal bins, each as a hex byte, and the mean."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 255 // len(x)
    return bytes(bins.astype(np.uint8)).hex() + f"{int(x.sum(dtype=np.int64)) // len(x):02x}"


_L, _S = T.LongType(), T.StringType()
DIGEST = T.StructType(
    [
        T.StructField(c, t)
        for c, t in (
            ("n_bytes", _L), ("payload_bytes", _L), ("payload_sha256", _S), ("tail_crc32", _L), ("media_bytes", _L),
            ("media_sha256", _S), ("feature", _S)
        )
    ]
)


def digest(media: pa.Array) -> pa.Array:
    """All figures of stored media, from their decoded samples."""
    rows = []
    for m in media:
        data = m.as_buffer().to_pybytes()
        samples, n = png_samples(data)
        rows.append(
            (
                n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(data),
                hashlib.sha256(data).hexdigest(), histogram(samples)
            )
        )
    fields = to_arrow_schema(DIGEST)
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], [f.name for f in fields])


def read_media(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("newsloom_archive").load(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = run_dir(spark, "media")
    write_archives(docs, folder)
    figures = F.arrow_udf(digest, DIGEST)
    return read_media(spark, folder).select(
        F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"), figures("media").alias("d")
    ).select("doc_id", "d.*")
