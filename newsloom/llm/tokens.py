"""Token ids as Parquet list columns, in ascending document order.

Texts are range-partitioned and sorted by id, tokenised in the writing task, and
written as one Parquet file per partition: ids as a dictionary-encoded list column,
the metadata columns delta-encoded, row groups bounded by tokens, small pages and
page indexes.  So a reader of metadata never touches the ids, and a range of ids or
documents touches only its pages.  ``start`` is stored relative to the file; a
file's own start is the sum of the files before it (one manifest row each).

Defined cases: a null text has only the end id; null ids come first and tied ids in
the order of a hash of the text; repeated rows stay; an empty table writes no row;
further columns are left out of the files; names are the file format's own.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom.llm._shared import enter_stage, open_fs, run_dir, small_batches, written
from newsloom.llm._text import TextBlock, blocks
from newsloom.llm._wordtok import default_file, encoder

ROW_GROUP_TOKENS, PAGE_BYTES, BLOCK = 1 << 20, 64 << 10, 4 << 20
#: Files whose bases (some 30 bytes each) may be broadcast; beyond, they are joined by shuffle.
BROADCAST_FILES = 100_000
MANIFEST = "part int, file string, docs long, tokens long"


def write_tokens(
    docs: DataFrame,
    folder: str,
    text: str = "text",
    doc_id: str = "doc_id",
    tokenizer: str | None = None,
    row_group_tokens: int = ROW_GROUP_TOKENS
) -> DataFrame:
    """Write the files below ``folder``/ids and the manifest; returns the manifest
    with each file's ``base``, the ids of all files before it."""
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or default_file()
    id_type = docs.schema[doc_id].dataType
    arrow = to_arrow_schema(
        T.StructType(
            [
                T.StructField("doc_id", id_type), T.StructField("start", T.LongType()),
                T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))
            ]
        )
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter_stage()
        part, enc = TaskContext.get().partitionId(), encoder(path)
        fs, inner = open_fs(f"{folder}/ids")
        fs.create_dir(inner, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.parquet"  # an attempt's own: only the manifest says which count
        total = docs_ = 0
        held: list[pa.RecordBatch] = []
        with fs.open_output_stream(f"{inner}/{name}") as sink, pq.ParquetWriter(
            sink, arrow, compression="zstd", use_dictionary=["ids.list.element"],
            column_encoding={
                "doc_id": "DELTA_BINARY_PACKED", "start": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"
            } if isinstance(id_type, (T.LongType, T.IntegerType)) else {"start": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"},
            data_page_size=PAGE_BYTES, write_page_index=True, store_schema=False
        ) as to:
            waiting = 0

            def flush() -> None:
                if held:
                    rows = pa.Table.from_batches(held)
                    to.write_table(rows, row_group_size=max(rows.num_rows, 1))
                    held.clear()

            for batch in batches:
                for a, e in blocks(batch.column(1), BLOCK):
                    b = TextBlock(batch.column(1).slice(a, e - a))
                    ids = enc.encode(b)
                    sizes = np.array([len(x) for x in ids], np.int64)
                    first = 0
                    while first < b.n:  # row groups of so many tokens, or one longer document
                        room = row_group_tokens - waiting
                        take = max(int(np.searchsorted(np.cumsum(sizes[first:]), room, side="right")), 0 if waiting else 1)
                        if take:
                            s = sizes[first : first + take]
                            lists = pa.ListArray.from_arrays(
                                pa.array(np.concatenate([[0], np.cumsum(s)]).astype(np.int32)),
                                pa.array(np.concatenate(ids[first : first + take]).astype(np.int32))
                            )
                            held.append(
                                pa.RecordBatch.from_arrays(
                                    [
                                        batch.column(0).slice(a + first, take), pa.array(total + np.cumsum(s) - s),
                                        pa.array(s), lists.cast(arrow.field(3).type)
                                    ],
                                    schema=arrow
                                )
                            )
                            total, docs_, waiting, first = total + int(s.sum()), docs_ + take, waiting + int(s.sum()), first + take
                        if first < b.n or waiting >= row_group_tokens:
                            flush()
                            waiting = 0
            flush()
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "file": [name], "docs": [docs_], "tokens": [total]},
            schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
        )

    fs_, inner_ = open_fs(f"{folder}/ids")
    fs_.create_dir(inner_, recursive=True)  # an empty table has no task that makes it
    tie = F.xxhash64(F.col("t"))
    rows = docs.select(docs[doc_id].alias("i"), docs[text].alias("t")).repartitionByRange(F.col("i"), tie).sortWithinPartitions(F.col("i"), tie)
    manifest = written(rows.mapInArrow(write, MANIFEST), f"{folder}/manifest").collect()  # a row for each file
    base, out = 0, []
    for r in sorted(manifest, key=lambda r: r["part"]):
        out.append((r["part"], r["file"], r["docs"], r["tokens"], base))
        base += r["tokens"]
    return spark.createDataFrame(out, MANIFEST + ", base long")


def read_tokens(
    spark: SparkSession,
    folder: str,
    manifest: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids"),
    id_type: str = "long"
) -> DataFrame:
    """The rows of the manifest's files (not those of attempts that failed) with ``start``
    over all files; only ``columns`` are read."""
    files = spark.read.schema(f"doc_id {id_type}, start long, n_tokens long, ids array<int>").parquet(f"{folder}/ids")
    rows = files.select(*[c for c in columns if c != "start"], F.col("start").alias("_at"), F.col("_metadata.file_name").alias("_file"))
    bases = manifest.select(F.col("file").alias("_file"), "base")
    if manifest.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        bases = F.broadcast(bases)
    out = {c: F.col(c) for c in columns} | {"start": F.col("_at") + F.col("base")}
    return rows.join(bases, "_file").select(*[out[c].alias(c) for c in columns])


def ids_crc32(column: pa.Array) -> pa.Array:
    """CRC-32 of each list as little-endian unsigned 32-bit ids."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False)).astype("<u4")
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    raw = memoryview(flat.tobytes())
    return pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.int64())


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = run_dir(spark, "tokens")
    manifest = write_tokens(docs, folder, tokenizer=tokenizer)
    crc = F.arrow_udf(ids_crc32, T.LongType())
    return read_tokens(
        spark, folder, manifest, id_type=docs.schema["doc_id"].dataType.simpleString()
    ).select("doc_id", "start", "n_tokens", crc("ids").alias("ids_crc32"))
