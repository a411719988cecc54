"""Best-fit-decreasing packing of documents into windows of ``window`` tokens.

A document of more than one window is first cut into full windows and a rest.  What
best fit does with pieces of one length depends only on how many there are, so the plan
is made from the histogram of piece lengths (``window`` numbers, whatever the input's
size): in decreasing length, a segment tree indexed by remaining capacity finds the
tightest open windows, and a whole run of equal pieces goes there at once.  The plan
is a short list of rules ``(length, rank from) -> (sequence, offset)``; every piece has
a rank among the pieces of its length and looks its rule up.

A sequence is padded to ``window``, or to the next power of two that holds it
(``padded_length``).

Defined cases: a null text has only the end id; null or tied ids and repeated rows
are packed row by row; an empty table gives an empty result; names are the operator's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom.llm._shared import enter_stage, run_dir, small_batches, trim, written
from newsloom.llm._text import TextBlock, blocks
from newsloom.llm._wordtok import default_file, encoder

WINDOW, BLOCK = 4096, 4 << 20


class CapacityTree:
    """Open windows by remaining capacity: runs of consecutive sequence ids at the
    leaves; an inner node knows whether any leaf below it is filled."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.some = [False] * (2 * self.size)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, capacity: int, first: int, n: int) -> None:
        if capacity <= 0 or n <= 0:
            return
        self.runs.setdefault(capacity, []).append((first, n))
        i = capacity + self.size
        while i and not self.some[i]:
            self.some[i] = True
            i >>= 1

    def pop(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        if not self.runs[capacity]:
            i = capacity + self.size
            self.some[i] = False
            while i > 1 and not (self.some[i] or self.some[i ^ 1]):
                i >>= 1
                self.some[i] = False
        return run

    def tightest(self, length: int) -> int | None:
        """The least filled capacity of at least ``length``."""
        i = length + self.size
        if self.some[i]:
            return length
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


class Plan:
    """Where best fit decreasing puts pieces: arrays sorted by (length, rank)."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW):
        tree, rules, self.sequences = CapacityTree(window), [], 0
        for length in sorted(histogram, reverse=True):
            left, rank = histogram[length], 0
            while left:
                room = tree.tightest(length)
                if room is None:
                    room, first, n = window, self.sequences, -(-left // (window // length))
                    self.sequences += n
                else:
                    first, n = tree.pop(room)
                each = room // length
                full, rest = (n, 0) if left >= n * each else divmod(left, each)
                if full:
                    rules.append((length, rank, first, each, window - room))
                    tree.add(room - each * length, first, full)
                    rank, left = rank + full * each, left - full * each
                if rest:
                    rules.append((length, rank, first + full, rest, window - room))
                    tree.add(room - rest * length, first + full, 1)
                    rank, left = rank + rest, left - rest
                used = full + (rest > 0)
                tree.add(room, first + used, n - used)
        rules.sort()
        self.length, self.rank, self.first, self.each, self.offset = np.array(rules, np.int64).reshape(-1, 5).T
        ends = sorted((s, n, c) for c, runs in tree.runs.items() for s, n in runs)
        self.run_first, self.run_n, self.run_room = np.array(ends, np.int64).reshape(-1, 3).T
        self.window = window

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, offset and padded length for pieces."""
        at = np.searchsorted(self.length * (1 << 44) + self.rank, length * (1 << 44) + rank, side="right") - 1
        past = rank - self.rank[at]
        sequence = self.first[at] + past // self.each[at]
        offset = self.offset[at] + past % self.each[at] * length
        room = np.zeros(len(sequence), np.int64)
        if len(self.run_first):
            run = np.maximum(np.searchsorted(self.run_first, sequence, side="right") - 1, 0)
            inside = (sequence >= self.run_first[run]) & (sequence < self.run_first[run] + self.run_n[run])
            room[inside] = self.run_room[run[inside]]
        fill = self.window - room
        return sequence, offset, np.minimum(self.window, 1 << np.ceil(np.log2(fill)).astype(np.int64))


PIECES = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "part", "local")])


def cut(docs: DataFrame, text: str, doc_id: str, tokenizer: str | None, window: int) -> DataFrame:
    """The pieces of each document, with their rank among those of equal length that
    the same task has made."""
    small_batches(docs.sparkSession)
    path = tokenizer or default_file()
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *PIECES.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter_stage()
        part, enc, seen = TaskContext.get().partitionId(), encoder(path), np.zeros(window + 1, np.int64)
        for batch in batches:
            for a, e in blocks(batch.column(1), BLOCK):
                b = TextBlock(batch.column(1).slice(a, e - a))
                row, start, length, crc, total = [], [], [], [], []
                for i, ids in enumerate(enc.encode(b)):
                    raw = memoryview(ids.astype("<u4").tobytes())
                    for s in range(0, len(ids), window):
                        n = min(window, len(ids) - s)
                        row.append(a + i)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
                        total.append(len(ids))
                size = np.array(length, np.int64)
                order = np.argsort(size, kind="stable")
                s = size[order]
                head = np.searchsorted(s, s, side="left")
                local = np.empty(len(s), np.int64)
                local[order] = seen[s] + np.arange(len(s)) - head
                seen += np.bincount(size, minlength=window + 1)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *map(pa.array, (start, size, crc, total, np.full(len(s), part), local))]
                yield pa.RecordBatch.from_arrays([c.cast(arrow.field(k).type) for k, c in enumerate(columns)], schema=arrow)
        trim()

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("t")).mapInArrow(run, schema)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, padded_length."""
    spark = docs.sparkSession
    pieces = written(cut(docs, text, doc_id, tokenizer, window), run_dir(spark, "packing"))
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    plan = spark.sparkContext.broadcast(Plan(histogram, window))

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        found = plan.value.place(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["sequence_id", "offset", "padded_length"])

    placed = F.arrow_udf(place, "sequence_id long, offset long, padded_length long")
    ranked = pieces.join(bases, ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        placed("length", F.col("local") + F.col("base")).alias("p")
    )
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "p.*")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer=tokenizer)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the kept documents, packed."""
    return pack(docs)
