"""Segments and hash exchanges: counting over the whole corpus without a row per word.

``stage`` writes the texts once, as compressed Arrow files of a few megabytes (a
*segment*) in the shared folder, with a manifest.  A task on a segment depends on that
file alone, so a lost executor costs a rerun of its segments and nothing else.

``exchange`` asks a question about 64-bit hashes.  Each segment sends its *distinct*
hashes and their counts, sorted and cut into hash ranges (buckets); a bucket's task adds
up what all segments sent and replies to each in the order of its hashes.  A value that
a third of all rows share is sent once per segment, so no bucket is hot.  Hashes go as
compressed differences, replies compressed too.  Beyond ``FAN`` segments the exchange
is a tree, so that its rows grow in proportion to the segments and not to
segments x ranges.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom.llm._shared import enter_stage, open_fs, run_dir, small_batches, trim, written
from newsloom.llm._text import TextBlock, blocks

SEGMENT_BYTES = 4 << 20
#: Keys that a hash range has at most on average; segments that send straight to ranges.
RANGE_KEYS, FAN = 1_500_000, 512
U = np.uint64
_CODEC = pa.Codec("zstd", compression_level=1)
MANIFEST = T.StructType(
    [
        T.StructField("seg", T.LongType()), T.StructField("path", T.StringType()),
        T.StructField("docs", T.LongType()), T.StructField("words", T.LongType())
    ]
)
_SENT = T.StructType(
    [
        T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()),
        T.StructField("seg", T.LongType()), T.StructField("blob", T.BinaryType())
    ]
)


@dataclass
class Segments:
    manifest: DataFrame
    n: int
    words: int
    docs: int
    spark: SparkSession
    columns: list[str]

    @property
    def tasks(self) -> int:
        return max(1, self.n)


def stage(docs: DataFrame, columns: list[str], text: str, name: str, segment_bytes: int = SEGMENT_BYTES) -> Segments:
    """Write ``columns`` of ``docs``; the text column comes first in the files."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = run_dir(spark, name)
    order = [text, *[c for c in columns if c != text]]
    manifest_schema = to_arrow_schema(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter_stage()
        fs, inner = open_fs(f"{folder}/segments")
        fs.create_dir(inner, recursive=True)
        part, n = TaskContext.get().partitionId(), 0
        stem = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        sink = to = None
        size = rows = words = 0

        def close() -> pa.RecordBatch:
            to.close()
            sink.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + n]), pa.array([f"{folder}/segments/{stem}-{n:06d}.arrow"]), pa.array([rows]), pa.array([words])],
                schema=manifest_schema
            )

        for batch in batches:
            for a, e in blocks(batch.column(0)):
                piece = batch.slice(a, e - a)
                b = TextBlock(piece.column(0))
                if to is None:
                    sink = fs.open_output_stream(f"{inner}/{stem}-{n:06d}.arrow")
                    to = pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                to.write_batch(piece)
                size, rows, words = size + len(b.data) + 64 * b.n, rows + b.n, words + len(b.starts)
                if size >= segment_bytes:
                    yield close()
                    n, to, size, rows, words = n + 1, None, 0, 0, 0
        if to is not None:
            yield close()
        trim()

    source = docs.select(*[docs[c] for c in order])
    manifest = written(source.mapInArrow(run, MANIFEST), f"{folder}/manifest")
    total = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    return Segments(manifest, total[0], total[1], total[2], spark, order)


def read(path: str) -> Iterator[pa.RecordBatch]:
    """The blocks of a segment, as written."""
    fs, inner = open_fs(path)
    with fs.open_input_stream(inner) as f, pa.ipc.open_stream(f) as stream:
        yield from stream


def map_segments(
    segments: Segments,
    fn: Callable[[int, str, dict[int, list[bytes]]], Iterator[pa.RecordBatch]],
    schema: T.StructType,
    replies: dict[int, DataFrame] | None = None
) -> DataFrame:
    """``fn(seg, path, replies)`` for each segment, one task group each.  ``replies`` by
    kind are those of exchanges, in bucket order."""
    columns = ["seg", "path", "kind", "bucket", "blob"]
    rows = segments.manifest.select("seg", "path", F.lit(-1).alias("kind"), F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("blob"))
    for kind, df in (replies or {}).items():
        rows = rows.unionByName(df.where(F.col("kind") == kind).select("seg", F.lit(None).cast("string").alias("path"), "kind", "bucket", "blob"))
    out = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        enter_stage()
        seg, path, kind, bucket = (table.column(c).to_pylist() for c in columns[:4])
        blob = table.column("blob")
        where = next((p for p in path if p is not None), None)
        got: dict[int, list] = {}
        for i in sorted(range(len(kind)), key=lambda i: (kind[i], bucket[i])):
            if kind[i] >= 0:
                got.setdefault(kind[i], []).append(blob[i].as_buffer().to_pybytes())
        found = [] if where is None else list(fn(seg[0], where, got))
        done = pa.Table.from_batches(found, schema=out)
        del found, got
        trim()
        return done

    return rows.repartition(segments.tasks, "seg").groupBy("seg").applyInArrow(run, schema)


@dataclass(frozen=True)
class Ranges:
    """How the hash space is cut for one kind of question.  ``splits`` has one number
    unless there are more than ``fan`` segments; then the space is cut in levels, each a
    cut of the one before, so that no level has more than ``fan`` rows for each of its
    senders.  ``bits`` of a hash are sent, counted from where its last range begins."""

    splits: tuple[int, ...]
    bits: int = 64

    @property
    def first(self) -> int:
        return self.splits[0]

    @property
    def total(self) -> int:
        return int(np.prod(self.splits, dtype=object))

    @staticmethod
    def of(keys: int, segments: int, bits: int = 64, fan: int = FAN) -> Ranges:
        left, splits = max(1, -(-keys // RANGE_KEYS)), []
        while segments > fan and left > fan:
            splits.append(fan)
            left, segments = -(-left // fan), -(-segments // fan)
        splits.append(left)
        further = sum(k.bit_length() for k in splits[1:])
        return Ranges(tuple(splits), min(64, bits + further))


def range_of(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` (below 2^31) equal ranges each hash is in, and its place there as a
    fraction of 2^64; both ascend with the hash."""
    low = (h & U(0xFFFFFFFF)) * U(n)
    high = (h >> U(32)) * U(n) + (low >> U(32))
    return (high >> U(32)).astype(np.int64), (high << U(32)) | (low & U(0xFFFFFFFF))


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def _unplaned(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((8, n), np.uint8)
    out[:width] = raw.reshape(width, n)
    return np.ascontiguousarray(out.T).reshape(-1).view("<u8")


def encode(place: np.ndarray, counts: np.ndarray, check: np.ndarray | None, bits: int) -> bytes:
    """Ascending places (their leading ``bits``), counts and 32-bit checks: differences
    and counts as byte planes, compressed."""
    width = -(-bits // 8)
    delta = np.diff(place >> U(64 - bits), prepend=U(0))
    most = int(counts.max(initial=0))
    wide = 0 if most == 1 and counts.min() == 1 else max(1, -(-most.bit_length() // 8))
    body = _planes(delta, width) + (_planes(counts, wide) if wide else b"") + (check.astype("<u4").tobytes() if check is not None else b"")
    return struct.pack(
        "<IBBB", len(place), width, wide, check is not None
    ) + struct.pack("<BI", 64 - bits, len(body)) + _CODEC.compress(body, asbytes=True)


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width, wide, checked = struct.unpack_from("<IBBB", blob)
    shift, size = struct.unpack_from("<BI", blob, 7)
    body = np.frombuffer(_CODEC.decompress(blob[12:], size), np.uint8)
    place = np.cumsum(_unplaned(body[: n * width], n, width), dtype=U) << U(shift)
    counts = _unplaned(body[n * width : n * (width + wide)], n, wide).astype(np.int64) if wide else np.ones(n, np.int64)
    check = np.frombuffer(body[n * (width + wide) :], "<u4") if checked else np.zeros(n, np.uint32)
    return place, counts, check


def packed(reply: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(reply.view(np.uint8).reshape(len(reply), reply.dtype.itemsize).T).tobytes()
    return struct.pack("<IB", len(reply), reply.dtype.itemsize) + _CODEC.compress(raw, asbytes=True)


def unpacked(blobs: list[bytes], dtype) -> np.ndarray:
    """The replies to a sender, in the order of its keys."""
    out, kind = [], np.dtype(dtype)
    for b in blobs:
        n, size = struct.unpack_from("<IB", b)
        raw = np.frombuffer(_CODEC.decompress(b[5:], n * size), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(kind))
    return np.concatenate([*out, np.empty(0, kind)])


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    schema = to_arrow_schema(_SENT)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _cut(kind: int, n: int, base: int, sender: int, place: np.ndarray, counts: np.ndarray, check: np.ndarray | None, bits: int) -> pa.RecordBatch:
    which, inner = range_of(place, n)
    ends = np.searchsorted(which, np.arange(n + 1)).tolist()
    return _rows(
        [
            (kind, base + k, sender, encode(inner[s:e], counts[s:e], None if check is None else check[s:e], bits))
            for k, (s, e) in enumerate(zip(ends, ends[1:], strict=False))
            if e > s
        ]
    )


def sent(seg: int, kind: int, ranges: Ranges, hashes: np.ndarray, counts: np.ndarray, check: np.ndarray | None = None) -> pa.RecordBatch:
    """The rows of one segment: its distinct hashes, ascending (with ``check``: distinct
    and ascending as pairs), and how often it has each."""
    return _cut(kind, ranges.first, 0, seg, hashes, counts, check, ranges.bits)


def passed(seg: int, kind: int, spread: int, blob: bytes) -> pa.RecordBatch:
    """A row that an exchange hands through as it is."""
    return _rows([(kind, seg % spread, seg, blob)])


#: Answers the distinct (place, check) of a range, given their counts over all segments:
#: an array of replies (or None) and further (kind, blob) rows of the range's own.
Final = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray | None, list[tuple[int, bytes]]]]


def _merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct places, checks, their summed counts; the group of each entry; the limits
    of the senders' entries."""
    parts = [decode(b) for b in blobs]
    place, counts, check = (np.concatenate(x) for x in zip(*parts, strict=True))
    if check.any():
        order = np.lexsort((check, place))
    else:
        order = ascending(place)
    p, c = place[order], check[order]
    head = np.ones(len(p), bool)
    head[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
    group = np.empty(len(p), np.int64)
    group[order] = np.cumsum(head) - 1
    total = np.add.reduceat(counts[order], np.flatnonzero(head)) if len(p) else counts
    return p[head], c[head], total, group, np.cumsum([0, *(len(x[0]) for x in parts)])


def exchange(rows: DataFrame, segments: int, ranges: dict[int, Ranges], finals: dict[int, Final], folder: str, fan: int = FAN) -> DataFrame:
    """Replies (kind, bucket, seg, blob) to what ``sent`` made, in the order of a
    segment's hashes.  Rows of kinds that ``ranges`` lacks pass through.

    With up to ``fan`` segments a range's task sees all senders.  With more, senders are
    taken together in groups of ``fan``: a group's task adds up what its members sent to a
    range and asks a finer cut in their name, and the answers go back the same way."""
    if all(len(r.splits) == 1 for r in ranges.values()):
        return written(_answered(rows, ranges, finals), folder)
    rows = written(rows, f"{folder}/sent")
    out = rows.where(~F.col("kind").isin(list(ranges)))
    for kind, r in ranges.items():
        out = out.unionByName(_tree(rows.where(F.col("kind") == kind), kind, segments, r, finals[kind], f"{folder}/{kind}", fan))
    return written(out, f"{folder}/replies")


def _answered(rows: DataFrame, ranges: dict[int, Ranges], finals: dict[int, Final]) -> DataFrame:
    kinds = set(ranges)

    def run(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        if kind not in kinds:
            return table
        segs = table.column("seg").to_pylist()
        place, check, total, group, cut = _merged([x.as_buffer().to_pybytes() for x in table.column("blob")])
        reply, own = finals[kind](place, total)
        out = [(kind, bucket, s, packed(reply[group[a:e]])) for s, a, e in zip(segs, cut, cut[1:], strict=False)] if reply is not None else []
        done = pa.Table.from_batches([_rows(out + [(k, bucket, -1, r) for k, r in own])])
        del out, own, reply, place, check, total, group
        trim()
        return done

    tasks = max(1, sum(r.total for r in ranges.values()))
    return rows.repartition(tasks, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(run, _SENT)


def _tree(rows: DataFrame, kind: int, senders: int, ranges: Ranges, final: Final, folder: str, fan: int) -> DataFrame:
    if len(ranges.splits) == 1:
        return _answered(rows, {kind: ranges}, {kind: final})
    first, second = ranges.splits[:2]
    groups = -(-senders // fan)
    grouped_rows = rows.withColumn("grp", F.pmod(F.xxhash64("seg"), F.lit(groups)))

    def up(table: pa.Table) -> pa.Table:
        bucket, grp = (table.column(c)[0].as_py() for c in ("bucket", "grp"))
        blobs = [x.as_buffer().to_pybytes() for x in table.column("blob")]
        place, check, total, _, _ = _merged(blobs)
        done = pa.Table.from_batches([_cut(kind, second, bucket * second, grp, place, total, check if blobs[0][6] else None, ranges.bits)])
        trim()
        return done

    asked = written(grouped_rows.groupBy("bucket", "grp").applyInArrow(up, _SENT), f"{folder}/up-{first}")
    replies = written(
        _tree(asked, kind, groups, Ranges((first * second, *ranges.splits[2:]), ranges.bits), final, folder, fan),
        f"{folder}/down-{first}"
    )
    back = replies.where("seg >= 0").select(
        "kind", F.expr(f"cast(bucket div {second} as int)").alias("bucket"),
        F.col("bucket").cast("long").alias("seg"), "blob", F.col("seg").alias("grp"), F.lit(True).alias("answer")
    )

    def down(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        answer = table.column("answer").to_pylist()
        segs, blobs = table.column("seg").to_pylist(), table.column("blob")
        at = sorted((i for i, x in enumerate(answer) if x), key=lambda i: segs[i])
        mine = [i for i, x in enumerate(answer) if not x]
        if not at or not mine:
            return pa.Table.from_batches([_rows([])])
        size = blobs[at[0]].as_buffer().to_pybytes()[4]
        reply = unpacked([blobs[i].as_buffer().to_pybytes() for i in at], f"<u{size}")
        _, _, _, group, cut = _merged([blobs[i].as_buffer().to_pybytes() for i in mine])
        done = pa.Table.from_batches(
            [_rows([(kind, bucket, segs[i], packed(reply[group[a:e]])) for i, a, e in zip(mine, cut, cut[1:], strict=False)])]
        )
        trim()
        return done

    both = grouped_rows.withColumn("answer", F.lit(False)).unionByName(back)
    return both.groupBy("bucket", "grp").applyInArrow(down, _SENT).unionByName(replies.where("seg < 0"))


def twice(place: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list]:
    """Whether each key occurs at least twice in the corpus."""
    return (counts > 1).astype(np.uint8), []


def ascending(h: np.ndarray) -> np.ndarray:
    """A stable order of 64-bit hashes: one sort of their leading bits with the places
    in the low ones, checked, and a plain sort where leading bits are not enough."""
    bits = max(1, len(h) - 1).bit_length()
    mask = U((1 << bits) - 1)
    order = (np.sort((h & ~mask) | np.arange(len(h), dtype=U)) & mask).astype(np.int64)
    s = h[order]
    return order if (s[1:] >= s[:-1]).all() else np.argsort(h, kind="stable")


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct values, the group of each entry, and the groups' sizes."""
    order = ascending(h)
    s = h[order]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(head)
    group = np.empty(len(s), np.int64)
    group[order] = np.cumsum(head) - 1
    return s[at], group, np.diff(np.append(at, len(s)))


SENT = _SENT
