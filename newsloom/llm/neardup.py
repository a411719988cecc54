"""Near-duplicates by bottom-k sketches of word shingles.

A document's set: the distinct 5-word shingles of its words, A-Z in lower case; with
fewer words the whole sequence.  Documents are linked when
``100 |A & B| >= percent |A | B|``; components of links share the smallest doc_id.

1. Documents of equal sets form a class; only its representative goes on.
2. A sketch is the ``K`` least values of one 64-bit hash function.  Values are ranked by
   corpus frequency (one exchange), rarest first.  Two linked sets share at least ``m``
   retained values, so they share one of their ``K - m + 1`` rarest: only these enter
   the inverted lists, and a passage that a third of all documents share does so only
   where a sketch has little else.
3. A document's *home* is a block of at most about ``BLOCK`` members of the longest of its
   lists.  A document that shares a list with one of another block goes there, once however
   many it meets; the largest component of each list stays at home, as the others come to
   it.  So no pair of documents is ever a row: a group of n similar documents makes
   n x (its blocks) rows, be they linked or not.
4. In a block the lists of retained values (``K_UNION`` of each document) give the overlap
   of all its pairs at once; a pair passes when the union sketch estimates enough, and the
   exact test on whole sets, read by offset from the shared folder, decides.  The most
   central documents (whose retained values are the most frequent, such as the original of
   edited copies) come first, and what is connected already is not compared again.  A block
   emits the links that connect its components, no others.
5. Where a list is longer than a block, rounds before the last send only its most central
   members, so that most of a large group is one component before its outsiders travel.
6. Links contract components (minimum labels with pointer jumping, each iteration
   written to the shared folder).

``m`` is such that a pair at the threshold falls short with probability below 1e-7
(binomial tail, an upper bound for the sampling without replacement here); sets of at
most K shingles are compared whole, without any such chance.

Defined cases: null or empty text has an empty set and no links; copies are linked
whatever their ids; component_id is the smallest non-null id reachable (null if there is
none), and a null id alone in its component is kept; ids must be integral; an empty table
gives an empty result; further columns are not read by the query and pass through
``keep_one``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom.llm import _segments as G
from newsloom.llm._shared import enter_stage, open_fs, run_dir, trim, written
from newsloom.llm._text import TextBlock, join2, mix, windows

SHINGLE, PERCENT, K, TAIL = 5, 85, 128, 1e-7
#: Values in the sketches that estimate a pair's similarity.
K_UNION = 512
#: Documents of a block; parts of a list, of which each has a central member; rounds of those.
BLOCK, SALTS, CENTRAL_ROUNDS = 2048, 16, 2
#: Bytes of whole sets that a task keeps.
SET_CACHE = 32 << 20
U = np.uint64
_DOC = np.dtype([("ref", "<i8"), ("id", "<i8"), ("has", "<i8"), ("n", "<i8"), ("s1", "<i8"), ("s2", "<i8")])
_ROW_BITS = 18


def least_shared(k: int, percent: int, tail: float = TAIL) -> int:
    """The most m with P(Binomial(k, percent / 100) < m) <= tail."""
    p, total = percent / 100, 0.0
    for m in range(k + 1):
        total += comb(k, m) * p**m * (1 - p) ** (k - m)
        if total > tail:
            return m
    return k


class Sets:
    """The shingle sets of a block's texts, as ascending hashes side by side."""

    def __init__(self, column: pa.Array, size: int = SHINGLE):
        b = TextBlock(column, lower=True)
        h = windows(b.words, size) if len(b.words) >= size else np.empty(0, U)
        at = np.flatnonzero(b.in_text(size))
        text, value = b.word_text[at], h[at]
        few = np.flatnonzero((b.n_words > 0) & (b.n_words < size))
        if len(few):
            short = np.zeros(len(few), U)
            for j in range(size - 1):  # the whole sequence as one shingle
                has = b.n_words[few] > j
                short[has] = join2(short[has], b.words[b.first_word[few[has]] + j], 50 + j)
            text, value = np.concatenate([text, few]), np.concatenate([value, short])
        order = np.lexsort((value, text))
        text, value = text[order], value[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        self.text, self.value = text[new], value[new]
        self.first = np.searchsorted(self.text, np.arange(b.n + 1))
        self.n = np.diff(self.first)

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set, as two sums of mixed values."""
        out = []
        for salt in (U(0x51ED270B), U(0xB5297A4D1B56C4E9)):
            total = np.zeros(len(self.value) + 1, U)
            np.cumsum(mix(self.value ^ salt), out=total[1:])
            out.append((total[self.first[1:]] - total[self.first[:-1]]).astype(np.int64))
        return out[0], out[1]

    def sketch(self, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """The retained values, and each one's text."""
        kept = np.arange(len(self.value)) - self.first[self.text] < k
        return self.value[kept], self.text[kept]


def prefix_length(n: np.ndarray, k: int = K, percent: int = PERCENT) -> np.ndarray:
    """How many of its rarest retained values index a set of ``n`` shingles."""
    t = percent / 100
    whole = np.ceil(n * t - 1e-9)
    cut = np.floor(k - (1 / t - 1) * n + 1e-9)  # against a set whose sketch leaves some out
    small = n - np.where(n <= np.floor(k * t), whole, np.minimum(whole, cut)) + 1
    return np.where(n <= k, small, k - least_shared(k, percent) + 1).astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, k: int, percent: int, m: int) -> bool:
    """Whether two sketches (32-bit values, ascending) may belong to linked sets."""
    both = np.intersect1d(a, b, assume_unique=False)
    if n_a <= k and n_b <= k:  # whole sets; two more for 32-bit values that coincide
        return 100 * (len(both) + 2) >= percent * (n_a + n_b - len(both) - 2)
    union = np.union1d(a, b)[:k]
    return bool(np.isin(union, both, assume_unique=True).sum() >= min(m, ceil(len(union) * percent / 100 - 1e-9)))


def _docs_of(exchanged: DataFrame) -> DataFrame:
    """(ref, seg, row, doc_id, n, s1, s2) from the segments' document records."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("ref", "doc_id", "n", "s1", "s2")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                d = np.frombuffer(x.as_buffer(), _DOC)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d["ref"]), pa.array(d["id"], mask=d["has"] == 0), pa.array(d["n"]), pa.array(d["s1"]), pa.array(d["s2"])],
                    schema=arrow
                )

    return exchanged.where(F.col("kind") == 2).select("blob").mapInArrow(run, schema)


def _requests(refs: DataFrame, kind: int) -> DataFrame:
    """The rows asked of each segment, as a reply blob; refs are distinct."""
    schema = T.StructType(
        [
            T.StructField("seg", T.LongType()), T.StructField("kind", T.IntegerType()),
            T.StructField("bucket", T.IntegerType()), T.StructField("blob", T.BinaryType())
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        ref = np.sort(table.column("ref").to_numpy())
        rows = (ref & ((1 << _ROW_BITS) - 1)).astype(np.int32)
        return pa.Table.from_arrays(
            [pa.array([int(ref[0] >> _ROW_BITS)]), pa.array([kind], pa.int32()), pa.array([0], pa.int32()), pa.array([rows.tobytes()], pa.binary())],
            schema=arrow
        )

    return refs.select("ref", F.shiftright("ref", _ROW_BITS).alias("seg")).groupBy("seg").applyInArrow(run, schema)


def _asked(got: dict, kind: int) -> np.ndarray:
    return np.frombuffer(b"".join(got.get(kind, [])), np.int32)


def _picked(path: str, rows: np.ndarray) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """The asked rows of a segment, block by block, with their row numbers."""
    at = 0
    for batch in G.read(path):
        mine = rows[(rows >= at) & (rows < at + batch.num_rows)]
        if len(mine):
            yield mine, batch.take(pa.array(mine - at))
        at += batch.num_rows


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label) with the smallest node of its component, for the nodes of
    ``edges`` (a, b)."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = written(both, f"{folder}/edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"))
    labels, i = written(labels, f"{folder}/0"), 0
    while True:
        i += 1
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("was"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(lower.join(jump, "label", "left").select("node", F.coalesce("further", "label").alias("label"), "was"), f"{folder}/{i}")
        labels = new.select("node", "label")
        if new.where(F.col("label") != F.col("was")).isEmpty():
            return labels


def _level(place: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list]:
    """Frequency on a scale of an eighth of a doubling; 0 is a value met once."""
    return np.minimum(255, np.floor(8 * np.log2(counts))).astype(np.uint8), []


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    size: int = SHINGLE,
    percent: int = PERCENT,
    k: int = K,
    block: int = BLOCK
) -> tuple[DataFrame, G.Segments]:
    """A row per document: ref, doc_id, n_shingles, component_id, kept, first (one true
    per component, a true one always of the smallest id).  ``docs`` columns are in the
    segments, in ref order."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"column {doc_id} is {docs.schema[doc_id].dataType.simpleString()}; near_duplicates needs integral ids")
    others = [c for c in docs.columns if c not in (text, doc_id)]
    segments = G.stage(docs, [text, doc_id, *others], text, "neardup")
    folder = run_dir(spark, "neardup-work")
    m = least_shared(k, percent)
    ranges = G.Ranges.of(segments.docs * k, segments.n)

    def survey(seg: int, path: str, got: dict) -> Iterator[pa.RecordBatch]:
        values, at, records = [], 0, []
        for batch in G.read(path):
            s = Sets(batch.column(0), size)
            values.append(s.sketch(k)[0])
            d = np.zeros(len(s.n), _DOC)
            ids = batch.column(1)
            d["ref"] = (seg << _ROW_BITS) + at + np.arange(len(s.n))
            d["has"] = np.asarray(ids.is_valid())
            d["id"] = ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            d["n"] = s.n
            d["s1"], d["s2"] = s.signatures()
            records.append(d)
            at += len(s.n)
        distinct, _, count = G.grouped(np.concatenate(values))
        yield G.sent(seg, 1, ranges, distinct, count)
        yield G.passed(seg, 2, ranges.first, np.concatenate(records).tobytes())

    surveyed = G.exchange(G.map_segments(segments, survey, G.SENT), segments.n, {1: ranges}, {1: _level}, f"{folder}/frequency")
    rows = written(_docs_of(surveyed), f"{folder}/docs")
    classes = rows.where(F.col("n") > 0).groupBy("s1", "s2", "n").agg(F.min("ref").alias("rep"))
    classes = written(classes, f"{folder}/classes")

    indexed_schema = T.StructType(_NODE + [T.StructField("values", T.ArrayType(T.LongType()))])
    indexed_arrow = to_arrow_schema(indexed_schema)
    sets_folder = f"{folder}/sets"

    def index(seg: int, path: str, got: dict) -> Iterator[pa.RecordBatch]:
        """Of the representatives: the shared ones among their rarest retained values.
        Whole sets of those that have any go to a file."""
        reps = _asked(got, 5)
        if not len(reps):
            return
        reps = np.sort(reps)
        sets, at = [], 0
        for batch in G.read(path):
            s = Sets(batch.column(0), size)
            sets.append((s, at))
            at += batch.num_rows
        value, of = (np.concatenate(x) for x in zip(*((v, t + a) for s, a in sets for v, t in [s.sketch(k)]), strict=True))
        n = np.concatenate([s.n for s, _ in sets])
        _, group, _ = G.grouped(value)
        level = G.unpacked(got.get(1, []), np.uint8)[group]
        mine = np.isin(of, reps)
        value, of, level = value[mine], of[mine], level[mine]
        start = np.searchsorted(of, reps)
        rank = np.empty(len(of), np.int64)
        order = np.lexsort((value, level, of))
        rank[order] = np.arange(len(of))
        use = (rank - start[np.searchsorted(reps, of)] < prefix_length(n, k, percent)[of]) & (level > 0)
        ends = np.append(start[1:], len(of))
        file, out, written_, which = f"{sets_folder}/{seg}-{uuid.uuid4().hex[:12]}.bin", [], 0, 0
        fs, inner = open_fs(sets_folder)
        sink = None
        for r, s, e in zip(reps.tolist(), start.tolist(), ends.tolist(), strict=True):
            if not use[s:e].any():
                continue
            while which + 1 < len(sets) and sets[which + 1][1] <= r:
                which += 1
            block, at = sets[which]
            whole = block.value[block.first[r - at] : block.first[r - at + 1]]
            if sink is None:
                fs.create_dir(inner, recursive=True)
                sink = fs.open_output_stream(f"{inner}/{file.rpartition('/')[2]}")
            sink.write(whole.tobytes())
            out.append(
                (
                    (seg << _ROW_BITS) + r, int(n[r]), int(100 * level[s:e].mean()), short(whole).tobytes(), file,
                    written_, value[s:e][use[s:e]].astype(np.int64)
                )
            )
            written_ += len(whole)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(indexed_arrow)], schema=indexed_arrow)

    asked = _requests(classes.select(F.col("rep").alias("ref")), 5)
    indexed = written(G.map_segments(segments, index, indexed_schema, {1: surveyed, 5: asked}), f"{folder}/index")
    labels = _linked(spark, indexed, folder, percent, block)

    # back to documents: by class, then by component
    of_class = classes.join(labels, classes["rep"] == labels["node"], "left").select("s1", "s2", "n", F.coalesce("label", "rep").alias("component"))
    placed = rows.join(of_class, ["s1", "s2", "n"], "left").select(
        "ref", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "ref").alias("component")
    )
    best = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ref")).alias("best"))
    out = placed.join(best, "component").select(
        "ref", "doc_id", "n_shingles", F.col("best.doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"),
        (F.col("ref") == F.col("best.ref")).alias("first")
    )
    return out, segments


#: A document in a block: its sketch, and where its whole set is.
_NODE = [
    T.StructField("ref", T.LongType()), T.StructField("n", T.LongType()), T.StructField("w", T.LongType()),
    T.StructField("sketch", T.BinaryType()), T.StructField("file", T.StringType()), T.StructField("at", T.LongType())
]


def short(values: np.ndarray) -> np.ndarray:
    """The sketch of a set: its ``K_UNION`` least values, 32 bits each."""
    return (values[:K_UNION] >> U(32)).astype(np.uint32)


class WholeSets:
    """Sets by file and offset, the latest few kept."""

    def __init__(self):
        self.kept, self.size, self.files = {}, 0, {}

    def __getitem__(self, key: tuple[str, int, int]) -> np.ndarray:
        if key not in self.kept:
            file, at, n = key
            if file not in self.files:
                if len(self.files) >= 64:
                    self.files.pop(next(iter(self.files))).close()
                fs, inner = open_fs(file)
                self.files[file] = fs.open_input_file(inner)
            while self.kept and self.size + 8 * n > SET_CACHE:
                self.size -= self.kept.pop(next(iter(self.kept))).nbytes
            self.kept[key] = np.frombuffer(self.files[file].read_at(8 * n, 8 * at), U)
            self.size += 8 * n
        return self.kept[key]


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``a`` has in common with each of ``b``: over the inverted
    lists of ``b``, or as a product of 0/1 matrices where the lists are long."""
    sizes = np.array([len(x) for x in b])
    values, owner = np.concatenate(b), np.repeat(np.arange(len(b)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    mine, row = np.concatenate(a), np.repeat(np.arange(len(a)), [len(x) for x in a])
    start, end = np.searchsorted(values, mine), np.searchsorted(values, mine, side="right")
    met = end > start
    start, end, row = start[met], end[met], row[met]
    total = int((end - start).sum())
    heads, column = np.unique(start, return_inverse=True)
    if total > 200_000 and 20 * total > len(a) * len(b) * len(heads) // 16:
        out = np.zeros((len(a), len(b)), np.float32)
        tail = np.zeros(len(heads), np.int64)
        tail[column] = end
        for c in range(0, len(heads), 1024):  # columns of the matrices
            d = min(c + 1024, len(heads))
            left, right = np.zeros((len(a), d - c), np.float32), np.zeros((len(b), d - c), np.float32)
            pick = (column >= c) & (column < d)
            left[row[pick], column[pick] - c] = 1
            size = tail[c:d] - heads[c:d]
            at = np.repeat(heads[c:d] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            right[owner[at], np.repeat(np.arange(d - c), size)] = 1
            out += left @ right.T
        return out.astype(np.int64)
    out = np.zeros(len(a) * len(b), np.int64)
    size = end - start
    step = max(1, int(len(size) * 2_000_000 / max(total, 1)))
    for s in range(0, len(size), step):
        z = size[s : s + step]
        at = np.repeat(start[s : s + step] - (np.cumsum(z) - z), z) + np.arange(int(z.sum()))
        np.add(out, np.bincount(np.repeat(row[s : s + step], z) * len(b) + owner[at], minlength=len(out)), out=out)
    return out.reshape(len(a), len(b))


class Block:
    """Documents of one home and those that came to it, compared until all pairs are
    either tested or connected."""

    STEP = 64

    def __init__(self, rows: list[tuple], percent: int, sets: WholeSets):
        """Rows (came, component, ref, n, w, sketch, file, at)."""
        rows.sort(key=lambda r: (-r[4], r[2]))
        self.percent, self.sets, self.m = percent, sets, least_shared(K_UNION, percent)
        self.came = np.array([r[0] for r in rows], bool)
        self.comp = np.unique([r[1] for r in rows], return_inverse=True)[1]
        self.ref = [r[2] for r in rows]
        self.n = np.array([r[3] for r in rows])
        self.sketch = [np.frombuffer(r[5], np.uint32) for r in rows]
        self.key = [(r[6], r[7], r[3]) for r in rows]

    def passes(self, shared: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Where sketches with so many common values may belong to linked sets."""
        whole = (n_a <= K_UNION) & (n_b <= K_UNION)  # two more for 32-bit values that coincide
        enough = np.where(whole, 100 * (shared + 2) >= self.percent * (n_a + n_b - shared - 2), shared >= self.m)
        return enough & (100 * np.minimum(n_a, n_b) >= self.percent * np.maximum(n_a, n_b))

    def linked(self, i: int, j: int) -> bool:
        n_a, n_b = int(self.n[i]), int(self.n[j])
        if not estimate(self.sketch[i], self.sketch[j], n_a, n_b, K_UNION, self.percent, self.m):
            return False
        both = len(np.intersect1d(self.sets[self.key[i]], self.sets[self.key[j]], assume_unique=True))
        return 100 * both >= self.percent * (n_a + n_b - both)

    def links(self, inside: bool) -> Iterator[tuple[int, int]]:
        """Links that join components; ``inside``: of the home's own pairs too."""
        total = len(self.ref)
        home = np.flatnonzero(~self.came)
        pivots = np.arange(total) if inside else np.flatnonzero(self.came)
        for s in range(0, len(pivots), self.STEP):
            now = pivots[s : s + self.STEP]
            if (self.comp == self.comp[0]).all():
                return
            # later documents of the home; of those that came, all of the home
            there = home if self.came[now].any() else home[home > now[0]]
            some = np.unique(self.comp[now])
            there = there[~np.isin(self.comp[there], some)] if len(some) == 1 else there
            if not len(there):
                continue
            shared = overlaps([self.sketch[i] for i in now], [self.sketch[j] for j in there])
            ok = self.passes(shared, self.n[now][:, None], self.n[there][None, :])
            for x, i in enumerate(now.tolist()):
                if not ok[x].any():
                    continue
                for j in there[ok[x]].tolist():
                    if self.comp[i] != self.comp[j] and (self.came[i] or j > i) and self.linked(i, j):
                        self.comp[self.comp == self.comp[j]] = self.comp[i]
                        yield self.ref[i], self.ref[j]


_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _compared(units: DataFrame, percent: int, inside: bool, tasks: int) -> DataFrame:
    """Links (a, b) of the units' blocks; rows (unit, block, slice, came, component, *node)."""
    arrow = to_arrow_schema(_LINK)

    def run(table: pa.Table) -> pa.Table:
        enter_stage()
        groups: dict[tuple, list] = {}
        columns = [table.column(c).to_pylist() for c in ("block", "slice", "came", "component", *(f.name for f in _NODE))]
        for block, slice_, *row in zip(*columns, strict=True):
            groups.setdefault((block, slice_), []).append(tuple(row))
        sets, found = WholeSets(), []
        for (_, slice_), rows in groups.items():
            if len(rows) > 1:
                found += Block(rows, percent, sets).links(inside and slice_ == 0)
        done = pa.Table.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], schema=arrow)
        del groups, columns, sets
        trim()
        return done

    return units.repartition(tasks, "unit").groupBy("unit").applyInArrow(run, _LINK)


def _linked(spark: SparkSession, indexed: DataFrame, folder: str, percent: int, block: int) -> DataFrame:
    """(node, label) of the linked representatives' components."""
    salt = F.pmod(F.xxhash64("ref", F.lit(1)), F.lit(SALTS))
    entries = indexed.select(F.explode("values").alias("v"), "ref", "w", salt.alias("s"))
    # a list's parts (v, s) stand for it in joins, so that a long list is many keys
    parts = written(entries.groupBy("v", "s").agg(F.count(F.lit(1)).alias("k")), f"{folder}/parts")
    lists = parts.groupBy("v").agg(F.sum("k").alias("size")).where("size > 1")
    parts = written(parts.join(lists, "v").select("v", "s", "size"), f"{folder}/lists")
    entries = written(entries.join(parts, ["v", "s"]), f"{folder}/entries")
    homes = entries.groupBy("ref").agg(F.max(F.struct("size", "v")).alias("top")).select(
        "ref",
        F.xxhash64("top.v", F.pmod(F.xxhash64("ref", F.lit(2)), F.ceil(F.col("top.size") / block))).alias("home")
    )
    nodes = written(indexed.drop("values").join(homes, "ref"), f"{folder}/nodes")
    homes = nodes.select("ref", "home")
    n_nodes, longest = nodes.count(), parts.agg(F.max("size")).first()[0] or 0
    labels = spark.createDataFrame([], T.StructType([T.StructField("node", T.LongType()), T.StructField("label", T.LongType())]))
    links = None
    for step in range(CENTRAL_ROUNDS * (longest > block) + 1):
        here, last = f"{folder}/round-{step}", step == CENTRAL_ROUNDS * (longest > block)
        placed = labels.withColumnRenamed("node", "ref")
        of = F.coalesce("label", "ref").alias("component")
        members = entries if last else entries.where(F.col("size") > block)
        members = written(members.join(homes, "ref").join(placed, "ref", "left").select("v", "s", "ref", "w", "home", of), f"{here}/members")
        main = members.groupBy("v", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("v").agg(
            F.max(F.struct("k", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("several")
        ).where("several > 1").select("v", "main")
        at = members.groupBy("v", "home").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        # lists with members in the same homes are one ``way``; should two ways' hashes meet, each has both's homes
        ways = at.groupBy("v").agg(
            F.bit_xor(F.xxhash64("home", "low", "high")).alias("way"), F.count(F.lit(1)).alias("homes")
        ).where(F.col("homes") > int(last)).select("v", "way")
        at = at.join(ways, "v").select("way", "home", "low", "high").distinct()
        spread = written(parts.select("v", "s").join(main, "v").join(ways, "v"), f"{here}/main")
        outside = members.join(spread, ["v", "s"]).where("component != main") if last or step else members.join(spread, ["v", "s"])
        if not last:
            central = outside.groupBy("v", "s").agg(F.max(F.struct("w", "ref"))["ref"].alias("ref"))
            outside = outside.join(central, ["v", "s", "ref"])
        outside = outside.select("way", "s", "ref", "component", F.col("home").alias("own")).distinct()
        meets = outside.join(spread.select("way", "s").distinct().join(at, "way"), ["way", "s"])
        other = (F.col("low") != F.col("component")) | (F.col("high") != F.col("component"))
        ship = meets.where(
            other & (F.col("home") != F.col("own")) if last else other
        ).select("ref", "component", F.col("home").alias("block")).distinct()
        ship = written(ship, f"{here}/ship")
        slices = written(ship.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("slices")), f"{here}/slices")
        home = nodes.withColumnRenamed("home", "block").join(slices, "block", "left" if last else "inner").join(placed, "ref", "left")
        node = [f.name for f in _NODE]
        home = home.select(
            "block", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1)).alias("slice"),
            F.lit(False).alias("came"), of, *node
        )
        several = slices.where("slices > 1")
        came = ship.join(several, "block", "left").select(
            "ref", "component", "block",
            F.pmod(F.xxhash64("ref", F.lit(3)), F.coalesce(F.col("slices"), F.lit(1))).cast("int").alias("slice")
        )
        came = came.join(nodes.drop("home"), "ref").select("block", "slice", F.lit(True).alias("came"), "component", *node)
        tasks = max(1, -(-n_nodes // 256))
        units = home.unionByName(came).withColumn("unit", F.pmod(F.xxhash64("block", "slice"), F.lit(tasks)))
        found = written(_compared(units, percent, last, tasks), f"{here}/links")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = components(links, f"{here}/components")
    return labels


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "doc_id")
    return near_duplicates(docs)[0].select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The documents, one of each component (that of the smallest id)."""
    found, segments = near_duplicates(docs, text, doc_id, **how)
    stored = [c for c in segments.columns]
    schema = T.StructType([docs.schema[c] for c in stored])
    arrow = to_arrow_schema(schema)

    def pick(seg: int, path: str, got: dict) -> Iterator[pa.RecordBatch]:
        for _, batch in _picked(path, _asked(got, 8)):
            yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(batch.columns)], schema=arrow)

    kept = G.map_segments(segments, pick, schema, {8: _requests(found.where("first").select("ref"), 8)})
    return kept.select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates stays, at five
    words and a similarity of 0.8 or more."""
    return keep_one(docs, percent=80)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], chr(32)) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, chr(32)) FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a AS x, b AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(m.y, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS y FROM r GROUP BY x) m USING (doc_id)"""
