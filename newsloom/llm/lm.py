"""Language-model scores from a log-frequency Bloom filter (Talbot & Osborne 2007).

Tokens are the words of the text with A-Z in lower case, then one end token.  All
training texts are counted exactly, in one exchange: every segment sends its distinct
tokens, bigrams and trigrams with their counts, every hash range adds them up.  A range
builds its own shard of the filter over *all* its bigrams and trigrams, those seen once
too: an n-gram of count c is entered as the keys (n-gram, 1) ... (n-gram, q) with
q = 1 + floor(log2 c).  A lookup probes 1, 2, ... until one is absent; q such hits stand
for ``expected(q)``, the mean of the counts 2^(q-1) ... 2^q - 1 where those fall off as
their square.  Counts of single tokens are exact.

    P1(w)      = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P2(w | v)  = (c(vw) + 500 P1(w)) / (c(v) + 500)
    P3(w | uv) = (c(uvw) + 3 P2(w | v)) / (c(uv) + 3)

so each is a distribution where the counts are exact, and nearly one with the filter's.
The first word follows the end token and has no trigram.  ``score`` is the sum of
log10 P3 over the text's tokens.  A training text is scored by the model of all *other*
texts: its own counts are taken off first (``exclude_self``), or a text met once would
look as likely as one that the corpus repeats, and scores of training texts would not
compare with those of held-out ones.

The filter is broadcast where its size is bounded by ``broadcast_bytes``: the quantised
counts of one order add up to at most the number of tokens, so the bound is known before
anything is counted.  Beyond it nothing is broadcast: each range probes its own shard
for the n-grams that segments sent, and replies with their q in the same exchange.  Both
ways give the same scores.  A range knows an n-gram by 32 bits besides the range; with
1.5 million keys in a range two share them with a chance of 0.04 %, less than the
filter's own false positives (``BITS`` and ``PROBES``: below 0.5 %).

Defined cases: a null text has just the end token; a null id is trained on and not held
out; with no training text, N and V are 0 and the formulas still hold; repeated rows
count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom.llm import _segments as G
from newsloom.llm._shared import run_dir
from newsloom.llm._text import TextBlock, join2, mix

U = np.uint64
END = U(0x0E0D0E0D0E0D0E0D)
#: Weight of the shorter history, in occurrences; of tokens for ``P1``.
MU, ADD = {2: 500.0, 3: 3.0}, 0.1
ORDERS = (1, 2, 3)
BITS, PROBES, NAME_BITS = 14, 6, 32
BROADCAST_BYTES = 64 << 20
#: Kinds of exchange rows: n for n-grams, totals; a shard's kind is 10 + n.
TOTALS = 100
SCHEMA = [
    T.StructField("held_out", T.BooleanType()),
    *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
    T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())
]


class Tokens:
    """Token hashes of a block of texts, each text with its end token."""

    def __init__(self, batch: pa.RecordBatch):
        b = TextBlock(batch.column(0), lower=True)
        self.n = b.n_words + 1
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.hash = np.full(int(self.first[-1]), END, U)
        self.hash[np.arange(len(b.words)) + b.word_text] = b.words
        ids = batch.column(1).to_pylist()
        self.held_out = np.array([x is not None and zlib.crc32(str(x).encode()) % 10 == 0 for x in ids], bool)


def quantised(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count); 0 for no count."""
    return np.frexp(np.maximum(counts, 0).astype(float))[1].astype(np.int64)


def _mean_count(q: int) -> float:
    if q > 14:
        return 2.0 ** (q - 1) * 2 * np.log(2)
    x = np.arange(2 ** (q - 1), 2**q, dtype=float)
    return float((1 / x).sum() / (1 / x**2).sum())


_MEAN = np.array([0.0, *(_mean_count(q) for q in range(1, 65))])


def expected(q: np.ndarray) -> np.ndarray:
    """The count that q hits stand for."""
    return _MEAN[q]


def _positions(low: np.ndarray, j: int | np.ndarray, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """The bits to probe for key (n-gram, j), by its place in the range."""
    a = mix(low + U(0x632BE59BD9B4E019) * np.asarray(j, U))
    b = mix(a) | U(1)
    for _ in range(PROBES):
        yield (a % np.asarray(bits, U)).astype(np.int64)
        a = a + b


def build_shard(place: np.ndarray, counts: np.ndarray, bits_a_key: int = BITS) -> bytes:
    q = quantised(counts)
    total = int(q.sum())
    bits = max(64, (total * bits_a_key + 63) // 64 * 64)
    flags = np.zeros(bits, bool)
    for j in range(1, int(q.max(initial=0)) + 1):
        for at in _positions(place[q >= j], j, bits):
            flags[at] = True
    return np.packbits(flags, bitorder="little").tobytes()


@dataclass
class LogFrequencyFilter:
    """Shards side by side: per n-gram length the byte offset of each range's shard."""

    starts: dict[int, np.ndarray]
    data: np.ndarray
    bits: int = NAME_BITS

    @staticmethod
    def of(shards: dict[int, dict[int, bytes]], buckets: dict[int, int]) -> LogFrequencyFilter:
        starts, parts, at = {}, [], 0
        for n in sorted(buckets):
            offsets = [at]
            for k in range(buckets[n]):
                parts.append(shards.get(n, {}).get(k, b""))
                at += len(parts[-1])
                offsets.append(at)
            starts[n] = np.array(offsets, np.int64)
        return LogFrequencyFilter(starts, np.frombuffer(b"".join(parts), np.uint8))

    def lookup(self, n: int, h: np.ndarray) -> np.ndarray:
        """The quantised count of each n-gram."""
        starts = self.starts[n]
        k, place = G.range_of(h, len(starts) - 1)
        return self.probe(place >> U(64 - self.bits) << U(64 - self.bits), starts[k], starts[k + 1] - starts[k])

    def probe(self, place: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        q, live, j = np.zeros(len(place), np.int64), np.flatnonzero(size > 0), 1
        while len(live):
            hit = np.ones(len(live), bool)
            base, bits = start[live], size[live] * 8
            for at in _positions(place[live], j, bits):
                hit &= (self.data[base + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            live = live[hit]
            q[live] = j
            j += 1
        return q


def n_grams(parts: list[Tokens], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the n-gram that ends at each token, and where there is one: a bigram
    of the first word starts with the end token, a trigram there is none."""
    h = np.concatenate([t.hash for t in parts])
    if n == 1 or not len(h):
        return h, np.ones(len(h), bool)
    before = np.concatenate([[END], h[:-1]])  # the text before ends with the end token
    if n == 2:
        return join2(before, h, 9), np.ones(len(h), bool)
    inside = np.ones(len(h), bool)
    first = np.concatenate([[0], np.cumsum([len(t.hash) for t in parts])])
    for t, at in zip(parts, first, strict=False):
        inside[at + t.first[:-1]] = False
    return join2(join2(np.concatenate([[END], before[:-1]]), before, 10), h, 11), inside


@dataclass
class Grouped:
    """Distinct n-grams of a segment, the group of each, and how often each one's own
    text has it."""

    distinct: np.ndarray
    group: np.ndarray
    own: np.ndarray

    @staticmethod
    def of(h: np.ndarray, text: np.ndarray) -> Grouped:
        order = G.ascending(h)
        s, t = h[order], text[order]
        head = np.ones(len(s), bool)
        head[1:] = s[1:] != s[:-1]
        run = head.copy()
        run[1:] |= t[1:] != t[:-1]
        at = np.flatnonzero(run)
        group, own = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
        group[order] = np.cumsum(head) - 1
        own[order] = np.repeat(np.diff(np.append(at, len(s))), np.diff(np.append(at, len(s))))
        return Grouped(s[head], group, own)


def _counted(place: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """Tokens: their exact counts."""
    return counts.astype(np.uint64), [(TOTALS, struct.pack("<qq", int((counts > 0).sum()), int(counts.sum())))]


def _shard(place: np.ndarray, counts: np.ndarray, n: int, reply: bool, bits: int) -> tuple[np.ndarray | None, list[tuple[int, bytes]]]:
    """Longer n-grams: the range's shard, or its answers to the n-grams that were sent."""
    some = counts > 0
    shard = build_shard(place[some], counts[some], bits)
    if not reply:
        return None, [(10 + n, shard)]
    table = LogFrequencyFilter({}, np.frombuffer(shard, np.uint8))
    return table.probe(place, np.zeros(len(place), np.int64), np.full(len(place), len(shard))).astype(np.uint8), []


def lm_scores(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    broadcast_bytes: int = BROADCAST_BYTES,
    exclude_self: bool = True,
    bits: int = BITS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    base = docs.select(docs[text].alias("t"), docs[doc_id].alias("doc_id"))
    segments = G.stage(base, ["t", "doc_id"], "t", "lm")
    folder = run_dir(spark, "lm-counts")
    tokens = segments.words + segments.docs
    ranges = {1: G.Ranges.of(tokens // 4, segments.n)} | {n: G.Ranges.of(tokens, segments.n, NAME_BITS) for n in ORDERS[1:]}
    small = len(ORDERS[1:]) * (tokens * bits // 8) + 8 * sum(r.total for r in ranges.values()) <= broadcast_bytes

    def count(seg: int, path: str, got: dict) -> Iterator[pa.RecordBatch]:
        parts = [Tokens(batch) for batch in G.read(path)]
        train = np.concatenate([np.repeat(~t.held_out, t.n) for t in parts])
        for n in ORDERS:
            h, there = n_grams(parts, n)
            use = there & train if small and n > 1 else there
            distinct, group, _ = G.grouped(h[use])
            yield G.sent(seg, n, ranges[n], distinct, np.bincount(group, weights=train[use], minlength=len(distinct)).astype(np.int64))

    finals = {1: _counted} | {n: partial(_shard, n=n, reply=not small, bits=bits) for n in ORDERS[1:]}
    counted = G.exchange(G.map_segments(segments, count, G.SENT), segments.n, ranges, finals, folder)
    v = n_train = 0
    for r in counted.where(F.col("kind") == TOTALS).select("blob").collect():  # 16 bytes for each hash range
        a, b = struct.unpack("<qq", r[0])
        v, n_train = v + a, n_train + b
    table = None
    if small:
        found: dict[int, dict[int, bytes]] = {n: {} for n in ORDERS[1:]}
        for r in counted.where(F.col("kind") > 10).where(F.col("kind") < TOTALS).select("kind", "bucket", "blob").collect():  # broadcast_bytes at most
            found[r[0] - 10][r[1]] = bytes(r[2])
        table = spark.sparkContext.broadcast(LogFrequencyFilter.of(found, {n: ranges[n].total for n in found}))

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *SCHEMA])
    arrow = to_arrow_schema(schema)

    def score(seg: int, path: str, got: dict) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []
        for batch in G.read(path):
            ids.append(batch.column(1))
            parts.append(Tokens(batch))
        size = np.concatenate([t.n for t in parts])
        first = np.cumsum(size) - size
        held_out = np.concatenate([t.held_out for t in parts])
        text_of = np.repeat(np.arange(len(size)), size)
        off = (np.repeat(~held_out, size) & exclude_self).astype(np.int64)
        h, _ = n_grams(parts, 1)
        g = Grouped.of(h, text_of)
        counts = G.unpacked(got.get(1, []), np.uint64).astype(np.int64)
        exact = counts[g.group]
        base = np.log10((exact + ADD) / (n_train + ADD * (v + 1)))
        known = np.add.reduceat((exact > 0).astype(np.int64), first)
        c = exact - off * g.own
        p = (c + ADD) / (n_train - off * np.repeat(size, size) + ADD * (v + 1))
        history = np.concatenate([[0], c[:-1]])  # the first word's is the end token, once a text
        history[first] = counts[g.group[first + size - 1]] - off[first]
        for n in ORDERS[1:]:
            h, there = n_grams(parts, n)
            g = Grouped.of(h[there], text_of[there])
            q = table.value.lookup(n, g.distinct) if table is not None else G.unpacked(got.get(n, []), np.uint8).astype(np.int64)
            c = np.zeros(len(h))
            c[there] = np.maximum(expected(q)[g.group] - off[there] * g.own, 0)
            history = np.where(there, history, 0)
            p = (np.minimum(c, history) + MU[n] * p) / (history + MU[n])
            history = np.concatenate([[0.0], c[:-1]])
        total = [np.add.reduceat(x, first) for x in (base, np.log10(p))]
        columns = [pa.chunked_array(ids).combine_chunks(), held_out, size, known, np.full(len(size), n_train), *total]
        yield pa.RecordBatch.from_arrays(
            [(c if isinstance(c, pa.Array) else pa.array(c)).cast(arrow.field(k).type) for k, c in enumerate(columns)],
            schema=arrow
        )

    return G.map_segments(segments, score, schema, {n: counted for n in ORDERS})


def query(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
