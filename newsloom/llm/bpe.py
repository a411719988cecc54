"""Byte-level BPE over a rank file, with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (levels of bit arrays with
ranks, Limasset et al. 2017) gives the slot of a whole pre-token; the slot's bytes
confirm it.  Tier two: other pre-tokens are merged by a heap of (rank, position)
over linked bytes.  Both run once per new pre-token of a block; a memo of bounded
size carries results between blocks.

Defined cases: a null text is an empty one, with no ids; repeated rows are encoded one
by one; an empty table gives an empty result; further columns pass through, clashing
names get underscores.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from newsloom.llm import _stats as S
from newsloom.llm._shared import CACHES
from newsloom.llm._text import TextBlock, mix

GAMMA, MEMO = 1.5, 250_000
_LOW = (1 << 32) - 1


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def key_hash(keys: list[bytes]) -> np.ndarray:
    """64-bit hash of each byte string (none may be empty)."""
    b = object.__new__(TextBlock)
    b.data = np.frombuffer(b"".join(keys), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))
    return b.span_hash(np.concatenate([[0], ends[:-1]]), ends) if keys else np.empty(0, np.uint64)


class PerfectHash:
    """Maps each of n distinct 64-bit keys to its own slot below n; any other key
    to some slot or -1."""

    def __init__(self, keys: np.ndarray):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("the keys' hashes are not distinct")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, before = keys, 0
        while len(rest):
            size = max(64, int(len(rest) * GAMMA))
            at = self._place(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = before + np.cumsum(alone) - alone
            self.levels.append((alone, rank.astype(np.int32)))
            before += int(alone.sum())
            rest = rest[~alone[at]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            at = self._place(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


class ByteBPE:
    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        self.ranks = load_ranks(path)
        self.find = regex.compile(pattern).findall
        tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.hash = PerfectHash(key_hash(tokens))
        order = self.hash.slots(key_hash(tokens))
        self.slot_token: list[bytes] = [b""] * len(tokens)
        for t, s in zip(tokens, order.tolist(), strict=True):
            self.slot_token[s] = t
        top = max(self.ranks.values(), default=0)
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.bytes_of: list[bytes] = [b""] * (top + 1)
        for t, r in self.ranks.items():
            self.bytes_of[r] = t
        self.digits = [str(i) for i in range(top + 1)]
        self.slot_ids = [np.array([self.ranks[t]], self.dtype).tobytes() for t in self.slot_token]
        self.memo, self.young, self.old = memo, {}, {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: always the pair of lowest rank, leftmost first."""
        n, get = len(piece), self.ranks.get
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # of the pair that starts at i
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        rank.append(-1)
        heapify(heap)
        while heap:
            x = heappop(heap)
            i = x & _LOW
            if rank[i] != x >> 32:  # merged away, or another pair by now
                continue
            j = right[i]
            right[i] = k = right[j]
            rank[j] = -1
            if k < n:
                left[k] = i
                rank[i] = r = get(piece[i : right[k]], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                rank[i] = -1
            p = left[i]
            if p >= 0:
                rank[p] = r = get(piece[p:k], -1)
                if r >= 0:
                    heappush(heap, r << 32 | p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : right[i]]])
            i = right[i]
        return out

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        slots = self.hash.slots(key_hash(raw)).tolist()
        young, token, ids, merge, dtype = self.young, self.slot_token, self.slot_ids, self.merge, self.dtype
        for w, b, s in zip(words, raw, slots, strict=True):
            young[w] = ids[s] if s >= 0 and token[s] == b else np.array(merge(b), dtype).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [self.find(t) for t in texts]
        new, young, old = [], self.young, self.old
        for w in set().union(*pieces):
            if w not in young:
                ids = old.get(w)
                if ids is None:
                    new.append(w)
                else:
                    young[w] = ids
        if new:
            self._learn(new)
        out = [np.frombuffer(b"".join(map(young.__getitem__, p)), self.dtype) for p in pieces]
        if len(young) > self.memo:
            self.old, self.young = young, {}
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], ByteBPE] = {}
CACHES.append(_ENCODERS)


def encoder(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ByteBPE(path, pattern)
    return _ENCODERS[path, pattern]


SCHEMA = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
)


def encode_texts(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    ranks: str | None = None,
    pattern: str | None = None,
    digest: bool = False
) -> DataFrame:
    """``keep`` (default: all columns) with ``ids`` (array<int>), or with
    ``digest`` the digests of the ids and of the bytes they decode to."""
    path, pattern = ranks or default_file(), pattern or default_pattern()

    def fn(b: TextBlock) -> dict:
        bpe = encoder(path, pattern)
        got = bpe.encode([b.slice_bytes(i).decode() for i in range(b.n)])
        n = np.array([len(x) for x in got], np.int64)
        if not digest:
            import pyarrow as pa

            return {
                "ids": pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(n)]).astype(np.int32),
                    np.concatenate([*got, np.empty(0)]).astype(np.int32)
                )
            }
        ids_sha, text_sha, digits = [], [], bpe.digits
        for x in got:
            ids = x.tolist()
            ids_sha.append(hashlib.sha256(" ".join([digits[i] for i in ids]).encode()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return {"n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    new = SCHEMA if digest else T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return S.map_texts(docs, text, docs.columns if keep is None else keep, new, fn)


def decode_ids(column: str, ranks: str | None = None, pattern: str | None = None):
    """Column of the bytes that an array column of ids stands for."""
    from pyspark.sql import functions as F

    path, pattern = ranks or default_file(), pattern or default_pattern()

    def run(lists):
        import pyarrow as pa

        bpe = encoder(path, pattern)
        return pa.array([None if x is None else bpe.decode(x) for x in lists.to_pylist()], pa.binary())

    return F.arrow_udf(run, T.BinaryType())(column)


def query(spark, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"], digest=True)
