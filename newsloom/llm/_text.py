"""Vectorised text kernels over Arrow string columns.

A :class:`TextBlock` holds a few megabytes of whole texts as one byte array.
Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; this equals the
regex ``[^\\x20\\x09-\\x0D]+`` on the decoded text, as all six separators are
ASCII.  Everything per word or per window is numpy, never a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SYMBOLS = b"#*$%&|<>"
#: Two independent hash families; a pair of them is a 128-bit name.
SEEDS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_C1, _C2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_POW: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x *= _C1
    x ^= x >> U(33)
    x *= _C2
    x ^= x >> U(33)
    return x


def join2(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * SEEDS[0] + ((b << U(31)) | (b >> U(33))) * SEEDS[1] + U(salt))


def _powers(seed: int, n: int) -> np.ndarray:
    have = _POW.get(seed)
    if have is None or len(have) < n:
        base = np.full(max(n, 256), SEEDS[seed] | U(1))
        base[0] = 1
        have = np.multiply.accumulate(base)
        if len(have) <= 1 << 16:
            _POW[seed] = have
    return have[:n]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive entries of ``h`` (across texts too: callers
    keep only the starts that have ``k`` words in one text)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out, done, level, size = None, 0, h, 1
    while True:
        if k & size:
            part = level[done : done + n]
            out = part if out is None else join2(out, part, size)
            done += size
        if done == k:
            return out.copy() if out is level else out
        level = join2(level[:-size], level[size:], size) if len(level) > size else level[:0]
        size *= 2


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``column`` with at most ``limit`` bytes, or one longer text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class TextBlock:
    """Whole texts as bytes; a null text counts as an empty one."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        if pa.types.is_string(column.type):
            column = column.cast(pa.large_string())
        column = column.cast(pa.large_binary())
        column = pc.fill_null(column, b"") if column.null_count else column
        self.n = len(column)
        parts = column.buffers()
        off = np.frombuffer(parts[1], np.int64, count=column.offset + self.n + 1)[column.offset :] if self.n else np.zeros(1, np.int64)
        data = np.frombuffer(parts[2], np.uint8) if parts[2] is not None and parts[2].size else np.empty(0, np.uint8)
        self.data = data[off[0] : off[-1]]
        self.off = off - off[0]
        if lower:
            self.data = _LOWER[self.data]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Count of set byte flags in each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]

    @cached_property
    def space(self) -> np.ndarray:
        return _SPACE[self.data]

    @cached_property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        solid = ~self.space
        before = np.empty(len(solid), bool)
        before[:1] = True
        before[1:] = self.space[:-1]
        inner = self.off[1:-1]
        before[inner[inner < len(before)]] = True
        starts = np.flatnonzero(solid & before)
        after = np.empty(len(solid), bool)
        after[-1:] = True
        after[:-1] = self.space[1:]
        after[inner[inner > 0] - 1] = True
        return starts, np.flatnonzero(solid & after) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._edges[0]

    @property
    def ends(self) -> np.ndarray:
        return self._edges[1]

    @cached_property
    def first_word(self) -> np.ndarray:
        """Index of each text's first word; one more entry ends the last text."""
        return np.searchsorted(self.starts, self.off)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    @cached_property
    def word_text(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(self.n), self.n_words)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hash of each non-empty, ordered, disjoint byte span."""
        if not len(starts):
            return np.empty(0, U)
        sizes = ends - starts
        at = np.cumsum(sizes) - sizes
        local = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
        bytes_ = self.data[local + np.repeat(starts, sizes)].astype(U)
        bytes_ += U(1)
        bytes_ *= _powers(seed, int(sizes.max()))[local]
        return mix(np.add.reduceat(bytes_, at) + U(seed))

    def word_hash(self, seed: int = 0) -> np.ndarray:
        return self.span_hash(self.starts, self.ends, seed)

    @cached_property
    def words(self) -> np.ndarray:
        return self.word_hash()

    def in_text(self, k: int) -> np.ndarray:
        """Which window starts have all their ``k`` words in one text."""
        n = len(self.starts) - k + 1
        return self.word_text[: max(n, 0)] == self.word_text[k - 1 :] if n > 0 else np.empty(0, bool)

    def repeated(self, k: int) -> np.ndarray:
        """Per text, the words within some ``k``-word window that the text holds
        at least twice (the first one counts too)."""
        ok = np.flatnonzero(self.in_text(k))
        if not len(ok):
            return np.zeros(self.n, np.int64)
        key = join2(windows(self.words, k)[ok], self.word_text[ok].astype(U), 7)
        return self.per_word_sum(self.covered(ok[duplicated(key)], k))

    def covered(self, at: np.ndarray, k: int) -> np.ndarray:
        """Flags of the words within the ``k``-word windows that start at ``at``."""
        step = np.zeros(len(self.starts) + 1, np.int32)
        step[at] += 1
        np.subtract.at(step, at + k, 1)
        return np.cumsum(step[:-1]) > 0

    def per_word_sum(self, flags: np.ndarray) -> np.ndarray:
        """Count of set word flags in each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.first_word[1:]] - total[self.first_word[:-1]]

    def dup_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Per text: lines with a word, and those equal to an earlier line."""
        inner = self.off[1:-1]
        cut = np.unique(
            np.concatenate([np.flatnonzero(self.data == 10), inner - 1, [len(self.data) - 1]])
        ) if len(self.data) else np.empty(0, np.int64)
        cut = cut[cut >= 0]
        ends = cut + 1
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        ends = ends - (self.data[cut] == 10)
        wordy = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends = starts[wordy], ends[wordy]
        text = np.searchsorted(self.off, starts, side="right") - 1
        key = join2(self.span_hash(starts, ends), text.astype(U), 11)
        lines = np.bincount(text, minlength=self.n)
        once = np.unique(key, return_index=True)[1]
        return lines, lines - np.bincount(text[once], minlength=self.n)

    def slice_bytes(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def duplicated(key: np.ndarray) -> np.ndarray:
    """Flags of the entries whose value occurs at least twice."""
    if not len(key):
        return np.empty(0, bool)
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    flag = np.zeros(len(s), bool)
    flag[1:] |= same
    flag[:-1] |= same
    out = np.empty(len(s), bool)
    out[order] = flag
    return out
