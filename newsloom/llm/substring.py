"""Substring dedup by recompression.

A document's words are recompressed level by level (Jez 2013): maximal runs of one
symbol become one symbol, then each left-class symbol followed by a right-class one
becomes a pair.  Names and classes are hashes of what they stand for, so they are
global without any round of naming, and equal substrings get equal interior symbols.
Every symbol knows its *support*: the words that decide that it exists.  A window of 35
words that contains the support has the symbol wherever the window occurs.

Each window picks, by its own words alone, the leftmost symbol of the highest level
whose support it contains.  Equal windows pick equal symbols, so only windows whose
symbol occurs twice in the corpus can repeat: the first exchange finds those symbols.
The second verifies the windows that are left, by a 96-bit hash of their 35 words.
What a pass over a segment has worked out goes to a file in the shared folder, whose
name travels with the answers, so the next pass does not work it out again.

Defined cases: a null text has no words; a text of fewer words than a window keeps
them all; repeated rows and copies repeat each other, so all their windows go; null ids
stay; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom.llm import _segments as G
from newsloom.llm._shared import free_name, open_fs, run_dir
from newsloom.llm._text import SEEDS, TextBlock, join2, windows

WINDOW = 35
MAX_LEVELS = 12
U = np.uint64
#: A multiplier per level, whose product gives a symbol its class there.
_CLASS = [U(0x9E3779B97F4A7C15 * (1 + level) ** 9 & (1 << 64) - 1) | U(1) for level in range(MAX_LEVELS)]


class Words:
    """The word hashes of a segment, its texts' limits, and its blocks."""

    def __init__(self, path: str, window: int):
        hashes, sizes, self.blocks = [], [], []
        for batch in G.read(path):
            b = TextBlock(batch.column(0))
            hashes.append(b.words)
            sizes.append(b.n_words)
            self.blocks.append(b)
        self.hash = np.concatenate([*hashes, np.empty(0, U)])
        self.n_words = np.concatenate([*sizes, np.empty(0, np.int64)])
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        ok = np.maximum(self.n_words - window + 1, 0)
        self.starts = np.repeat(self.first[:-1] - (np.cumsum(ok) - ok), ok) + np.arange(ok.sum())
        self.window = window

    def picks(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window the number of the symbol it picks, and the symbols' names."""
        n, k = len(self.hash), self.window
        I = np.int32 if n < 1 << 30 else np.int64
        text_of = np.repeat(np.arange(len(self.n_words), dtype=I), self.n_words)
        first = self.first.astype(I)
        name, low, high = self.hash, np.arange(n, dtype=I), np.arange(1, n + 1, dtype=I)  # a symbol and its support
        levels = [(name, low, high)]
        for level in range(MAX_LEVELS):
            if len(name) < 2:
                break
            # runs: first and last symbol of each
            change = np.ones(len(name), bool)
            np.logical_or(name[1:] != name[:-1], text_of[1:] != text_of[:-1], out=change[1:])
            head = np.flatnonzero(change).astype(I)
            tail = np.append(head[1:], I(len(name))) - I(1)
            run, long_ = name[head], np.flatnonzero(tail > head)
            left = (run * _CLASS[level] >> U(47) & U(1)).astype(bool)  # classes by the base symbol
            if len(long_):
                run[long_] = join2(run[long_], (tail - head + 1)[long_].astype(U), 2 * level + 101)
            # pairs: a left-class symbol and the right-class one after it, in one text
            first_of = np.flatnonzero(left[:-1] & ~left[1:] & (text_of[head[1:]] == text_of[head[:-1]]))
            kept = np.ones(len(head), bool)
            kept[first_of + 1] = False
            paired = run[first_of + 1]
            run[first_of] = join2(run[first_of], paired, 2 * level + 102)
            tail[first_of] = tail[first_of + 1]
            p, q = head[kept], tail[kept]
            merged, t = run[kept], text_of[p]
            # support: up to the neighbours on both sides, or past the text's end
            before, after = low[np.maximum(p - 1, 0)], high[np.minimum(q + 1, len(name) - 1)]
            edge = np.ones(len(t), bool)
            edge[1:] = t[1:] != t[:-1]
            before[edge] = first[t[edge]] - 1
            edge[:-1] = edge[1:]
            edge[-1:] = True
            after[edge] = first[t[edge] + 1] + 1
            name, low, high, text_of = merged, before, after, t
            if not (high - low <= k).any():
                break
            levels.append((name, low, high))
        chosen, names, total = np.full(len(self.starts), -1, I), [], 0
        open_ = np.arange(len(self.starts), dtype=I)
        for level in range(len(levels) - 1, -1, -1):
            name, low, high = levels[level]
            start = self.starts[open_].astype(I)
            below = np.cumsum(np.bincount(low + 1, minlength=n + 2), dtype=I)  # supports that begin before a word
            j = below[start]
            inside = np.append(high, np.iinfo(I).max)[j] <= start + k
            mine = j[inside]  # ascending
            new = np.ones(len(mine), bool)
            new[1:] = mine[1:] != mine[:-1]
            used = mine[new]
            chosen[open_[inside]] = total + np.cumsum(new, dtype=I) - 1
            names.append(join2(name[used], np.full(len(used), level, U), 5))
            total += len(used)
            open_ = open_[~inside]
            if not len(open_):
                break
        return chosen, np.concatenate([*names, np.empty(0, U)])

    def named(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows at ``at`` by 96 bits: distinct names and checks, how many windows
        have each, and the number of each window's."""
        name, check = self.window_names(at), self.window_checks(at)
        order = np.lexsort((check, name))
        head = np.ones(len(at), bool)
        head[1:] = (name[order][1:] != name[order][:-1]) | (check[order][1:] != check[order][:-1])
        group = np.empty(len(at), np.int64)
        group[order] = np.cumsum(head) - 1
        return name[order][head], check[order][head], np.bincount(group, minlength=int(head.sum())), group

    def window_names(self, at: np.ndarray) -> np.ndarray:
        """64 bits of hash for the windows at ``at``."""
        inside, place = self._covered(at)
        return windows(self.hash[inside], self.window)[place] if len(at) else np.empty(0, U)

    def window_checks(self, at: np.ndarray) -> np.ndarray:
        """32 bits of another hash for them."""
        if not len(at):
            return np.empty(0, np.uint32)
        inside, place = self._covered(at)
        second, first = [], 0
        for b in self.blocks:
            mine = inside[first : first + len(b.starts)]
            second.append(b.span_hash(b.starts[mine], b.ends[mine], 1))
            first += len(b.starts)
        return (windows(np.concatenate(second) * SEEDS[1], self.window)[place] >> U(32)).astype(np.uint32)

    def _covered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flags of the words that the windows at ``at`` cover, and where each window
        starts among those words alone."""
        inside = covered(at, self.window, len(self.hash))
        return inside, (np.cumsum(inside) - 1)[at]


def covered(at: np.ndarray, window: int, n: int) -> np.ndarray:
    """Flags of ``n`` words: those within the windows that start at ``at`` (distinct)."""
    step = np.zeros(n + 1, np.int32)
    step[at] += 1
    step[at + window] -= 1
    return np.cumsum(step[:-1]) > 0


def put(folder: str, seg: int, flags: np.ndarray, numbers: np.ndarray) -> bytes:
    """Write flags and numbers below 2^32 to a new file, which a failed attempt leaves
    unnamed; the file's name."""
    fs, inner = open_fs(folder)
    fs.create_dir(inner, recursive=True)
    name = f"{seg}-{uuid.uuid4().hex[:12]}.bin"
    parts = G.packed(np.packbits(flags)), G.packed(numbers.astype(np.uint32))
    with fs.open_output_stream(f"{inner}/{name}") as f:
        f.write(struct.pack("<QQ", len(flags), len(parts[0])) + b"".join(parts))
    return f"{folder}/{name}".encode()


def got_back(name: bytes) -> tuple[np.ndarray, np.ndarray]:
    fs, inner = open_fs(name.decode())
    with fs.open_input_file(inner) as f:
        raw = f.read()
    n, size = struct.unpack_from("<QQ", raw)
    flags = np.unpackbits(G.unpacked([raw[16 : 16 + size]], np.uint8), count=n).astype(bool)
    return flags, G.unpacked([raw[16 + size :]], np.uint32)


def repeats(segments: G.Segments, window: int, folder: str) -> dict[int, DataFrame]:
    """Replies by kind: 2 for repeated windows, 3 for each segment's own candidates."""
    r1, r2 = G.Ranges.of(segments.words // 4, segments.n), G.Ranges.of(segments.words // 2, segments.n)

    def symbols(seg: int, path: str, got: dict) -> Iterator[pa.RecordBatch]:
        chosen, names = Words(path, window).picks()
        distinct, group, count = G.grouped(names)
        yield G.sent(seg, 1, r1, distinct, count)
        # of windows side by side that pick the same symbol, the first has its number
        new = np.ones(len(chosen), bool)
        new[1:] = chosen[1:] != chosen[:-1]
        yield G.passed(seg, 4, r1.first, put(f"{folder}/picks", seg, new, group[chosen[new]]))

    def verify(seg: int, path: str, got: dict) -> Iterator[pa.RecordBatch]:
        w = Words(path, window)
        new, picked = got_back(got[4][0])
        twice = G.unpacked(got.get(1, []), np.uint8).astype(bool)
        at = w.starts[twice[picked][np.cumsum(new) - 1]] if len(new) else w.starts
        name, check, count, group = w.named(at)
        yield G.sent(seg, 2, r2, name, count, check)
        flags = np.zeros(len(w.hash), bool)
        flags[at] = True
        yield G.passed(seg, 3, r2.first, put(f"{folder}/candidates", seg, flags, group))

    first = G.exchange(G.map_segments(segments, symbols, G.SENT), segments.n, {1: r1}, {1: G.twice}, f"{folder}/symbols")
    second = G.exchange(G.map_segments(segments, verify, G.SENT, {1: first, 4: first}), segments.n, {2: r2}, {2: G.twice}, f"{folder}/windows")
    return {2: second, 3: second}


def removed(got: dict[int, list[bytes]], window: int) -> np.ndarray:
    """Flags of the words that some repeated window covers."""
    flags, group = got_back(got[3][0])
    twice = G.unpacked(got.get(2, []), np.uint8).astype(bool)
    return covered(np.flatnonzero(flags)[twice[group]], window, len(flags))


def substring_dedup(docs: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """``docs`` with the words of repeated windows gone (``keep``: the other columns to
    carry).  A text that loses words becomes its kept words joined by one space; any other
    stays as it is.  With ``digest``: ``keep``, n_words, n_removed and kept_sha256."""
    others = [c for c in (docs.columns if keep is None else keep) if c != text]
    segments = G.stage(docs, [text, *others], text, "substring")
    replies = repeats(segments, window, run_dir(docs.sparkSession, "substring-replies"))
    new = [T.StructField(free_name(others, "n_words"), T.LongType()), T.StructField(free_name(others, "n_removed"), T.LongType())]
    last = T.StructField(free_name(others, "kept_sha256"), T.StringType()) if digest else T.StructField(text, T.StringType())
    schema = T.StructType([docs.schema[c] for c in others] + new + [last])
    arrow = to_arrow_schema(schema)

    def finish(seg: int, path: str, got: dict) -> Iterator[pa.RecordBatch]:
        total = np.concatenate([[0], np.cumsum(removed(got, window))])
        gone, word = np.diff(total).astype(bool), 0
        for batch in G.read(path):
            b = TextBlock(batch.column(0))
            first = word + b.first_word
            lost = total[first[1:]] - total[first[:-1]]
            new = np.ones(b.n, bool) if digest else lost > 0
            out = []
            for i in np.flatnonzero(new).tolist():
                words = b.slice_bytes(i).split()
                if lost[i]:
                    words = list(compress(words, (~gone[first[i] : first[i + 1]]).tolist()))
                kept = b" ".join(words)
                out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            column = pa.array(out, pa.string())
            if not digest:
                column = pc.replace_with_mask(batch.column(0), pa.array(new), column.cast(batch.column(0).type))
            columns = [*batch.columns[1:], pa.array(b.n_words), pa.array(lost), column]
            yield pa.RecordBatch.from_arrays([c.cast(arrow.field(k).type) for k, c in enumerate(columns)], schema=arrow)
            word = first[-1]

    return G.map_segments(segments, finish, schema, replies)


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"], digest=True)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages go; ``n_chars`` follows the new text."""
    from pyspark.sql import functions as F

    out = substring_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 34], chr(32)) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM g) WHERE c >= 2),
gone AS (SELECT DISTINCT r, i + j AS p FROM twice, range(35) AS o(j)),
x AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT x.r, string_agg(word, chr(32) ORDER BY x.p) AS t, count(*) AS n FROM x LEFT JOIN gone ON gone.r = x.r AND gone.p = x.p WHERE gone.p IS NULL GROUP BY x.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""
