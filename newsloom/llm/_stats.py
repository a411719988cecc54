"""Whole-text statistics that the quality rules and the quality classifier use,
and the Arrow plumbing that runs such statistics over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom.llm._shared import enter_stage, free_name, small_batches, trim
from newsloom.llm._text import SYMBOLS, TextBlock, blocks, join2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def word_chars(b: TextBlock) -> np.ndarray:
    return b.per_text(~b.space & ((b.data & 0xC0) != 0x80))


def n_symbols(b: TextBlock) -> np.ndarray:
    return b.per_text(_SYMBOL[b.data])


def n_marks(b: TextBlock) -> np.ndarray:
    """Exclamation and question marks."""
    return b.per_text((b.data == 33) | (b.data == 63))


def n_upper(b: TextBlock) -> np.ndarray:
    """ASCII capitals."""
    return b.per_text((b.data >= 65) & (b.data <= 90))


def n_digits(b: TextBlock) -> np.ndarray:
    return b.per_text((b.data >= 48) & (b.data <= 57))


def n_adjacent(b: TextBlock) -> np.ndarray:
    """Words equal to the word before."""
    same = np.zeros(len(b.starts), bool)
    same[1:] = (b.words[1:] == b.words[:-1]) & (b.word_text[1:] == b.word_text[:-1])
    return b.per_word_sum(same)


def word_spread(b: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct words, and the count of its most frequent word."""
    if not len(b.words):
        return np.zeros(b.n, np.int64), np.zeros(b.n, np.int64)
    key = join2(b.words, b.word_text.astype(np.uint64), 3)
    order = np.argsort(key)
    key, t = key[order], b.word_text[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(head, len(key)))
    top = np.zeros(b.n, np.int64)
    np.maximum.at(top, t[head], size)
    return np.bincount(t[head], minlength=b.n), top


def map_texts(
    docs: DataFrame,
    text: str,
    keep: list[str],
    new: T.StructType,
    fn: Callable[[TextBlock], dict[str, np.ndarray]],
    where: Callable[[dict], np.ndarray] | None = None,
    lower: bool = False
) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the columns ``new`` that ``fn`` computes
    from blocks of whole texts.  A new name that clashes with a kept one gets
    underscores.  ``where`` picks the rows to return."""
    small_batches(docs.sparkSession)
    fields = list(new.fields)
    named = {}
    for f in fields:
        named[f.name] = free_name([*keep, *named.values()], f.name)
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField(named[f.name], f.dataType) for f in fields])
    arrow = to_arrow_schema(out)
    at = [docs.columns.index(c) for c in dict.fromkeys([*keep, text])]
    source = docs.select(*[docs[docs.columns[i]] for i in at])
    n_keep, text_at = len(keep), list(dict.fromkeys([*keep, text])).index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter_stage()
        for batch in batches:
            for a, b in blocks(batch.column(text_at)):
                part = batch.slice(a, b - a)
                found = fn(TextBlock(part.column(text_at), lower))
                columns = [part.column(i) for i in range(n_keep)] + [pa.array(found[f.name]) for f in fields]
                columns = [c.cast(arrow.field(i).type) for i, c in enumerate(columns)]
                rows = pa.RecordBatch.from_arrays(columns, schema=arrow)
                if where is not None:
                    rows = rows.filter(pa.array(where(found)))
                if rows.num_rows:
                    yield rows
        trim()

    return source.mapInArrow(run, out)
