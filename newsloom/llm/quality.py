"""Quality rules as a short-circuit cascade.

The base figures of a document are always computed.  The further rules form a
cascade: a rule sees only the documents that every rule before it let pass, and
the order is by rejections per second, both estimated on a bounded sample: the first
documents of up to ``SAMPLE_PARTS`` partitions spread over the table, ``sample_rows`` and
``sample_bytes`` in all, measured where they lie.  A document is kept when no rule rejects it, so the
order decides only the work, never the verdict.

Defined cases: null or empty text has no words and fails the base rule
(``n_words < 20``); repeated rows are judged one by one; an empty table gives an
empty result; further columns pass through, and a clashing name gets underscores.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom.llm import _stats as S
from newsloom.llm._shared import small_batches
from newsloom.llm._text import TextBlock, blocks

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_PARTS = 1000, 4 << 20, 8


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the block of the documents still alive and their base
    figures, and flags those to reject."""

    name: str
    rejects: Callable[[TextBlock, dict[str, np.ndarray]], np.ndarray]


def _over(part: np.ndarray, whole: np.ndarray, percent: int) -> np.ndarray:
    return 100 * part > percent * whole


def _dup_lines(b: TextBlock, base: dict) -> np.ndarray:
    lines, dup = b.dup_lines()
    return _over(dup, lines, 40)


#: Rejects a document whose ... share is above the limit.
RULES = (
    Rule("symbols", lambda b, base: _over(base["n_symbols"], base["word_chars"], 5)),
    Rule("marks", lambda b, base: _over(S.n_marks(b), base["word_chars"], 5)),
    Rule("capitals", lambda b, base: _over(S.n_upper(b), base["word_chars"], 50)),
    Rule("adjacent", lambda b, base: _over(S.n_adjacent(b), base["n_words"], 25)),
    Rule("lines", _dup_lines),
    Rule("top_word", lambda b, base: _over(S.word_spread(b)[1], base["n_words"], 30)),
    Rule("long_words", lambda b, base: base["word_chars"] > 20 * base["n_words"]),
)
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in FIGURES] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def base_figures(b: TextBlock) -> dict[str, np.ndarray]:
    out = {
        "n_words": b.n_words, "word_chars": S.word_chars(b), "n_symbols": S.n_symbols(b),
        "n_dup_lines": b.dup_lines()[1], "n_repeat_words": b.repeated(WINDOW)
    }
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | _over(out["n_repeat_words"], out["n_words"], REPEAT_PERCENT)
    return out


def pick(b: TextBlock, rows: np.ndarray) -> TextBlock:
    """The block of only these texts."""
    sizes = np.diff(b.off)[rows]
    out = object.__new__(TextBlock)
    out.n, out.off = len(rows), np.concatenate([[0], np.cumsum(sizes)])
    out.data = b.data[np.repeat(b.off[rows] - out.off[:-1], sizes) + np.arange(out.off[-1])]
    return out


def cascade(
    b: TextBlock,
    base: dict[str, np.ndarray],
    rules: tuple[Rule, ...],
    spent: dict | None = None,
    clock: Callable[[], float] = time.perf_counter
) -> np.ndarray:
    """Which documents no rule rejects.  A rule runs on the survivors alone.
    ``spent`` gathers (seconds, documents seen, rejected) by rule, and then every
    rule sees every document, so that the figures don't depend on an order."""
    kept = ~base["base_failed"]
    alive = b
    for rule in rules:
        rows = np.flatnonzero(kept) if spent is None else np.arange(b.n)
        if not len(rows):
            break
        if len(rows) != alive.n:
            alive = pick(b, rows)
        began = clock()
        bad = rule.rejects(alive, {k: v[rows] for k, v in base.items()})
        if spent is not None:
            s = spent.setdefault(rule.name, [0.0, 0, 0])
            s[0] += clock() - began
            s[1] += len(rows)
            s[2] += int((bad & ~base["base_failed"]).sum())
        kept[rows[bad]] = False
    return kept


_SPENT = T.StructType([T.StructField("rule", T.StringType()), T.StructField("seconds", T.DoubleType()), T.StructField("rejected", T.LongType())])


def ordered(
    docs: DataFrame,
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
    clock: Callable[[], float] = time.perf_counter
) -> tuple[Rule, ...]:
    """The rules by rejections per second.  Only a row of figures for each rule and
    sampled partition comes to the driver."""
    column = docs.select(docs[text])
    total = max(1, column.rdd.getNumPartitions())
    parts = min(total, SAMPLE_PARTS)
    chosen = {i * total // parts for i in range(parts)}
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() not in chosen:
            return
        spent: dict[str, list] = {}
        rows, size = sample_rows // parts, sample_bytes // parts
        for batch in batches:
            for a, e in blocks(batch.column(0), max(1, sample_bytes // parts)):
                piece = batch.column(0).slice(a, min(e - a, rows))
                for rule in rules:  # a block of its own for each rule: nothing another rule computed comes for free
                    cascade(TextBlock(piece), base_figures(TextBlock(piece)), (rule,), spent, clock)
                rows, size = rows - len(piece), size - piece.nbytes
                if rows <= 0 or size <= 0:
                    break
            if rows <= 0 or size <= 0:
                break
        yield pa.RecordBatch.from_pydict(
            {"rule": [*spent], "seconds": [float(s[0]) for s in spent.values()], "rejected": [s[2] for s in spent.values()]},
            schema=to_arrow_schema(_SPENT)
        )

    found = column.mapInArrow(run, _SPENT).groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect()
    gain = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-12) for r in found}
    return tuple(sorted(rules, key=lambda r: -gain.get(r.name, 0.0)))


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    rules: tuple[Rule, ...] | None = None,
    only_kept: bool = False
) -> DataFrame:
    """Base figures and verdict of each document, beside the columns ``keep``
    (default: all).  ``only_kept`` returns just the kept documents' ``keep``."""
    keep = docs.columns if keep is None else keep
    rules = ordered(docs, text) if rules is None else rules

    def judge(b: TextBlock) -> dict[str, np.ndarray]:
        base = base_figures(b)
        return base | {"kept": cascade(b, base, rules)}

    out = S.map_texts(docs, text, keep, SCHEMA, judge, (lambda found: found["kept"]) if only_kept else None)
    return out.select(*keep) if only_kept else out


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, keep=["doc_id"])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go."""
    return quality_rules(docs, only_kept=True)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: DuckDB SQL for query().
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
s AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^!?]', '', 'g')) AS marks, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(list_sum(list_transform(range(2, len(w) + 1), lambda i: (w[i] = w[i - 1])::INT)), 0) AS adjacent
  FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 7], chr(32)) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c >= 2),
rep AS (SELECT r, count(DISTINCT i + j)::BIGINT AS n FROM twice, range(8) AS o(j) GROUP BY r),
top AS (SELECT r, max(c) AS c FROM (SELECT r, x, count(*) AS c FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r, x) GROUP BY r),
f AS (
  SELECT s.*, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(top.c, 0) AS top
  FROM s LEFT JOIN rep USING (r) LEFT JOIN top USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 5 * word_chars OR 100 * marks > 5 * word_chars OR 100 * upper > 50 * word_chars
    OR 100 * adjacent > 25 * n_words OR 100 * n_dup_lines > 40 * n_lines OR 100 * top > 30 * n_words
    OR word_chars > 20 * n_words) AS kept
FROM b"""
