"""The corpus pipeline: quality rules, quality classifier, near-duplicates,
substring dedup and packing, each over all that the one before kept.

Defined cases, for every stage: a null text counts as empty, so the quality rules reject
it; rows that repeat are judged one by one until near-duplicates keeps one of them; a null
id stays a null id; a table without rows gives one without rows; further columns of the
documents pass through all stages but the last, whatever their names.

Stages 2 to 4 leave intermediate tables in the shared folder for as long as their result
may still be read lazily.  A later stage's call deletes those of earlier stages of the same
thread, but never a folder that its own input reads from: so a stage is called when the
result of the one before has been written (as ``run`` does), or composed on it lazily.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import classifier, neardup, packing, quality, substring
from newsloom.llm._shared import dropped, recorded, run_dir, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_MADE = threading.local()


def _in_turn(at: int, stage: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        made: dict[int, list[str]] = _MADE.__dict__.setdefault("by_stage", {})
        read = docs.inputFiles() if any(made.values()) else []
        for earlier in [i for i in made if i < at]:
            still = [f for f in made[earlier] if any(f.split(":")[-1].lstrip("/") in x for x in read)]
            dropped([f for f in made[earlier] if f not in still])
            made[earlier] = still
        with recorded(made.setdefault(at, [])):
            return stage(spark, docs, sf_dir)

    return run


_NAMED = (
    ("quality rules", quality.stage),
    ("quality classifier", classifier.stage),
    ("near-duplicates", neardup.stage),
    ("substring dedup", substring.stage),
    ("packing", packing.stage),
)
STAGES = [(name, _in_turn(i, stage)) for i, (name, stage) in enumerate(_NAMED)]

#: A learned classifier has no SQL; the tests hold each stage's rows against brute force on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = run_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
