"""Quality classifier: regularised quadratic discriminant analysis.

Each document becomes eleven transformed statistics (logs, roots and saturated
shares of its whole text).  Per class the mean and covariance come from exact sums
over all labelled training rows, gathered as one row per partition; the covariance
is shrunk towards the diagonal of the pooled variances (Friedman 1989), factored
once by Cholesky, and the factors are cached in the model that goes to the workers.
The score is the logistic of the difference of the two log densities
``log prior - log|L| - |L^-1 (x - mean)|^2 / 2``.

Labels are learned only from rows whose ``crc32(doc_id as text) mod 5`` is not 0.

Defined cases: null text counts as empty and is scored like any other; a null label
or null doc_id teaches nothing; repeated label rows each count; without any training row
the score is 0.5, with one class only it is 1 or 0; an empty table gives an empty
result; clashing column names get underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm import _stats as S
from newsloom.llm._shared import enter_stage, free_name, run_dir, written
from newsloom.llm._text import TextBlock

SHRINKAGE, THRESHOLD, WINDOW = 0.05, 0.3, 8
N_FEATURES = 11


def _share(part: np.ndarray, whole: np.ndarray, half: float) -> np.ndarray:
    """A share, saturated so that ``half`` becomes one half."""
    x = part / whole
    return x / (x + half)


def features(b: TextBlock) -> np.ndarray:
    """One row of statistics for each text."""
    chars, n = np.maximum(S.word_chars(b), 1), np.maximum(b.n_words, 1)
    lines, dup = b.dup_lines()
    lines = np.maximum(lines, 1)
    distinct, top = S.word_spread(b)
    return np.stack(
        [
            np.log1p(b.n_words),
            _share(S.n_symbols(b), chars, 0.02),
            _share(S.n_marks(b), chars, 0.02),
            _share(S.n_upper(b), chars, 0.2),
            _share(S.n_adjacent(b), n, 0.1),
            _share(b.repeated(WINDOW), n, 0.3),
            _share(dup, lines, 0.3),
            np.log(chars / n),
            np.sqrt(distinct / n),
            np.sqrt(top / n),
            np.log(n / lines),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Model:
    """Per class: log prior, mean, Cholesky factor, and its log determinant."""

    classes: dict[int, tuple[float, np.ndarray, np.ndarray, float]]

    @staticmethod
    def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Model:
        """``sums``: by class the count, the sum and the sum of outer products."""
        sums = {c: s for c, s in sums.items() if s[0] > 0}
        if not sums:
            return Model({})
        total = sum(s[0] for s in sums.values())
        mean = sum(s[1] for s in sums.values()) / total
        pooled = np.diag(sum(s[2] for s in sums.values()) / total) - mean**2
        pooled = np.maximum(pooled, 0) + 1e-6
        out = {}
        for c, (n, s, ss) in sums.items():
            m = s / n
            cov = (1 - shrinkage) * (ss / n - np.outer(m, m)) + shrinkage * np.diag(pooled)
            low = np.linalg.cholesky(cov)
            out[c] = (float(np.log(n / total)), m, low, float(np.log(np.diag(low)).sum()))
        return Model(out)

    def log_density(self, c: int, x: np.ndarray) -> np.ndarray:
        prior, mean, low, logdet = self.classes[c]
        z = np.linalg.solve(low, (x - mean).T)
        return prior - logdet - 0.5 * (z * z).sum(axis=0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if set(self.classes) != {0, 1}:
            return np.full(len(x), {(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(sorted(self.classes))])
        d = np.clip(self.log_density(1, x) - self.log_density(0, x), -500, 500)
        return 1 / (1 + np.exp(-d))


def _vectors(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, N_FEATURES)


def featured(docs: DataFrame, text: str, keep: list[str]) -> tuple[DataFrame, str]:
    """``keep`` and the array column of statistics, whose name comes second."""
    new = T.StructType([T.StructField("features", T.ArrayType(T.DoubleType()))])

    def fn(b: TextBlock) -> dict:
        x = features(b)
        return {"features": pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32), x.ravel())}

    return S.map_texts(docs, text, keep, new, fn), free_name(keep, "features")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(rows: DataFrame, features_: str, label: str, shrinkage: float = SHRINKAGE) -> Model:
    """Learn from all ``rows``; only one row of sums per partition moves."""
    size = N_FEATURES

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: [0.0, np.zeros(size), np.zeros((size, size))] for c in (0, 1)}
        for batch in batches:
            x, y = _vectors(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for c, s in sums.items():
                z = x[y == c]
                s[0] += len(z)
                s[1] += z.sum(axis=0)
                s[2] += z.T @ z
        yield pa.RecordBatch.from_pydict(
            {"c": [*sums], "s": [[s[0], *s[1], *s[2].ravel()] for s in sums.values()]},
            schema=pa.schema([("c", pa.int32()), ("s", pa.list_(pa.float64()))])
        )

    parts = rows.where(F.col(label).isin(0, 1)).select(features_, F.col(label).cast("int").alias("c")).mapInArrow(partial, "c int, s array<double>")
    got = parts.groupBy("c").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(1 + size + size * size)]).collect()
    return Model.fit({r["c"]: (r[1], np.array(r[2 : 2 + size]), np.array(r[2 + size :]).reshape(size, size)) for r in got}, shrinkage)


def quality_classifier(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    keep: list[str] | None = None,
    threshold: float = THRESHOLD
) -> DataFrame:
    """``keep`` (default: all columns) with held_out, score and predicted.

    Statistics are computed once and written to the shared folder without the
    text unless ``keep`` has it; training joins them with the labels by id.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    stats, name = featured(docs, text, list(dict.fromkeys([*keep, doc_id])))
    table = written(stats, run_dir(spark, "classifier"))
    train = table.select(table[doc_id].alias("id"), table[name].alias("x")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    marked = labels.select(labels[doc_id].alias("id"), labels[label].alias("y")).where(F.col("id").isNotNull())
    model = fit(train.join(marked, "id").select("x", "y"), "x", "y")

    names = []
    for c in ("held_out", "score", "predicted"):
        names.append(free_name([*table.columns, *names], c))

    def score(column: pa.Array) -> pa.Array:
        enter_stage()
        return pa.array(model.score(_vectors(column)))

    scorer = F.arrow_udf(score, T.DoubleType())
    scored = table.select(*[table[c] for c in keep], held_out(table[doc_id]).alias(names[0]), scorer(table[name]).alias(names[1]))
    return scored.withColumn(names[2], (F.col(names[1]) >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_classifier(docs, labels, keep=["doc_id"])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of predicted low quality go.

    The columns of ``docs`` pass through the statistics table, so a document's
    verdict never depends on its id being unique."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality_classifier(docs, labels)
    return out.where(out[out.columns[-1]] == 1).select(*docs.columns)
