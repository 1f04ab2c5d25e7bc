"""Quality classifier: regularised quadratic discriminant analysis.

Each document becomes a vector of transformed statistics of its whole text.  For
either label the mean and a shrunk covariance are estimated from sums that Spark
gathers over all labelled training rows (two rows of sums reach the driver).  A
score is the difference of the two Gaussian log densities, Mahalanobis distances
taken with Cholesky factors that are computed once, plus the log prior odds.  The
Gaussian fit is far too sure of itself, so a logistic line through the training
rows' differences, fitted on their counts by bins, turns them into probabilities.

Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have the statistics of an empty text and get
a score like any other.  Labels other than 0 and 1 are ignored, and every row of a
repeated label counts.  If a label has no training row, all scores are 0.5.  Rows
are scored one by one: repeats and null ids are kept.  An empty table gives an
empty result.  Other input columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm.common import materialize, release
from docflow.llm.wordhash import buffers, groups

#: Weight of the pooled covariance in a class's own, and of the scaled identity in both.
POOLED = 0.2
RIDGE = 0.05
#: Log-odds are counted in bins of this width up to this size for the logistic line.
BIN = 0.5
LARGEST = 200.0
FOLDS = 5
THRESHOLD = 0.3

STATISTICS = ["log_words", "log_word_length", "upper", "digits", "symbols", "marks", "bangs", "lines", "distinct", "top_word", "adjacent", "same_lines", "long_words"]

_KEEP = {
    name: bytes(b for b in range(256) if chr(b) not in chars)
    for name, chars in {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "symbols": "#*$%&|<>@^~=_\\{}[]", "marks": ".,;:?'\"()-", "bangs": "!", "lines": "\n"}.items()
}


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of :data:`STATISTICS`."""
    words = text.split()
    n, size = len(words), len(text)
    share = lambda k, of: float(np.log((k + 0.02) / (of + 1.0)))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        float(np.log1p(size / max(n, 1))),
        *(share(len(text.translate(None, _KEEP[k])), size) for k in ("upper", "digits", "symbols", "marks", "bangs", "lines")),
        float(np.log1p(len(counts)) / np.log1p(max(n, 1))),
        share(max(counts.values(), default=0), n),
        share(sum(a == b for a, b in pairwise(words)), n),
        share(len(lines) - len(set(lines)), len(lines)),
        share(sum(len(w) > 15 for w in words), n),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(STATISTICS)
    for batch in batches:
        for lo, hi in groups(batch.column(1)):
            raw, at = buffers(batch.column(1)[lo:hi])
            view = memoryview(np.ascontiguousarray(raw)).cast("B")
            rows = np.empty((hi - lo, d))
            for k in range(hi - lo):
                rows[k] = statistics(bytes(view[at[k] : at[k + 1]]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * d), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], lists], ["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_statistics, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


@dataclass
class Discriminant:
    """Means, Cholesky factors and their inverses, log determinants of both classes, log prior odds, and the logistic line."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    log_odds: float
    line: tuple[float, float] = (1.0, 0.0)

    def __post_init__(self) -> None:
        # Inverted once, here; a batch then costs a product with a triangle.
        self.whiteners = [np.tril(np.linalg.solve(factor, np.eye(len(factor)))) for factor in self.factors]

    def odds(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, whitener, log_det in zip(self.means, self.whiteners, self.log_dets, strict=True):
            # einsum without a path runs in one thread and needs no library buffers in the workers.
            z = np.einsum("ni,ji->nj", x - mean, whitener)
            logs.append(-0.5 * ((z * z).sum(1) + log_det))
        return np.clip(logs[1] - logs[0] + self.log_odds, -LARGEST, LARGEST)

    def scores(self, x: np.ndarray) -> np.ndarray:
        slope, level = self.line
        return 1 / (1 + np.exp(-(slope * self.odds(x) + level)))


def logistic_line(odds: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and level of the most likely logistic line; ``counts``: rows of labels 0 and 1 at each value."""
    design = np.stack([odds, np.ones(len(odds))], 1)
    w = np.array([0.05, 0.0])
    penalty = np.diag([1.0, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        n = counts.sum(1)
        gradient = design.T @ (counts[:, 1] - n * p) - penalty @ (w - [0.05, 0.0])
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return (max(float(w[0]), 1e-3), float(w[1]))


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant | None:
    """From (rows, sum of x, sum of x x') of labels 0 and 1; None without both."""
    if set(sums) != {0, 1}:
        return None
    means = [sums[k][1] / sums[k][0] for k in (0, 1)]
    scatter = [sums[k][2] - sums[k][0] * np.outer(means[k], means[k]) for k in (0, 1)]
    total = sums[0][0] + sums[1][0]
    pooled = (scatter[0] + scatter[1]) / total
    d = len(pooled)
    factors, log_dets = [], []
    for k in (0, 1):
        own = (1 - POOLED) * scatter[k] / sums[k][0] + POOLED * pooled
        own = (1 - RIDGE) * own + RIDGE * (max(np.trace(pooled), 1e-6) / d) * np.eye(d)
        factors.append(np.linalg.cholesky(own))
        log_dets.append(2 * float(np.log(np.diag(factors[k])).sum()))
    return Discriminant(means, factors, log_dets, float(np.log(sums[1][0] / sums[0][0])))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Fit on the labelled documents outside the held-out fold."""
    d = len(STATISTICS)
    own = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("l_id")))
    # Joined once, for the sums and for the line.
    rows = materialize(stats.join(own, F.col("doc_id") == F.col("l_id")).select("label", "x"), "op1-training")
    x = [F.get("x", F.lit(i)) for i in range(d)]
    firsts = F.array(*[F.sum(x[i]) for i in range(d)])
    seconds = F.array(*[F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)])
    found = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), firsts.alias("s"), seconds.alias("ss")).collect()  # two rows
    sums = {}
    for row in found:
        matrix = np.zeros((d, d))
        matrix[np.triu_indices(d)] = row["ss"]
        sums[row["label"]] = (float(row["n"]), np.array(row["s"]), matrix + np.triu(matrix, 1).T)
    model = discriminant(sums)
    if model is None:
        return None
    bins = rows.select("label", F.floor(_udf(model.odds)("x") / BIN).alias("bin")).groupBy("bin", "label").count().collect()  # bounded by the bins
    values = sorted({r["bin"] for r in bins})
    counts = np.zeros((len(values), 2))
    for r in bins:
        counts[values.index(r["bin"]), r["label"]] = r["count"]
    model.line = logistic_line((np.array(values, float) + 0.5) * BIN, counts)
    release(stats.sparkSession, rows)
    return model


def _udf(score):
    def run(x: pa.Array) -> pa.Array:
        return pa.array(score(np.asarray(x.flatten()).reshape(len(x), len(STATISTICS))))

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.DoubleType())


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    stats = materialize(document_statistics(docs), "op1-statistics")
    model = fit(stats, labels)
    score = F.lit(0.5) if model is None else _udf(model.scores)("x")
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
