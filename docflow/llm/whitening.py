"""Whitening of embeddings by a one-sided Jacobi SVD.

An entry c becomes the integer ``floor(1024 * c) + 100000``, so that counts and sums
are exact.  Four reads of the vectors make the result:

1. their number and the sum of each dimension;
2. TSQR: a task takes its centred rows in blocks and keeps only the triangular factor R
   of what it has seen; factors of several tasks are stacked and compressed again, until
   one is left.  ``R'R`` is then the sum of squares and products of all centred rows;
3. plane rotations make R's columns orthogonal (one-sided Jacobi, all pairs of columns in
   rounds of disjoint pairs).  The accumulated rotations are the components, the norms of
   the columns over ``sqrt(n)`` their standard deviations.  No covariance is squared up
   first, so small deviations keep their digits.  Sums of whitened rows give their covariance;
4. rows are projected.

What reaches the driver is one factor and a few sums, whose size depends on the dimension
alone.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries, or
entries of a magnitude of 2**40 and more (their squares would not be exact), are dropped, as
are rows of another length than most (of lengths as frequent, the longest stays).
A component's sign makes its largest entry positive.  Where a component has no variance, its
``whitened`` is null and ``identity_error`` leaves it out; ``explained`` is null where no
component has any, ``identity_error`` then is too.  A ``deviation`` beyond a long is null.  Rows
that repeat ``vec_id``, or have none, count each.  An empty table gives an empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grid of the integers that entries become.
SCALE, SHIFT = 1024, 100000
#: Magnitude of entries from which on squares would not be exact.
LARGEST = 2.0**40
COMPONENTS = 8
#: Rows of a block that is factored at once, and factors that are stacked in one step.
BLOCK_ROWS = 4096
FAN_IN = 16
#: Cosine of two columns under which they count as orthogonal, and rounds at most.
ORTHOGONAL = 1e-15
SWEEPS = 60

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """A fitted whitening: components are the columns of ``axes``, by falling deviation."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x minus the mean, as doubles, and the exact sum of ``(n * x - sums)**2`` of each row."""
        return _centred(x, self.n, self.sums)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Rows on the components, over their deviations; NaN where a component has none."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (centred @ self.axes) / self.deviations
        out[:, self.deviations == 0] = np.nan
        return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = int(np.abs(x).max(initial=0)) * n + int(np.abs(sums).max(initial=0))
    if top >= 2**63:  # beyond a long: Python's integers
        wide = x.astype(object) * n - sums.astype(object)
        return (wide / n).astype(float), (wide * wide).sum(1)
    moved = x * np.int64(n) - sums
    most = int(np.abs(moved).max(initial=0))
    if most * most * x.shape[1] >= 2**63:
        wide = moved.astype(object)
        return moved / n, (wide * wide).sum(1)
    return moved / n, (moved * moved).sum(1)


def integers(vectors: pa.ListArray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The integer rows of the vectors that remain, and which those are."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(sizes == dimension) if dimension else np.zeros(0, np.int64)
    values = vectors.take(pa.array(fits)).flatten().cast(pa.float64())  # null entries become NaN
    rows = values.to_numpy(zero_copy_only=False).reshape(len(fits), dimension)
    good = (np.abs(np.where(np.isfinite(rows), rows, np.inf)) * SCALE < LARGEST).all(1) if dimension else np.zeros(0, bool)
    return np.floor(rows[good] * SCALE).astype(np.int64) + SHIFT, fits[good]


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square factor R of ``rows``; fewer rows than columns are filled up with zeros."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))]) if len(r) < rows.shape[1] else r


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``d`` columns, in rounds of disjoint pairs."""
    ring = list(range(d + d % 2))
    out = []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :]), strict=True) if max(a, b) < d]
        out.append((np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (as columns) and singular values of ``r``, falling.

    A rotation in the plane of two columns makes them orthogonal; rounds go on until no
    two columns have a cosine above :data:`ORTHOGONAL`.
    """
    d = r.shape[1]
    scale = np.abs(r).max(initial=0)
    u, v = (r / scale if scale else r.copy()), np.eye(d)
    rounds = _rounds(d)
    for _ in range(SWEEPS):
        worst = 0.0
        for a, b in rounds:
            if not len(a):
                continue
            alpha, beta = (u[:, a] ** 2).sum(0), (u[:, b] ** 2).sum(0)
            gamma = (u[:, a] * u[:, b]).sum(0)
            norm = np.sqrt(alpha) * np.sqrt(beta)
            cosine = np.divide(np.abs(gamma), norm, out=np.zeros_like(gamma), where=norm > 0)
            worst = max(worst, cosine.max(initial=0))
            turn = cosine > ORTHOGONAL
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t[~turn] = 0.0
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (u, v):
                left, right = m[:, a], m[:, b]
                m[:, a], m[:, b] = c * left - s * right, s * left + c * right
        if worst <= ORTHOGONAL:
            break
    values = np.sqrt((u**2).sum(0)) * scale
    order = np.argsort(-values, kind="stable")
    values, v = values[order], v[:, order]
    # Columns that rounding alone has left are none.
    values[values <= values.max(initial=0) * d * np.finfo(float).eps] = 0.0
    return v, values


def _dimension(vectors: DataFrame) -> int:
    """The length of most vectors."""
    sizes = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return top[0]["d"] if top else 0


def _totals(vectors: DataFrame, dimension: int) -> tuple[int, np.ndarray]:
    """The number of vectors that remain and the sum of each dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dimension, object)
        for batch in batches:
            x, _ = integers(batch.column(0), dimension)
            n += len(x)
            sums += x.sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([n, *map(int, sums)], pa.decimal128(38, 0)), pa.array(range(-1, dimension), pa.int32())], ["total", "place"])

    rows = vectors.select("embedding").mapInArrow(run, "total decimal(38,0), place int").groupBy("place").agg(F.sum("total").alias("total")).collect()
    found = {r["place"]: int(r["total"]) for r in rows}
    sums = [found.get(k, 0) for k in range(dimension)]
    return found.get(-1, 0), np.array(sums, np.int64 if max(map(abs, sums), default=0) < 2**62 else object)


def _factor(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """TSQR: the factor R of all centred rows."""
    d = len(sums)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            x, _ = integers(batch.column(0), d)
            for at in range(0, len(x), BLOCK_ROWS):
                r = triangle(np.vstack([r, _centred(x[at : at + BLOCK_ROWS], n, sums)[0]]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for other in batch.column(0):
                r = triangle(np.vstack([r, np.frombuffer(other.as_buffer(), float).reshape(-1, d)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    factors = vectors.select("embedding").mapInArrow(blocks, "r binary")
    left = factors.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        factors = factors.repartition(left).mapInArrow(stack, "r binary")
    found = factors.collect()
    return triangle(np.vstack([np.frombuffer(f["r"], float).reshape(-1, d) for f in found]))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``vectors`` (embedding); none where no vector remains."""
    dimension = _dimension(vectors)
    n, sums = _totals(vectors, dimension) if dimension else (0, np.zeros(0, np.int64))
    if not n:
        return None
    axes, values = jacobi(_factor(vectors, n, sums))
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(dimension)])
    total = (values**2).sum()
    explained = values**2 / total if total else np.full(dimension, np.nan)
    k = min(components, dimension)
    return Whitening(n, sums, (axes * signs)[:, :k], values[:k] / np.sqrt(n), explained[:k])


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    live = np.flatnonzero(model.deviations > 0)
    k = len(live)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x, _ = integers(batch.column(0), len(model.sums))
            w = model.whitened(model.centred(x)[0])[:, live]
            sums += w.sum(0)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([sums, products.ravel()])), pa.array(np.arange(k + k * k), pa.int32())], ["total", "place"])

    rows = vectors.select("embedding").mapInArrow(run, "total double, place int").groupBy("place").agg(F.sum("total").alias("total")).collect()
    found = np.zeros(k + k * k)
    for r in rows:
        found[r["place"]] = r["total"] / model.n
    # Rows are centred before they are multiplied; what is left of their mean is rounding.
    covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row of ``vectors`` (vec_id, embedding) and component, see :data:`SCHEMA`."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    model = fit(vectors, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(vectors, model)
    k = len(model.deviations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x, kept = integers(part.column(1), len(model.sums))
                centred, deviation = model.centred(x)
                w = model.whitened(centred).ravel()
                long = [int(v) if int(v) < 2**63 else None for v in deviation]
                rows = np.repeat(np.arange(len(x)), k)
                explained = np.tile(model.explained, len(x))
                columns = [
                    part.column(0).take(pa.array(kept[rows])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), model.n)),
                    pa.array(long, pa.int64()).take(pa.array(rows)),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(explained, mask=np.isnan(explained)),
                    pa.array([error] * len(rows), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, SCHEMA)
