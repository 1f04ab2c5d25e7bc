import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.llm import whitening
from docflow.llm.whitening import jacobi, whiten

KIND = "vec_id long, embedding array<float>, label int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], KIND).repartition(parts)


def vectors(n=400, d=12, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ np.diag(np.geomspace(1, 0.01, d)) @ rng.normal(size=(d, d)) + 0.3).astype(np.float32)


def check(out, kept, components=8):
    """Against the eigenvectors of the covariance, from exact integers."""
    x = np.floor(np.array([v for _, v in kept], np.float32).astype(float) * 1024).astype(np.int64) + 100000
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, x.shape[1])
    got = {(r["vec_id"], r["component"]): r for r in out}
    assert len(got) == len(out) == n * k
    deviation = ((n * x - sums) ** 2).sum(1)
    for c in range(k):
        want = centred @ axes[:, c] / math.sqrt(values[c])
        mine = np.array([got[i, c + 1]["whitened"] for i, _ in kept])
        sign = np.sign(want @ mine)
        assert np.allclose(sign * want, mine, rtol=1e-6, atol=1e-7)
        assert all(math.isclose(got[i, c + 1]["explained"], values[c] / values.sum(), rel_tol=1e-9) for i, _ in kept)
    for (i, _), d in zip(kept, deviation.tolist(), strict=True):
        assert got[i, 1]["deviation"] == d and got[i, 1]["n"] == n
    errors = {r["identity_error"] for r in out}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whiten(spark):
    rows = list(enumerate(vectors().tolist()))
    odd = [(1000, None), (1001, [None] * 12), (1002, [math.nan] * 12), (1003, [math.inf] + [0.0] * 11), (1004, []), (1005, [1.0] * 5), (1006, [1e30] * 12)]
    out = whiten(table(spark, rows + odd, 7).withColumn("n", F.lit(1)).withColumn("component", F.lit("x")))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), rows)


def test_whiten_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 5)
    rows = list(enumerate(vectors(120, 5, 3).tolist()))
    check(whiten(table(spark, rows, 9)).collect(), rows)


def test_whiten_few_rows(spark):
    assert whiten(table(spark, [])).count() == 0
    assert whiten(table(spark, [(1, None), (2, [math.nan])])).count() == 0
    out = whiten(table(spark, [(1, [0.5, 1.0, 2.0])])).collect()
    assert len(out) == 3 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in out)
    # Three rows span two directions; repeated and null ids count each.
    out = whiten(table(spark, [(1, [0, 0, 0]), (1, [1, 0, 0]), (None, [0, 2, 0])])).collect()
    assert len(out) == 9 and sum(r["whitened"] is None for r in out) == 3
    assert all(r["identity_error"] < 1e-12 for r in out)


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(k, [1e8 * k, 0.0]) for k in range(40)]
    out = whiten(table(spark, rows)).collect()
    assert {r["deviation"] is None for r in out} == {True, False} and all(r["whitened"] is not None for r in out if r["component"] == 1)


@pytest.mark.parametrize("d", [1, 2, 5, 64])
def test_jacobi(d):
    """Small singular values keep their digits beside large ones."""
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    values = np.geomspace(1e6, 1e-4, d) if d > 1 else np.array([3.0])
    r = np.linalg.qr(np.diag(values) @ q.T, mode="r")
    axes, found = jacobi(r)
    assert np.allclose(found, values, rtol=1e-4)
    assert np.abs(axes.T @ axes - np.eye(d)).max() < 1e-12
    assert np.allclose(np.abs((r @ axes).T @ (r @ axes)), np.diag(found**2), atol=1e-3)
