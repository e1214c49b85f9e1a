"""Whitened vectors against dense eigenvectors."""

import numpy as np
import pytest
from plain import tables

from gleanspark.llm import queries, whitening

FOLDER = "/root/testdata/sf0.01"


def plain(vectors, count=4):
    """n, exact deviations, whitened vectors and shares of variance."""
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)) + 0
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    values, basis = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, basis = values[::-1], basis[:, ::-1]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, total, strict=True)) for row in x]
    return n, deviation, (x - total / n) @ basis[:, :count] / np.sqrt(values[:count]), values[:count] / values.sum()


def test_query(spark):
    (df,) = tables(spark, FOLDER, "embeddings")
    rows = df.select("vec_id", "embedding").collect()
    n, deviation, want, share = plain([r.embedding for r in rows])
    got = {}
    for r in queries.op12_whitening(spark, FOLDER).collect():
        got[r.vec_id, r.component] = r
    assert len(got) == 4 * len(rows)
    for k in range(4):
        column = np.array([got[r.vec_id, k + 1].whitened for r in rows])
        assert min(np.abs(column - want[:, k]).max(), np.abs(column + want[:, k]).max()) < 1e-9
        assert got[rows[0].vec_id, k + 1].explained == pytest.approx(share[k], rel=1e-10)
    assert [got[r.vec_id, 1].deviation for r in rows] == deviation
    assert {r.n for r in got.values()} == {n} and all(r.identity_error < 1e-9 for r in got.values())


@pytest.mark.parametrize("spectrum", [np.linspace(1, 9, 40), 1.0 / np.arange(1, 201) ** 2, np.concatenate([[5, 4.99, 4.98, 4.97], np.ones(60)]), [2.0, 1], [3.0]])
def test_components(spectrum):
    """Residuals reach double precision, and no direction is left out."""
    size = len(spectrum)
    turn, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(size, size)))
    dense = (turn * np.array(spectrum)) @ turn.T
    vectors, values = whitening.components(lambda v: dense @ v, size, 4)
    count = min(4, size)
    assert np.allclose(values, sorted(spectrum, reverse=True)[:count], rtol=1e-12)
    assert np.abs(dense @ vectors - vectors * values).max() < 1e-13 * max(spectrum) * 10
    assert np.allclose(vectors.T @ vectors, np.eye(count), atol=1e-13)


def test_odd_vectors(spark):
    """Nulls, other lengths, values that are not finite, repeated rows, huge entries, no variance, no rows."""
    kind = "vec_id long, embedding array<float>, n string, x int"
    good = [(k, [float(k), float(k * k % 7), 1.0], "a", 1) for k in range(20)]
    odd = [(30, None, None, 1), (31, [1.0, None, 2.0], None, 1), (32, [float("nan"), 0.0, 1.0], None, 1), (33, [float("inf"), 0.0, 1.0], None, 1), (34, [], None, 1), (35, [1.0, 2.0], None, 1), (None, [3.0, 2.0, 1.0], None, 1), (3, good[3][1], None, 1)]
    got = whitening.whiten(spark.createDataFrame(good + odd, kind)).collect()
    kept = [r[1] for r in good] + [odd[-2][1], odd[-1][1]]
    n, deviation, want, share = plain(kept, 2)
    assert len(got) == 2 * len(kept) and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2}  # the third entry is constant
    assert sorted(int(r.deviation) for r in got if r.component == 1) == sorted(deviation)
    assert sorted(r.explained for r in got)[-1] == pytest.approx(share[0])
    for rows in ([], odd[:5], good[:1], [good[0]] * 3):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).collect() == []
    huge = [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 1e30])]
    found = whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<float>")).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and all(np.isfinite(r.whitened) for r in found)
