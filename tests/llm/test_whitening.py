import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chebyshev_whitening as W


def _expected(vectors, count=4):
    """Plain numpy: the dense covariance of the distinct integer vectors."""
    x = np.array([[math.floor(256 * v) for v in c] for c in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - fit.mean(axis=0)
    values, q = np.linalg.eigh(y.T @ y / n)
    values, q = values[::-1][:count], q[:, ::-1][:, :count]
    return n, [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in x], (x - fit.mean(axis=0)) @ q / np.sqrt(values), values / np.trace(y.T @ y / n)


def _table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def _held(out, ids, want):
    n, deviation, white, share = want
    rows = sorted(out.collect(), key=lambda r: (r.vec_id, r.component))
    k = white.shape[1]
    assert [(r.vec_id, r.component) for r in rows] == [(i, c + 1) for i in ids for c in range(k)]
    assert {r.n for r in rows} == {n}
    assert [r.deviation for r in rows[::k]] == deviation
    got = np.array([r.whitened for r in rows]).reshape(-1, k)
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-6
    assert np.allclose([r.explained for r in rows[:k]], share, rtol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_equals_the_dense_covariance(spark):
    rng = np.random.default_rng(1)
    v = (rng.standard_normal((400, 40)) * np.linspace(2, 0.2, 40)).astype(np.float32)
    v[50:60] = v[0]  # copies count once in the fit
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] * 40)]
    df = _table(spark, [*rows, *odd]).withColumn("component", F.lit("x")).withColumn("n", F.lit(0)).repartition(5)
    _held(W.whiten(df), range(400), _expected(v))


def test_the_registered_query_on_the_given_table(spark):
    from palimpsest.llm.queries import op11_whitening

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    _held(op11_whitening(spark, "/root/testdata/sf0.01"), [r.vec_id for r in rows], _expected([r.embedding for r in rows]))


@pytest.mark.parametrize("gap", [1.0, 1e-3, 1e-6])
def test_rounds_end_certified_with_close_and_large_eigenvalues(spark, gap):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    scale = np.concatenate([[3e4, 600, 300, 300 * (1 - gap / 2)], np.linspace(280, 5, 44)])
    x = np.round((rng.standard_normal((3000, 48)) * scale) @ q.T).astype(np.int64)
    fit = spark.createDataFrame([(r,) for r in np.unique(x, axis=0).tolist()], "x array<long>").cache()
    got = W.components(fit, 4, block=12)
    y = np.unique(x, axis=0) - np.unique(x, axis=0).mean(axis=0)
    values = np.linalg.eigvalsh(y.T @ y / len(y))[::-1][:4]
    assert np.allclose(got.values, values, rtol=1e-10)
    assert got.residuals.max() <= 100 * W.ROUNDING * math.sqrt(48) * values[0]
    assert got.passes < 120


def test_the_filter_damps_what_is_unwanted():
    values = np.array([10.0, 8.0, 5.0, 4.0, 2.0, 0.1, 0.0])
    out = W.chebyshev(lambda q: values[:, None] * q, np.eye(7), 6, 4.0, 10.0)
    exact = [np.polynomial.chebyshev.Chebyshev([0] * 6 + [1])(v / 2 - 1) for v in values]
    assert np.allclose(np.diag(out), np.array(exact) / exact[0])
    assert out[0, 0] == pytest.approx(1) and np.abs(np.diag(out)[3:]).max() < 1e-2


def test_edges(spark):
    assert W.whiten(_table(spark, [])).count() == 0
    assert W.whiten(_table(spark, [(1, [])])).count() == 0
    alone = W.whiten(_table(spark, [(1, [1.0, -2.0]), (1, [1.0, -2.0]), (None, [1.0, -2.0])])).collect()
    assert len(alone) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone} == {(1, 0, None, 0.0, 0.0)}
    assert {r.vec_id for r in alone} == {1, None}
    line = W.whiten(_table(spark, [(1, [1.0, 1.0]), (2, [3.0, 3.0])])).collect()  # one of two dimensions has extent
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in line) == [(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True)]
    assert {abs(round(r.whitened, 9)) for r in line if r.component == 1} == {1.0}
    with pytest.raises(ValueError, match="dimensions"):
        W.whiten(_table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(Exception, match="(?i)long|overflow"):
        W.whiten(_table(spark, [(1, [3e16]), (2, [-3e16])] * 3)).collect()
