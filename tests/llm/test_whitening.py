"""Whitening against a dense eigensolver on exact covariances, and odd inputs."""

from fractions import Fraction

import numpy as np
import pytest
from against import SF

from docquery.llm import queries, whitening


def brute(vectors, most=4):
    """n, deviations, components and values by numpy's own solver."""
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1][:most], vecs[:, ::-1][:, :most]
    return x, n, ((n * x - sums) ** 2).sum(axis=1), values, (x - sums / n) @ vecs / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def compare(rows, ids, vectors):
    x, n, deviation, values, whitened, explained = brute(vectors)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(ids) * len(values)
    for k in range(len(values)):
        own = np.array([got[i, k + 1].whitened for i in ids])
        sign = np.sign(own @ whitened[:, k])
        assert np.abs(sign * own - whitened[:, k]).max() < 1e-8
        for i, d in zip(ids, deviation):
            r = got[i, k + 1]
            assert (r.n, r.deviation) == (n, d) and r.explained == pytest.approx(explained[k], rel=1e-9) and r.identity_error < 1e-9


def test_all_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    compare(queries.op11_whiten(spark, SF).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [rng.standard_normal(5).tolist() for _ in range(40)]
    rows = [*((i, v) for i, v in enumerate(good)), (100, good[0]), (100, good[0]), (None, good[1])]
    bad = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (205, [1.0, 2.0]), (206, [-float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows + bad], "vec_id long, embedding array<float>, n int, x string")
    got = whitening.whiten(df).collect()
    assert len(got) == 4 * len(rows) and {r.vec_id for r in got} == {r[0] for r in rows}
    plain = [r for r in got if r.vec_id is not None and r.vec_id < 100]
    as_floats = [np.array(v, np.float32).tolist() for v in good]
    compare(plain, range(40), as_floats)
    assert {r.whitened for r in got if r.vec_id == 100} == {r.whitened for r in got if r.vec_id == 0}
    again = whitening.whiten(df.repartition(5)).collect()  # all but the rounding of sums is the same in any order
    assert sorted(repr((*r[:4], round(r.whitened, 9))) for r in again) == sorted(repr((*r[:4], round(r.whitened, 9))) for r in got)
    assert whitening.whiten(df.where("false")).count() == 0 and whitening.whiten(df.where("vec_id = 100")).count() == 0


def test_large_and_flat_vectors(spark):
    """Sums beyond 64 bits are exact, deviations beyond are null; dimensions without variance give no component."""
    df = spark.createDataFrame([(i, [v, 3.0, 0.0]) for i, v in enumerate((1e14, 2e14, -1e14, 0.0))], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert {r.component for r in got} == {1} and {r.deviation for r in got} == {None} and got[0].explained == pytest.approx(1)
    assert sorted(abs(r.whitened) for r in got) == pytest.approx(sorted(abs(v - 0.5e14) / np.std([1e14, 2e14, -1e14, 0]) for v in (1e14, 2e14, -1e14, 0.0)))


def test_covariance_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 9, (60, 3)) + np.array([0, 10**6, -(10**9)])
    fit = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(3)
    n, sums = whitening.column_sums(fit, 3)
    got = whitening.covariance(fit, n, sums)
    mean = [Fraction(s, n) for s in sums]
    for i in range(3):
        for j in range(3):
            assert got[i, j] == float(sum((int(v[i]) - mean[i]) * (int(v[j]) - mean[j]) for v in x) / n)


SPECTRA = {
    "spread": np.linspace(1, 50, 24), "equal": [5.0] * 5 + [1.0] * 3, "close": [9, 3, 3, 3 - 1e-9, 1, 1, 0.5], "cut": [9, 3, 3, 3, 3 - 1e-10, 1], "low rank": [4.0, 2, 0, 0, 0, 0],
    "steep": [1e8, 1e4, 1.0, 1e-2, 1e-5], "two": [2.0, 1.0], "one": [3.0],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenvalues(spark, name):
    rng, values = np.random.default_rng(3), np.sort(np.array(SPECTRA[name]))[::-1]
    turn, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    matrix = turn * values @ turn.T
    matrix = (matrix + matrix.T) / 2
    true = np.linalg.eigvalsh(matrix)
    for s in (0.0003, 0.7, 1.3, 2.5, 4.3, 6, 20, 1e5):
        if np.abs(true - s).min() > 1e-9:
            assert whitening.below(matrix, s) == (true < s).sum()
    got, vectors = whitening.components(spark, matrix, min(4, len(values)))
    want = values[values > 1e-9][:4]
    assert len(got) == len(want) and np.abs(got - want).max() < 1e-12 * values.max()
    assert np.linalg.norm(matrix @ vectors - vectors * got, axis=0).max() < 1e-12 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-13
    spans = whitening.brackets(matrix / np.trace(matrix), min(4, len(values)))
    assert sum(n for *_, n in spans) >= len(got)
