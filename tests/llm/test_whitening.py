import numpy as np
import pytest

from geopanel.llm.whitening import jacobi, whiten

SCHEMA = "vec_id long, embedding array<float>, x int, n string, component string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "n", "c") for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors, k):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(fit), fit.sum(0)
    z = (n * fit - s).astype(float) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    w = ((n * x - s).astype(float) / n) @ u / np.sqrt(e)
    return n, [int(((n * r - s) ** 2).sum()) for r in x], w, e / np.trace(z.T @ z / n), e


def test_rotations_keep_small_eigenvalues():
    rng = np.random.default_rng(0)
    scale = 10.0 ** -np.arange(0, 12)
    b = rng.normal(size=(12, 12)) + 4 * np.eye(12)
    a = scale[:, None] * (b @ b.T) * scale
    e, u = jacobi(a)
    assert np.allclose(u.T @ u, np.eye(12), atol=1e-13) and np.all(np.diff(e) <= 0)
    # The smallest eigenvalue is the inverse of the largest one of the inverse, which is graded the other way.
    low = 1 / np.linalg.eigvalsh(np.diag(1 / scale) @ np.linalg.inv(b @ b.T) @ np.diag(1 / scale)).max()
    assert e[-1] == pytest.approx(low, rel=1e-9)


@pytest.mark.parametrize("d", [1, 2, 5, 16, 33])
def test_rotations_agree_with_a_dense_solver(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(3 * d, d))
    a = a.T @ a
    e, u = jacobi(a)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=1e-12)
    assert np.allclose(u @ np.diag(e) @ u.T, a, atol=1e-11 * e[0])


def test_whitening_agrees_with_brute_force(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(300, 20)) * np.linspace(2, 0.2, 20)).astype(np.float32)
    good = np.concatenate([good, good[:50], np.repeat(good[:1], 80, axis=0)])
    bad = [None, [], [None] * 20, [float("nan")] * 20, [float("inf")] + [0.0] * 19, [1.0] * 3, [1e30] + [0.0] * 19]
    rows = whiten(table(spark, [*bad, *good.tolist()]).repartition(5)).collect()
    n, dev, w, explained, _ = brute(good.tolist(), 16)
    assert len(rows) == 16 * len(good) and {r.n for r in rows} == {n}
    got = np.zeros((len(good), 16))
    for r in rows:
        assert r.deviation == dev[r.id - len(bad)]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        got[r.id - len(bad), r.component - 1] = r.whitened
    sign = np.sign((got * w).sum(0))
    assert np.allclose(got * sign, w, atol=1e-8)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-10


def test_components_without_variance(spark):
    rows = whiten(table(spark, [[0.0, 0.0, 1.0], [1.0, 1.0, 1.0], [2.0, 2.0, 1.0], [2.0, 2.0, 1.0]])).orderBy("id", "component").collect()
    assert [r.component for r in rows] == [1, 2, 3] * 4
    assert all((r.whitened is None) == (r.component > 1) for r in rows)
    assert rows[0].explained == pytest.approx(1) and rows[1].explained == 0 and rows[0].identity_error < 1e-12
    one = whiten(table(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(one) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.n == 1 and r.deviation == 0 for r in one)
    assert whiten(table(spark, [])).count() == 0 and whiten(table(spark, [None])).count() == 0


def test_a_deviation_beyond_64_bits_is_null(spark):
    rows = whiten(table(spark, [[0.0], [float(2**40)], [float(2**46)]])).orderBy("id").collect()
    x = [1_000_000, 64 * 2**40 + 1_000_000, 64 * 2**46 + 1_000_000]
    want = [(3 * v - sum(x)) ** 2 for v in x]
    assert [r.deviation for r in rows] == [v if v < 2**63 else None for v in want]
