import numpy as np
import pytest

from geopanel.operators import eliminate, fem, mesh, spde
from geopanel.sources import tables as T


def entries(spark, q):
    i, j = np.nonzero(q)
    return spark.createDataFrame([(int(a), int(b), float(q[a, b])) for a, b in zip(i, j, strict=True)], "i int, j int, q double").repartition(3)


def dense(df, keep):
    at = {v: k for k, v in enumerate(keep)}
    out = np.zeros((len(keep), len(keep)))
    for r in df.collect():
        out[at[r.i], at[r.j]] = r.q
    return out


def test_marginal_of_a_mesh_equals_the_dense_complement(spark):
    cov = spde.Spde.of(mesh.grid_mesh([T.SQUARE], 1.5, 6, 6))
    v, t = cov.mesh.tables(spark)
    q = spde.precision(fem.mass(v, t), fem.stiffness(v, t), 0.8)
    got = eliminate.marginal(q, v.where("inner").select("v"))
    assert dense(got, np.flatnonzero(cov.mesh.inner).tolist()) == pytest.approx(cov.marginal(0.8), abs=1e-9)


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_marginal_of_random_precisions(spark, share):
    rng = np.random.default_rng(5)
    n = 12
    a = np.where(rng.random((n, n)) < 0.2, rng.normal(size=(n, n)), 0.0)
    q = a @ a.T + np.eye(n)
    inner = np.flatnonzero(rng.random(n) < share).tolist()
    got = eliminate.marginal(entries(spark, q), spark.createDataFrame([(v,) for v in [*inner, *inner[:1], 99]], "v int"))
    want = np.linalg.inv(np.linalg.inv(q)[np.ix_(inner, inner)])
    assert dense(got, inner) == pytest.approx(want, abs=1e-9)


def test_marginal_of_odd_tables(spark):
    none = spark.createDataFrame([], "i int, j int, q double")
    v = spark.createDataFrame([(1,)], "v int")
    assert eliminate.marginal(none, v).isEmpty()
    # Two parts of one entry add up; vertex 2 goes.
    rows = [(1, 1, 2.0), (1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 2.0)]
    assert eliminate.marginal(spark.createDataFrame(rows, "i int, j int, q double"), v).first().q == pytest.approx(2.5)
    with pytest.raises(Exception, match="not positive definite"):
        eliminate.marginal(spark.createDataFrame([(1, 1, 1.0), (2, 2, -1.0)], "i int, j int, q double"), v).collect()
