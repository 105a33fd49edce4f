"""Whitening of embeddings by the eigenvectors of their covariance, found by cyclic Jacobi rotations.

Entries become integers, so that counts, sums and deviations are exact however the table is partitioned. Three passes over
the distinct vectors, each of which leaves one small table a partition that Spark adds up: sums a dimension, the scatter of
the centred vectors, and the covariance of the whitened ones. The driver holds matrices of dimensions x dimensions alone.
It annihilates the scatter's off-diagonal entries in rounds of disjoint pairs until every one is below rounding relative
to its two diagonal entries, which keeps small eigenvalues accurate, sorts the eigenvalues and broadcasts the matrix that
whitens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.llm.common import cut, lean

#: An entry c becomes floor(STEP * c) + SHIFT.
STEP, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Scaled entries beyond this are no exact integers in double precision.
LARGEST = float(2**53)
#: Vectors of a block of the passes.
BLOCK = 1024
#: Sweeps of the rotations at most; some ten do.
SWEEPS = 60
EPS = np.finfo(float).eps

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix without negative eigenvalues.

    A sweep turns every pair of coordinates once, in rounds of disjoint pairs, which are turned together. A pair is turned
    where its entry exceeds rounding relative to the geometric mean of its diagonal entries.
    """
    d = len(a)
    a, v = (np.asarray(a, float) + np.asarray(a, float).T) / 2, np.eye(d)
    ring = np.arange(d + d % 2)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(max(0, len(ring) - 1)):
            half = len(ring) // 2
            p, q = np.minimum(ring[:half], ring[half:][::-1]), np.maximum(ring[:half], ring[half:][::-1])
            p, q = p[q < d], q[q < d]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            off = a[p, q]
            hit = np.abs(off) > EPS * np.sqrt(np.abs(a[p, p] * a[q, q]))
            if not hit.any():
                continue
            turned = True
            p, q, off = p[hit], q[hit], off[hit]
            app, aqq = a[p, p], a[q, q]
            theta = (aqq - app) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            rp, rq = a[p], a[q]
            a[p], a[q] = c[:, None] * rp - s[:, None] * rq, s[:, None] * rp + c[:, None] * rq
            cp, cq = a[:, p], a[:, q]
            a[:, p], a[:, q] = c * cp - s * cq, s * cp + c * cq
            a[p, p], a[q, q] = app - t * off, aqq + t * off
            a[p, q] = a[q, p] = 0.0
            vp, vq = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
        if not turned:
            break
    e = np.maximum(np.diag(a), 0.0)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


def _blocks(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
    for i in range(0, len(x), BLOCK):
        yield x[i : i + BLOCK]


def _cells(table: np.ndarray) -> pa.RecordBatch:
    """The entries of a small matrix, one a row."""
    i, j = np.indices(table.shape).reshape(2, -1).astype(np.int32)
    return pa.record_batch([pa.array(i), pa.array(j), pa.array(table.ravel())], ["i", "j", "s"])


def _sums(d: int) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            for x in _blocks(batch, d):
                n, total = n + len(x), total + (x - SHIFT).sum(0).astype(object) + SHIFT * len(x)
        if n:
            s = pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))
            yield pa.record_batch([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), s], ["i", "n", "s"])

    return lean(run)


def _scatter(whole: np.ndarray, rest: np.ndarray, matrix: np.ndarray | None = None) -> Run:
    """Sums of the outer products of x - whole - rest, projected on the matrix if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _blocks(batch, len(whole)):
                z = (x - whole) - rest
                z = z if matrix is None else z @ matrix
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield _cells(total)

    return lean(run)


def _matrix(fit: DataFrame, run: Run, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    for r in fit.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = r.s
    return out


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; None where it is no 64-bit integer."""
    base = np.array([s // n for s in sums], dtype=object)
    y = x - base.astype(np.int64)
    rest = sums - n * base
    reach = float(np.abs(y).max(initial=0) + 1) * n
    if reach * reach * len(sums) < 2.0**62:
        z = y * n - rest.astype(np.int64)
        return (z * z).sum(1).tolist()
    z = y.astype(object) * n - rest
    out = (z * z).sum(1)
    return [int(t) if t < 2**63 else None for t in out]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every vector and each of the first components.

    x = floor(64 c) + 1000000 for every entry c. The covariance (divisor n) is that of the n distinct x; component 1 is
    the eigenvector of its largest eigenvalue e. deviation is the sum over dimensions of (n x - S)^2, exact, with S the sums
    of the distinct x (null where it is no 64-bit integer). whitened is x - S / n projected on the component, over sqrt(e);
    explained is e over the trace; identity_error is the largest absolute entry of the measured covariance of whitened less
    the identity, over the components that have variance.

    Vectors that are null, empty, or hold null or non-finite entries take no part, nor do those with an entry beyond
    2^53 / 64, which is no exact integer, and those not of the commonest length (the shorter on a tie). A component
    without variance (all vectors equal, or fewer directions than components) has whitened null and explained 0, or null
    where nothing varies. Repeated rows and ids, and null ids, are rows of the result each; the id keeps its type.
    Further columns are ignored; an empty table gives an empty result. Vectors may be long: the driver's work grows with
    the third power of their length.
    """
    spark = vectors.sparkSession
    kind = vectors.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    v = F.col(vector_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * STEP) <= LARGEST))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)))
    rows = rows.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * STEP).cast("long") + SHIFT).alias("x"))
    width = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if width is None:
        return spark.createDataFrame([], schema)
    d = width.d
    rows = rows.where(F.size("x") == d)
    fit = cut(rows.select("x").distinct())
    found = fit.mapInArrow(_sums(d), "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    n, sums = int(found[0].n), np.zeros(d, object)
    for r in found:
        sums[r.i] = int(r.s)
    # The mean as a whole number and a remainder below 1: centring loses no digits.
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    cov = _matrix(fit, _scatter(whole, rest), d) / n
    e, u = jacobi(cov)
    k, trace = min(components, d), float(np.trace(cov))
    # Below rounding of the trace an eigenvalue is none.
    some = e[:k] > d * EPS * max(trace, 0.0)
    matrix = np.where(some, u[:, :k] / np.sqrt(np.where(some, e[:k], 1.0)), 0.0)
    error = None
    if some.any():
        shown = matrix[:, some]
        error = float(np.abs(_matrix(fit, _scatter(whole, rest, shown), shown.shape[1]) / n - np.eye(shown.shape[1])).max())
    ratio = [float(t) / trace for t in np.where(some, e[:k], 0.0)] if trace > 0 else [None] * k
    shared = spark.sparkContext.broadcast((matrix, some, ratio, error, n, sums, whole, rest))  # dimensions x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, some, ratio, error, n, sums, whole, rest = shared.value
        k = matrix.shape[1]
        for batch in batches:
            at = 0
            for x in _blocks(batch, len(whole)):
                m = len(x)
                ids = batch.column("id").slice(at, m).take(pa.array(np.repeat(np.arange(m), k)))
                at += m
                w = ((x - whole) - rest) @ matrix
                yield pa.record_batch(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)),
                        pa.array(_deviation(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(w.ravel(), mask=np.tile(~some, m)),
                        pa.array(ratio * m, pa.float64()),
                        pa.array([error] * (m * k), pa.float64()),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(lean(run), schema)
