import math
import random

import numpy as np
import pytest

from geopanel.operators import field, mesh

GRID = field.Grid(-1.0, 2.0, 0.5, 13, 9)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_intensity_agrees_with_dense_sums(spark):
    rnd = random.Random(1)
    pts = [(rnd.gauss(1, 1.5), rnd.uniform(1, 7)) for _ in range(200)]
    domain = [[(-0.6, 2.1), (4.8, 2.2), (3.1, 5.9), (0.2, 5.0)]]
    got = {(r.i, r.j): r.f for r in field.intensity(table(spark, pts, "x double, y double"), GRID, 0.8, domain).collect()}
    counts = np.zeros((GRID.ny, GRID.nx))
    for x, y in pts:
        i, j = round((x + 1) / 0.5), round((y - 2) / 0.5)
        if 0 <= i < GRID.nx and 0 <= j < GRID.ny:
            counts[j, i] += 1
    sigma = 0.8 / 0.5
    reach = int(4 * sigma + 0.5)
    mask = np.zeros_like(counts)
    for i, j in got:
        mask[j, i] = 1
    want_mask = mesh._inside(np.array([(-1 + i * 0.5, 2 + j * 0.5) for j in range(GRID.ny) for i in range(GRID.nx)]), domain).reshape(GRID.ny, GRID.nx)
    assert np.array_equal(mask > 0, want_mask)

    def smooth(z):
        w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        w /= w.sum()
        z = np.apply_along_axis(lambda v: np.convolve(np.pad(v, reach), w, "valid"), 0, z)
        return np.apply_along_axis(lambda v: np.convolve(np.pad(v, reach), w, "valid"), 1, z)

    f = smooth(counts) / np.maximum(smooth(mask), 0.05) * mask
    f /= f.sum() * 0.25
    assert all(math.isclose(v, f[j, i], rel_tol=1e-10) for (i, j), v in got.items())
    assert sum(got.values()) * 0.25 == pytest.approx(1)


def test_intensity_without_points(spark):
    empty = table(spark, [], "x double, y double")
    assert {r.f for r in field.intensity(empty, GRID, 1.0).collect()} == {0.0}
    with pytest.raises(ValueError):
        field.scott(empty)


def test_slope_limit_agrees_with_all_paths(spark):
    rnd = random.Random(2)
    rows = [(i, j, rnd.uniform(0, 10)) for i in range(GRID.nx) for j in range(GRID.ny) if rnd.random() < 0.2] + [(5, 5, None)]
    rows = list({r[:2]: r for r in rows}.values())
    got = {(r.i, r.j): r.h for r in field.limit_slope(table(spark, rows, "i int, j int, h double"), GRID, 0.7).collect()}
    assert len(got) == GRID.nx * GRID.ny
    for (i, j), h in got.items():
        far = [(max(abs(i - a), abs(j - b)), min(abs(i - a), abs(j - b)), v) for a, b, v in rows if v is not None]
        assert h == pytest.approx(min(v + 0.7 * 0.5 * (m - n + n * math.sqrt(2)) for m, n, v in far), rel=1e-9)
    none = field.limit_slope(table(spark, [], "i int, j int, h double"), GRID, 0.7).collect()
    assert len(none) == 117 and {r.h for r in none} == {None}


def brute_peel(tri, least):
    while tri:
        edges = {tuple(sorted(p)) for a, b, c in tri for p in ((a, b), (b, c), (c, a))}
        degree = {}
        for e in edges:
            for v in e:
                degree[v] = degree.get(v, 0) + 1
        kept = [t for t in tri if all(degree[v] >= least for v in t)]
        if len(kept) == len(tri):
            break
        tri = kept
    return tri


@pytest.mark.parametrize("least", [3, 4])
def test_peeling_agrees_with_brute_force(spark, least):
    rnd = random.Random(least)
    tri = []
    for i in range(9):
        for j in range(9):
            if rnd.random() < 0.75:
                a = i + 10 * j
                tri += [(a, a + 1, a + 11), (a, a + 11, a + 10)]
    tri += [(200 + k, 201 + k, 202 + k) for k in range(8)] + [(200, 201, 202)]
    got = field.peel(table(spark, [(n, *t) for n, t in enumerate(tri)], "e int, v1 int, v2 int, v3 int"), least)
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(brute_peel(tri, least))
    assert field.peel(table(spark, [], "e int, v1 int, v2 int, v3 int"), 3).count() == 0
