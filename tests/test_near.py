import math
import random

import pytest

from geopanel.operators import near

SCHEMA = "id long, x double, y double"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(left, right, k):
    ok = [r for r in set(right) if None not in r and all(math.isfinite(v) for v in r[1:])]
    out = []
    for i, x, y in set(left):
        if x is None or y is None or not (math.isfinite(x) and math.isfinite(y)):
            continue
        d = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, u, v in ok)[:k]
        out += [(i, r, j, e) for r, (e, j) in enumerate(d, 1)]
    return sorted(out)


def points(rnd, n, kind):
    if kind == "even":
        return [(rnd.uniform(-5, 5), rnd.uniform(0, 3)) for _ in range(n)]
    if kind == "lattice":  # many ties
        return [(float(rnd.randint(0, 12)), float(rnd.randint(0, 12))) for _ in range(n)]
    hubs = [(rnd.uniform(0, 1e6), rnd.uniform(0, 1e6)) for _ in range(4)]
    return [(h[0] + rnd.gauss(0, 1e-2), h[1] + rnd.gauss(0, 1e-2)) if rnd.random() < 0.9 else (rnd.uniform(0, 1e6), rnd.uniform(0, 1e6)) for h in rnd.choices(hubs, k=n)]


@pytest.mark.parametrize("kind,k,leaf", [("even", 1, 4), ("lattice", 3, 2), ("clusters", 5, 4)])
def test_nearest_agrees_with_brute_force(spark, kind, k, leaf):
    rnd = random.Random(kind)
    left = [(i, *p) for i, p in enumerate(points(rnd, 150, kind))] + [(900, 1e9, -1e9), (901, None, 1.0), (902, float("nan"), 1.0)]
    right = [(i, *p) for i, p in enumerate(points(rnd, 400, kind))] + [(500 + i, left[0][1], left[0][2]) for i in range(50)] + [(990, None, None), (991, float("inf"), 0.0)]
    left, right = left + left[:5], right + right[:5]
    got = near.nearest(table(spark, left), table(spark, right), k, leaf=leaf)
    assert sorted(tuple(r) for r in got.collect()) == brute(left, right, k)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in got._jdf.queryExecution().toString()


def test_nearest_with_few_or_no_points(spark):
    left = [(1, 0.0, 0.0), (2, -0.0, 0.0)]
    assert near.nearest(table(spark, left), table(spark, [])).count() == 0
    assert near.nearest(table(spark, []), table(spark, left)).count() == 0
    assert sorted(tuple(r) for r in near.nearest(table(spark, left), table(spark, [(7, 3.0, 4.0)]), 4).collect()) == [(1, 1, 7, 5.0), (2, 1, 7, 5.0)]


@pytest.mark.parametrize("radius", [0.0, 0.1, 1.0])
def test_radius_join_agrees_with_brute_force(spark, monkeypatch, radius):
    monkeypatch.setattr(near, "PART", 20)
    rnd = random.Random(2)
    left = [(i, *(round(v, 1) for v in p)) for i, p in enumerate(points(rnd, 120, "even"))]
    right = [(i, *(round(v, 1) for v in p)) for i, p in enumerate(points(rnd, 200, "even"))] + [(300 + i, 1.0, 1.0) for i in range(60)] + [(999, None, 0.0)]
    got = near.within(table(spark, left), table(spark, right), radius)
    want = [(i, j, math.sqrt((x - u) * (x - u) + (y - v) * (y - v))) for i, x, y in left for j, u, v in right if u is not None]
    assert sorted(tuple(r) for r in got.collect()) == sorted(w for w in want if w[2] <= radius)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
