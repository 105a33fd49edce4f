import random

import numpy as np
from pyspark.sql import functions as F

from geopanel.llm import common, outliers
from geopanel.llm.outliers import CONSISTENT, CUT, DIMS, FLOOR, INLIERS, chi2_cdf, chi2_quantile, flag, vector

SCHEMA = "doc_id long, text string, lang string, source string"


def corpus(n=900):
    r = random.Random(8)
    rows = []
    for i in range(n):
        size = int(np.exp(r.gauss(5, 0.7))) + 21
        w = [r.choice("abcdefghij") + "".join(r.choice("aeiou") for _ in range(r.randint(1, 7))) for _ in range(size)]
        if r.random() < 0.3:
            w[3] = w[3].title() + "!"
        if i % 30 == 7:
            w = [x.upper() + "#$" for x in w]
        rows.append((i, "\n".join(" ".join(w[k : k + 30]) for k in range(0, size, 30)), "en" if i % 3 else "de", "big" if i % 5 else "small"))
    return rows


def brute(x):
    """Distances by exact concentration steps from the three starts, until the nearest h stay the same."""
    n, d = x.shape
    floor = np.diag([FLOOR[k] ** 2 for k in DIMS])
    h = INLIERS * n
    mid = np.median(x, 0)
    scale = np.maximum((np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)) / 1.349, [FLOOR[k] for k in DIMS])
    z = (x - mid) / scale
    u = z * np.sqrt(d) / np.sqrt(np.maximum((z * z).sum(1), 1e-12))[:, None]
    best = None
    for c in (np.eye(d), np.tanh(z).T @ np.tanh(z) / n, u.T @ u / n):
        m, cov = mid, c * np.outer(scale, scale) + floor
        for _ in range(60):
            dist = ((x - m) @ np.linalg.inv(cov) * (x - m)).sum(1)
            near = np.argsort(dist, kind="stable")
            w = np.zeros(n)
            w[near[: int(h)]] = 1
            m = (w[:, None] * x).sum(0) / w.sum()
            cov = CONSISTENT * ((w[:, None] * (x - m)).T @ (x - m) / w.sum()) + floor
        dist = ((x - m) @ np.linalg.inv(cov) * (x - m)).sum(1)
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0] - 1e-9:
            best = det, dist
    return best[1]


def vectors(spark, df):
    stats = outliers.base_statistics(df, "doc_id", "text", ["lang", "source"])
    return {r.id: ((r.g0, r.g1), [r[k] for k in DIMS]) for r in stats.select("id", "g0", "g1", *[c.alias(n) for n, c in vector().items()]).collect()}


def test_verdicts_against_exact_steps(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    got = {r.id: r for r in flag(df).collect()}
    assert not any(r.base_failed for r in got.values())
    x = vectors(spark, df)
    odd = 0
    for g in {g for g, _ in x.values()}:
        ids = [i for i in x if x[i][0] == g]
        assert len(ids) >= outliers.LEAST or g == ("de", "small")
        if len(ids) < outliers.LEAST:
            continue
        want = brute(np.array([x[i][1] for i in ids]))
        for i, v in zip(ids, want, strict=True):
            assert abs(got[i].distance - v) < 0.15 * v + 0.3
            odd += got[i].kept != (v <= CUT)
    assert odd == 0
    assert all(not r.kept for i, r in got.items() if i % 30 == 7)


def test_many_groups_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), SCHEMA)
    want = {r.id: (round(r.distance, 9), r.kept) for r in flag(df).collect()}
    monkeypatch.setattr(common, "TABLE", 2)  # estimates of hot groups are broadcast, others are joined
    assert {r.id: (round(r.distance, 9), r.kept) for r in flag(df.repartition(3)).collect()} == want


def test_chi_square_constants():
    assert abs(chi2_cdf(2.0, 2) - (1 - np.exp(-1))) < 1e-12
    assert abs(chi2_quantile(0.975, 7) - 16.0128) < 1e-3 and abs(CONSISTENT - 1.3247) < 1e-3 and abs(CUT - 40.522) < 1e-2


def test_odd_groups(spark):
    rows = [(i, "one two three four five six seven eight nine ten " * 2 + str(i) + " x y z w", None, None) for i in range(120)]
    rows += [(200, None, None, "a"), (201, "", "en", None), (202, rows[0][1], "xx", "alone")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("distance", F.lit("z")).withColumn("grp", F.lit(1))
    out = {r.id: r for r in flag(df).collect()}
    assert len(out) == 123 and out[200].base_failed and out[201].base_failed and not out[200].kept
    assert all(r.kept for i, r in out.items() if i < 120 and not r.base_failed)
