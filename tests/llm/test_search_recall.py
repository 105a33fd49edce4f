import numpy as np
import pandas as pd

from geopanel.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def found(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return got


def recall(got, x):
    x, hits = x.astype(float), 0
    for q, ids in got.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(ids & set(np.argsort(d, kind="stable")[:10].tolist()))
    return hits / (10 * len(got))


def test_recall_holds_over_many_lists_without_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 12)  # 512 lists
    monkeypatch.setattr(ann, "SAMPLE", 4096)
    x = np.random.default_rng(1).normal(0, 1, (8000, 48)).astype(np.float32)
    got = found(spark, x)
    assert len(got) == 80 and all(len(v) == 10 for v in got.values())
    assert recall(got, x) >= 0.97


def test_no_query_is_short_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 5)
    rng = np.random.default_rng(2)
    x = (np.repeat(rng.normal(0, 50, (80, 16)), 5, axis=0) + 0.01 * rng.normal(0, 1, (400, 16))).astype(np.float32)
    got = found(spark, x)
    assert len(got) == 4 and all(len(v) == 10 for v in got.values())


def test_recall_on_a_large_table(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (50_000, 32)) + 1.5 * rng.normal(0, 1, (200, 32))[rng.integers(0, 200, 50_000)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), SCHEMA)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(got) == 500 and all(len(v) == 10 for v in got.values())
    some = {q: got[q] for q in sorted(got)[::2]}
    assert recall(some, x) >= 0.95


def test_rows_come_from_the_lists_alone(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 20)
    x = np.random.default_rng(3).normal(0, 1, (600, 16)).astype(np.float32)
    assert recall(found(spark, x), x) >= 0.95

    def nothing(k):
        return lambda q, p: pd.DataFrame({"q": [], "c": [], "score": [], "ids": pd.Series([], dtype=object)})

    monkeypatch.setattr(ann, "_compare", nothing)
    assert found(spark, x) == {}
