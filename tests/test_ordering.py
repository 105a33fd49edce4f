import random

from geopanel.plans.ordering import numbered, with_previous


def test_numbers_and_neighbours(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 1, 1, 1, 2, 7]), f"k{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = numbered(df, ["a", "b"], "n")
    assert [(r.a, r.b) for r in sorted(got.collect(), key=lambda r: r.n)] == want
    assert sorted(r.n for r in got.collect()) == list(range(500))
    before = {r.b: r.p for r in with_previous(df, ["a", "b"], "b", "p").collect()}
    assert before == {b: p for (_, b), p in zip(want, [None, *[b for _, b in want]], strict=False)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert numbered(df, ["a"], "n").collect() == [] and with_previous(df, ["a"], "b", "p").collect() == []
