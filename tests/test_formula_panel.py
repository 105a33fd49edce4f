import datetime as dt

import pytest
from pyspark.sql import functions as F

from geopanel.plans import formula as fm
from geopanel.plans import panel as pn


def frame(spark, n=6, t=8, skip=()):
    rows = []
    for s in range(n):
        for k in range(t):
            if (s, k) in skip:
                continue
            rows.append((s, dt.datetime(2020, 1, 1) + dt.timedelta(days=k), float(s), float(s % 3), 1000.0 * s + k, float(s * k), "ab"[k % 2]))
    return spark.createDataFrame(rows, "site long, ts timestamp, x double, y double, v double, w double, c string")


def names(spark, text, df=None):
    df = df if df is not None else frame(spark)
    f = fm.parse(text)
    cols, y = fm.design(f, df, fm.learn(f, df))
    return [n for n, _ in cols], df.select(*[c.alias(f"c{i}") for i, (_, c) in enumerate(cols)], *([y.alias("y")] if y is not None else []))


def test_terms_and_intercept(spark):
    assert names(spark, "v ~ w + x:w")[0] == ["Intercept", "w", "x:w"]
    assert names(spark, "v ~ w - 1")[0] == ["w"]
    assert names(spark, "v ~ 0 + w")[0] == ["w"]
    assert names(spark, "v")[0] == ["Intercept"]
    assert names(spark, "~ x * w")[0] == ["Intercept", "x", "w", "x:w"]
    assert names(spark, "v ~ c")[0] == ["Intercept", "c[T.b]"]
    assert names(spark, "v ~ c - 1")[0] == ["c[a]", "c[b]"]
    assert names(spark, "v ~ C(c):w")[0] == ["Intercept", "C(c)[T.b]:w"]
    assert names(spark, "v ~ -1")[0] == []


def test_metadata():
    f = fm.parse("np.log(v) ~ np.sqrt(I(w**2)) + standardize(x)")
    assert f.response_columns == ["v"] and f.columns == ["w", "x"]
    assert f.transformations["np.sqrt(I(w**2))"] == ["sqrt", "I"]


@pytest.mark.parametrize("bad", ["a + b ~ c", "a ~ b ~ c", "a ~ (b", "a ~ b +", "", "a ~ b c"])
def test_bad_formulas(bad):
    with pytest.raises(fm.FormulaError):
        fm.parse(bad)


def test_unknown_functions_and_columns(spark):
    with pytest.raises(fm.FormulaError, match="unknown function"):
        names(spark, "v ~ bs(w)")
    with pytest.raises(fm.FormulaError, match="columns not in the table: q, z"):
        fm.check_columns(fm.parse("v ~ z + q"), frame(spark))
    with pytest.raises(fm.FormulaError, match="numeric"):
        fm.check_columns(fm.parse("c ~ w"), frame(spark))


def test_missing_values_stay_missing(spark):
    df = spark.createDataFrame([(0.0, float("nan")), (-1.0, 2.0), (None, float("inf"))], "v double, w double")
    got = [tuple(r) for r in names(spark, "np.log(v) ~ w", df)[1].collect()]
    assert got == [(1.0, None, None), (1.0, 2.0, None), (1.0, None, None)]


def test_standardize_uses_population_sd(spark):
    df = names(spark, "v ~ standardize(w) + standardize(standardize(w))")[1]
    r = df.agg(F.avg("c1"), F.stddev_pop("c1"), F.avg("c2"), F.stddev_pop("c2")).first()
    assert abs(r[0]) < 1e-12 and abs(r[1] - 1) < 1e-12 and abs(r[2]) < 1e-12 and abs(r[3] - 1) < 1e-12


STAMPS = [
    ([dt.datetime(2020, 1, d) for d in range(1, 7)], (True, 1.0, "day")),
    ([dt.datetime(2020, 1, 1, h) for h in range(6)], (True, 1.0, "hour")),
    ([dt.datetime(2020, m, 1) for m in range(1, 7)], (True, 1.0, "month")),
    ([dt.datetime(y, 7, 1) for y in range(2000, 2006)], (True, 1.0, "year")),
    ([dt.datetime(2020, 1, 31), dt.datetime(2020, 2, 29), dt.datetime(2020, 3, 31)], (True, 1.0, "month")),
    ([dt.datetime(2020, m, 1) for m in (1, 4, 7, 10)], (True, 3.0, "month")),
    ([dt.datetime(2020, 1, 1 + 7 * k) for k in range(4)], (True, 7.0, "day")),
    ([dt.datetime(2020, 1, 1, 0, 0, 15 * k) for k in range(4)], (True, 15.0, "second")),
    ([dt.datetime(2020, 1, d) for d in (1, 2, 4)], (False, 0.0, "None")),
    ([dt.datetime(2020, 1, 1)], (True, 0.0, "None")),
]


@pytest.mark.parametrize("stamps,want", STAMPS)
def test_regular_steps(spark, stamps, want):
    r = pn.check_regular(spark.createDataFrame([(s,) for s in stamps] * 2, "ts timestamp"), "ts")
    assert (r.regular, r.delta, r.unit) == want


def test_unreadable_times_are_irregular(spark):
    assert not pn.check_regular(spark.createDataFrame([("2020-01-01",), ("x",)], "ts string"), "ts").regular


def test_build_keeps_values_with_their_rows(spark):
    p = pn.build(frame(spark), "v ~ w")
    assert p.shape == (6, 2, 8)
    for r in p.rows.collect():
        assert r.obs == 1000 * r.site + r.t_idx and r.cov == [1.0, float(r.site * r.t_idx)]


def test_build_errors(spark):
    with pytest.raises(pn.PanelError, match="1 sites are incomplete"):
        pn.build(frame(spark, skip={(2, 3)}), "v ~ w")
    with pytest.raises(pn.PanelError, match="no column 'x'; no column 'y'"):
        pn.build(frame(spark).drop("x", "y"), "v ~ w")
    with pytest.raises(pn.PanelError, match="regular"):
        pn.build(frame(spark, skip={(s, 3) for s in range(6)}), "v ~ w")
    with pytest.raises(pn.PanelError, match="no rows"):
        pn.build(frame(spark), "v ~ w", start=dt.datetime(2030, 1, 1))


def test_duplicates_and_unobserved_sites(spark):
    df = frame(spark).withColumn("ord", F.monotonically_increasing_id())
    twice = df.unionByName(df.where("site = 1").withColumns({"v": F.lit(-1.0), "ord": F.col("ord") + 10**9}))
    lost = twice.withColumn("v", F.when(F.col("site") != 4, F.col("v")))
    p = pn.build(lost, "v ~ 1", pn.PanelSpec(order="ord"))
    assert p.n_sites == 5 and p.rows.where("obs < 0").count() == 0


def test_prediction_reuses_training(spark):
    train = pn.build(frame(spark), "v ~ standardize(w) + c", domain=[[(-1, -1), (3, -1), (3, 3), (-1, 3)]])
    assert train.n_sites == 4
    new = frame(spark, n=2).withColumn("x", F.col("x") + 10)
    p = pn.build_predict(train, new, domain=[[(-1, -1), (3, -1), (3, 3), (-1, 3)]])
    assert p.rows.where("in_domain").count() == 0 and p.rows.count() == 16
    mean = frame(spark).where("site < 4").agg(F.avg("w"), F.stddev_pop("w")).first()
    r = p.rows.where("site = 1 and t_idx = 3").first()
    assert r.cov[1] == pytest.approx((3 - mean[0]) / mean[1]) and r.cov[2] == 1.0
    with pytest.raises(pn.PanelError, match="do not match"):
        pn.build_predict(train, new.where("extract(day from ts) % 2 = 1"))


def test_masks_windows_and_summary(spark):
    df = frame(spark)
    q = pn.quantile_mask(df, ["v"], 0.1, 0.9)
    assert 0 < q.where("v is null").count() < 12
    m = pn.moving_average(df.where("site = 0"), "ts", "v", 5, "m").orderBy("ts").select("m").collect()
    assert [r.m for r in m] == [2.0, 3.0, 4.0, 5.0]
    b = pn.balance(df, "site", "ts", "v").first()
    assert (b.n_sites, b.n_times, b.n_rows, b.incomplete) == (6, 8, 48, 0)
    s = pn.build(df, "v ~ w").summary().first()
    assert s.observed_pct == 100 and s.n_sites == 6 and s.unit == "day"
    cells = pn.raster_axis(df, "x", "cell").select("site", "cell").distinct().collect()
    assert all(r.site == r.cell for r in cells)


def test_a_panel_is_evaluated_once(spark):
    """Panels are read from a written table, not derived again from the raw one by each reader."""
    p = pn.build(frame(spark), "v ~ w")
    new = pn.build_predict(p, frame(spark))
    for rows in (p.rows, new.rows):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan


def test_checks_share_their_passes(spark):
    """Counts of each site serve the checks for repeats, infinite and missing responses, unseen sites and balance."""
    counts = pn._site_counts(frame(spark).selectExpr("site AS __site", "ts AS __ts", "v"), "v", "__site")
    assert {(r.rows, r.steps, r.seen, r.infinite) for r in counts.collect()} == {(8, 8, 8, 0)}
    plan = pn.regular_steps(frame(spark), "ts")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
