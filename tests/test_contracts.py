"""What users may rely on around panels, predictions and results."""

import datetime as dt
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from geopanel.functions import geo
from geopanel.functions.semantics import safe_ln
from geopanel.operators import em, kalman, mesh, spde
from geopanel.operators.model import LowRankModel, Results, site_hull
from geopanel.plans import formula as fm
from geopanel.plans import panel as pn
from geopanel.sources import geotext

SQUARE = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
DAY = dt.timedelta(days=1)
START = dt.datetime(2021, 1, 1)


def table(spark, n=12, t=8):
    r = np.random.default_rng(3)
    xy = r.uniform(1, 9, (n, 2))
    rows = [(i, START + k * DAY, float(xy[i, 0]), float(xy[i, 1]), float(2 + np.sin(i + k) + 0.1 * r.normal()), float(r.normal())) for i in range(n) for k in range(t)]
    return spark.createDataFrame(rows, "site long, ts timestamp, x double, y double, v double, w double")


@pytest.fixture(scope="module")
def results(spark):
    model = LowRankModel.of(table(spark), "v ~ w", pn.PanelSpec()).setup(spde.Spde.of(mesh.grid_mesh([SQUARE], 1.5, 5, 5)))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return model.fit(options=em.FitOptions(max_iter=3, tol_relat=0.0))


def test_reprojection_goes_there_and_back(spark):
    df = spark.createDataFrame([(9.2, 45.5), (11.9, 44.1), (6.1, 46.0)], "lon double, lat double")
    for crs in ("EPSG:3857", "EPSG:32632", "EPSG:32732"):
        x, y = geo.reproject(F.col("lon"), F.col("lat"), "EPSG:4326", crs)
        there = df.select("lon", "lat", x.alias("x"), y.alias("y"))
        a, b = geo.reproject(F.col("x"), F.col("y"), crs, "EPSG:4326")
        assert all(abs(r.a - r.lon) < 2e-8 and abs(r.b - r.lat) < 2e-8 for r in there.select("lon", "lat", a.alias("a"), b.alias("b")).collect())
    with pytest.raises(ValueError, match="cannot reproject"):
        geo.reproject(F.col("lon"), F.col("lat"), "EPSG:2154", "EPSG:4326")


def test_prediction_tables_in_another_system_are_reprojected(spark):
    train = pn.build(table(spark), "v ~ w", pn.PanelSpec(crs="EPSG:4326"))
    x, y = geo.web_mercator(F.col("x"), F.col("y"))
    far = table(spark).withColumns({"x": x, "y": y})
    with pytest.warns(UserWarning, match="reprojected from EPSG:3857"):
        p = pn.build_predict(train, far, pn.PanelSpec(crs="EPSG:3857"))
    a, b = ({r.site: (r.x, r.y) for r in q.select("site", "x", "y").distinct().collect()} for q in (p.rows, train.rows))
    assert all(abs(a[s][k] - b[s][k]) < 1e-9 for s in b for k in (0, 1))


def test_polygon_sites_lie_at_their_centroids(spark):
    ring = "array<array<struct<x:double,y:double>>>"
    ell = [[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0)]]
    hole = [[(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)], [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0)]]
    rows = [(i, START + k * DAY, p, float(k)) for i, p in enumerate((ell, hole)) for k in range(4)]
    df = spark.createDataFrame(rows, f"site long, Time timestamp, area {ring}, v double")
    with pytest.warns(UserWarning, match="centroids"):
        p = pn.build(df, "v ~ 1", pn.PanelSpec(ts=None, polygon="area"))
    got = {r.site: (r.x, r.y) for r in p.rows.select("site", "x", "y").distinct().collect()}
    for i, poly in enumerate((ell, hole)):
        _, x, y = geo.area_centroid(poly)
        assert got[i] == pytest.approx((x, y))


def test_repeated_rows_take_an_order_and_are_counted(spark):
    df = table(spark).withColumn("ord", F.lit(0))
    twice = df.unionByName(df.where("site = 1").withColumns({"v": F.lit(-5.0), "ord": F.lit(1)}))
    with pytest.raises(pn.PanelError, match="8 rows repeat"):
        pn.build(twice, "v ~ w")
    with pytest.warns(UserWarning, match="8 rows repeat"):
        p = pn.build(twice, "v ~ w", pn.PanelSpec(order="ord"))
    assert p.rows.where("obs < -4").count() == 0
    with pytest.warns(UserWarning, match="infinite"):
        p = pn.build(df.withColumn("v", F.when(F.col("site") > 2, F.col("v")).otherwise(float("inf"))), "v ~ w")
    assert p.n_sites == 9


def test_times_of_predictions(spark):
    train = pn.build(table(spark), "v ~ w")
    late = table(spark).withColumn("ts", F.expr("ts + interval 5 days"))
    with pytest.warns(UserWarning, match="left out"):
        assert pn.build_predict(train, late).n_times == 3
    with pytest.warns(UserWarning), pytest.raises(pn.PanelError, match="no training times"):
        pn.build_predict(train, table(spark).withColumn("ts", F.expr("ts + interval 6 hours")))


def test_exact_quantiles(spark):
    r = np.random.default_rng(1)
    v = np.concatenate([r.normal(0, 1, 5000), np.repeat(0.25, 3000)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    at = [0.0, 0.001, 0.33, 0.5, 0.999, 1.0]
    assert pn.exact_quantiles(df, "v", at) == pytest.approx(np.quantile(v, at).tolist())
    assert pn.exact_quantiles(df.limit(0), "v", [0.5]) == [None]
    assert pn.exact_quantiles(df.where("v = 0.25"), "v", [0.1, 0.9]) == [0.25, 0.25]


def test_scans_longer_than_a_chunk(spark):
    n = 3 * kalman.CHUNK + 5
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda v: v.cast("double")).alias("xs"))
    got = df.select(kalman.scan(F.col("xs"), F.lit(0.0), lambda s, x: s / 2 + x).alias("s")).first().s
    want, s = [], 0.0
    for k in range(1, n + 1):
        s = s / 2 + k
        want.append(s)
    assert got == pytest.approx(want)
    assert spark.range(1).select(kalman.scan(F.array().cast("array<double>"), F.lit(0.0), lambda s, x: x).alias("s")).first().s == []


def test_functions_of_ones_own_in_formulas(spark):
    fm.register("cubed", lambda c: c * c * c)
    p = pn.build(table(spark), "v ~ cubed(w)")
    r = p.rows.join(table(spark).select("site", "ts", "w"), ["site", "ts"]).first()
    assert r.cov[1] == pytest.approx(r.w**3)
    with pytest.raises(fm.FormulaError):
        fm.register("standardize", safe_ln)
    assert p.astype("float").rows.schema["cov"].dataType.elementType.simpleString() == "float"


def test_default_domains_are_hulls(spark, results):
    xy = {(r.x, r.y) for r in table(spark).select("x", "y").distinct().collect()}
    (ring,) = site_hull(table(spark).repartition(5))
    assert set(ring) <= xy and all(geo.contains(ring, x, y) for x, y in xy)
    assert results.model.with_default_domains().domains[0] is not None


def test_results_are_updated_viewed_and_loaded(spark, results, tmp_path):
    other = results.params.set(s2e=2 * results.params.s2e)
    new = results.update(params=other)
    assert new.loglik != results.loglik and new.params.s2e[0] == 2 * results.params.s2e[0] and results.update(options=em.FitOptions()).loglik == results.loglik
    with pytest.raises(AttributeError, match="colour"):
        results.update(colour=1)
    assert results.missing == 0 and results.nspace == (12,) and results.ntime == 8
    results.save(str(tmp_path / "r"))
    back = Results.load(str(tmp_path / "r"), results.model)
    a, b = ({(r.site, r.t_idx): r.mean for r in q.view(0).collect()} for q in (results, back))
    assert a == pytest.approx(b) and back.aic == results.aic
    with pytest.raises(ValueError):
        results.view(3)
    snap = results.as_dict(spark)
    assert snap["nobs"] == 96 and snap["states"].count() == 9 * results.stats.q


def test_back_transformed_fits_and_intervals(results):
    f = {(r.site, r.t_idx): r for r in results.back_transform("exp").collect()}
    own = (F.exp, F.exp, F.exp)
    g = {(r.site, r.t_idx): r for r in results.back_transform(own).collect()}
    for k, r in f.items():
        assert r.mean_back == pytest.approx(np.exp(r.mean) * (1 + r.variance / 2)) and r.residual_back == pytest.approx(np.exp(r.obs) - r.mean_back)
        assert g[k].mean_back == pytest.approx(r.mean_back)
    wide, narrow = ({(r.site, r.t_idx): r.y_upper - r.y_lower for r in results.intervals(prediction=p).collect()} for p in (True, False))
    assert all(wide[k] > narrow[k] >= 0 for k in wide)


def test_full_covariances_hold_the_variances(results):
    sites = results.model.panels[0].rows.select("site_id", "x", "y").distinct()
    c = {(r.t_idx, r.site_a, r.site_b): r["cov"] for r in results.covariance(sites).collect()}
    for r in results.fitted().collect():
        if r.in_support:
            assert c[r.t_idx, r.site_id, r.site_id] == pytest.approx(r.variance)


def test_polygons_without_points_stay(spark, results):
    far = [[(50.0, 50.0), (51.0, 50.0), (51.0, 51.0)]]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        p = results.predict(table(spark))
    with pytest.warns(UserWarning, match="1 polygons hold no point"):
        out = p.to_poly([SQUARE, far], ["all", "far"], std=True).collect()
    assert len(out) == 16
    assert all((r["mean"] is None and r.n_points == 0 and r.std is None) if r.name == "far" else r.std > 0 for r in out)
    with pytest.raises(ValueError):
        p.to_poly([])
    regions = spark.createDataFrame([(7, "all", "POLYGON ((0 0, 10 0, 10 10, 0 10))"), (9, "none", "POLYGON EMPTY"), (11, "bad", "POLYGON ((0 0")], "poly_id int, name string, t string")
    with pytest.warns(UserWarning, match="no point"):
        read = p.to_poly(geotext.parse_polygons(regions, "t").drop("t"), std=True).collect()
    assert {(r.ts, round(r["mean"], 9), round(r["std"], 9)) for r in read if r.poly_id == 7} == {(r.ts, round(r["mean"], 9), round(r["std"], 9)) for r in out if r.poly_id == 0}
    assert all(r.n_points == 0 and r["mean"] is None for r in read if r.poly_id != 7) and {r.poly_id for r in read} == {7, 9, 11}
    with pytest.raises(ValueError, match="scale of the model"):
        p.back_transform("exp").intervals()


def test_distances_take_a_bounded_set(spark, monkeypatch):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "id long, x double, y double")
    assert {(r.a, r.b): r.d for r in spde.distances(a, a).collect()}[1, 2] == 5.0
    monkeypatch.setattr(spde, "MOST", 1)
    with pytest.raises(ValueError, match="more than 1"):
        spde.distances(a, a)


def test_results_from_a_folder_predict_without_the_data(spark, results, tmp_path):
    path = str(tmp_path / "kept")
    assert results.save(path) == 1 and results.update(params=results.params.set(s2e=2 * results.params.s2e)).save(path) == 2
    first, last = (Results.load(path, spark=spark.newSession(), version=v) for v in (1, None))
    for k, v in results.params.as_dict().items():
        assert np.array_equal(getattr(first.params, k), v), k
    assert last.params.s2e[0] == 2 * results.params.s2e[0] and first.loglik == results.loglik and first.aic == results.aic
    for k in ("x", "p", "lag", "s11"):
        assert np.array_equal(getattr(first.fit.smoothed, k), getattr(results.fit.smoothed, k)), k
    assert repr(first.fit.trace) == repr(results.fit.trace) and first.options == results.options and first.model.panels[0].span == results.model.panels[0].span
    new = table(spark).withColumn("x", F.col("x") * 0.9 + 0.5)
    a, b = ({(r.site, r.ts): (r.mean, r.variance) for r in q.predict(new).rows.collect()} for q in (results, first))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    # Steps with missing rows are kept: another E step gives the same likelihood.
    assert first.update(params=first.params).loglik == pytest.approx(results.update(params=results.params).loglik)
    with pytest.raises(ValueError, match="no training rows"):
        first.fitted()
    with pytest.raises(ValueError, match="no finished version 3"):
        Results.load(path, spark=spark, version=3)
    with pytest.raises(ValueError, match="no finished version"):
        Results.load(str(tmp_path / "nothing"), spark=spark)
    # A version without a manifest is not one.
    import shutil

    shutil.rmtree(f"{path}/manifest/version=2")
    assert Results.load(path, spark=spark).params.s2e[0] == results.params.s2e[0] and results.save(path) == 2
