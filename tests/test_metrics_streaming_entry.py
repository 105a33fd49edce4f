import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from geopanel import queries as base
from geopanel.operators import metrics
from geopanel.operators.kalman import StateSpace
from geopanel.sources import io
from geopanel.streaming.online import stream_filter, stream_panel

DATA = "/root/testdata/sf0.001"


def test_diagnostics_against_numpy(spark):
    r = np.random.default_rng(0)
    e = r.gamma(2, 1, (8, 20)) - 2
    e[r.uniform(0, 1, e.shape) < 0.2] = np.nan
    df = spark.createDataFrame([(i, t, None if np.isnan(e[i, t]) else float(e[i, t])) for i in range(8) for t in range(20)], "site int, t int, r double")
    g = metrics.diagnostics(df, "r").first()
    v = e.ravel()[np.isfinite(e.ravel())]
    z = v - v.mean()
    s, k = (z**3).mean() / z.var() ** 1.5, (z**4).mean() / z.var() ** 2 - 3
    assert (g.n, g.skew, g.kurt) == (len(v), pytest.approx(s), pytest.approx(k))
    assert g.durbin_watson == pytest.approx((np.diff(v) ** 2).sum() / (v**2).sum())
    k2, p = metrics.omnibus(df, "r")
    assert k2 > 0 and 0 < p < 1
    m = {(x.site, x.t): x.mse for x in metrics.grouped_mse(df, "r").collect()}
    assert m[None, None] == pytest.approx(np.nanmean(e**2)) and m[3, None] == pytest.approx(np.nanmean(e[3] ** 2)) and m[None, 4] == pytest.approx(np.nanmean(e[:, 4] ** 2))


def test_least_squares(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, 200)
    y = 1 + 2 * x + r.normal(0, 0.5, 200)
    df = spark.createDataFrame([(1.0, float(a), float(b)) for a, b in zip(x, y)] + [(1.0, None, 3.0)], "one double, x double, y double")
    o = metrics.ols(df, ["one", "x"], "y")
    X = np.column_stack([np.ones(200), x])
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    s2 = ((y - X @ b) ** 2).sum() / 198
    assert np.allclose(o["beta"], b) and np.allclose(o["se"], np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * s2)) and o["n"] == 200


def test_csv_and_registry(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ts,v\n2020-01-01,1.5\nx, NA \n")
    df = io.read_csv(spark, str(tmp_path / "a.csv"), ts="ts", schema="v double")
    assert [tuple(r) for r in df.collect()] == [(dt.datetime(2020, 1, 1), 1.5), (None, None)]
    io.write_table(df, str(tmp_path / "p"))
    io.register("a", str(tmp_path / "p"))
    assert io.load_dataset(spark, "a").count() == 2 and io.list_datasets(spark).count() == 1
    with pytest.raises(ValueError, match="unknown dataset"):
        io.load_dataset(spark, "b")


def test_streamed_filter_equals_the_batch_one(spark, tmp_path):
    rows = [(s, dt.datetime(2024, 1, 1 + d, h), float((s * 7 + d * 3 + h) % 11)) for s in (1, 2) for d in range(12) for h in (3, 9) if not (s == 2 and d in (4, 5))]
    for k in range(3):
        part = [r for r in rows if (r[1].day - 1) // 4 == k]
        spark.createDataFrame(part, "user long, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    spark.createDataFrame([(9, dt.datetime(2024, 3, 1), 0.0)], "user long, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in/9"))
    src = spark.readStream.schema("user long, ts timestamp, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    panel = stream_panel(src, "user", "ts", "v", late="0 seconds")
    q = panel.writeStream.format("parquet").option("path", str(tmp_path / "panel")).option("checkpointLocation", str(tmp_path / "c0")).trigger(availableNow=True).outputMode("append").start()
    assert q.awaitTermination(120)
    closed = spark.readStream.schema("site long, start timestamp, y double, n long").parquet(str(tmp_path / "panel"))
    out = stream_filter(closed, 0.8, 1.0, 2.0, 0.0, 4.0)
    q = out.writeStream.format("memory").queryName("flt").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).outputMode("append").start()
    assert q.awaitTermination(120)
    got = {(r.site, r.start.day): r.x for r in spark.table("flt").collect()}
    for s in (1, 2):
        y = np.array([[np.mean([v for a, t, v in rows if a == s and t.day == d + 1]) if any(a == s and t.day == d + 1 for a, t, _ in rows) else np.nan for d in range(12)]])
        x = StateSpace(np.ones((1, 1)), np.array([2.0]), np.array([0.8]), np.eye(1), np.zeros(1), 4 * np.eye(1)).filter(y).x[1:, 0]
        for d in range(12):
            if not np.isnan(y[0, d]) and (s, d + 1) in got:
                assert got[s, d + 1] == pytest.approx(x[d])
    assert len(got) >= 20


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(base.QUERIES) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("events", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    def cell(v):
        if v is None or v != v:
            return "-"
        return f"{float(v):.5f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    return sorted([cell(v) for v in r] for r in rows)


@pytest.mark.parametrize("name", sorted(base.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = base.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.execute(base.ORACLE[name])
    order = [c[0] for c in want.description]
    assert sorted(order) == cols
    got = plain(df.select(*[F.col(f"`{c}`") for c in cols]).collect())
    at = [order.index(c) for c in cols]
    assert got == plain([tuple(r[i] for i in at) for r in want.fetchall()])
