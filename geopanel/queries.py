"""Queries over the bundled tables, one or more an operator, with DuckDB SQL of the same result where SQL can say it."""

from __future__ import annotations

import calendar
import datetime
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.functions import geo, special
from geopanel.functions.semantics import finite, std_of_variance
from geopanel.operators import areal, em, fem, kalman, mesh, metrics, spde, suffstat
from geopanel.operators.model import LowRankModel
from geopanel.plans import formula as fm
from geopanel.plans import panel as pn
from geopanel.sources import tables as T
from geopanel.streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)  # adding zero makes negative zero positive


# --- the flagship: a filtered level a series ---------------------------------------------------------------------------

_SERIES_SQL = """WITH RECURSIVE daily AS (SELECT event_type AS k, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, avg(value) AS y FROM events GROUP BY 1, 2),
grid AS (SELECT k, g.t AS t FROM (SELECT DISTINCT k FROM daily) CROSS JOIN generate_series(0, 29) AS g(t)),
s AS (SELECT grid.k, CAST(grid.t AS BIGINT) AS t, {y} AS y FROM grid LEFT JOIN daily ON daily.k = grid.k AND daily.t = grid.t),
f(k, t, x, p, ll, xp, pp) AS (
  SELECT DISTINCT k, CAST(-1 AS BIGINT), 50.0::DOUBLE, 10.0::DOUBLE, 0.0::DOUBLE, 50.0::DOUBLE, 10.0::DOUBLE FROM s
  UNION ALL
  SELECT k, t, CASE WHEN y IS NULL THEN xp ELSE xp + pp / (pp + 25.0) * (y - xp) END, CASE WHEN y IS NULL THEN pp ELSE (1 - pp / (pp + 25.0)) * pp END,
    ll - CASE WHEN y IS NULL THEN 0.0 ELSE 0.5 * (ln(2 * pi()) + ln(pp + 25.0) + (y - xp) * (y - xp) / (pp + 25.0)) END, xp, pp
  FROM (SELECT f.k, s.t, s.y, f.ll, 0.8 * f.x AS xp, 0.64 * f.p + 1.0 AS pp FROM f JOIN s ON s.k = f.k AND s.t = f.t + 1)
)"""


def _daily(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    day = F.datediff(F.to_date("ts"), F.lit(T.START).cast("date"))
    daily = e.groupBy(F.col("event_type").alias("k"), day.alias("t")).agg(F.avg("value").alias("y"))
    grid = e.select(F.col("event_type").alias("k")).distinct().select("k", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("t"))
    return grid.join(daily, ["k", "t"], "left")


_SCALAR = (0.8, 1.0, 25.0, 50.0, 10.0)


@query(_SERIES_SQL.format(y="daily.y") + " SELECT k, round(x, 6) AS x, round(p, 6) AS p, round(ll, 6) AS ll FROM f WHERE t = 29")
def kalman_scalar(spark: SparkSession, d: str) -> DataFrame:
    s = kalman.scalar_series(_daily(spark, d), ["k"], "t", "y")
    out = s.select("k", kalman.filter_scalar_last(F.col("ys"), *_SCALAR).alias("s"))
    return out.select("k", r6(F.col("s.x"), "x"), r6(F.col("s.p"), "p"), r6(F.col("s.ll"), "ll"))


@query(_SERIES_SQL.format(y="CASE WHEN grid.t % 4 <> 1 THEN daily.y END") + " SELECT k, t, round(x, 6) AS x, round(p, 6) AS p, round(ll, 6) AS ll FROM f WHERE t >= 0")
def kalman_scalar_missing(spark: SparkSession, d: str) -> DataFrame:
    df = _daily(spark, d).withColumn("y", F.when(F.col("t") % 4 != 1, F.col("y")))
    s = kalman.scalar_series(df, ["k"], "t", "y").select("k", F.posexplode(kalman.filter_scalar(F.col("ys"), *_SCALAR)).alias("t", "s"))
    return s.select("k", F.col("t").cast("long").alias("t"), r6(F.col("s.x"), "x"), r6(F.col("s.p"), "p"), r6(F.col("s.ll"), "ll"))


@query(
    _SERIES_SQL.format(y="daily.y")
    + """, b(k, t, x, p, xp, pp) AS (
  SELECT k, t, x, p, xp, pp FROM f WHERE t = 29
  UNION ALL
  SELECT k, t, fx + j * (x - xp), fp + j * j * (p - pp), nxp, npp FROM (SELECT b.k, f.t, f.x AS fx, f.p AS fp, b.x, b.p, b.xp, b.pp, f.xp AS nxp, f.pp AS npp, f.p * 0.8 / b.pp AS j FROM b JOIN f ON f.k = b.k AND f.t = b.t - 1 WHERE f.t >= 0)
) SELECT k, t, round(x, 6) AS x, round(p, 6) AS p FROM b"""
)
def rts_scalar(spark: SparkSession, d: str) -> DataFrame:
    s = kalman.scalar_series(_daily(spark, d), ["k"], "t", "y")
    f = s.select("k", kalman.filter_scalar(F.col("ys"), *_SCALAR).alias("f"))
    out = f.select("k", F.posexplode(kalman.smooth_scalar(F.col("f"), 0.8)).alias("t", "s"))
    return out.select("k", F.col("t").cast("long").alias("t"), r6(F.col("s.x"), "x"), r6(F.col("s.p"), "p"))


@query(
    _SERIES_SQL.format(y="daily.y")
    + """, seen AS (SELECT k, min(t) AS lo FROM daily GROUP BY k)
SELECT f.k, f.t, round(f.x, 6) AS x, round(f.p, 6) AS p, round(f.ll, 6) AS ll FROM f JOIN seen ON seen.k = f.k AND f.t >= seen.lo WHERE f.t < (SELECT max(t) FROM daily)"""
)
def stream_levels(spark: SparkSession, d: str) -> DataFrame:
    """The filtered level of every day that a stream over the events closes; its last day stays open."""
    # As a pattern: a stream takes a plain path for a folder, and the table may be a file.
    src = spark.readStream.schema(T.table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    origin = 1000 * calendar.timegm(datetime.date.fromisoformat(T.START).timetuple())
    out = online.replayed(online.stream_levels(src, "event_type", "ts", "value", *_SCALAR, late="0 seconds", origin_ms=origin))
    day = F.floor((F.unix_millis("start") - origin) / 86_400_000).cast("long")
    return out.select(F.col("site").alias("k"), day.alias("t"), r6(F.col("x"), "x"), r6(F.col("p"), "p"), r6(F.col("loglik"), "ll"))


# --- panels ------------------------------------------------------------------------------------------------------------


@query(f"WITH {T.PANEL_SQL}, per AS (SELECT site, count(*) AS n, count(obs) AS seen FROM panel GROUP BY site) SELECT count(*) AS n_sites, {T.DAYS}::BIGINT AS n_times, sum(n)::BIGINT AS n_rows, sum(seen)::BIGINT AS n_observed, round(1 - sum(seen) / sum(n), 6) AS nan_ratio, sum(CASE WHEN n <> {T.DAYS} THEN 1 ELSE 0 END)::BIGINT AS incomplete FROM per")
def panel_balance(spark: SparkSession, d: str) -> DataFrame:
    b = pn.balance(T.panel_events(spark, d), "site", "t", "obs")
    return b.withColumn("nan_ratio", F.round("nan_ratio", 6))


_REGULAR_SQL = """u AS (SELECT DISTINCT {t} AS t FROM {src}), d AS (SELECT t, lag(t) OVER (ORDER BY t) AS p FROM u)
SELECT {ok} AS regular, CAST({delta} AS DOUBLE) AS delta, '{unit}' AS unit FROM d"""


@query("WITH " + _REGULAR_SQL.format(t="date_trunc('day', ts)", src="events", ok="min(date_diff('day', p, t)) = max(date_diff('day', p, t))", delta="min(date_diff('day', p, t))", unit="day"))
def panel_regularity_day(spark: SparkSession, d: str) -> DataFrame:
    return pn.regular_steps(T.table(spark, d, "events").select(F.date_trunc("day", "ts").alias("ts")), "ts")


@query("WITH " + _REGULAR_SQL.format(t="date_trunc('month', l_shipdate)", src="lineitem", ok="min(date_diff('month', p, t)) = max(date_diff('month', p, t))", delta="min(date_diff('month', p, t))", unit="month"))
def panel_regularity_month(spark: SparkSession, d: str) -> DataFrame:
    return pn.regular_steps(T.table(spark, d, "lineitem").select(F.date_trunc("month", "l_shipdate").alias("ts")), "ts")


@query("SELECT user_id, CAST(strftime(day, '%Y%m%d') AS INT) AS day, event_id, round(value, 6) AS value FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS n FROM events) WHERE n = 1")
def panel_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "value")
    out = pn.first_rows(e, ["user_id", "day"], "event_id")
    return out.select("user_id", F.date_format("day", "yyyyMMdd").cast("int").alias("day"), "event_id", r6(F.col("value"), "value"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' GROUP BY user_id")
def panel_time_window(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt

    e = pn.time_window(T.table(spark, d, "events"), "ts", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {T.PANEL_SQL} SELECT site, count(*) AS n, count(obs) AS n_observed FROM panel WHERE {T.inside_sql(T.LEFT, 'px', 'py')} GROUP BY site")
def panel_domain_filter(spark: SparkSession, d: str) -> DataFrame:
    p = pn.domain_filter(T.panel_events(spark, d), T.LEFT, "px", "py")
    return p.groupBy("site").agg(F.count("*").alias("n"), F.count("obs").alias("n_observed"))


@query(f"WITH {T.SITES_SQL} SELECT site, {T.inside_sql(T.ELL, 'x', 'y')} AS in_domain FROM sites")
def panel_domain_flag(spark: SparkSession, d: str) -> DataFrame:
    return pn.domain_flag(T.sites_events(spark, d), T.ELL).select("site", "in_domain")


@query(f"WITH {T.PANEL_SQL}, q AS (SELECT *, CASE WHEN t >= 5 AND x1 > 1.5 THEN obs END AS v FROM panel) SELECT site, t, round(v, 6) AS v FROM q WHERE site IN (SELECT site FROM q WHERE v IS NOT NULL)")
def panel_observed_sites(spark: SparkSession, d: str) -> DataFrame:
    p = T.panel_events(spark, d).withColumn("v", F.when((F.col("t") >= 5) & (F.col("x1") > 1.5), F.col("obs")))
    return pn.observed_sites(p, "site", "v").select("site", "t", r6(F.col("v"), "v"))


@query(f"WITH {T.PANEL_SQL} SELECT t, sum(CASE WHEN obs IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing, count(*) AS n FROM panel GROUP BY t")
def panel_missing_mask(spark: SparkSession, d: str) -> DataFrame:
    p = T.panel_events(spark, d).withColumn("lost", finite(F.col("obs")).isNull() | finite(F.col("x1")).isNull())
    return p.groupBy("t").agg(F.sum(F.col("lost").cast("long")).alias("missing"), F.count("*").alias("n"))


@query(f"WITH {T.PANEL_SQL}, q AS (SELECT quantile_cont(obs, 0.01) AS lo, quantile_cont(obs, 0.99) AS hi FROM panel) SELECT site, t, round(CASE WHEN obs BETWEEN lo AND hi THEN obs END, 6) AS obs FROM panel, q")
def panel_quantile_mask(spark: SparkSession, d: str) -> DataFrame:
    return pn.quantile_mask(T.panel_events(spark, d), ["obs"], 0.01, 0.99).select("site", "t", r6(F.col("obs"), "obs"))


@query(f"WITH {T.PANEL_SQL} SELECT round(min(obs), 6) AS y_min, round(max(obs), 6) AS y_max, round(avg(obs), 6) AS y_mean, round(100.0 * count(obs) / count(*), 6) AS observed_pct, count(DISTINCT site) AS n_sites, count(DISTINCT t) AS n_times, round(min(px), 3) AS x_min, round(max(px), 3) AS x_max FROM panel")
def panel_summary(spark: SparkSession, d: str) -> DataFrame:
    p = _events_long(spark, d)
    built = pn.build(p, "obs ~ x1", _SPEC)
    s = built.summary()
    return s.select(r6(F.col("y_min"), "y_min"), r6(F.col("y_max"), "y_max"), r6(F.col("y_mean"), "y_mean"), r6(F.col("observed_pct"), "observed_pct"), F.col("n_sites").cast("long").alias("n_sites"), F.col("n_times").cast("long").alias("n_times"), "x_min", "x_max")


_SPEC = pn.PanelSpec(site="site", ts="ts", x="px", y="py")


def _events_long(spark: SparkSession, d: str) -> DataFrame:
    """The events panel with timestamps, as a user would hold it."""
    return T.panel_events(spark, d).withColumn("ts", F.date_add(F.lit(T.START).cast("date"), F.col("t")).cast("timestamp"))


# --- formulas ----------------------------------------------------------------------------------------------------------


def _design(df: DataFrame, text: str, train: DataFrame | None = None) -> DataFrame:
    """site, t and the design's columns under simple names c0, c1, .."""
    f = fm.parse(text)
    coding = fm.learn(f, df if train is None else train)
    cols, y = fm.design(f, df, coding)
    return df.select("site", "t", *[r6(c, f"c{k}") for k, (_, c) in enumerate(cols)], *([r6(y, "y")] if y is not None else []))


@query(f"WITH {T.PANEL_SQL}, m AS (SELECT avg(x1) AS a, stddev_pop(x1) AS s FROM panel) SELECT site, t, 1.0::DOUBLE AS c0, round((x1 - a) / s, 6) AS c1, round(CASE WHEN 1 + x2 > 0 THEN ln(1 + x2) END, 6) AS c2, round(obs, 6) AS y FROM panel, m")
def formula_log_standardize(spark: SparkSession, d: str) -> DataFrame:
    return _design(T.panel_events(spark, d), "obs ~ standardize(x1) + np.log(1 + x2)")


@query(f"WITH {T.PANEL_SQL} SELECT site, t, 1.0::DOUBLE AS c0, round(x1, 6) AS c1, round(x2, 6) AS c2, round(x1 * x2, 6) AS c3, round(x1 * x1 - 2 * x2, 6) AS c4 FROM panel")
def formula_interaction(spark: SparkSession, d: str) -> DataFrame:
    f = _design(T.panel_events(spark, d), "~ x1 * x2 + I(x1**2 - 2 * x2)")
    return f.select("site", "t", "c0", "c1", "c2", F.col("c4").alias("c3"), F.col("c3").alias("c4"))


@query(f"WITH {T.PANEL_SQL}, w AS (SELECT *, CASE WHEN t % 7 < 2 THEN 'a' WHEN t % 7 < 5 THEN 'b' ELSE 'c' END AS part FROM panel) SELECT site, t, 1.0::DOUBLE AS c0, CASE WHEN part = 'b' THEN 1.0 ELSE 0.0 END::DOUBLE AS c1, CASE WHEN part = 'c' THEN 1.0 ELSE 0.0 END::DOUBLE AS c2, round(x1, 6) AS c3 FROM w")
def formula_categorical(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("t") % 7
    return _design(T.panel_events(spark, d).withColumn("part", F.when(m < 2, "a").when(m < 5, "b").otherwise("c")), "~ part + x1")


@query(f"WITH {T.PANEL_SQL}, m AS (SELECT avg(x1) AS a, stddev_pop(x1) AS s FROM panel WHERE t < 20) SELECT site, t, 1.0::DOUBLE AS c0, round((x1 - a) / s, 6) AS c1 FROM panel, m WHERE t >= 20")
def predict_reuses_train_stats(spark: SparkSession, d: str) -> DataFrame:
    p = T.panel_events(spark, d)
    return _design(p.where("t >= 20"), "~ standardize(x1)", p.where("t < 20"))


@query(f"WITH {T.LINE_SQL} SELECT 0 AS var, site, strftime(month, '%Y-%m') AS month, round(y1, 6) AS obs, 0 AS off FROM line UNION ALL SELECT 1, site, strftime(month, '%Y-%m'), round(y2, 6), 2 FROM line")
def stack_two_responses(spark: SparkSession, d: str) -> DataFrame:
    p = T.panel_lineitem(spark, d)
    parts, offset = [], 0
    for i, text in enumerate(("y1 ~ y2", "y2 ~ 1")):
        f = fm.parse(text)
        cols, y = fm.design(f, p, fm.learn(f, p))
        parts.append(p.select(F.lit(i).alias("var"), "site", F.date_format("month", "yyyy-MM").alias("month"), r6(y, "obs"), F.lit(offset).alias("off")))
        offset += len(cols)
    return parts[0].unionByName(parts[1])


# --- regression and residuals -------------------------------------------------------------------------------------------

_OLS_SQL = f"WITH {T.PANEL_SQL}, o AS (SELECT regr_slope(obs, x1) AS b1, regr_intercept(obs, x1) AS b0 FROM panel), r AS (SELECT site, t, obs, x1, obs - b0 - b1 * x1 AS r FROM panel, o)"


@query(f"WITH {T.PANEL_SQL} SELECT round(regr_intercept(obs, x1), 6) AS b0, round(regr_slope(obs, x1), 6) AS b1, count(obs) AS n FROM panel")
def ols_pooled_b2(spark: SparkSession, d: str) -> DataFrame:
    p = T.panel_events(spark, d)
    return p.agg(r6(F.regr_intercept("obs", "x1"), "b0"), r6(F.regr_slope("obs", "x1"), "b1"), F.count("obs").alias("n"))


@query(f"WITH {T.PANEL_SQL}, s AS (SELECT site, avg(obs) AS y, avg(x1) AS x FROM panel GROUP BY site) SELECT round(regr_intercept(y, x), 6) AS b0, round(regr_slope(y, x), 6) AS b1, count(y) AS n FROM s")
def ols_site_means(spark: SparkSession, d: str) -> DataFrame:
    s = T.panel_events(spark, d).groupBy("site").agg(F.avg("obs").alias("y"), F.avg("x1").alias("x"))
    return s.agg(r6(F.regr_intercept("y", "x"), "b0"), r6(F.regr_slope("y", "x"), "b1"), F.count("y").alias("n"))


@query(f"WITH {T.PANEL_SQL}, v AS (SELECT site, t, obs, unnest([0, 1, 2]) AS i, unnest([1.0, x1, x2]) AS x FROM panel WHERE obs IS NOT NULL) SELECT a.i, b.i AS j, round(sum(a.x * b.x), 4) AS xx, CASE WHEN a.i = b.i THEN round(sum(a.x * a.obs), 4) END AS xy FROM v a JOIN v b ON a.site = b.site AND a.t = b.t AND a.i <= b.i GROUP BY 1, 2")
def ols_normal_equations(spark: SparkSession, d: str) -> DataFrame:
    p = T.panel_events(spark, d).withColumn("one", F.lit(1.0))
    return metrics.normal_equations(p, ["one", "x1", "x2"], "obs").select("i", "j", F.round("xx", 4).alias("xx"), F.round("xy", 4).alias("xy"))


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    p = T.panel_events(spark, d)
    o = p.agg(F.regr_intercept("obs", "x1").alias("b0"), F.regr_slope("obs", "x1").alias("b1"))
    p = p.crossJoin(F.broadcast(o))  # one row
    return p.select("site", "t", "obs", (F.col("b0") + F.col("b1") * F.col("x1")).alias("fit"), (F.col("obs") - F.col("b0") - F.col("b1") * F.col("x1")).alias("r"))


@query(_OLS_SQL + " SELECT site, t, count(r) AS n, round(avg(r * r), 6) AS mse, round(sqrt(avg(r * r)), 6) AS rmse FROM r GROUP BY GROUPING SETS ((), (site), (t))")
def residual_metrics_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return metrics.grouped_mse(_residuals(spark, d), "r").select("site", "t", "n", r6(F.col("mse"), "mse"), r6(F.col("rmse"), "rmse"))


_Z = special.z_quantile(0.975)


@query(_OLS_SQL + f", i AS (SELECT *, CASE WHEN obs IS NOT NULL THEN CASE WHEN abs(r) <= {_Z!r} * sqrt(0.01 + 0.25) THEN 1.0 ELSE 0.0 END END AS h FROM r) SELECT site, t, count(h) AS n, round(avg(h), 6)::DOUBLE AS coverage FROM i GROUP BY GROUPING SETS ((), (site), (t))")
def coverage_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    p = _residuals(spark, d).withColumn("v", F.lit(0.01))
    return metrics.coverage(p, "obs", "fit", "v", F.lit(0.25)).select("site", "t", "n", r6(F.col("coverage"), "coverage"))


@query(
    _OLS_SQL
    + """, m AS (SELECT count(r) AS n, avg(r) AS mu, sum(r * r) AS ss FROM r), c AS (SELECT avg((r - mu) ** 2) AS m2, avg((r - mu) ** 3) AS m3, avg((r - mu) ** 4) AS m4 FROM r, m),
l AS (SELECT r, lag(r) OVER (ORDER BY site, t) AS p FROM r WHERE r IS NOT NULL), w AS (SELECT sum((r - p) ** 2) AS dd FROM l),
k AS (SELECT n, m3 / m2 ** 1.5 AS s, m4 / (m2 * m2) - 3 AS e, dd / ss AS dw FROM m, c, w)
SELECT n, round(s, 5) AS skew, round(e, 5) AS kurt, round(n / 6.0 * (s * s + e * e / 4), 3) AS jarque_bera, round(exp(-n / 12.0 * (s * s + e * e / 4)), 6) AS jb_p, round(dw, 6) AS durbin_watson FROM k"""
)
def residual_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    g = metrics.diagnostics(_residuals(spark, d), "r")
    return g.select("n", F.round("skew", 5).alias("skew"), F.round("kurt", 5).alias("kurt"), F.round("jarque_bera", 3).alias("jarque_bera"), r6(F.col("jb_p"), "jb_p"), r6(F.col("durbin_watson"), "durbin_watson"))


@query(f"WITH {T.PANEL_SQL}, day AS (SELECT t, avg(obs) AS m FROM panel GROUP BY t), a AS (SELECT t, avg(m) OVER (ORDER BY t ROWS 4 PRECEDING) AS ma, row_number() OVER (ORDER BY t) AS n FROM day) SELECT t, round(ma, 6) AS ma FROM a WHERE n >= 5")
def moving_average_5(spark: SparkSession, d: str) -> DataFrame:
    day = T.panel_events(spark, d).groupBy("t").agg(F.avg("obs").alias("m"))
    return pn.moving_average(day, "t", "m", 5, "ma").select("t", r6(F.col("ma"), "ma"))


@query("SELECT l_suppkey AS site, month(l_shipdate) AS month, round(avg(l_discount), 6) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2")
def monthly_mean(spark: SparkSession, d: str) -> DataFrame:
    li = T.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("site"), F.month("l_shipdate").cast("long").alias("month")).agg(F.round(F.avg("l_discount"), 6).alias("m"), F.count("*").alias("n"))


@query("SELECT CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'Winter' WHEN month(l_shipdate) IN (3, 4, 5) THEN 'Spring' WHEN month(l_shipdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1")
def season_dummies(spark: SparkSession, d: str) -> DataFrame:
    li = T.table(spark, d, "lineitem")
    return li.groupBy(pn.season(F.col("l_shipdate")).alias("season")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query(f"WITH {T.PANEL_SQL}, s AS (SELECT site, max(px) AS px, avg(obs) AS m, count(obs) AS n FROM panel GROUP BY site) SELECT site, round(px, 6) AS px, round(m, 6) AS m, n FROM s")
def station_means(spark: SparkSession, d: str) -> DataFrame:
    return T.panel_events(spark, d).groupBy("site").agg(r6(F.max("px"), "px"), r6(F.avg("obs"), "m"), F.count("obs").alias("n"))


# --- variances and back-transformation ----------------------------------------------------------------------------------


@query(f"WITH {T.PANEL_SQL}, v AS (SELECT site, t, (t - 3) * CASE WHEN t < 3 THEN 1e-9 ELSE 0.5 END AS v FROM panel) SELECT site, t, round(CASE WHEN v >= -1e-8 THEN sqrt(greatest(v, 0.0)) END, 6) AS s FROM v")
def safe_sqrt(spark: SparkSession, d: str) -> DataFrame:
    v = (F.col("t") - 3) * F.when(F.col("t") < 3, 1e-9).otherwise(0.5)
    return T.panel_events(spark, d).select("site", "t", r6(std_of_variance(v), "s"))


@query(f"WITH {T.PANEL_SQL} SELECT site, t, round(exp(obs) * (1 + x1 / 20), 4) AS m, round(exp(2 * obs) * x1 / 10, 2) AS v FROM panel WHERE obs IS NOT NULL")
def delta_method_exp(spark: SparkSession, d: str) -> DataFrame:
    m, v = areal.delta_method("exp", F.col("obs"), F.col("x1") / 10)
    return T.panel_events(spark, d).where("obs is not null").select("site", "t", F.round(m, 4).alias("m"), F.round(v, 2).alias("v"))


@query(f"WITH {T.PANEL_SQL} SELECT site, t, round(obs * obs + x1 / 10, 6) AS m, round(4 * obs * obs * x1 / 10, 6) AS v FROM panel WHERE obs IS NOT NULL")
def delta_method_square(spark: SparkSession, d: str) -> DataFrame:
    m, v = areal.delta_method("square", F.col("obs"), F.col("x1") / 10)
    return T.panel_events(spark, d).where("obs is not null").select("site", "t", r6(m, "m"), r6(v, "v"))


# --- geometry ----------------------------------------------------------------------------------------------------------


def _hits_sql(boundary: bool) -> str:
    return " UNION ALL ".join(f"SELECT site, {k} AS poly_id, '{n}' AS name FROM sites WHERE {T.inside_sql(p, 'x', 'y', boundary)}" for k, (n, p) in enumerate(T.POLYGONS.items()))


_POLYS, _NAMES = list(T.POLYGONS.values()), list(T.POLYGONS)


@query(f"WITH {T.SITES_SQL} {_hits_sql(True)}")
def point_in_polygon_covers(spark: SparkSession, d: str) -> DataFrame:
    return areal.points_in_polygons(T.sites_events(spark, d), _POLYS, _NAMES).select("site", "poly_id", "name")


@query(f"WITH {T.SITES_SQL} {_hits_sql(False)}")
def point_in_polygon_strict(spark: SparkSession, d: str) -> DataFrame:
    return areal.points_in_polygons(T.sites_events(spark, d), _POLYS, _NAMES, boundary=False).select("site", "poly_id", "name")


@query(f"WITH {T.PANEL_SQL}, hit AS ({_hits_sql(True)}) SELECT poly_id, name, t, count(*) AS n_points, round(avg(obs), 6) AS m FROM hit JOIN panel USING (site) WHERE obs IS NOT NULL GROUP BY 1, 2, 3")
def areal_mean(spark: SparkSession, d: str) -> DataFrame:
    p = T.panel_events(spark, d).where("obs is not null").withColumnsRenamed({"px": "x", "py": "y"})
    return areal.areal_mean(p, _POLYS, _NAMES, ["t"], "obs").select("poly_id", "name", "t", "n_points", r6(F.col("obs"), "m"))


@query(f"WITH {T.SITES_SQL}, hit AS ({_hits_sql(True)}) SELECT poly_id, name, count(*) AS n, round(1.0 / count(*), 8)::DOUBLE AS weight FROM hit GROUP BY 1, 2")
def areal_counts(spark: SparkSession, d: str) -> DataFrame:
    h = areal.points_in_polygons(T.sites_events(spark, d), _POLYS, _NAMES)
    return h.groupBy("poly_id", "name").agg(F.count("*").alias("n"), F.round(1.0 / F.count("*"), 8).alias("weight"))


@query(f"WITH {T.SITES_SQL} SELECT site, round(2 * {geo.EARTH_KM} * asin(sqrt(least(1.0, pow(sin(radians(5.0 - y) / 2), 2) + cos(radians(y)) * cos(radians(5.0)) * pow(sin(radians(5.0 - x) / 2), 2)))), 5) AS km FROM sites")
def great_circle_distance(spark: SparkSession, d: str) -> DataFrame:
    return T.sites_events(spark, d).select("site", F.round(geo.great_circle(F.col("x"), F.col("y"), F.lit(5.0), F.lit(5.0)), 5).alias("km"))


@query(f"WITH {T.SITES_SQL} SELECT site, round(radians(x) * 6378137.0, 3) + 0.0 AS mx, round(6378137.0 * ln(tan(pi() / 4 + radians(y) / 2)), 3) + 0.0 AS my FROM sites")
def web_mercator(spark: SparkSession, d: str) -> DataFrame:
    mx, my = geo.web_mercator(F.col("x"), F.col("y"))
    return T.sites_events(spark, d).select("site", (F.round(mx, 3) + F.lit(0.0)).alias("mx"), (F.round(my, 3) + F.lit(0.0)).alias("my"))


# --- meshes and finite elements ------------------------------------------------------------------------------------------

_BOX, _NX, _NY = (-3.0, -3.0, 13.0, 13.0), 9, 9
_LATTICE_SQL = f"""v AS (SELECT CAST(i AS INT) AS v, -3.0 + (i % {_NX}) * 2.0 AS x, -3.0 + (i // {_NX}) * 2.0 AS y FROM generate_series(0, {_NX * _NY - 1}) AS g(i)),
cell AS (SELECT i, (i // {_NX - 1}) * {_NX} + i % {_NX - 1} AS a FROM generate_series(0, {(_NX - 1) * (_NY - 1) - 1}) AS g(i)),
tri AS (SELECT 2 * i AS e, a AS v1, a + 1 AS v2, a + {_NX} + 1 AS v3 FROM cell UNION ALL SELECT 2 * i + 1, a, a + {_NX} + 1, a + {_NX} FROM cell),
cn AS (SELECT e, v1, v2, v3, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2, r.x AS x3, r.y AS y3, 0.5 * ((q.x - p.x) * (r.y - p.y) - (r.x - p.x) * (q.y - p.y)) AS area FROM tri JOIN v p ON p.v = v1 JOIN v q ON q.v = v2 JOIN v r ON r.v = v3),
mass AS (SELECT v, sum(area / 3) AS c FROM (SELECT v1 AS v, area FROM cn UNION ALL SELECT v2, area FROM cn UNION ALL SELECT v3, area FROM cn) GROUP BY v),
part AS (SELECT e, v1 AS v, y2 - y3 AS b, x3 - x2 AS d, area FROM cn UNION ALL SELECT e, v2, y3 - y1, x1 - x3, area FROM cn UNION ALL SELECT e, v3, y1 - y2, x2 - x1, area FROM cn),
stiff AS (SELECT p.v AS i, q.v AS j, sum((p.b * q.b + p.d * q.d) / (4 * p.area)) AS g FROM part p JOIN part q ON p.e = q.e GROUP BY 1, 2)"""


def _lattice(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return mesh.lattice(spark, _BOX, _NX, _NY, T.SQUARE)


@query(f"WITH {_LATTICE_SQL} SELECT v, x::DOUBLE AS x, y::DOUBLE AS y, {T.inside_sql(T.SQUARE, 'x', 'y')} AS inner FROM v")
def mesh_lattice_vertices(spark: SparkSession, d: str) -> DataFrame:
    return _lattice(spark)[0]


@query(f"WITH {_LATTICE_SQL} SELECT e::INT AS e, v1::INT AS v1, v2::INT AS v2, v3::INT AS v3 FROM tri")
def mesh_lattice_triangles(spark: SparkSession, d: str) -> DataFrame:
    return _lattice(spark)[1]


@query(
    f"WITH {_LATTICE_SQL}, s AS (SELECT e, area, (x2-x3)**2 + (y2-y3)**2 AS s1, (x1-x3)**2 + (y1-y3)**2 AS s2, (x1-x2)**2 + (y1-y2)**2 AS s3 FROM cn) SELECT e::INT AS e, round(area, 6)::DOUBLE AS area, round(degrees(acos((s2 + s3 - s1) / (2 * sqrt(s2 * s3)))), 6) AS a1, round(degrees(acos((s1 + s3 - s2) / (2 * sqrt(s1 * s3)))), 6) AS a2, round(degrees(acos((s1 + s2 - s3) / (2 * sqrt(s1 * s2)))), 6) AS a3 FROM s"
)
def mesh_angles_areas(spark: SparkSession, d: str) -> DataFrame:
    return mesh.angles(*_lattice(spark)).select("e", *[r6(F.col(c), c) for c in ("area", "a1", "a2", "a3")])


@query(f"WITH {_LATTICE_SQL}, ed AS (SELECT least(a, b)::INT AS u, greatest(a, b)::INT AS w FROM (SELECT v1 AS a, v2 AS b FROM tri UNION ALL SELECT v2, v3 FROM tri UNION ALL SELECT v3, v1 FROM tri)) SELECT u, w, count(*) AS n, count(*) = 1 AS boundary FROM ed GROUP BY 1, 2")
def mesh_edges(spark: SparkSession, d: str) -> DataFrame:
    return mesh.edge_table(_lattice(spark)[1])


@query(
    f"WITH {_LATTICE_SQL}, s AS (SELECT e, area, (x2-x3)**2 + (y2-y3)**2 AS s1, (x1-x3)**2 + (y1-y3)**2 AS s2, (x1-x2)**2 + (y1-y2)**2 AS s3 FROM cn), a AS (SELECT least(degrees(acos((s2 + s3 - s1) / (2 * sqrt(s2 * s3)))), degrees(acos((s1 + s3 - s2) / (2 * sqrt(s1 * s3)))), degrees(acos((s1 + s2 - s3) / (2 * sqrt(s1 * s2))))) AS m FROM s), "
    "side AS (SELECT e, area, least(p, q) AS u, greatest(p, q) AS w FROM (SELECT e, area, v1 AS p, v2 AS q FROM cn UNION ALL SELECT e, area, v2, v3 FROM cn UNION ALL SELECT e, area, v3, v1 FROM cn)), ed AS (SELECT u, w, max(area) / min(area) AS ratio FROM side GROUP BY u, w), len AS (SELECT sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS d FROM ed JOIN v p ON p.v = u JOIN v q ON q.v = w) "
    f"SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM v WHERE {T.inside_sql(T.SQUARE, 'x', 'y')}) AS n_inner, (SELECT count(*) FROM tri) AS n_triangles, (SELECT round(min(m), 6) FROM a) AS min_angle, (SELECT round(quantile_cont(m, 0.05), 6) FROM a) AS angle_q05, (SELECT round(quantile_cont(m, 0.5), 6) FROM a) AS angle_q50, (SELECT count(*) FROM len) AS n_edges, (SELECT round(min(d), 6) FROM len) AS edge_min, (SELECT round(avg(d), 6) FROM len) AS edge_mean, (SELECT round(max(d), 6) FROM len) AS edge_max, (SELECT round(max(ratio), 6) FROM ed)::DOUBLE AS neighbour_ratio, (SELECT round(max(c) / min(c), 6) FROM mass)::DOUBLE AS mass_ratio"
)
def mesh_quality(spark: SparkSession, d: str) -> DataFrame:
    q = mesh.quality(*_lattice(spark))
    return q.select(*[r6(F.col(n), n) if t == "double" else F.col(n) for n, t in q.dtypes])


@query(f"WITH {T.SITES_SQL}, {_LATTICE_SQL} SELECT s.site AS a, v.v::INT AS b, round(sqrt((s.x - v.x) * (s.x - v.x) + (s.y - v.y) * (s.y - v.y)), 6) AS d FROM sites s CROSS JOIN v")
def site_node_distance(spark: SparkSession, d: str) -> DataFrame:
    """Every site to every vertex of the lattice, whose number is that of the mesh."""
    nodes = _lattice(spark)[0].withColumnRenamed("v", "id")
    return spde.distances(T.sites_events(spark, d).withColumnRenamed("site", "id"), nodes).select("a", "b", r6(F.col("d"), "d"))


@query(f"WITH {_LATTICE_SQL} SELECT v::INT AS v, round(c, 6)::DOUBLE AS c FROM mass")
def fem_mass(spark: SparkSession, d: str) -> DataFrame:
    return fem.mass(*_lattice(spark)).select("v", r6(F.col("c"), "c"))


@query(f"WITH {_LATTICE_SQL} SELECT i::INT AS i, j::INT AS j, (round(g, 6) + 0.0)::DOUBLE AS g FROM stiff")
def fem_stiffness(spark: SparkSession, d: str) -> DataFrame:
    return fem.stiffness(*_lattice(spark)).select("i", "j", r6(F.col("g"), "g"))


@query(f"WITH {_LATTICE_SQL}, u AS (SELECT v, 2 * x - 3 * y AS u FROM v) SELECT round(sum(a.u * g * b.u), 4)::DOUBLE AS energy FROM stiff JOIN u a ON a.v = i JOIN u b ON b.v = j")
def fem_energy(spark: SparkSession, d: str) -> DataFrame:
    v, t = _lattice(spark)
    return fem.energy(v.withColumn("u", 2 * F.col("x") - 3 * F.col("y")), t, "u").select(F.round("energy", 4).alias("energy"))


_BASIS_SQL = f"""{T.SITES_SQL}, {_LATTICE_SQL},
l AS (SELECT s.site, e, v1, v2, v3, ((x2 - s.x) * (y3 - s.y) - (x3 - s.x) * (y2 - s.y)) / (2 * area) AS l1, ((x3 - s.x) * (y1 - s.y) - (x1 - s.x) * (y3 - s.y)) / (2 * area) AS l2, ((x1 - s.x) * (y2 - s.y) - (x2 - s.x) * (y1 - s.y)) / (2 * area) AS l3 FROM sites s JOIN cn ON s.x BETWEEN least(x1, x2, x3) - 1e-9 AND greatest(x1, x2, x3) + 1e-9 AND s.y BETWEEN least(y1, y2, y3) - 1e-9 AND greatest(y1, y2, y3) + 1e-9),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY e) AS n FROM l WHERE l1 >= -1e-12 AND l2 >= -1e-12 AND l3 >= -1e-12) WHERE n = 1),
h AS (SELECT * FROM (SELECT site, v1 AS v, l1 AS h FROM one UNION ALL SELECT site, v2, l2 FROM one UNION ALL SELECT site, v3, l3 FROM one) WHERE h > 1e-8)"""


@query(f"WITH {_BASIS_SQL} SELECT site, v::INT AS v, round(h, 6)::DOUBLE AS h FROM h")
def fem_basis(spark: SparkSession, d: str) -> DataFrame:
    return fem.basis(T.sites_events(spark, d), *_lattice(spark), site="site").select("site", "v", r6(F.col("h"), "h"))


@query(f"WITH {_BASIS_SQL}, k AS (SELECT h.site, h.v, h.h FROM h JOIN v ON v.v = h.v WHERE {T.inside_sql(T.SQUARE, 'v.x', 'v.y')}) SELECT site, v::INT AS v, round(h / sum(h) OVER (PARTITION BY site), 6)::DOUBLE AS h FROM k")
def latent_basis_normalised(spark: SparkSession, d: str) -> DataFrame:
    v, t = _lattice(spark)
    return fem.latent_basis(fem.basis(T.sites_events(spark, d), v, t, "site"), v, "site").select("site", "v", r6(F.col("h"), "h"))


_KAPPA = 0.8


@query(
    f"WITH {_LATTICE_SQL}, q AS (SELECT v AS i, v AS j, {_KAPPA**4!r} * c AS q FROM mass UNION ALL SELECT i, j, {2 * _KAPPA**2!r} * g FROM stiff UNION ALL SELECT a.i, b.j, a.g * b.g / c FROM stiff a JOIN mass ON mass.v = a.j JOIN stiff b ON b.i = a.j) SELECT i::INT AS i, j::INT AS j, round({1 / (4 * math.pi * _KAPPA**2)!r} * sum(q), 6) + 0.0::DOUBLE AS q FROM q GROUP BY 1, 2"
)
def spde_precision(spark: SparkSession, d: str) -> DataFrame:
    v, t = _lattice(spark)
    return spde.precision(fem.mass(v, t), fem.stiffness(v, t), _KAPPA).select("i", "j", r6(F.col("q"), "q"))


def _cov(n: int = 8) -> spde.Spde:
    return spde.Spde.of(mesh.grid_mesh([T.SQUARE], 1.5, n, n))


@query()
def spde_marginal_precision(spark: SparkSession, d: str) -> DataFrame:
    low = _cov().marginal(_KAPPA)
    i, j = np.divmod(np.arange(low.size), len(low))
    return spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(i, j, low.ravel(), strict=True)], "i int, j int, q double")


def _poly_sql(c: tuple[float, ...], x: str) -> str:
    out = repr(c[-1])
    for a in reversed(c[:-1]):
        out = f"({out} * {x} + {a!r})"
    return out


_I1_SQL = f"u * {_poly_sql(special._I1, '(u / 3.75 * u / 3.75)')}"
_U_K1_SQL = f"CASE WHEN u = 0 THEN 1.0 WHEN u <= 2 THEN u * ln(u / 2) * {_I1_SQL} + {_poly_sql(special._K1_SMALL, '(u * u / 4)')} ELSE sqrt(u) * exp(-u) * {_poly_sql(special._K1_LARGE, '(2 / u)')} END"


@query(f"WITH {T.SITES_SQL}, d AS (SELECT site, sqrt((x - 5.0) * (x - 5.0) + (y - 5.0) * (y - 5.0)) AS d FROM sites), u AS (SELECT *, {_KAPPA} * d AS u FROM d), r AS (SELECT site, d, {_U_K1_SQL} AS rho FROM u) SELECT site, round(d, 6) AS d, round(rho, 6) + 0.0 AS rho, round(1 - rho, 6) + 0.0 AS gamma FROM r")
def matern_correlation(spark: SparkSession, d: str) -> DataFrame:
    s = T.sites_events(spark, d).withColumn("d", geo.euclid(F.col("x"), F.col("y"), F.lit(5.0), F.lit(5.0)))
    return s.select("site", r6(F.col("d"), "d"), r6(spde.correlation(F.col("d"), _KAPPA), "rho"), r6(spde.variogram(F.col("d"), _KAPPA), "gamma"))


# --- statistics, filters, fits -------------------------------------------------------------------------------------------


@query(
    f"WITH {_BASIS_SQL}, seen AS (SELECT user_id AS site, date_diff('day', DATE '{T.START}', CAST(ts AS DATE)) AS t, avg(value) AS m FROM events GROUP BY 1, 2), o AS (SELECT site, t, ln(m) AS obs FROM seen WHERE m > 0), p AS (SELECT a.site, a.v AS va, a.h AS ha, b.v AS vb, b.h AS hb FROM h a JOIN h b ON a.site = b.site AND a.v <= b.v) SELECT t::INT AS t, va::INT AS a, vb::INT AS b, round(sum(ha * hb), 5)::DOUBLE AS d, round(sum(CASE WHEN va = vb THEN ha * obs END), 5)::DOUBLE AS c FROM o JOIN p USING (site) GROUP BY t, va, vb"
)
def kalman_suffstats(spark: SparkSession, d: str) -> DataFrame:
    b = fem.basis(T.sites_events(spark, d), *_lattice(spark), site="site")
    hs = b.groupBy("site").agg(F.collect_list(F.struct(F.col("v").alias("node"), "h")).alias("hs"))
    p = T.panel_events(spark, d).where("obs is not null").select("site", "t", "obs")
    pairs = suffstat.pair_sums(p.join(hs, "site"), ["t"])
    c = p.join(b, "site").groupBy("t", F.col("v").alias("a")).agg(F.sum(F.col("h") * F.col("obs")).alias("c")).withColumn("b", F.col("a"))
    out = pairs.join(c, ["t", "a", "b"], "left")
    return out.select("t", "a", "b", F.round("d", 5).alias("d"), F.round("c", 5).alias("c"))


def _small() -> kalman.StateSpace:
    k = np.arange(18).reshape(6, 3)
    h = ((k * 7) % 5 + 1) / 5.0
    return kalman.StateSpace(h, 0.2 + np.arange(6) / 10, np.array([0.9, 0.5, -0.4]), np.array([[1.0, 0.2, 0.0], [0.2, 0.8, 0.1], [0.0, 0.1, 0.5]]))


def _small_y() -> np.ndarray:
    y = ((np.arange(60).reshape(6, 10) * 13) % 17) / 8.0 - 1
    y[2, :4], y[:, 8] = np.nan, np.nan
    return y


def _array_rows(spark: SparkSession, x: np.ndarray, p: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(t, i, float(x[t, i]), float(p[t, i, i])) for t in range(len(x)) for i in range(x.shape[1])], "t int, i int, x double, p double")


@query()
def kalman_q_dense(spark: SparkSession, d: str) -> DataFrame:
    f = _small().filter(_small_y())
    return _array_rows(spark, f.x, f.p)


@query()
def smoother_q_dense(spark: SparkSession, d: str) -> DataFrame:
    s = _small().smoother(_small_y())
    return _array_rows(spark, s.x, s.p)


@query()
def simulate_small(spark: SparkSession, d: str) -> DataFrame:
    y, _ = _small().simulate(20, seed=4)
    return spark.createDataFrame([(i, t, float(y[i, t])) for i in range(y.shape[0]) for t in range(y.shape[1])], "i int, t int, y double")


def _fit(spark: SparkSession, d: str, iters: int = 4):
    m = LowRankModel.of(_events_long(spark, d), "obs ~ x1", _SPEC).setup(_cov(7))
    return m.fit(options=em.FitOptions(max_iter=iters, tol_relat=0.0))


@query()
def em_fit_univariate(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d).trace(spark)


@query()
def em_fit_bivariate(spark: SparkSession, d: str) -> DataFrame:
    df = _events_long(spark, d)
    m = LowRankModel.of(df, ["obs ~ x1", "x1 ~ 1"], _SPEC).setup([_cov(6), _cov(5)])
    return m.fit(options=em.FitOptions(max_iter=3, tol_relat=0.0)).trace(spark)


@query()
def fitted_export(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, 2).export()


@query()
def prediction_export(spark: SparkSession, d: str) -> DataFrame:
    r = _fit(spark, d, 2)
    new = _events_long(spark, d).withColumns({"px": F.col("px") + 0.05, "py": F.col("py") + 0.05})
    return r.predict(new, _SPEC).back_transform("exp").export()


@query()
def prediction_to_poly(spark: SparkSession, d: str) -> DataFrame:
    r = _fit(spark, d, 2)
    return r.predict(_events_long(spark, d), _SPEC).to_poly(_POLYS, _NAMES)


@query()
def param_ci(spark: SparkSession, d: str) -> DataFrame:
    r = _fit(spark, d, 3)
    return r.with_errors(spark).estimates(spark)


@query()
def mesh_search(spark: SparkSession, d: str) -> DataFrame:
    pts = np.array([geo_place(k) for k in range(60)])
    grid = [{"n_inner": n, "eps": e} for n in (30, 60) for e in (0.3, 0.8)]
    return mesh.search(spark, pts, [T.SQUARE], grid)


def geo_place(k: int) -> tuple[float, float]:
    return T.place(k)
