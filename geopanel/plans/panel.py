"""From a long table (site, time, columns, coordinates) to a validated, balanced panel.

A panel stays long: one row per site and time step with site_id, t_idx, x, y, obs (the response) and cov (the covariates).
Site numbers follow first appearance in a given order; times are regular steps. All checks are aggregations.
"""

from __future__ import annotations

import datetime as dt
import warnings
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geopanel.functions import geo
from geopanel.functions.semantics import finite
from geopanel.operators.work import cut, written
from geopanel.plans import formula as fm
from geopanel.plans.ordering import numbered, with_previous


class PanelError(ValueError):
    """A table that is no panel; the message lists what is wrong."""


@dataclass(frozen=True)
class Regularity:
    regular: bool
    delta: float
    unit: str


def regular_steps(df: DataFrame, ts: str) -> DataFrame:
    """One row (regular, delta, unit) for a timestamp column.

    Unreadable or irregular times give regular = false. One step alone is (0, None); three or more are first tried as
    calendar steps of months or years (same day of month, or always the last day); else the constant difference is
    given in the largest of day, hour, minute, second, millisecond, microsecond that divides it.
    """
    t = F.col(ts)
    if dict(df.dtypes)[ts] == "string":
        t = F.try_to_timestamp(t)
    times = df.select(t.cast("timestamp").alias("t")).distinct()
    w = Window.orderBy("t")  # distinct times only: T rows whatever the number of sites; an unreadable one comes first
    d = times.select("t", F.unix_micros("t").alias("u"), F.lag(F.unix_micros("t")).over(w).alias("pu"), F.lag("t").over(w).alias("pt"))
    month = F.year("t") * 12 + F.month("t")
    before = F.year("pt") * 12 + F.month("pt")
    clock = F.col("u") - F.unix_micros(F.date_trunc("day", "t"))
    row = d.agg(
        F.count("t").alias("n"),
        F.count(F.when(F.col("t").isNull(), 1)).alias("bad"),
        F.min(F.col("u") - F.col("pu")).alias("lo"),
        F.max(F.col("u") - F.col("pu")).alias("hi"),
        F.min(month - before).alias("mlo"),
        F.max(month - before).alias("mhi"),
        (F.min(F.dayofmonth("t")) == F.max(F.dayofmonth("t"))).alias("same_day"),
        F.min(F.col("t").cast("date") == F.last_day("t")).alias("last_day"),
        (F.min(clock) == F.max(clock)).alias("same_clock"),
    )
    calendar = (F.col("n") >= 3) & (F.col("mlo") == F.col("mhi")) & (F.col("mlo") > 0) & (F.col("same_day") | F.col("last_day")) & F.col("same_clock")
    even = F.col("lo") == F.col("hi")
    us = F.col("lo")
    steps = [("day", 86_400_000_000), ("hour", 3_600_000_000), ("minute", 60_000_000), ("second", 1_000_000), ("millisecond", 1_000), ("microsecond", 1)]
    delta, unit = F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, size in reversed(steps):
        delta = F.when(us % size == 0, (us / size).cast("double")).otherwise(delta)
        unit = F.when(us % size == 0, F.lit(name)).otherwise(unit)
    ok = (F.col("bad") == 0) & (F.col("n") > 0) & ((F.col("n") == 1) | calendar | even)
    yearly = F.col("mlo") % 12 == 0
    return row.select(
        F.coalesce(ok, F.lit(False)).alias("regular"),
        F.when(~F.coalesce(ok, F.lit(False)), None).when(F.col("n") == 1, 0.0).when(calendar, F.when(yearly, F.col("mlo") / 12).otherwise(F.col("mlo")).cast("double")).otherwise(delta).alias("delta"),
        F.when(~F.coalesce(ok, F.lit(False)), None).when(F.col("n") == 1, F.lit("None")).when(calendar, F.when(yearly, F.lit("year")).otherwise(F.lit("month"))).otherwise(unit).alias("unit"),
    )


def check_regular(df: DataFrame, ts: str) -> Regularity:
    r = regular_steps(df, ts).first()
    return Regularity(bool(r.regular), r.delta or 0.0, r.unit or "None")


def time_column(df: DataFrame) -> str:
    """`Time` if there is one, else the first timestamp or date column."""
    if "Time" in df.columns:
        return "Time"
    for n, t in df.dtypes:
        if t in ("timestamp", "timestamp_ntz", "date"):
            return n
    raise PanelError("no time column")


def first_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in a given order; later ones go."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def duplicates(df: DataFrame, keys: list[str]) -> int:
    """Rows that repeat a key."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]


def naive_utc(ts: Column) -> Column:
    """A timestamp with time zone as the UTC clock time without one."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def time_window(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """Rows from start to end, both included; the filter reaches the scan."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    return df.where(F.col(ts) <= F.lit(end)) if end is not None else df


def domain_filter(df: DataFrame, domain, x: str = "x", y: str = "y") -> DataFrame:
    """Rows of sites inside a domain, its boundary included. The bounding box is a plain range filter, for the scan."""
    polys = geo.as_polygons(domain)
    if not polys:
        return df
    xs = [p[0] for q in polys for r in q for p in r]
    ys = [p[1] for q in polys for r in q for p in r]
    df = df.where(F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys)))
    return df.where(geo.covered(polys, F.col(x), F.col(y)))


def domain_flag(df: DataFrame, domain, x: str = "x", y: str = "y", out: str = "in_domain") -> DataFrame:
    return df.withColumn(out, geo.covered(domain, F.col(x), F.col(y)))


def observed_sites(df: DataFrame, site: str, value: str) -> DataFrame:
    """Rows of sites with at least one value."""
    seen = df.where(finite(F.col(value)).isNotNull()).select(site).distinct()
    return df.join(seen.hint("merge"), site, "left_semi")


def _site_counts(df: DataFrame, raw: str, order: str) -> DataFrame:
    """(__site, o, rows, steps, seen, infinite) of each site, by which a panel is checked without a pass for each check."""
    v = F.col(f"`{raw}`")
    infinite = F.abs(v) == float("inf") if dict(df.dtypes).get(raw) in ("double", "float") else F.lit(False)
    cell = df.groupBy("__site", "__ts").agg(F.min(order).alias("o"), F.count("*").alias("rows"), F.count(finite(v)).alias("seen"), F.count(F.when(infinite, 1)).alias("infinite"))
    return cut(cell.groupBy("__site").agg(F.min("o").alias("o"), F.count("*").alias("steps"), *[F.sum(c).alias(c) for c in ("rows", "seen", "infinite")]))


def balance(df: DataFrame, site: str, ts: str, value: str) -> DataFrame:
    """One row: n_sites, n_times, n_rows, n_observed, nan_ratio, incomplete (sites without exactly one row a step)."""
    per = df.groupBy(site).agg(F.count("*").alias("n"), F.count(finite(F.col(value))).alias("seen"))
    times = df.select(ts).distinct().agg(F.count("*").alias("n_times"))
    per = per.crossJoin(F.broadcast(times))
    return per.groupBy("n_times").agg(F.count("*").alias("n_sites"), F.sum("n").alias("n_rows"), F.sum("seen").alias("n_observed"), F.sum(F.when(F.col("n") != F.col("n_times"), 1).otherwise(0)).alias("incomplete")).select("n_sites", "n_times", "n_rows", "n_observed", (1 - F.col("n_observed") / F.col("n_rows")).alias("nan_ratio"), "incomplete")


def exact_quantiles(df: DataFrame, col: str, at: list[float], slack: float = 1e-3) -> list[float | None]:
    """Exact, interpolated quantiles of the non-null values. An approximate pass brackets each one; values outside its
    bracket are counted and only those inside, about 2 slack of all, are sorted, so that no task holds all values."""
    v = df.select(F.col(col).cast("double").alias("v")).where("v is not null")
    edges = [min(1.0, max(0.0, q + d)) for q in at for d in (-slack, slack)]
    got = v.agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*[F.lit(e) for e in edges]), 10_000).alias("e")).first()
    if not got.n:
        return [None] * len(at)
    cuts = [(got.e[2 * k], got.e[2 * k + 1]) for k in range(len(at))]
    # Ranks from 0; the ends of the range are taken as they are.
    cuts = [(None if edges[2 * k] == 0 else lo, None if edges[2 * k + 1] == 1 else hi) for k, (lo, hi) in enumerate(cuts)]
    below = v.agg(*[(F.count(F.when(F.col("v") < lo, 1)) if lo is not None else F.lit(0)).alias(f"b{k}") for k, (lo, _) in enumerate(cuts)]).first()
    out: list[float | None] = []
    for k, (q, (lo, hi)) in enumerate(zip(at, cuts, strict=True)):
        inside = v.where((F.lit(True) if lo is None else F.col("v") >= lo) & (F.lit(True) if hi is None else F.col("v") <= hi))
        m = inside.count()
        first, want = below[f"b{k}"], q * (got.n - 1)
        if not first <= want <= first + m - 1:  # the approximation was off: take a wider bracket
            return exact_quantiles(df, col, at, min(1.0, 10 * slack))
        share = (want - first) / (m - 1) if m > 1 else 0.0
        out.append(inside.agg(F.percentile("v", share)).first()[0])
    return out


def quantile_mask(df: DataFrame, cols: list[str], lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    """Values outside their exact lo and hi quantiles become NULL."""
    for c in cols:
        a, b = exact_quantiles(df, c, [lo, hi])
        df = df.withColumn(c, F.when(F.col(c).between(F.lit(a), F.lit(b)), F.col(c)))
    return df


def season(ts: Column) -> Column:
    """Meteorological season of the northern hemisphere."""
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring").when(m.isin(6, 7, 8), "Summer").otherwise("Autumn")


def moving_average(df: DataFrame, order: str, value: str, width: int, out: str, by: list[str] | None = None) -> DataFrame:
    """Averages over full windows of `width` rows that end at each row; the first width - 1 rows go."""
    base = Window.partitionBy(*(by or [])).orderBy(order)
    df = df.withColumn(out, F.avg(value).over(base.rowsBetween(1 - width, 0))).withColumn("__n", F.row_number().over(base))
    return df.where(F.col("__n") >= width).drop("__n")


def raster_axis(df: DataFrame, coord: str, out: str) -> DataFrame:
    """Integer cell of a coordinate on a raster: steps of the median spacing of its distinct values."""
    gap = with_previous(df.select(F.col(coord).alias("v")).distinct(), ["v"], "v", "before").select("v", (F.col("v") - F.col("before")).alias("g"))
    step = gap.agg(F.min("v").alias("__lo"), F.median("g").alias("__step"))
    return df.crossJoin(F.broadcast(step)).withColumn(out, F.round((F.col(coord) - F.col("__lo")) / F.col("__step")).cast("long")).drop("__lo", "__step")


@dataclass(frozen=True)
class Panel:
    """A design in long form: rows has site_id, site, t_idx, ts, x, y, obs, cov (array), in_domain."""

    rows: DataFrame
    names: list[str]
    formula: fm.Formula
    coding: fm.Coding
    n_sites: int
    n_times: int
    steps: Regularity
    box: tuple[float, float, float, float]
    span: tuple[dt.datetime, dt.datetime]
    crs: str | None

    def astype(self, kind: str) -> Panel:
        """The panel with response and covariates as float or double."""
        if kind not in ("float", "double"):
            raise PanelError("a panel is of float or double")
        return replace(self, rows=self.rows.withColumns({"obs": F.col("obs").cast(kind), "cov": F.col("cov").cast(f"array<{kind}>")}))

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.n_sites, len(self.names), self.n_times

    def summary(self) -> DataFrame:
        """One row: spread of the response, share observed, sizes, box, period and step."""
        s = self.rows.agg(F.min("obs").alias("y_min"), F.max("obs").alias("y_max"), F.avg("obs").alias("y_mean"), (100 * F.count("obs") / F.count("*")).alias("observed_pct"))
        lit = {"n_sites": self.n_sites, "n_covariates": len(self.names), "n_times": self.n_times, "delta": self.steps.delta, "unit": self.steps.unit, "crs": self.crs, "start": self.span[0], "end": self.span[1]}
        for k, v in zip(("x_min", "y_lo", "x_max", "y_hi"), self.box, strict=True):
            lit[k] = v
        return s.withColumn("missing_pct", 100 - F.col("observed_pct")).withColumns({k: F.lit(v) for k, v in lit.items()})


@dataclass(frozen=True)
class PanelSpec:
    """Column roles of a raw table. order says which row comes first (for duplicates and site numbers). ts None is found
    by time_column. polygon is a column of polygons (array<array<struct<x, y>>>) whose centroids are the sites' places,
    in place of x and y. With utc times are read as UTC clock times."""

    site: str = "site"
    ts: str | None = "ts"
    x: str = "x"
    y: str = "y"
    order: str | None = None
    crs: str | None = None
    polygon: str | None = None
    utc: bool = False


def _roles(df: DataFrame, spec: PanelSpec) -> tuple[DataFrame, PanelSpec]:
    """df and spec with the time column found and polygons replaced by their centroids."""
    if spec.ts is None:
        spec = replace(spec, ts=time_column(df))
    if spec.polygon:
        warnings.warn("sites that are polygons are placed at their planar centroids", stacklevel=3)
        x, y = geo.centroid(F.col(spec.polygon))
        df = df.withColumns({"__px": x, "__py": y})
        spec = replace(spec, x="__px", y="__py", polygon=None)
    return df, spec


def _prepare(df: DataFrame, spec: PanelSpec, what: list[str]) -> DataFrame:
    wrong = [f"no column {c!r}" for c in (spec.site, spec.ts, spec.x, spec.y) if c not in df.columns]
    if wrong:
        raise PanelError("; ".join(wrong))
    ts = F.col(spec.ts)
    kind = dict(df.dtypes)[spec.ts]
    ts = F.try_to_timestamp(ts) if kind == "string" else ts.cast("timestamp")
    ts = naive_utc(ts).cast("timestamp") if spec.utc else ts
    keep = [F.col(f"`{c}`") for c in dict.fromkeys(what) if c not in ("__site", "__ts", "__x", "__y", "__ord")]
    order = F.col(spec.order) if spec.order else F.lit(0)
    out = df.select(F.col(spec.site).alias("__site"), ts.alias("__ts"), F.col(spec.x).cast("double").alias("__x"), F.col(spec.y).cast("double").alias("__y"), order.alias("__ord"), *keep)
    out = written(out)  # all checks read it again, and the table may be a long query
    check = out.agg(
        F.count(F.when(F.col("__ts").isNull(), 1)).alias("bad_ts"),
        F.count(F.when(finite(F.col("__x")).isNull() | finite(F.col("__y")).isNull(), 1)).alias("bad_xy"),
        F.count(F.when(F.col("__site").isNull(), 1)).alias("bad_site"),
    ).first()
    wrong = [f"{n} rows with {w}" for n, w in ((check.bad_ts, "an unreadable time"), (check.bad_xy, "no finite coordinates"), (check.bad_site, "no site")) if n]
    if wrong:
        raise PanelError("; ".join(wrong))
    return out


def build(df: DataFrame, text: str, spec: PanelSpec | None = None, start=None, end=None, domain=None) -> Panel:
    """Validate a table and evaluate a formula on it: the training panel.

    Steps must be regular over all rows, before windows and domains apply. Duplicates of a (site, time) go, keeping the
    first in order; sites that are never observed go; every remaining site must have one row a step.
    """
    df, spec = _roles(df, spec or PanelSpec())
    f = fm.parse(text)
    if f.response is None:
        raise PanelError("a training formula has a response")
    fm.check_columns(f, df)
    rows = _prepare(df, spec, [*f.columns, *f.response_columns])
    steps = check_regular(rows, "__ts")
    if not steps.regular:
        raise PanelError("times are not regular steps")
    box = rows.agg(F.min("__x"), F.min("__y"), F.max("__x"), F.max("__y")).first()
    rows = domain_filter(time_window(rows, "__ts", start, end), domain, "__x", "__y")
    raw, order = f.response_columns[0], "__ord" if spec.order else "__site"
    sites = _site_counts(rows, raw, order)
    again = sites.agg(F.coalesce(F.sum(F.col("rows") - F.col("steps")), F.lit(0))).first()[0]
    if again:
        if not spec.order:
            raise PanelError(f"{again} rows repeat a site and time; spec.order has to say which one comes first")
        warnings.warn(f"{again} rows repeat a site and time; the first of each is kept", stacklevel=2)
        rows = first_rows(rows, ["__site", "__ts"], "__ord")
        sites = _site_counts(rows, raw, order)
    n = sites.agg(F.sum("infinite").alias("infinite"), F.count(F.when(F.col("seen") == 0, 1)).alias("unseen")).first()
    if n.infinite:
        warnings.warn(f"{n.infinite} infinite responses count as missing", stacklevel=2)
    if n.unseen:
        sites = sites.where("seen > 0")
        rows = rows.join(sites.select("__site").hint("merge"), "__site", "left_semi")
    times = cut(rows.select("__ts").distinct())
    ends = times.agg(F.count("*").alias("n"), F.min("__ts"), F.max("__ts")).first()
    if not ends.n:
        raise PanelError("no rows are left after the time window, the domain and the observed-site filter")
    b = sites.agg(F.count("*").alias("n_sites"), F.sum("rows").alias("n_rows"), F.count(F.when(F.col("rows") != ends.n, 1)).alias("incomplete")).first()
    if b.n_rows != b.n_sites * ends.n:
        raise PanelError(f"unbalanced panel: {b.n_sites} sites x {ends.n} steps need {b.n_sites * ends.n} rows, there are {b.n_rows}; {b.incomplete} sites are incomplete")
    coding = fm.learn(f, rows)
    named, y = fm.design(f, rows, coding)
    sites = numbered(sites.select("o", "__site"), ["o", "__site"], "site_id").select("__site", "site_id")
    times = times.select("__ts", (F.row_number().over(Window.orderBy("__ts")) - 1).alias("t_idx"))
    out = rows.join(sites.hint("merge"), "__site").join(F.broadcast(times), "__ts")
    out = out.select("site_id", F.col("__site").alias("site"), "t_idx", F.col("__ts").alias("ts"), F.col("__x").alias("x"), F.col("__y").alias("y"), y.alias("obs"), (F.array(*[c for _, c in named]) if named else F.array().cast("array<double>")).alias("cov"))
    return Panel(written(out), [n for n, _ in named], f, coding, b.n_sites, ends.n, steps, tuple(round(v, 3) for v in box), tuple(ends[1:]), spec.crs)


def build_predict(train: Panel, df: DataFrame, spec: PanelSpec | None = None, domain=None, include_response: bool = False) -> Panel:
    """The same design at new sites, with the training statistics and levels. Coordinates of another system are
    reprojected and times clipped to the training period, both with a warning; the times left must be training times at
    its step; sites outside the domain are flagged, not dropped."""
    df, spec = _roles(df, spec or PanelSpec())
    f = train.formula
    fm.check_columns(f, df, response=include_response)
    if spec.crs and train.crs and spec.crs != train.crs:
        warnings.warn(f"coordinates are reprojected from {spec.crs} to {train.crs}, that of the training panel", stacklevel=2)
        x, y = geo.reproject(F.col(spec.x).cast("double"), F.col(spec.y).cast("double"), spec.crs, train.crs)
        df = df.withColumns({"__rx": x, "__ry": y})
        spec = replace(spec, x="__rx", y="__ry", crs=train.crs)
    rows = _prepare(df, spec, [*f.columns, *(f.response_columns if include_response else [])])
    steps = check_regular(rows, "__ts")
    if (steps.delta, steps.unit) != (train.steps.delta, train.steps.unit):
        raise PanelError(f"steps of {steps.delta:g} {steps.unit} do not match the training steps of {train.steps.delta:g} {train.steps.unit}")
    outside = rows.where((F.col("__ts") < F.lit(train.span[0])) | (F.col("__ts") > F.lit(train.span[1]))).count()
    if outside:
        warnings.warn(f"{outside} rows outside the training period {train.span[0]} to {train.span[1]} are left out", stacklevel=2)
        rows = time_window(rows, "__ts", *train.span)
    known = train.rows.select(F.col("ts").alias("__ts")).distinct()
    strange = rows.select("__ts").distinct().join(F.broadcast(known), "__ts", "left_anti").count()  # a row a step
    if strange:
        raise PanelError(f"{strange} times are no training times")
    named, y = fm.design(replace(f, response=f.response if include_response else None), rows, train.coding)
    times = train.rows.select("ts", "t_idx").distinct()
    out = rows.join(F.broadcast(times), F.col("__ts") == F.col("ts"))
    out = domain_flag(out, domain, "__x", "__y")
    sites = numbered(out.select("__site").distinct(), ["__site"], "site_id")
    out = out.join(sites.hint("merge"), "__site").select("site_id", F.col("__site").alias("site"), "t_idx", "ts", F.col("__x").alias("x"), F.col("__y").alias("y"), (y if y is not None else F.lit(None).cast("double")).alias("obs"), (F.array(*[c for _, c in named]) if named else F.array().cast("array<double>")).alias("cov"), "in_domain")
    out = written(out)
    n = out.agg(F.countDistinct("site_id"), F.countDistinct("t_idx")).first()
    return replace(train, rows=out, n_sites=n[0], n_times=n[1])


def stack(panels: list[Panel]) -> DataFrame:
    """Responses one below the other: var is the response's number; covariate positions continue across responses."""
    out, offset = None, 0
    for i, p in enumerate(panels):
        part = p.rows.withColumn("var", F.lit(i)).withColumn("offset", F.lit(offset))
        offset += len(p.names)
        out = part if out is None else out.unionByName(part)
    return out
