"""Results of a fit as a versioned folder of parquet tables, from which prediction runs without the training table.

Below the folder, each partitioned by version: manifest (one JSON text), state (a row a step: x, p, lag), array (named
parameters and statistics in pieces), vertex and triangle (a mesh a factor), step (the training times of each response) and
span (its period). The manifest is written last: a version without one was not finished and is written over.
"""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.operators import em, suffstat
from geopanel.operators.kalman import Smoothed
from geopanel.operators.mesh import Mesh
from geopanel.operators.spde import Spde
from geopanel.plans import formula as fm
from geopanel.plans.panel import Panel, Regularity

#: Layout of the tables; folders of another layout are refused.
FORMAT = 1
#: Numbers in a row of the array table, and in the rows of states that are sent to Spark together.
PIECE, TOGETHER = 1 << 18, 1 << 23
_STATISTICS = ("c", "m", "yy", "y1")
_LISTS = ("full", "e", "xy", "xx")


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([r.size for r in rows])]).astype(np.int64)
    flat = np.concatenate([np.ravel(r) for r in rows]) if rows else np.zeros(0)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(float))).cast(pa.list_(pa.float64()))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions in a folder, oldest first; none where there is no folder."""
    try:
        found = spark.read.parquet(f"{path}/manifest").select("version").distinct().collect()  # a row a version
    except AnalysisException:
        return []
    return sorted(int(r["version"]) for r in found)


def _arrays(results) -> dict[str, np.ndarray]:
    s, sm = results.stats, results.fit.smoothed
    out = results.params.as_dict() | {k: getattr(s, k) for k in _STATISTICS} | {"factor": s.factor, "s11": sm.s11, "s10": sm.s10, "s00": sm.s00}
    out |= {f"{k}.{i}": v for k in _LISTS for i, v in enumerate(getattr(s, k))}
    for i, steps in enumerate(s.gone):
        rows = [np.column_stack([np.full(len(v), t), a, b, v]) for t, (a, b, v) in sorted(steps.items())]
        out[f"gone.{i}"] = np.concatenate(rows) if rows else np.zeros((0, 4))
    if results.cov_params is not None:
        out["cov_params"] = results.cov_params
    return {k: np.asarray(v, float) for k, v in out.items()}


def save(results, path: str, spark: SparkSession) -> int:
    """Write results as the next version of a folder that driver and executors share, and return its number.

    Nothing of the training table is kept but its times. Functions of formulas added by formula.register are kept by name.
    """
    n = max(versions(spark, path), default=0) + 1

    def write(df: DataFrame, table: str, *by: str) -> None:
        w = df.withColumn("version", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        w.partitionBy("version", *by).parquet(f"{path}/{table}")

    sm, q = results.fit.smoothed, results.fit.smoothed.x.shape[1]
    size = max(1, TOGETHER // (1 + 2 * q * q))
    starts = range(0, len(sm.x), size)
    lag = np.concatenate([np.zeros((1, q, q)), sm.lag])  # the initial state has no step before it
    for k, at in enumerate(starts):
        to = min(at + size, len(sm.x))
        t = pa.array(np.arange(at, to) - 1, pa.int32())
        rows = pa.table({"t_idx": t, "x": _lists(list(sm.x[at:to])), "p": _lists(list(sm.p[at:to])), "lag": _lists(list(lag[at:to]))})
        write(spark.createDataFrame(rows).withColumn("chunk", F.lit(k)), "state", "chunk")

    names, shapes, parts, values = [], [], [], []
    for name, v in _arrays(results).items():
        flat = v.ravel()
        for k, at in enumerate(range(0, max(1, flat.size), PIECE)):
            names.append(name), shapes.append(list(v.shape)), parts.append(k), values.append(flat[at : at + PIECE])
    write(spark.createDataFrame(pa.table({"name": names, "shape": pa.array(shapes, pa.list_(pa.int64())), "part": parts, "value": _lists(values)})), "array")

    model = results.model
    for table, cut in (("vertex", lambda m: {"v": np.arange(len(m.xy)), "x": m.xy[:, 0], "y": m.xy[:, 1], "is_inner": m.inner}), ("triangle", lambda m: {"e": np.arange(len(m.tri)), **{f"v{k + 1}": m.tri[:, k] for k in range(3)}})):
        each = [pa.table({"factor": np.full(len(c.mesh.xy if table == "vertex" else c.mesh.tri), j), **cut(c.mesh)}) for j, c in enumerate(model.covs)]
        write(spark.createDataFrame(pa.concat_tables(each)), table)

    times = None
    for i, p in enumerate(model.panels):
        one = p.rows.select(F.lit(i).alias("var"), "t_idx", "ts").distinct()
        times = one if times is None else times.unionByName(one)
    write(times.coalesce(1), "step")  # a row a response and step
    write(spark.createDataFrame([(i, *p.span) for i, p in enumerate(model.panels)], "var int, first timestamp, last timestamp"), "span")

    panels = [{"formula": p.formula.text, "names": p.names, "stats": p.coding.stats, "levels": p.coding.levels, "n_sites": p.n_sites, "n_times": p.n_times, "steps": asdict(p.steps), "box": p.box, "crs": p.crs} for p in model.panels]
    fields = [{"domain": c.mesh.domain, "latlon": c.latlon} for c in model.covs]
    keep = {"format": FORMAT, "chunks": len(starts), "panels": panels, "fields": fields, "domains": model.domains, "options": asdict(results.options), "fixed": sorted(results.params.fixed), "slices": [[k.start, k.stop] for k in results.stats.covs]}
    keep |= {"loglik": results.loglik, "loglik_smoothed": sm.loglik, "converged": bool(results.fit.converged), "termination": results.fit.termination, "trace": results.fit.trace}
    write(spark.createDataFrame([(json.dumps(keep, default=lambda v: v.item() if isinstance(v, np.generic) else list(v)),)], "text string"), "manifest")
    return n


def _points(v):
    """Polygons as read from JSON, with places as pairs."""
    if v is None or not isinstance(v, list):
        return v
    return tuple(v) if v and isinstance(v[0], (int, float)) else [_points(w) for w in v]


def load(path: str, spark: SparkSession, version: int | None = None) -> dict:
    """The parts of a saved version, the last one if none is named: model's panels, fields and domains, and the results."""
    have = versions(spark, path)
    if not have or version is not None and version not in have:
        raise ValueError(f"{path} has no finished version{'' if version is None else f' {version}'}")
    n = have[-1] if version is None else version

    def read(table: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{table}").where(F.col("version") == n).drop("version")

    kept = json.loads(read("manifest").first()["text"])
    if kept["format"] != FORMAT:
        raise ValueError(f"{path} has layout {kept['format']}, not {FORMAT}")
    pieces: dict[str, list] = {}
    for r in sorted(read("array").toArrow().to_pylist(), key=lambda r: (r["name"], r["part"])):
        pieces.setdefault(r["name"], [r["shape"]]).append(np.array(r["value"], float))
    arrays = {k: np.concatenate(v[1:]).reshape(v[0]) for k, v in pieces.items()}

    xs, ps, lags = [], [], []
    for k in range(kept["chunks"]):
        t = read("state").where(F.col("chunk") == k).orderBy("t_idx").select("x", "p", "lag").toArrow().combine_chunks()
        for out, name in ((xs, "x"), (ps, "p"), (lags, "lag")):
            out.append(t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1))
    x = np.concatenate(xs)
    q = x.shape[1]
    p, lag = (np.concatenate(v).reshape(len(x), q, q) for v in (ps, lags))

    vertex, triangle = (read(t).toArrow().to_pandas() for t in ("vertex", "triangle"))
    covs = []
    for j, f in enumerate(kept["fields"]):
        v, e = vertex[vertex["factor"] == j].sort_values("v"), triangle[triangle["factor"] == j].sort_values("e")
        mesh = Mesh(v[["x", "y"]].to_numpy(), e[["v1", "v2", "v3"]].to_numpy(), v["is_inner"].to_numpy(bool), tuple(_points(f["domain"])))
        covs.append(Spde.of(mesh, latlon=f["latlon"]))

    spans = {r["var"]: (r["first"], r["last"]) for r in read("span").collect()}
    panels = []
    for i, k in enumerate(kept["panels"]):
        coding = fm.Coding({a: tuple(b) for a, b in k["stats"].items()}, k["levels"])
        rows = read("step").where(F.col("var") == i).select("t_idx", "ts")
        panels.append(Panel(rows, k["names"], fm.parse(k["formula"]), coding, k["n_sites"], k["n_times"], Regularity(**k["steps"]), tuple(k["box"]), spans[i], k["crs"]))

    n_vars = len(kept["slices"])
    gone = []
    for i in range(n_vars):
        g = arrays.get(f"gone.{i}")
        if g is not None:
            gone.append({int(t): (h[:, 1].astype(int), h[:, 2].astype(int), h[:, 3]) for t in np.unique(g[:, 0]) for h in [g[g[:, 0] == t]]})
    lists = {k: [arrays[f"{k}.{i}"] for i in range(n_vars) if f"{k}.{i}" in arrays] for k in _LISTS}
    stats = suffstat.Stats(gone=gone, covs=[slice(a, b) for a, b in kept["slices"]], factor=arrays["factor"].astype(int), **lists, **{k: arrays[k] for k in _STATISTICS})
    params = em.Params(**{k: arrays[k] for k in em.Params.NAMES}, fixed=frozenset(kept["fixed"]))
    smoothed = Smoothed(x, p, lag[1:], arrays["s11"], arrays["s10"], arrays["s00"], kept["loglik_smoothed"])
    fit = em.Fit(params, smoothed, kept["loglik"], kept["converged"], kept["termination"], kept["trace"])
    domains = tuple(_points(d) for d in kept["domains"])
    return {"panels": tuple(panels), "covs": tuple(covs), "domains": domains, "stats": stats, "fit": fit, "options": em.FitOptions(**kept["options"]), "cov_params": arrays.get("cov_params")}
