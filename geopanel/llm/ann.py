"""Nearest neighbours through balanced posting lists.

Centroids come from halving a bounded sample of the vectors along two-means directions at the median, so that lists are
balanced. They are searched by a neighbour graph in memory. Every vector is posted to the list of its nearest centroid,
and boundary vectors also to those hardly farther away; a query visits the lists whose centroid is within a ratio of the
nearest one. Lists are dealt to blocks of bounded size and a block compares its queries with its vectors exactly.

Both ratios are measured on the table at hand: PROBES of its queries are held against all vectors, and the pair of ratios
that gives RECALL of their true neighbours at the least number of comparisons is taken.

Equal vectors are one entry of the index that keeps the least k + 1 of their ids: a result has k rows at most and ties go
to smaller ids, so the others can never be in it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geopanel.llm.common import cut

#: Vectors that centroids are fitted on, at most: those with the least hashes.
SAMPLE = 65_536
#: Vectors a list is to have while that gives at most MAX_LISTS lists, an eighth of the sample. Lists of larger tables are
#: longer; they are dealt to blocks, and nothing in them is left out.
LIST = 300
MAX_LISTS = SAMPLE // 8
#: A vector is also posted to centroids within a ratio of its nearest distance: one of these.
REPLICATES = (1.0, 1.01, 1.03, 1.06)
#: Share of the true neighbours that the ratio of the queries' lists is to find, and the queries it is measured on.
RECALL, PROBES = 0.99, 256
DEGREE = 24
#: Centroids that a search in the graph keeps. Where the ratio may admit more, all centroids are compared.
POST_BEAM, QUERY_BEAM = 16, 256
BLOCK = 8192
SALT = 256


def balanced_centroids(x: np.ndarray, depth: int) -> np.ndarray:
    """Means of 2^depth parts: each part is halved at the median along the line between its two means."""
    parts = [np.arange(len(x))]
    for _ in range(depth):
        nxt = []
        for p in parts:
            if len(p) < 4:
                nxt.append(p)
                continue
            v = x[p]
            a, b = v[0], v[np.argmax(((v - v[0]) ** 2).sum(1))]
            for _ in range(8):
                near = ((v - a) ** 2).sum(1) <= ((v - b) ** 2).sum(1)
                if near.all() or not near.any():
                    break
                a, b = v[near].mean(0), v[~near].mean(0)
            order = np.argsort(v @ (b - a), kind="stable")
            nxt += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
        parts = nxt
    c = np.stack([x[p].mean(0) for p in parts if len(p)])
    return np.unique(c, axis=0)


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


class Graph:
    """Centroids with links to their nearest ones and to a few random others, searched by best-first beam search."""

    def __init__(self, c: np.ndarray, degree: int = DEGREE):
        self.c = c
        n = len(c)
        near = min(degree, n - 1)
        rng = np.random.default_rng(1)
        links = []
        for i in range(0, n, 512):
            d = _square(c[i : i + 512], c)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            links.append(np.argsort(d, axis=1, kind="stable")[:, :near])
        far = rng.integers(0, n, (n, 4))
        self.links = np.concatenate([np.concatenate(links), far], 1) if near else far
        self.entry = np.unique(np.concatenate([rng.integers(0, n, 8), [int(np.argmin(((c - c.mean(0)) ** 2).sum(1)))]]))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each vector (nodes, distances) of the beam nearest centroids found, nearest first; -1 and inf pad."""
        n, k, width = len(x), len(self.c), min(beam, len(self.c))
        rows = np.arange(n)
        seen = np.zeros((n, k), bool)
        seen[:, self.entry] = True
        d = np.full((n, width + self.links.shape[1] + len(self.entry)), np.inf)
        node = np.full(d.shape, -1)
        done = np.ones(d.shape, bool)
        m = len(self.entry)
        d[:, :m], node[:, :m], done[:, :m] = np.sqrt(_square(x, self.c[self.entry])), self.entry, False
        while True:
            order = np.argsort(d, axis=1, kind="stable")
            d, node, done = (np.take_along_axis(v, order, 1) for v in (d, node, done))
            d[:, width:], node[:, width:], done[:, width:] = np.inf, -1, True
            todo = ~done[:, :width]
            live = np.flatnonzero(todo.any(1))
            if not len(live):
                return node[:, :width], d[:, :width]
            at = todo[live].argmax(1)
            done[live, at] = True
            nxt = self.links[node[live, at]]
            fresh = ~seen[live[:, None], nxt]
            seen[live[:, None], nxt] = True
            diff = x[live][:, None, :] - self.c[nxt]
            dist = np.where(fresh, np.sqrt((diff * diff).sum(2)), np.inf)
            # A node linked twice by the same neighbour would be entered twice: keep its first place.
            s = np.argsort(nxt, axis=1, kind="stable")
            same = np.zeros(nxt.shape, bool)
            srt = np.take_along_axis(nxt, s, 1)
            np.put_along_axis(same, s[:, 1:], srt[:, 1:] == srt[:, :-1], 1)
            dist[same] = np.inf
            w = nxt.shape[1]
            d[live, width : width + w] = dist
            node[live, width : width + w] = np.where(np.isinf(dist), -1, nxt)
            done[live, width : width + w] = np.isinf(dist)


def ranked(graph: Graph, x: np.ndarray, ratio: float, beam: int, sizes: np.ndarray | None = None, least: int = 0):
    """Yields (row, node, distance) of the centroids within the ratio of each vector's nearest one, nearest first, and of
    further ones until the lists so far, of the given sizes, hold `least` vectors.

    The graph finds them as long as its beam reaches beyond the ratio; all centroids are compared for the other vectors.
    """
    for i in range(0, len(x), 512):
        part = x[i : i + 512]
        node, d = graph.search(part, beam)
        full = np.arange(len(part)) if beam >= len(graph.c) else np.flatnonzero(d[:, -1] <= ratio * d[:, 0] + 1e-12)
        if sizes is not None:
            held = np.where(node >= 0, sizes[node], 0).sum(1)
            full = np.union1d(full, np.flatnonzero(held < least))
        close = np.setdiff1d(np.arange(len(part)), full)
        for rows, n, e in ((close, node[close], d[close]), (full, None, None)):
            if not len(rows):
                continue
            if n is None:
                e = np.sqrt(_square(part[rows], graph.c))
                n = np.argsort(e, axis=1, kind="stable")
                e = np.take_along_axis(e, n, 1)
            ok = (n >= 0) & (e <= ratio * e[:, :1] + 1e-12)
            if sizes is not None:
                w = np.where(n >= 0, sizes[n], 0)
                ok |= (n >= 0) & (np.cumsum(w, axis=1) - w < least)
            row, col = np.nonzero(ok)
            yield i + rows[row], n[row, col], e[row, col]


def _lists(graph: Graph, ratio: float, beam: int, id_cols: list[str], sizes: np.ndarray | None = None, least: int = 0):
    """mapInPandas function: (id columns, v, list, first) for every list of a vector; first marks its nearest list."""

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f["v"].to_numpy()).astype(np.float64)
            for row, node, _ in ranked(graph, x, ratio, beam, sizes, least):
                out = f[id_cols].iloc[row].reset_index(drop=True)
                out["v"] = [f["v"].iloc[r] for r in row]
                out["list"] = node.astype(np.int32)
                out["first"] = np.diff(row, prepend=-1) != 0
                yield out

    return run


def _least(x: np.ndarray, y: np.ndarray, k: int):
    """(positions in y, distances) of all y that can be among the k nearest of each x, ties with the last included."""
    for i in range(0, len(x), 256):
        rough = _square(x[i : i + 256], y)
        scale = 1e-9 * (1 + (x[i : i + 256] ** 2).sum(1) + (y * y).sum(1).max())
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1] + scale if len(y) > k else np.full(len(rough), np.inf)
        for r in range(len(rough)):
            at = np.flatnonzero(rough[r] <= edge[r])
            diff = y[at] - x[i + r]
            yield at, np.sqrt((diff * diff).sum(1))


def _truth(probes: np.ndarray, keys: np.ndarray, k: int):
    """mapInPandas function: (q, c, v, d) of the k nearest vectors of each probe in a partition, its own one aside."""

    def run(frames):
        best = [pd.DataFrame({"c": [], "d": [], "v": []})] * len(probes)
        for f in frames:
            if not len(f):
                continue
            c = f["c"].to_numpy()
            for q, (at, d) in enumerate(_least(probes, np.stack(f["v"].to_numpy()).astype(np.float64), k + 1)):
                at, d = at[c[at] != keys[q]], d[c[at] != keys[q]]
                new = pd.DataFrame({"c": c[at], "d": d, "v": f["v"].iloc[at].to_numpy()})
                best[q] = (pd.concat([best[q], new]) if len(best[q]) else new).nsmallest(k, "d")
        for q, b in enumerate(best):
            if len(b):
                yield pd.DataFrame({"q": np.int32(q), "c": b["c"].astype(np.int64), "v": b["v"], "d": b["d"]})

    return run


def calibrate(entries: DataFrame, asks: DataFrame, graph: Graph, sample: np.ndarray, k: int) -> tuple[float, float, float]:
    """(replication ratio, pruning ratio, recall): the ratios of least work whose lists hold RECALL of the true k nearest
    of PROBES queries, found by comparing those with all entries. Of bounded size on the driver."""
    got = asks.select("q", "v").orderBy(F.xxhash64(F.lit(5), "q"), "q").limit(PROBES).toPandas()
    probes, keys = np.stack(got["v"].to_numpy()).astype(np.float64), got["q"].to_numpy()
    near = entries.select("c", "v").mapInPandas(_truth(probes, keys, k), "q int, c long, v array<double>, d double")
    w = Window.partitionBy("q").orderBy("d", "c")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "v").toPandas()
    if not len(near):
        return 1.0, 1.0, 1.0
    q, x = near["q"].to_numpy(), np.stack(near["v"].to_numpy()).astype(np.float64)
    away = np.sqrt(_square(probes, graph.c))
    away /= np.maximum(away.min(1, keepdims=True), 1e-12)
    some = sample[:: max(1, len(sample) // 2000)]
    best = None
    for rep in REPLICATES:
        need = np.full(len(x), np.inf)
        for row, node, _ in ranked(graph, x, rep, POST_BEAM):
            np.minimum.at(need, row, away[q[row], node])
        prune = float(np.sort(need)[min(len(need), int(np.ceil(RECALL * len(need)))) - 1])
        posts = np.zeros(len(graph.c))
        for _, node, _ in ranked(graph, some, rep, POST_BEAM):
            posts += np.bincount(node, minlength=len(posts))
        work = float(((away <= prune + 1e-9) * posts).sum())
        if best is None or work < best[0]:
            best = work, rep, prune + 1e-9, float((need <= prune + 1e-9).mean())
    return best[1:]


def _compare(k: int):
    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        cols = {"q": [], "c": [], "score": [], "ids": []}
        if len(q) and len(p):
            a, b = np.stack(q["v"].to_numpy()).astype(np.float64), np.stack(p["v"].to_numpy()).astype(np.float64)
            key, least, ids = p["c"].to_numpy(), np.array([v[0] for v in p["ids"]]), p["ids"].to_numpy()
            for i, (at, d) in enumerate(_least(a, b, k + 1)):
                best = np.lexsort((least[at], d))[: k + 1]
                cols["q"] += [q["q"].iloc[i]] * len(best)
                cols["c"] += key[at[best]].tolist()
                cols["score"] += d[best].tolist()
                cols["ids"] += [ids[j] for j in at[best]]
        return pd.DataFrame(cols | {"ids": pd.Series(cols["ids"], dtype=object)})

    return run


def nearest(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", query: str = "pmod({id}, 100) = 0") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k nearest other rows found by Euclidean distance in double
    precision, ties to the smaller id.

    query is a condition on {id}. Rows without an id, and vectors that are null, empty, zero, hold null or non-finite
    components, or are not of the commonest length (the shorter on a tie) take no part. Rows that repeat an id with the
    same vector are one row. Fewer candidates than k give fewer rows; an empty table an empty result; further columns
    are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    ok = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double") + 0.0).alias("v"), ok.alias("ok")).where(F.coalesce("ok", F.lit(False))).drop("ok")
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if width is None:
        return empty
    rows = rows.where(F.size("v") == width.n).withColumn("c", F.xxhash64("v"))
    few = rows.groupBy("c", F.pmod(F.xxhash64("id"), F.lit(SALT)).alias("salt")).agg(F.first("v").alias("v"), F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"))
    entries = cut(few.groupBy("c").agg(F.first("v").alias("v"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")))
    total = entries.count()
    sample = entries.orderBy(F.xxhash64(F.lit(3), "c"), "c").limit(SAMPLE).select("c", "ids", "v").toArrow()
    x = np.array(sample.column("v").combine_chunks().flatten()).reshape(-1, width.n)
    want = min(MAX_LISTS, max(1, total // LIST), max(1, len(x) // 8))
    graph = Graph(balanced_centroids(x, int(np.log2(want))))

    asked = rows.where(F.expr(query.format(id="id")))
    asks = cut(asked.groupBy("c").agg(F.first("v").alias("v")).select(F.col("c").alias("q"), "v"))
    if asks.isEmpty():
        return empty
    replicate, prune, _ = calibrate(entries, asks, graph, x, k)
    posts = cut(entries.mapInPandas(_lists(graph, replicate, POST_BEAM, ["c", "ids"]), "c long, ids array<long>, v array<double>, list int, first boolean"))
    # Lists that hold k + 1 vectors between them are visited whatever the ratio.
    sizes = np.zeros(len(graph.c), np.int64)
    for r in posts.where("first").groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    asks = cut(asks.mapInPandas(_lists(graph, prune, QUERY_BEAM, ["q"], sizes, k + 1), "q long, v array<double>, list int, first boolean"))

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    # A list's vectors and queries are dealt to parts; every pair of parts is a block.
    split = parts(posts, "pn").join(parts(asks, "qn"), "list")
    p = posts.join(split, "list").withColumn("a", F.pmod(F.xxhash64("c"), F.col("pn")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)))
    q = asks.join(split, "list").withColumn("b", F.pmod(F.xxhash64("q"), F.col("qn")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("pn") - 1)))
    key = ["list", "a", "b"]
    hits = q.select(*key, "q", "v").groupBy(*key).cogroup(p.select(*key, "c", "ids", "v").groupBy(*key)).applyInPandas(_compare(k), "q long, c long, score double, ids array<long>")
    found = hits.dropDuplicates(["q", "c"]).select("q", "score", F.explode("ids").alias("vec_id"))
    w = Window.partitionBy("q").orderBy("score", "vec_id")
    found = cut(found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1))
    # Every query row reads its vector's list without its own id.
    out = asked.select("c", F.col("id").alias("query_id")).distinct().join(found.withColumnRenamed("q", "c"), "c").where("query_id <> vec_id")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = out.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
