"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set is its distinct k-word shingles after A-Z are lower-cased; with fewer words the whole sequence is the
one shingle; without words the set is empty and linked with nothing. Sketches follow the fast similarity sketch: in the
first t rounds every element is thrown into one of t bins by that round's hash and a bin keeps its least (round, value);
in the next t rounds round i sends every element to bin i, so that after 2t rounds no bin is empty. Coordinates agree
with probability equal to the Jaccard similarity, with Chernoff-like concentration. Bands of coordinates give candidates
and every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.llm.common import blocks, cut, hash_words, lean, mix64, text_bytes

BLOCK_BYTES = 1 << 20


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row."""
    h, _, _, first = hash_words(data, off, lower=True)
    n = np.diff(first)
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        if len(h) >= k:
            acc = np.zeros(len(h) - k + 1, np.uint64)
            for j in range(k):
                acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j] + np.uint64(j + 1))
        for i in range(len(n)):
            a, b = first[i], first[i + 1]
            if n[i] >= k:
                out.append(np.unique(acc[a : b - k + 1]))
            elif n[i]:
                one = np.zeros(1, np.uint64)
                for j in range(a, b):
                    one = mix64(one * np.uint64(0xD6E8FEB86659FD93) + h[j] + np.uint64(j - a + 1))
                out.append(mix64(one + n[i].astype(np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def fast_sketch(s: np.ndarray, t: int, seed: int = 1) -> np.ndarray:
    """t coordinates (uint64) of a nonempty set by rounds of hashed bin placement."""
    out = np.zeros(t, np.uint64)
    empty = np.ones(t, bool)
    with np.errstate(over="ignore"):
        for r in range(t):
            v = mix64(s ^ mix64(np.array([seed * 1_000_003 + r], np.uint64)))
            b = ((v >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
            low = v & np.uint64(0xFFFFFFFF)
            fresh = np.full(t, 1 << 32, np.uint64)
            np.minimum.at(fresh, b.astype(np.int64), low)
            hit = empty & (fresh < (1 << 32))
            out[hit] = fresh[hit] + np.uint64(r << 32)
            empty &= ~hit
            if not empty.any():
                return out
        for j in np.flatnonzero(empty):
            v = mix64(s ^ mix64(np.array([seed * 1_000_003 + t + j], np.uint64)))
            out[j] = (v & np.uint64(0xFFFFFFFF)).min() + np.uint64((t + int(j)) << 32)
    return out


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key a band, as signed for Spark's long."""
    with np.errstate(over="ignore"):
        parts = sketch.reshape(bands, -1)
        acc = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for j in range(parts.shape[1]):
            acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + parts[:, j])
    return acc.view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int, rows: int, keep_sets: bool = False) -> DataFrame:
    """Per document: its id, set size, two 64-bit set digests and band keys; with keep_sets the set in place of keys."""
    t = bands * rows
    schema = "id long, n_shingles long, d1 long, d2 long, " + ("shingles array<long>" if keep_sets else "keys array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for i, j in blocks(off, BLOCK_BYTES):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                d1, d2, vals = [], [], []
                with np.errstate(over="ignore"):
                    for s in sets:
                        d1.append(int(mix64(s + np.uint64(77)).sum(dtype=np.uint64).astype(np.int64)))
                        d2.append(int(np.bitwise_xor.reduce(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), initial=np.uint64(len(s))).astype(np.int64)))
                        if keep_sets:
                            vals.append(s.view(np.int64))
                        elif not len(s):
                            vals.append(np.zeros(0, np.int64))
                        else:
                            at = (d1[-1], d2[-1])
                            if at not in memo:
                                if len(memo) > 2000:
                                    memo.clear()
                                memo[at] = band_keys(fast_sketch(s, t), bands)
                            vals.append(memo[at])
                bounds = np.concatenate([[0], np.cumsum([len(v) for v in vals])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(vals) if vals else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists],
                    names=["id", "n_shingles", "d1", "d2", "shingles" if keep_sets else "keys"],
                )

    return docs.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), schema)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over edges (a, b), by alternating large-star and small-star steps.

    Edges only; nodes without an edge are their own component and are joined by the caller. edges is counted and read, so
    it had better be checkpointed.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = cut(e, edges.count())
    while True:
        # Large star: each node's larger neighbours link to its least neighbour (itself included).
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node's smaller neighbours link to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        new = cut(small, 2 * e.count())  # no more large-star edges than edges, and two for each
        gone = new.join(e, ["u", "v"], "left_anti").isEmpty() and e.join(new, ["u", "v"], "left_anti").isEmpty()
        e = new
        if gone:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))


#: Shingles (64-bit each) that one block of the exhaustive check may hold a side; bounds a task's memory.
BLOCK_SHINGLES = 1_000_000
#: Members from which a component gets chunks of its own within a star.
OWN_CHUNK = 32


def _linked(a: str, b: str, na: str, nb: str, percent: int):
    both = F.size(F.array_intersect(a, b))
    return (100 * both) >= percent * (F.col(na) + F.col(nb) - both)


def _blocks(stars: DataFrame) -> DataFrame:
    """(pivot, block, node, comp): members of each star dealt to pairs of chunks so that every pair of members of
    different components meets in a block, while a block holds at most about two chunks of BLOCK_SHINGLES."""
    size = stars.groupBy("pivot", "comp").agg(F.count("*").alias("m"))
    own = size.where(F.col("m") >= OWN_CHUNK).select("pivot", "comp", F.lit(True).alias("own"))
    s = stars.join(own, ["pivot", "comp"], "left").withColumn("pool", F.col("own").isNull()).withColumn("grp", F.when(F.col("own"), F.col("comp")).otherwise(0))
    weight = s.groupBy("pivot", "grp", "pool").agg(F.sum("n_shingles").alias("w"))
    chunks = weight.select("pivot", "grp", "pool", F.ceil(F.col("w") / BLOCK_SHINGLES).cast("int").alias("chunks"))
    each = chunks.select("pivot", "grp", "pool", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"))
    left, right = each.select("pivot", F.struct("pool", "grp", "c").alias("x")), each.select("pivot", F.struct("pool", "grp", "c").alias("y"))
    pairs = left.join(right, "pivot").where((F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & F.col("x.pool")))
    pairs = pairs.where(F.col("x.pool") | F.col("y.pool") | (F.col("x.grp") != F.col("y.grp")))
    pairs = pairs.withColumn("block", F.xxhash64(F.col("x.pool"), F.col("x.grp"), F.col("x.c"), F.col("y.pool"), F.col("y.grp"), F.col("y.c")))
    sides = pairs.select("pivot", "block", F.explode(F.array_distinct(F.array("x", "y"))).alias("at"))
    dealt = s.join(chunks, ["pivot", "grp", "pool"]).select("pivot", "node", "comp", F.struct("pool", "grp", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("c")).alias("at"))
    dealt = dealt.select("pivot", "node", "comp", F.xxhash64("at.pool", "at.grp", "at.c").alias("chunk"))
    return dealt.join(sides.select("pivot", "block", F.xxhash64("at.pool", "at.grp", "at.c").alias("chunk")), ["pivot", "chunk"]).select("pivot", "block", "node", "comp")


def _block_links(percent: int):
    def run(pdf):
        import pandas as pd

        sets, node, comp = [np.asarray(s) for s in pdf["shingles"]], pdf["node"].to_numpy(), pdf["comp"].to_numpy()
        n = np.array([len(s) for s in sets])
        vals = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), n)
        _, ids = np.unique(vals, return_inverse=True)
        order = np.argsort(ids, kind="stable")
        start = np.searchsorted(ids[order], np.arange(ids.max() + 2 if len(ids) else 1))
        by = owner[order]
        lead = np.concatenate([[0], np.cumsum(n)])
        a, b = [], []
        for i in range(len(sets)):
            mine = ids[lead[i] : lead[i + 1]]
            lo, width = start[mine], start[mine + 1] - start[mine]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
            both = np.bincount(by[at], minlength=len(sets))
            hit = np.flatnonzero((100 * both >= percent * (n[i] + n - both)) & (comp != comp[i]))
            hit = hit[hit > i]
            a.append(np.full(len(hit), node[i])), b.append(node[hit])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _number(seed: int):
    """A hash of a set's digests and size."""
    return F.xxhash64(F.lit(seed), "d1", "d2", "n_shingles")


def _with_node(sig: DataFrame, shared: DataFrame | None) -> DataFrame:
    """sig, which has node and other, with other as the node of sets whose node stands in shared."""
    if shared is None:
        return sig.drop("other")
    out = sig.join(shared, "node", "left").withColumn("node", F.when(F.col("hit"), F.col("other")).otherwise(F.col("node")))
    return out.drop("other", "hit")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """Return (id, n_shingles, component_id, kept) for every row of docs.

    Equal sets, told apart by 128 bits of digests and their size, collapse to one class first. In each band bucket every class is compared with the bucket's least class
    (its pivot); links make components; members of one star that are still in different components are then compared
    exhaustively in bounded blocks. So no candidate pair that could join two components is left out, none inside a
    component is compared twice, and no group's pairs are ever emitted as rows. A pair at exactly 80% misses all 32
    bands of 5 with probability 3e-6.

    Null or blank texts have n_shingles 0 and stand alone. Repeated rows are copies of one class. component_id is the
    least id of the component; rows with a null id get the component's least id (null if it has none); kept is true
    where id = component_id. Empty tables give empty results; further columns of docs are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    numbers = {"node": _number(0), "other": _number(1)}
    sig = cut(signatures(src, k, bands, rows).withColumns(numbers).drop("d1", "d2"))
    # Sets are told apart by both numbers: where different sets share the first, each goes by its second.
    shared = sig.groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("node", F.lit(True).alias("hit"))
    shared = cut(shared) if shared.count() else None  # one number for two sets is rare
    sig = _with_node(sig, shared)
    classes = sig.where("n_shingles > 0").groupBy("node").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    entries = classes.select("node", F.explode("keys").alias("key"))
    pivots = entries.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).where("m > 1").drop("m")
    stars = cut(entries.join(pivots, "key").where("node <> pivot").select("pivot", "node").distinct(), bands * sig.count())
    used = stars.select(F.col("node")).unionAll(stars.select("pivot")).distinct()
    reps = sig.join(used, "node", "left_semi").groupBy("node").agg(F.min(F.coalesce("id", F.lit(-(2**63)))).alias("id"))
    rep_text = src.withColumn("id", F.coalesce("id", F.lit(-(2**63)))).join(reps.select("id").distinct(), "id", "left_semi")
    sets = _with_node(signatures(rep_text, k, bands, rows, keep_sets=True).withColumns(numbers).drop("d1", "d2"), shared)
    sets = cut(sets.join(used, "node", "left_semi").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("shingles").alias("shingles")))

    def side(s: str) -> DataFrame:
        return sets.select(F.col("node").alias(s), F.col("n_shingles").alias("n" + s), F.col("shingles").alias("s" + s))

    likely = stars.select(F.col("pivot").alias("b"), F.col("node").alias("a"))
    size = sets.select("node", "n_shingles")
    likely = likely.join(size.select(F.col("node").alias("a"), F.col("n_shingles").alias("x")), "a").join(size.select(F.col("node").alias("b"), F.col("n_shingles").alias("y")), "b")
    likely = likely.where(100 * F.least("x", "y") >= percent * F.greatest("x", "y")).select("a", "b")
    links = cut(likely.join(side("a"), "a").join(side("b"), "b").where(_linked("sa", "sb", "na", "nb", percent)).select("a", "b"))
    comps = components(used, links)

    comp_of = used.join(comps.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("comp"))
    members = stars.join(comp_of, "node").join(size, "node")
    mixed = members.groupBy("pivot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("pivot")
    open_stars = members.join(mixed, "pivot", "left_semi")
    open_stars = cut(open_stars, stars.count())
    more = cut(_blocks(open_stars).join(sets.select("node", "shingles"), "node").groupBy("pivot", "block").applyInPandas(_block_links(percent), "a long, b long").distinct())
    if not more.isEmpty():
        comps = components(used, comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more))

    label = sig.select("id", "n_shingles", "node").join(comps.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("component", "node"))
    least = label.where("n_shingles > 0").groupBy("comp").agg(F.min("id").alias("least"))
    out = label.join(least, "comp", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("id")))
    return out.select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
