"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree over permuted blocks.

A source's documents are dealt by a seeded 64-bit hash into 2^b equal hash ranges, its blocks, of about a hundred documents,
which a seeded permutation of their numbers puts in an order. Its target says how many blocks the mix draws: whole passes
over the source take all blocks, the last, partial pass takes them in their order up to the target. Only the block in which
the target falls is opened, by further hash bits until a part of few documents is left, of which a greedy subset fills the
rest. The drawn block counts of all sources are the quotas that the tree splits: a node of k output shards gives its left
half a multivariate-hypergeometric draw of the remaining quotas, down to single shards. Each shard takes the next run of
every source's permuted blocks, so draws are disjoint, and orders its documents by a seeded hash.

The driver holds a few numbers a source, for the targets and the tree. Blocks and documents stay in tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geopanel.llm.common import cut, group_key, local_table, meet, n_words

#: Bits of a document's place that one search step reads, and those a place has.
STEP, PLACE = 10, 60
#: Documents of the last opened part that are weighed one by one.
FEW = 2048


def targets(size: dict[str, int], weight: dict[str, float], total: float, most: float) -> dict[str, float]:
    """Shares of total by weight, none above most times its size; the excess is reshared by weight."""
    out, free, left = {}, {s for s in size if weight[s] > 0}, float(total)
    out.update({s: 0.0 for s in size if weight[s] <= 0})
    while free:
        w = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / w >= most * size[s]}
        if not full:
            out.update({s: left * weight[s] / w for s in free})
            return out
        for s in full:
            out[s] = most * size[s]
        left -= sum(most * size[s] for s in full)
        free -= full
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources block counts: rows as equal in size as can be, columns sum to quotas; drawn by a splitting tree."""
    out = np.zeros((shards, len(quotas)), np.int64)
    total = int(quotas.sum())
    cap = np.full(shards, total // shards, np.int64)
    cap[: total % shards] += 1

    def go(lo: int, hi: int, q: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        need, rest, left = int(cap[lo:mid].sum()), int(q.sum()), np.zeros(len(q), np.int64)
        for s, n in enumerate(q):  # one hypergeometric draw a source: a multivariate draw by conditioning
            rest -= int(n)
            left[s] = need if not rest else rng.hypergeometric(int(n), rest, need) if need and n else 0
            need -= int(left[s])
        go(lo, mid, left)
        go(mid, hi, q - left)

    go(0, shards, quotas.astype(np.int64))
    return out


def _bits(docs: int) -> int:
    return min(30, max(0, int(docs // 64).bit_length() - 1))


def _rank(bits: Column, mult: Column, shift: Column, key: Column) -> Column:
    """The place of a key's block in its source's order: an odd multiple plus a shift permutes the numbers below 2^bits."""
    block = F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", key, F.lit(64) - bits))
    return (mult * block + shift).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)


def _placed(sized: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """sized with its source's columns, rank, and place: the rank, then further hash bits, in PLACE bits."""
    d = meet(sized, sources, "src", n, "docs")
    d = d.withColumn("rank", _rank(F.col("bits"), F.col("mult"), F.col("shift"), F.col("key")))
    rest = F.call_function("shiftrightunsigned", F.xxhash64("key"), F.col("bits") + (64 - PLACE))
    return d.withColumn("place", F.call_function("shiftleft", F.col("rank"), F.lit(PLACE) - F.col("bits")) + rest)


def _part(sized: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """The documents of each source's part of 2^width places from lo on."""
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("width"))
    return _placed(sized, state, n).where((F.col("place") >= F.col("lo")) & (F.col("place") - F.col("lo") < width))


def _edges(sized: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """(src, lo, width, some): the partial pass of a source takes the documents with a place under lo, and those with the
    places some, a greedy subset of the part of at most FEW documents of 2^width places from lo on. sources has the words
    it takes, left."""
    state = cut(sources.withColumns({"lo": F.lit(0).cast("long"), "width": F.lit(PLACE), "n": F.col("docs")}))
    while True:
        todo = state.where((F.col("n") > FEW) & (F.col("width") > 0))
        if todo.isEmpty():
            break
        # So many bits that parts of a quarter of FEW documents are to be expected.
        bits = F.least(F.lit(STEP), F.col("width"), F.ceil(F.log2(4 * F.col("n") / FEW)).cast("int"))
        todo = todo.withColumn("rest", F.col("width") - bits)
        digit = F.call_function("shiftrightunsigned", F.col("place") - F.col("lo"), F.col("rest")).alias("digit")
        sums = _part(sized, todo, n).groupBy("src", digit).agg(F.sum("size").alias("w"), F.count("*").alias("m"))
        w = Window.partitionBy("src").orderBy("digit")  # at most 2^STEP rows a source
        run = sums.withColumn("upto", F.sum("w").over(w)).join(todo.select("src", "left", "rest"), "src").where("upto > left")
        first = run.groupBy("src").agg(F.min_by(F.struct(F.call_function("shiftleft", F.col("digit"), F.col("rest")).alias("more"), (F.col("left") - F.col("upto") + F.col("w")).alias("left"), F.col("m").alias("n")), "digit").alias("f"))
        new = todo.drop("left", "n").withColumn("width", F.col("rest")).join(first, "src").withColumns({"lo": F.col("lo") + F.col("f.more"), "left": F.col("f.left"), "n": F.col("f.n")})
        done = state.where((F.col("n") <= FEW) | (F.col("width") <= 0))
        state = cut(done.unionByName(new.select(done.columns)))
    inside = _part(sized, state, n).where(F.col("size") > 0)
    part = inside.groupBy("src", "place").agg(F.sum("size").alias("size"))
    part = part.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("size", "place")), asc=False).alias("few"))
    part = state.join(part, "src", "left")
    start = F.struct(F.col("left").alias("rest"), F.array().cast("array<long>").alias("some"))
    fill = F.aggregate("few", start, lambda a, d: F.when(d["size"] <= a["rest"], F.struct((a["rest"] - d["size"]).alias("rest"), F.concat(a["some"], F.array(d["place"])).alias("some"))).otherwise(a))
    part = part.withColumn("fill", F.coalesce(fill, start))
    over = F.array_min(F.filter("few", lambda d: ~F.array_contains(F.col("fill")["some"], d["place"])))
    part = part.withColumn("over", over)
    nearer = F.col("over").isNotNull() & (F.col("over")["size"] - F.col("fill")["rest"] < F.col("fill")["rest"])  # one document more is nearer than none
    some = F.when(nearer, F.concat(F.col("fill")["some"], F.array(F.col("over")["place"]))).otherwise(F.col("fill")["some"])
    return cut(part.select("src", "lo", "width", some.alias("some")))


def plan(sized: DataFrame, weights, total_share: float, most: float, shards: int, seed: int) -> tuple[DataFrame, int]:
    """(one row a source, their number): src, docs, source_size, target, bits, mult and shift of its blocks, passes, lo, some
    and upto, the numbers of its drawn blocks that each shard ends before. sized has src, key, size; weights maps the
    ordered source keys to weights."""
    spark = sized.sparkSession
    stat = sized.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()  # a row a source
    size, docs = {r.src: int(r["size"]) for r in stat}, {r.src: int(r.docs) for r in stat}
    # Null last, then by code point: keys are 's' + name, and 'n' for null.
    order = sorted(size, key=lambda s: (s == "n", s))
    weight = dict(zip(order, weights(order), strict=True))
    goal = targets(size, weight, total_share * sum(size.values()), most)
    rng = np.random.default_rng(seed)
    rows = []
    for s in order:
        passes = int(goal[s] // size[s]) if size[s] else 0
        bits = _bits(docs[s])
        odd, shift = (int(v) for v in rng.integers(0, 1 << bits, 2))
        rows.append((s, docs[s], size[s], float(goal[s]), bits, odd | 1, shift, passes, goal[s] - passes * size[s]))
    schema = "src string, docs long, source_size long, target double, bits int, mult long, shift long, passes int, left double"
    sources = cut(local_table(spark, rows, schema))
    edges = _edges(sized, sources.where("left > 0"), len(rows))
    end = {r.src: int(r.lo) + (1 << r.width) - 1 for r in edges.select("src", "lo", "width").collect()}
    # A source's partial pass draws the blocks up to the end of the part that is opened.
    quotas = np.array([r[7] * (1 << r[4]) + ((end[r[0]] >> (PLACE - r[4])) + 1 if r[0] in end else 0) for r in rows], np.int64)
    deal = split_quotas(quotas, shards, rng) if rows else np.zeros((shards, 0), np.int64)
    upto = np.cumsum(deal, axis=0)
    dealt = local_table(spark, [(s, upto[:, i].tolist()) for i, s in enumerate(order)], "src string, upto array<long>")
    return cut(sources.drop("left").join(dealt, "src").join(edges.drop("width"), "src", "left")), len(rows)


def default_weights(order: list[str]) -> list[float]:
    return [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=default_weights, total_share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 5, digest: bool = False, ordered: bool = False) -> DataFrame:
    """Draw a mix whose sources meet their targets in words.

    Sources, in code point order with null last, get weights(sources) of total_share times all words; no target
    exceeds most (a whole number) times its source. Returns docs once for every time the mix takes a row, with copy, shard and
    place (its order within the shard) added; with ordered the rows are range-partitioned and sorted by shard and place; with digest one row a document instead: id, size, source_size, target,
    taken, source, and places, the copy, shard and place of every time it is taken. Null texts have size 0. Id and text
    decide a row's hash, so repeated rows are drawn together and reruns agree. Documents without words are taken with their block. Empty tables give empty results.
    """
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    sized = docs.select(group_key(F.col(source_col)).alias("src"), key.alias("key"), F.col(id_col).alias("id"), n_words(F.col(text_col)).alias("size"))
    sized = cut(sized)
    table, n = plan(sized.drop("id"), weights, total_share, most, shards, seed)

    def drawn(df: DataFrame) -> DataFrame:
        df = _placed(df, table, n)
        per = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))
        tail = (F.col("place") < F.col("lo")) | F.array_contains("some", F.col("place"))
        copies = F.col("passes") + F.when(tail, 1).otherwise(0)

        def copy(c: Column) -> Column:
            number = c * per + F.col("rank")  # of the block among those drawn from its source
            at = F.size(F.filter("upto", lambda v: v <= number))
            return F.struct(c.cast("int").alias("copy"), at.alias("shard"), F.xxhash64(F.lit(seed + 1), F.col("key"), c.cast("int"), at).alias("place"))

        none = F.array().cast("array<struct<copy:int,shard:int,place:bigint>>")
        return df.withColumn("at", F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), copy)).otherwise(none))

    if digest:
        out = drawn(sized).withColumn("source", F.when(F.col("src") != "n", F.substring("src", 2, 1 << 30)))
        return out.select("id", "size", "source_size", "target", (F.col("size") * F.size("at")).alias("taken"), "source", F.col("at").alias("places"))
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), group_key(F.col(source_col)).alias("src"), key.alias("key"))
    out = drawn(inner).select("row", F.explode("at").alias("d"))
    clash = [c for c in names if c.lower() in ("copy", "shard", "place")]
    out = out.select(*[F.col("row").getField(c).alias(c) for c in names if c not in clash], "d.copy", "d.shard", "d.place")
    return out.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place") if ordered else out
