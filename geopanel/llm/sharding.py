"""Weighted rendezvous sharding of stable record keys. DataFrame functions only.

Every (key, shard) pair has a hash u in (0, 1) and the score -weight / ln(u); a record lives in the shard of its highest
score. Scores of other shards don't change when one is added, so the new shard takes the records in which it scores
highest and no other record moves; a shard gets records in proportion to its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geopanel.llm.common import cut, own_prefix

#: Rows of one shard that are numbered together.
NUMBERED = 100_000
_SEED = 20231


def rendezvous(key: list[Column], weights: list[float]) -> Column:
    """The shard (int) of the highest score; ties, which need equal 64-bit hashes, go to the higher number. Null keys
    hash as they are, so all of them share a shard."""
    mark = [F.when(k.isNull(), F.lit(1)).otherwise(F.lit(0)) for k in key]
    scores = []
    for i, w in enumerate(weights):
        bits = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(_SEED), F.lit(i), *key, *mark), F.lit(11))
        u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        scores.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("s"), F.lit(i).alias("i")))
    return F.array_max(F.array(*scores))["i"].cast("int") if len(scores) > 1 else F.lit(0).cast("int")


def numbered(df: DataFrame, by: str, out: str) -> DataFrame:
    """df with `out`, gapless from 0 within each value of `by`.

    Rows get a physical number, are written once, and are dealt by its hash into parts of about NUMBERED rows; the parts'
    counts give each part its first number. However many rows share a key, no task numbers more than a part.
    """
    p = own_prefix(df.columns)
    rid, parts, part, n, start = (p + c for c in ("rid", "parts", "part", "n", "first"))
    rows = cut(df.withColumn(rid, F.monotonically_increasing_id()))
    size = rows.groupBy(by).agg(F.ceil(F.count("*") / NUMBERED).alias(parts))
    d = rows.join(size, by).withColumn(part, F.pmod(F.xxhash64(rid), F.col(parts))).drop(parts)
    first = d.groupBy(by, part).agg(F.count("*").alias(n))
    w = Window.partitionBy(by).orderBy(part)
    first = first.select(by, part, (F.sum(n).over(w) - F.col(n)).alias(start))
    d = d.join(first, [by, part])
    w = Window.partitionBy(by, part).orderBy(rid)
    return d.withColumn(out, (F.row_number().over(w) - 1 + F.col(start)).cast("long")).drop(start, part, rid)


def shard(docs: DataFrame, key_cols: list[str], weights: list[float], grown_weight: float | None = 1.0, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with shard, slot (gapless from 0 in each shard) and grown_shard (the shard with one
    more shard of weight grown_weight; null if that is None) added.

    Only the key decides a shard, so repeated rows share one. Columns of docs with these names are replaced. An empty
    table gives an empty result.
    """
    if not weights or any(w <= 0 for w in weights) or (grown_weight is not None and grown_weight <= 0):
        raise ValueError("weights must be positive")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("shard", "slot", "grown_shard")]
    key = [F.col(f"`{c}`") for c in key_cols]
    grown = rendezvous(key, [*weights, grown_weight]) if grown_weight is not None else F.lit(None).cast("int")
    placed = docs.select(*[F.col(f"`{c}`") for c in keep], rendezvous(key, weights).alias("shard"), grown.alias("grown_shard"))
    return numbered(placed, "shard", "slot").select(*[F.col(f"`{c}`") for c in keep], "shard", "grown_shard", "slot")
