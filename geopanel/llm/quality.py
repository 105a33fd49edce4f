"""Document quality by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise part is taken in linear time as half of
sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2. Words are hashed to WORDS slots with log counts scaled to unit length,
structure statistics and metadata are one-hot bins. The model is trained in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.llm.common import blocks, hash_words, lean, text_bytes

WORDS = 1 << 14
BINS = 24
BLOCK_BYTES = 1 << 20
#: Labelled rows the model is fitted on, at most: those with the least hash of their id and text.
MAX_LABELLED = 8000
#: Byte classes counted as shares of a text: symbols, capitals, digits, sentence marks, bars, white space, non-ASCII.
_CLASSES = [b"#*$%&<>@^~=+_\\{}[]", bytes(range(65, 91)), b"0123456789", b".,;:?", b"|", bytes(range(9, 14)) + b" ", bytes(range(128, 256)), b"!", b"\n"]
_CLASS = np.zeros((256, len(_CLASSES)), np.uint8)
for _k, _c in enumerate(_CLASSES):
    _CLASS[list(_c), _k] = 1
N_STATS = len(_CLASSES) + 5
N_META = 4


def _share_bin(x: np.ndarray) -> np.ndarray:
    """Shares 0 to 1 to bins: 0 alone, then by the logarithm down to 0.05%."""
    return np.where(x <= 0, 0, np.clip(BINS - 1 + 2 * np.log2(np.maximum(x, 1e-9)), 1, BINS - 1)).astype(np.int64)


def _size_bin(x: np.ndarray) -> np.ndarray:
    return np.clip(1.3 * np.log2(1 + np.maximum(x, 0)), 0, BINS - 1).astype(np.int64)


def features(data: np.ndarray, off: np.ndarray, meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row bounds, slot, value) of a block of texts; meta are nonnegative numbers, NaN where unknown."""
    n = len(off) - 1
    h, start, end, first = hash_words(data, off, lower=False)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    slot = (h >> np.uint64(50)).astype(np.int64)
    key, count = np.unique(doc * WORDS + slot, return_counts=True)
    owner, slot = key // WORDS, key % WORDS
    value = np.log1p(count)
    norm = np.sqrt(np.maximum(np.bincount(owner, value * value, minlength=n), 1e-12))
    value = value / norm[owner]
    distinct = np.bincount(owner, minlength=n)
    size = np.diff(off)
    stats = []
    for k in range(len(_CLASSES)):
        c = np.concatenate([[0], np.cumsum(_CLASS[data, k], dtype=np.int64)])
        stats.append(_share_bin((c[off[1:]] - c[off[:-1]]) / np.maximum(size, 1)))
    letters = np.bincount(doc, (end - start).astype(float), minlength=n)
    stats += [_size_bin(words), np.clip(2 * letters / np.maximum(words, 1), 0, BINS - 1).astype(np.int64), _share_bin(distinct / np.maximum(words, 1)), _share_bin(np.where(words > 0, np.bincount(doc, (end - start <= 1).astype(float), minlength=n) / np.maximum(words, 1), 0))]
    again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    stats.append(_share_bin(np.bincount(doc[1:], again.astype(float), minlength=n)[:n] / np.maximum(words, 1)) if len(h) else np.zeros(n, np.int64))
    for m in meta[:N_META]:
        stats.append(np.where(np.isnan(m), BINS - 1, np.minimum(_size_bin(np.nan_to_num(m)), BINS - 2)))
    table = np.stack(stats, 1) + WORDS + BINS * np.arange(len(stats))
    per = distinct + len(stats)
    bounds = np.concatenate([[0], np.cumsum(per)])
    slots, values = np.empty(bounds[-1], np.int32), np.empty(bounds[-1], np.float32)
    at = bounds[:-1, None] + np.arange(len(stats))
    slots[at], values[at] = table, 1 / np.sqrt(len(stats))
    place = np.arange(len(owner)) + len(stats) * (owner + 1)
    slots[place], values[place] = slot, value
    return bounds, slots, values


@dataclass(frozen=True)
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, bounds: np.ndarray, slot: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Probabilities of a block of rows; every row has a feature."""
        x = value.astype(np.float64)
        linear = np.add.reduceat(self.w[slot] * x, bounds[:-1])
        pair = np.zeros(len(bounds) - 1)
        for f in range(self.v.shape[1]):
            vx = self.v[slot, f] * x
            pair += np.add.reduceat(vx, bounds[:-1]) ** 2 - np.add.reduceat(vx * vx, bounds[:-1])
        return 1 / (1 + np.exp(-np.clip(self.w0 + linear + 0.5 * pair, -35, 35)))


def train(bounds: np.ndarray, slot: np.ndarray, value: np.ndarray, label: np.ndarray, rank: int = 4, epochs: int = 8, batch: int = 64, rate: float = 0.15, decay: float = 1e-5, seed: int = 3) -> Machine:
    """AdaGrad on the logistic loss. Without both classes the score is the labelled share, or 0.5 without labels."""
    size = WORDS + BINS * (N_STATS + N_META)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(size), rng.normal(0, 0.01, (size, rank))
    share = float(label.mean()) if len(label) else 0.5
    w0 = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if share in (0.0, 1.0) or not len(label):
        return Machine(w0, w, np.zeros((size, rank)))
    gw, gv = np.full(size, 1e-4), np.full((size, rank), 1e-4)
    n = len(label)
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            rows = order[i : i + batch]
            width = bounds[rows + 1] - bounds[rows]
            lead = np.concatenate([[0], np.cumsum(width)])
            at = np.repeat(bounds[rows] - lead[:-1], width) + np.arange(lead[-1])
            s, x, row = slot[at], value[at].astype(float), np.repeat(np.arange(len(rows)), width)
            vx = v[s] * x[:, None]
            total = np.add.reduceat(vx, lead[:-1], axis=0)
            z = w0 + np.add.reduceat(w[s] * x, lead[:-1]) + 0.5 * (total**2 - np.add.reduceat(vx * vx, lead[:-1], axis=0)).sum(1)
            err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - label[rows]) / len(rows)
            w0 -= rate * err.sum()
            e = err[row] * x
            used, back = np.unique(s, return_inverse=True)
            g = np.bincount(back, e, len(used)) + decay * w[used]
            gw[used] += g * g
            w[used] -= rate * g / np.sqrt(gw[used])
            for f in range(v.shape[1]):
                g = np.bincount(back, e * (total[row, f] - vx[:, f]), len(used)) + decay * v[used, f]
                gv[used, f] += g * g
                v[used, f] -= 0.3 * rate * g / np.sqrt(gv[used, f])
    return Machine(w0, w, v)


def _blocks(batch: pa.RecordBatch, lead: int) -> Iterator[tuple[int, int, tuple]]:
    """Feature blocks of a batch whose columns are `lead` others, the text, then metadata."""
    data, off = text_bytes(batch.column(lead))
    meta = [batch.column(k).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for k in range(lead + 1, batch.num_columns)]
    for i, j in blocks(off, BLOCK_BYTES):
        yield i, j, features(data[off[i] : off[j]], off[i : j + 1] - off[i], [m[i:j] for m in meta])


def _unique(rows: DataFrame) -> bool:
    """Whether no __id is there twice, which bounds the rows; a pass over ids alone."""
    return rows.groupBy("__id").count().where("count > 1").isEmpty()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = (), max_labelled: int = MAX_LABELLED) -> Machine:
    """Train on the max_labelled labelled rows of documents with the least hashes of their id and text.

    Rows with a null id or label are left out; of repeated labels of an id the greatest counts. Repeated documents are one
    row for each text, so that neither copies of a row nor of an id make more than max_labelled rows; null and empty texts
    count. Without labels, documents or both classes the machine gives one score to all.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("__y"))
    chosen = chosen.withColumn("__h", F.xxhash64(F.lit(11), "__id")).orderBy("__h", "__id").limit(max_labelled).drop("__h")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).cast("double").alias(f"__m{k}") for k, c in enumerate(metadata)])
    rows = rows.join(F.broadcast(chosen), "__id")  # at most max_labelled rows
    if not _unique(rows):
        # An id with several rows: equal rows are one, and the least hashes stay.
        rows = rows.distinct().orderBy(F.xxhash64(F.lit(11), "__id", "__text"), "__id", "__text").limit(max_labelled)
    rows = rows.select("__y", "__text", *[f"__m{k}" for k in range(len(metadata))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, (bounds, slot, value) in _blocks(batch, 1):
                y = batch.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([y, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(slot)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(value))], names=["y", "slot", "value"])

    got = rows.mapInArrow(lean(run), "y double, slot array<int>, value array<float>").toArrow()
    if not got.num_rows:
        return train(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(0))
    slot, value = got.column("slot").combine_chunks(), got.column("value").combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(got.column("slot").combine_chunks().value_lengths().to_numpy())])
    y = got.column("y").to_numpy()
    # The same rows in the same order whatever the partitions, so that reruns agree.
    s, x = slot.flatten().to_numpy(), value.flatten().to_numpy()
    mark = np.add.reduceat((s.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ x.view(np.uint32).astype(np.uint64), bounds[:-1])
    order = np.lexsort((np.diff(bounds), y, mark))
    width = np.diff(bounds)[order]
    lead = np.concatenate([[0], np.cumsum(width)])
    at = np.repeat(bounds[:-1][order] - lead[:-1], width) + np.arange(lead[-1])
    return train(lead, s[at], x[at], y[order])


def score(docs: DataFrame, machine: Machine, text_col: str = "text", metadata: tuple[str, ...] = (), keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """docs (or its columns keep) with the score of each whole text. Null and empty texts score by their structure bins
    alone; unknown metadata has a bin of its own; empty tables give empty results."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"), *[F.col(c).cast("double").alias(f"__m{k}") for k, c in enumerate(metadata)])
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # its size is set by WORDS and the rank
    lead = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, (bounds, slot, value) in _blocks(batch, lead):
                s = shared.value.score(bounds, slot, value)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, j - i) for k in range(lead)], pa.array(s)], names=[*keep, out])

    from pyspark.sql.types import DoubleType, StructField, StructType

    fields = {f.name: f for f in docs.schema.fields}
    return src.mapInArrow(lean(run), StructType([*[fields[c] for c in keep], StructField(out, DoubleType())]))
