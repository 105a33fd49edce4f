"""Masked pseudo-likelihood scores of documents by a bidirectional window network trained in numpy.

Every token is predicted from the WINDOW tokens on both its sides. A document's score is the sum of its tokens'
conditional log-probabilities. Tokens are the SLOTS - RARE commonest words of the corpus, counted over all of it, and
RARE hashed slots that share the other words. A word of a shared slot has its own part of the slot's probability, by the
corpus counts of all words, so that conditionals sum to one over words. The counts are a table that grows with the corpus
and is joined; only those of the HELD next commonest words go to the workers. The network embeds the window, weighs each position, adds them up, and
predicts through tanh and a two-level softmax (group of the slot, slot in the group), so that the conditional
probabilities of all slots sum to one.

Documents are dealt by their hash to groups of about GROUP tokens, whose number follows the corpus and not its partitions,
and are sorted in them. Training goes over all groups in ROUNDS rounds: round r trains on every ROUNDS-th token of every
document from its own phase on, so that the rounds together train on every token once. A group starts from the common
weights and the common sums of squared gradients; the groups' results are averaged by token counts, first in each task, then
in one aggregation over weight indices, so that the driver holds one model whatever the number of groups, and the same one
however the table is partitioned, but for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.llm.common import blocks, cut, hash_words, mix64, text_bytes

SLOTS, RARE, GROUPS = 1024, 256, 32
DIM, WINDOW, ROUNDS = 16, 2, 2
MEMBERS = SLOTS // GROUPS
OFFSETS = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]
BATCH = 2048
BLOCK_BYTES = 4 << 20
#: Commonest words of shared slots whose counts the workers hold; the counts of all others are joined.
HELD = 65_536
#: What a word of a shared slot is counted more often than it was seen; unseen words of the slot have this count together.
EXTRA = 0.5
#: Distinct words a task counts before it hands on partial counts.
PARTIAL = 400_000
#: Tokens that a group trains one after the other.
GROUP = 1_000_000
#: Copies of one row, id and text, from which on they are dealt to all groups.
COPIES = 1000
#: Tokens whose windows are laid out together.
LAID_OUT = 1 << 20


@dataclass(frozen=True)
class Net:
    """Weights: emb (SLOTS + 1, DIM), the last row for beyond the text; pos (window, DIM); bias (DIM); top (DIM + 1,
    GROUPS); low (GROUPS, DIM + 1, MEMBERS)."""

    emb: np.ndarray
    pos: np.ndarray
    bias: np.ndarray
    top: np.ndarray
    low: np.ndarray

    @staticmethod
    def shapes() -> list[tuple[int, ...]]:
        return [(SLOTS + 1, DIM), (len(OFFSETS), DIM), (DIM,), (DIM + 1, GROUPS), (GROUPS, DIM + 1, MEMBERS)]

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in (self.emb, self.pos, self.bias, self.top, self.low)])

    @staticmethod
    def of(flat: np.ndarray) -> Net:
        out, at = [], 0
        for s in Net.shapes():
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s).astype(np.float32))
            at += n
        return Net(*out)

    @staticmethod
    def start(counts: np.ndarray, seed: int = 9) -> Net:
        """Small random embeddings, and output biases that give the slots' frequencies."""
        rng = np.random.default_rng(seed)
        p = (counts + 1.0) / (counts.sum() + SLOTS)
        by = p.reshape(GROUPS, MEMBERS)
        top, low = rng.normal(0, 0.05, (DIM + 1, GROUPS)), rng.normal(0, 0.05, (GROUPS, DIM + 1, MEMBERS))
        top[DIM] = np.log(by.sum(1))
        low[:, DIM] = np.log(by / by.sum(1, keepdims=True))
        return Net(*(v.astype(np.float32) for v in (rng.normal(0, 0.3, (SLOTS + 1, DIM)), rng.normal(1, 0.1, (len(OFFSETS), DIM)), np.zeros(DIM), top, low)))

    def tables(self) -> list[np.ndarray]:
        """Embeddings weighed for each window position."""
        return [self.emb * w for w in self.pos]

    def hidden(self, ctx: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
        """tanh of the weighted window, with a last column of ones; ctx: the slots at each window position."""
        z = np.empty((len(ctx[0]), DIM + 1), np.float32)
        acc = tables[0].take(ctx[0], axis=0)
        for t, c in zip(tables[1:], ctx[1:], strict=True):
            acc += t.take(c, axis=0)
        acc += self.bias
        np.tanh(acc, out=z[:, :DIM])
        z[:, DIM] = 1
        return z

    def log_prob(self, ctx: list[np.ndarray], target: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """log p(target | window) of each position."""
        group, member, order, bounds = by_group(target)
        h = self.hidden(ctx, tables or self.tables()).take(order, axis=0)
        member = member.take(order)
        got = _log_softmax_at(h @ self.top, group.take(order))
        for g in range(GROUPS):
            lo, hi = bounds[g], bounds[g + 1]
            if lo < hi:
                got[lo:hi] += _log_softmax_at(h[lo:hi] @ self.low[g], member[lo:hi])
        out = np.empty_like(got)
        out[order] = got
        return out


def by_group(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, member) of slots, the order by group and each group's bounds in it."""
    group = (target // MEMBERS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    return group, target % MEMBERS, order, np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))])


_ONES = np.ones(max(GROUPS, MEMBERS), np.float32)


def _log_softmax_at(z: np.ndarray, k: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    at = z[np.arange(len(z)), k]
    return at - np.log(np.exp(z, out=z) @ _ONES[: z.shape[1]])


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    e = np.exp(z, out=z)
    e /= (e @ _ONES[: z.shape[1]])[:, None]
    return e


class Trainer:
    """AdaGrad on minibatches of one group, from given sums of squared gradients on."""

    def __init__(self, net: Net, rate: float, squares: Net | None = None):
        self.w = [v.copy() for v in (net.emb, net.pos, net.bias, net.top, net.low)]
        s = squares and (squares.emb, squares.pos, squares.bias, squares.top, squares.low)
        self.g = [v.copy() for v in s] if s else [np.full_like(v, 1e-6) for v in self.w]
        self.rate, self.seen = rate, 0
        self.waiting: list[np.ndarray] = []

    def feed(self, padded: np.ndarray, at: np.ndarray) -> None:
        """Train on the tokens at these places in batches of BATCH, whose bounds don't follow those of the calls."""
        new = np.stack([padded.take(at), *_context(padded, at)])
        self.waiting.append(new)
        if sum(v.shape[1] for v in self.waiting) >= BATCH:
            every = np.concatenate(self.waiting, axis=1)
            whole = every.shape[1] // BATCH * BATCH
            for k in range(0, whole, BATCH):
                part = every[:, k : k + BATCH]
                self.batch(list(part[1:]), part[0])
            self.waiting = [every[:, whole:]]

    def end(self) -> np.ndarray:
        """Train on what waits; weights, then sums of squares, then 1, all times the tokens seen."""
        if self.waiting and sum(v.shape[1] for v in self.waiting):
            every = np.concatenate(self.waiting, axis=1)
            self.batch(list(every[1:]), every[0])
        self.waiting = []
        return np.concatenate([self.net().flat(), Net(*self.g).flat(), [1.0]]).astype(np.float64) * self.seen

    def net(self) -> Net:
        return Net(*self.w)

    def _step(self, k: int, grad: np.ndarray) -> None:
        self.g[k] += grad * grad
        self.w[k] -= self.rate * grad / np.sqrt(self.g[k])

    def batch(self, ctx: list[np.ndarray], target: np.ndarray) -> None:
        net, n = self.net(), len(target)
        group, member, order, bounds = by_group(target)
        ctx, group, member = [c.take(order) for c in ctx], group.take(order), member.take(order)
        h = net.hidden(ctx, net.tables())
        d = _softmax(h @ net.top)
        d[np.arange(n), group] -= 1
        dh = d @ net.top.T
        g_top, g_low = h.T @ d, np.zeros_like(net.low)
        for g in range(GROUPS):
            at = slice(bounds[g], bounds[g + 1])
            if bounds[g] < bounds[g + 1]:
                d = _softmax(h[at] @ net.low[g])
                d[np.arange(len(d)), member[at]] -= 1
                g_low[g] = h[at].T @ d
                dh[at] += d @ net.low[g].T
        dz = dh[:, :DIM] * (1 - h[:, :DIM] ** 2)
        g_emb, g_pos = np.zeros_like(net.emb), np.zeros_like(net.pos)
        flat = np.arange(DIM)
        for k, c in enumerate(ctx):
            g_pos[k] = (dz * net.emb.take(c, axis=0)).sum(0)
            cell = (c.astype(np.int64)[:, None] * DIM + flat).ravel()
            g_emb += np.bincount(cell, (dz * net.pos[k]).ravel(), (SLOTS + 1) * DIM).reshape(-1, DIM).astype(np.float32)
        for k, g in enumerate((g_emb, g_pos, dz.sum(0), g_top, g_low)):
            self._step(k, (g / np.float32(n)).astype(np.float32))
        self.seen += n


@dataclass(frozen=True)
class Vocabulary:
    """Sorted hashes of the common words, their slots, and the corpus count of every slot.

    words (h, n) holds the corpus count of every word. share is the total of each shared slot after smoothing, held and
    held_n are the sorted hashes and the counts of its commonest words. Without words a slot's probability is not parted.
    """

    keys: np.ndarray
    slots: np.ndarray
    counts: np.ndarray
    words: DataFrame | None = None
    share: np.ndarray | None = None
    held: np.ndarray | None = None
    held_n: np.ndarray | None = None

    def slot(self, h: np.ndarray) -> np.ndarray:
        rare = (SLOTS - RARE + (h % np.uint64(RARE)).astype(np.int64)).astype(np.int32)
        if not len(self.keys):
            return rare
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.slots[at], rare).astype(np.int32)

    def parts(self, h: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log p(word | slot), open): 0 for words of their own slot; open words have a count of 0 here, and theirs is in
        words if anywhere."""
        out, left = np.zeros(len(h)), np.zeros(len(h), bool)
        if self.share is None or not len(h):
            return out, left
        rare = np.flatnonzero(slot >= SLOTS - RARE)
        w, n = h[rare], np.zeros(len(rare))
        if len(self.held):
            at = np.minimum(np.searchsorted(self.held, w), len(self.held) - 1)
            n = np.where(self.held[at] == w, self.held_n[at], 0)
        out[rare] = np.log((n + EXTRA) / self.share[slot[rare] - (SLOTS - RARE)])
        left[rare] = n == 0
        return out, left


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, n): corpus count of every word hash, over all texts; partial counts are summed by the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def emit() -> pa.RecordBatch:
            k, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(back, np.concatenate(counts)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["h", "n"])

        for batch in batches:
            data, off = text_bytes(batch.column(0))
            for i, j in blocks(off, BLOCK_BYTES):
                h, _, _, _ = hash_words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
                k, n = np.unique(h, return_counts=True)
                keys.append(k), counts.append(n)
                size += len(k)
                if size > PARTIAL:
                    yield emit()
                    keys, counts, size = [], [], 0
        if size:
            yield emit()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text_col: str) -> Vocabulary:
    counted = cut(count_words(docs, text_col))
    top = counted.orderBy(F.desc("n"), "h").limit(SLOTS - RARE + HELD).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    keys, held, held_n = h[: SLOTS - RARE], h[SLOTS - RARE :], n[SLOTS - RARE :]
    counts = np.zeros(SLOTS)
    counts[: len(keys)] = n[: SLOTS - RARE]
    # Totals of the shared slots, h mod RARE, over all words but the common ones.
    words, total = np.zeros(RARE), np.zeros(RARE)
    for r in counted.groupBy(F.pmod(F.col("h").bitwiseAND(F.lit(RARE - 1)), F.lit(RARE)).cast("int").alias("s")).agg(F.count("*").alias("w"), F.sum("n").alias("n")).collect():
        words[r.s], total[r.s] = r.w, r.n
    own = (keys % np.uint64(RARE)).astype(np.int64)
    words -= np.bincount(own, minlength=RARE)
    total -= np.bincount(own, n[: SLOTS - RARE], minlength=RARE)
    counts[SLOTS - RARE :] = total
    order, by_hash = np.argsort(keys), np.argsort(held)
    return Vocabulary(keys[order], order.astype(np.int32), counts, counted, total + EXTRA * (words + 1), held[by_hash], held_n[by_hash])


def _tokens(col, vocab: Vocabulary, hashes: list | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, padded slots, word bounds), and in hashes the word hashes, of blocks of texts; row i's words are at first[i] + WINDOW * (2 i
    + 1) on, with WINDOW pads on both sides of every text."""
    data, off = text_bytes(col)
    for i, j in blocks(off, BLOCK_BYTES):
        h, _, _, first = hash_words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
        n = np.diff(first)
        place = np.arange(len(h)) + np.repeat(WINDOW * (2 * np.arange(len(n)) + 1), n)
        padded = np.full(len(h) + 2 * WINDOW * len(n), SLOTS, np.int32)
        padded[place] = vocab.slot(h)
        if hashes is not None:
            hashes[:] = [h]
        yield i, j, padded, np.stack([place, np.repeat(np.arange(len(n)), n), np.arange(len(h)) - np.repeat(first[:-1], n)]) if len(h) else np.zeros((3, 0), np.int64)


def _context(padded: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [padded.take(at + o) for o in OFFSETS]


def in_round(row: np.ndarray, nth: np.ndarray, r: int) -> np.ndarray:
    """Whether round r trains on each token; every token is in one round. Phases follow the texts' lengths."""
    phase = mix64(np.bincount(row).astype(np.uint64)) % np.uint64(ROUNDS)
    return (nth + phase.astype(np.int64)[row] + r) % ROUNDS == 0


def dealt(docs: DataFrame, vocab: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(grp, slots): the slots of every text, 16 bits each, sorted by group and row hash within partitions of whole groups."""
    groups = max(1, -(-int(vocab.counts.sum()) // GROUP))
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    hot = rows.groupBy("key").count().where(F.col("count") > COPIES).select("key", F.lit(True).alias("hot"))
    at = F.when(F.col("hot"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    rows = rows.join(hot, "key", "left") if not hot.isEmpty() else rows.withColumn("hot", F.lit(False))
    rows = rows.select(F.pmod(F.xxhash64("key", at), F.lit(groups)).cast("int").alias("grp"), "key", "text")
    plain = docs.sparkSession.sparkContext.broadcast(replace(vocab, words=None, held=None, held_n=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = plain.value
        for batch in batches:
            data, off = text_bytes(batch.column(2))
            for i, j in blocks(off, BLOCK_BYTES):
                h, _, _, first = hash_words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
                raw = vocab.slot(h).astype("<u2")
                got = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((2 * first).astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), got.cast(pa.binary())], names=["grp", "key", "slots"])

    rows = rows.mapInArrow(run, "grp int, key long, slots binary")
    return cut(rows.repartition("grp").sortWithinPartitions("grp", "key").select("grp", "slots"))


def _laid_out(slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(padded slots, place, row and number in its row of each token) of texts whose slots are at first[i]:first[i + 1]."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(slots)) + WINDOW * (2 * row + 1)
    padded = np.full(len(slots) + 2 * WINDOW * len(n), SLOTS, np.int32)
    padded[place] = slots
    return padded, place, row, np.arange(len(slots)) - np.repeat(first[:-1], n)


def train(docs: DataFrame, text_col: str = "text", rate: float = 0.1, id_col: str = "doc_id") -> tuple[Vocabulary, Net]:
    """The corpus's vocabulary and network. Null and blank texts add nothing; repeated rows count each; without a word the
    network is the start."""
    vocab = vocabulary(docs, text_col)
    sc = docs.sparkSession.sparkContext
    net, squares = Net.start(vocab.counts), None
    rows = dealt(docs, vocab, id_col, text_col) if vocab.counts.sum() else None
    for r in range(ROUNDS if rows is not None else 0):
        shared = sc.broadcast((net, squares))  # one model: its size is set by SLOTS and DIM

        def run(batches: Iterator[pa.RecordBatch], r: int = r, shared=shared) -> Iterator[pa.RecordBatch]:
            total, t, now = None, None, -1
            for batch in batches:
                grp = batch.column(0).to_numpy(zero_copy_only=False)
                col = batch.column(1).cast(pa.large_binary())
                if not len(col):
                    continue
                off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] // 2
                slots = np.frombuffer(col.buffers()[2], "<u2") if col.buffers()[2] is not None else np.zeros(0, "<u2")
                edge = np.concatenate([[0], np.flatnonzero(np.diff(grp)) + 1, [len(grp)]])
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    if t is None or grp[a] != now:
                        if t is not None:
                            total = t.end() if total is None else total + t.end()
                        t, now = Trainer(shared.value[0], rate, shared.value[1]), grp[a]
                    for i, j in blocks(off[a : b + 1], LAID_OUT):
                        i, j = a + i, a + j
                        padded, place, row, nth = _laid_out(slots[off[i] : off[j]], off[i : j + 1] - off[i])
                        if len(place):
                            t.feed(padded, place[in_round(row, nth, r)])
            if t is not None:
                total = t.end() if total is None else total + t.end()
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "v"])

        sums = rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
        if sums.num_rows:
            k, v = sums.column("k").to_numpy(), sums.column("v").to_numpy()
            flat = np.empty(len(v))
            flat[k] = v
            if flat[-1] > 0:
                half = (len(flat) - 1) // 2
                net, squares = Net.of(flat[:half] / flat[-1]), Net.of(flat[half:-1] / flat[-1])
        shared.unpersist()
    return vocab, net


def score(docs: DataFrame, vocab: Vocabulary, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, log_prob (sum over the whole text), mean_log_prob. Null and blank texts have no tokens, log_prob 0
    and a null mean; repeated rows score alike; an empty table gives an empty result; further columns are ignored."""
    table = vocab.words
    shared = docs.sparkSession.sparkContext.broadcast((replace(vocab, words=None), net))
    names = ["key", "id", "n_tokens", "log_prob", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net = shared.value
        tables, hashes = net.tables(), []
        key = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            for i, j, padded, (place, row, _) in _tokens(batch.column(1), vocab, hashes):
                lp = np.zeros(len(place))
                for k in range(0, len(place), 4 * BATCH):
                    at = place[k : k + 4 * BATCH]
                    lp[k : k + 4 * BATCH] = net.log_prob(_context(padded, at), padded.take(at), tables)
                n = np.bincount(row, minlength=j - i)[: j - i] if len(row) else np.zeros(j - i, np.int64)
                total = np.bincount(row, lp, minlength=j - i)[: j - i] if len(row) else np.zeros(j - i)
                part, left = vocab.parts(hashes[0], padded[place]) if len(place) else (np.zeros(0), np.zeros(0, bool))
                total = total + np.bincount(row, part, minlength=j - i)[: j - i] if len(row) else total
                keys = key + np.arange(j - i)
                key += j - i
                # A row for each text, and one for each of its words whose count is to be joined.
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(total), pa.nulls(j - i, pa.int64())], names=names)
                at = np.flatnonzero(left)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row[at]]), pa.nulls(len(at), batch.column(0).type), pa.array(np.zeros(len(at), np.int64)), pa.array(np.zeros(len(at))), pa.array(hashes[0][at].view(np.int64))], names=names)

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"key long, id {kind}, n_tokens long, log_prob double, h long")
    if table is not None:
        # Rows of texts take a hash of their key to the join, which is dealt evenly and meets no count.
        out = out.withColumn("__h", F.coalesce("h", F.xxhash64("key"))).join(table.select(F.col("h").alias("__h"), "n").hint("merge"), "__h", "left")
        more = F.when(F.col("h").isNotNull() & F.col("n").isNotNull(), F.log((F.col("n") + EXTRA) / EXTRA)).otherwise(0.0)
        out = out.withColumn("log_prob", F.col("log_prob") + more)
        out = out.groupBy("key").agg(F.first("id", ignorenulls=True).alias("id"), F.sum("n_tokens").alias("n_tokens"), F.sum("log_prob").alias("log_prob"))
    return out.select("id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))
