"""Best-fit packing of token sequences by patterns fitted with non-negative least squares.

Lengths are counted first; the histogram has max_len bins whatever the input, so the plan is made on the driver. Patterns
of three lengths, or of runs of one or two lengths, that fill a sequence are enumerated, their repeat counts fitted to the
histogram by non-negative least squares and rounded, and the residual histogram is packed best-fit decreasing, whole groups
of equal lengths at a time. The plan is a table (length, rank range) -> (sequence, offset) by which every piece finds its
place.
"""

from __future__ import annotations

import string
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geopanel.llm.common import blocks, cut, hash_spans, hash_words, lean, local_table, text_bytes

#: Words whose ids a task remembers, and parts of words whose ids a worker does; a memory is emptied when full.
MEMO, PARTS = 1_000_000, 400_000
#: Bytes of text whose words are encoded together, and unknown parts of words that one call of the tokenizer takes.
TOGETHER, CALL = 1 << 20, 4096
#: Pieces of one length that are ranked together.
RANKED = 100_000
_shared: dict[str, Encoder] = {}
#: Classes of bytes: ASCII letters, ASCII signs, the lead byte of Latin letters with marks and their second bytes, in
#: which normalisation only lower-cases.
_LETTER, _SIGN, _SECOND = (np.zeros(256, bool) for _ in range(3))
_LETTER[np.frombuffer(string.ascii_letters.encode(), np.uint8)] = True
_SIGN[np.frombuffer(string.punctuation.encode(), np.uint8)] = True
_LEAD = 0xC3
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False  # the multiplication and division signs
#: The tokenizer's own letters for bytes: a printable byte of Latin-1 is itself, the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = [(chr(b), chr(256 + k)) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE) if b >= 0x80]


class _Memory:
    """Sorted 64-bit keys with a run of ids each, found by binary search."""

    def __init__(self) -> None:
        self.keys, self.at, self.width = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def missing(self, keys: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        fresh[inside] = self.keys[place[inside]] != keys[inside]
        return fresh

    def add(self, keys: np.ndarray, width: np.ndarray, ids: np.ndarray) -> None:
        """New keys, sorted; ids has their runs one after the other."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 2, len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(width) - width
        self.used += len(ids)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.width = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.width, place, width)

    def runs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, width) in ids of keys that are all here."""
        place = np.searchsorted(self.keys, keys)
        return self.at[place], self.width[place]


def _spread(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, .. of width[i] each, one run after the other."""
    return np.arange(int(width.sum())) + np.repeat(start - np.cumsum(width) + width, width)


def plain_words(flat: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, whether plain, bytes of letters) of words whose bytes flat has at lead[i]:lead[i + 1].

    A plain word is a run of Latin letters, which normalisation only lower-cases, and a run of ASCII signs after it, which
    may be empty: pre-tokens of their own.
    """
    first = flat == _LEAD
    first[:-1] &= _SECOND[flat[1:]]
    letter = _LETTER[flat] | first
    second = np.concatenate([[False], first[:-1]])
    letter |= second
    after = ~letter  # a letter that follows no letter of its word
    after[1:] = letter[1:] & ~letter[:-1]
    after[lead[:-1]] = ~letter[lead[:-1]]
    other = ~letter & ~_SIGN[flat]
    plain = ~np.logical_or.reduceat(after | other, lead[:-1])
    upper = ((flat >= 65) & (flat <= 90)) | (second & (flat <= 0x9E))
    return flat + upper.astype(np.uint8) * np.uint8(32), plain, np.add.reduceat(letter.astype(np.int64), lead[:-1])


class Encoder:
    """Ids of whole texts by way of their words.

    The tokenizer drops white space and its pre-tokens never span any, so a text's ids are its words' ids in a row; and a
    run of letters and a run of signs after it are pre-tokens of their own. Words, and their letters and signs, are found
    and hashed by array passes over the bytes; sorted arrays map a known one's 64-bit hash to its ids. The unknown letter
    runs of many texts are encoded in one call, in which the ids that end a word tell them apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.plain = Tokenizer.from_file(path)  # for letter runs that are normal and in the tokenizer's letters already
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words, self.parts = _Memory(), _Memory()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _runs(self, raw: list[bytes], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """(widths, ids) of letter or sign runs."""
        if letters and raw:
            text = b" ".join(raw).decode("latin-1")
            for b, c in () if text.isascii() else _BYTE_LETTERS:
                text = text.replace(b, c)
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            if len(ends) == len(raw):  # a tokenizer that marks word ends
                return np.diff(ends, prepend=0), ids
        each = [self._ids(r.decode()) for r in raw]
        return np.array([len(v) for v in each], np.int64), np.concatenate(each) if each else np.zeros(0, np.uint32)

    def _parts(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, letters: bool) -> np.ndarray:
        """Hashes of the runs flat[start:start + size], which are remembered from now on."""
        keys, index, back = np.unique(hash_spans(flat, start, start + size), return_index=True, return_inverse=True)
        fresh = self.parts.missing(keys)
        new, at = keys[fresh], index[fresh]
        widths, ids = [], []
        for i in range(0, len(at), CALL):
            a, n = start[at[i : i + CALL]], size[at[i : i + CALL]]
            raw = flat[_spread(a, n)].tobytes()
            bounds = np.concatenate([[0], np.cumsum(n)]).tolist()
            w, v = self._runs([raw[x:y] for x, y in zip(bounds, bounds[1:], strict=False)], letters)
            widths.append(w), ids.append(v)
        if widths:
            self.parts.add(new, np.concatenate(widths), np.concatenate(ids))
        return keys[back]

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Remember the ids of new words, given with their sorted hashes."""
        if len(self.parts.keys) > PARTS:
            self.parts = _Memory()
        size = end - start
        lead = np.concatenate([[0], np.cumsum(size)])
        flat = data[_spread(start, size)]
        low, plain, letters = plain_words(flat, lead)
        rest = size - letters
        head = self._parts(low, lead[:-1][plain], letters[plain], True)
        signed = plain & (rest > 0)
        tail = self._parts(low, (lead[:-1] + letters)[signed], rest[signed], False)
        raw = flat.tobytes()
        odd = [self._ids(raw[i:j].decode()) for i, j in zip(lead[:-1][~plain].tolist(), lead[1:][~plain].tolist(), strict=True)]
        # Every word is one or two runs of remembered ids; odd words' runs follow the memory.
        ids = np.concatenate([self.parts.ids[: self.parts.used], *odd])
        at, width = np.zeros((len(keys), 2), np.int64), np.zeros((len(keys), 2), np.int64)
        at[plain, 0], width[plain, 0] = self.parts.runs(head)
        at[signed, 1], width[signed, 1] = self.parts.runs(tail)
        n = np.array([len(v) for v in odd], np.int64)
        at[~plain, 0], width[~plain, 0] = self.parts.used + np.cumsum(n) - n, n
        self.words.add(keys, width.sum(1), ids[_spread(at.ravel(), width.ravel())])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of a block of texts, each with a closing id 0."""
        h, start, end, first = hash_words(data, off, lower=False)
        keys, index, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.words.keys) > MEMO:
            self.words = _Memory()
        fresh = self.words.missing(keys)
        if fresh.any():
            at = index[fresh]
            self._learn(keys[fresh], data, start[at], end[at])
        at, width = self.words.runs(keys)
        at, width = at[back], width[back]
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        ends = np.cumsum(width)
        into = ends - width + doc  # one closing id before each later text
        out = np.zeros(int(ends[-1] if len(ends) else 0) + len(off) - 1, "<u4")
        out[_spread(into, width)] = self.words.ids[_spread(at, width)]
        total = np.concatenate([[0], ends])[first]
        return out, total + np.arange(len(off))


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, max_len: int, with_ids: bool) -> DataFrame:
    """Each document's ids and a closing 0, cut at max_len."""
    schema = "id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _shared.get(tokenizer)
        if encoder is None:
            encoder = _shared[tokenizer] = Encoder(tokenizer)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, off = text_bytes(batch.column(1))
            for i, j in blocks(off, TOGETHER):
                cols: list[list] = [[], [], [], [], [], []]
                flat, bounds = encoder.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                raw = memoryview(flat.tobytes())
                for doc, lo, hi in zip(ids[i:j], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for k, at in enumerate(range(lo, hi, max_len)):
                        to = min(at + max_len, hi)
                        for c, v in zip(cols, (doc, k, at - lo, to - at, zlib.crc32(raw[4 * at : 4 * to]), flat[at:to].view(np.int32) if with_ids else None), strict=True):
                            c.append(v)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], types[:n], strict=True)], names=names[:n])
        encoder.words = _Memory()  # the worker lives on through other stages

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lean(run), schema)


def best_fit(hist: np.ndarray, cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram (index = length): (pattern, repeats), groups of equal lengths at a time."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    room = np.zeros(cap + 1, bool)
    for length in range(cap, 0, -1):
        n = int(hist[length])
        while n:
            fit = np.flatnonzero(room[length:])
            if len(fit):
                r = int(fit[0]) + length
                pattern, count = groups[r].pop()
                k = min(n, count)
                if count > k:
                    groups[r].append((pattern, count - k))
                room[r] = bool(groups[r])
                groups[r - length].append(((*pattern, length), k))
                room[r - length] = r > length
                n -= k
            else:
                per = min(n, cap // length)
                k = n // per
                groups[cap - per * length].append(((length,) * per, k))
                room[cap - per * length] = cap > per * length
                n -= k * per
    return [g for r in sorted(groups) for g in groups[r]]


def patterns(hist: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, times), rows of three (0: none), lengths falling: patterns with a sum of exactly cap of one or two lengths,
    each as often as its times say and no more often than it occurs, and of three lengths, once each. A length in none of
    them repeats alone where nothing that occurs fits behind it.

    Runs are at most as many as pairs of divisors of m and cap - m, about 60,000 for a cap of 2048, and patterns of three
    at most cap^2 / 12, whatever the input."""
    is_in = hist[: cap + 1] > 0
    is_in[0] = False
    lengths, times = [np.zeros((0, 3), np.int64)], [np.zeros((0, 3), np.int64)]

    def put(a, ka, b, kb, c, n: int) -> None:
        zero = np.zeros(n, np.int64)
        lengths.append(np.stack([zero + a, zero + b, zero + c], 1))
        times.append(np.stack([zero + ka, zero + kb, (zero + c > 0).astype(np.int64)], 1))

    have = np.flatnonzero(is_in[:cap])
    for at, a in enumerate(have.tolist()):
        below = have[:at]
        for ka in range(1, min(cap // a, int(hist[a])) + 1):
            rest = cap - ka * a
            if not rest:
                put(a, ka, 0, 0, 0, 1)
                continue
            b = below[: np.searchsorted(below, rest, "right")]
            b = b[rest % b == 0]
            b = b[rest // b <= hist[b]]
            put(a, ka, b, rest // b, 0, len(b))
        b = np.arange((cap - a) // 2 + 1, min(a, cap - a))
        b = b[is_in[b] & is_in[cap - a - b]]
        put(a, 1, b, 1, cap - a - b, len(b))
    out, n = np.concatenate(lengths), np.concatenate(times)
    alone = np.setdiff1d(have, out)
    k = np.minimum(cap // np.maximum(alone, 1), hist[alone])
    alone, k = (v[cap - alone * k < have.min(initial=cap)] for v in (alone, k))
    zero = np.zeros_like(alone)
    return np.concatenate([out, np.stack([alone, zero, zero], 1)]), np.concatenate([n, np.stack([k, zero, zero], 1)])


def fit_counts(hist: np.ndarray, pats: np.ndarray, times: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative least squares of pattern counts to the histogram by accelerated projected gradient with restarts. A
    length's error weighs by its count, so that rare lengths weigh as well."""
    if not len(pats):
        return np.zeros(0)
    n = len(hist)
    w = 1 / np.maximum(hist, 1.0)
    w[0] = 0  # the place of no length
    cols = [(np.ascontiguousarray(pats[:, k]), times[:, k].astype(float)) for k in range(pats.shape[1])]
    # Patterns of many pieces would set the step for all: each counts in units of its own weight.
    unit = 1 / np.sqrt(sum(k * k * w[c] for c, k in cols))

    def lengths(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(c, k * unit * x, n) for c, k in cols)

    def back(r: np.ndarray) -> np.ndarray:
        return unit * sum(k * r[c] for c, k in cols)

    v = np.ones(len(pats))
    for _ in range(12):
        v = back(w * lengths(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(w * (lengths(y) - hist)) / (1.05 * top))
        if (y - new) @ (new - x) > 0:
            y, t = new, 1.0
        else:
            u = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, t = new + (t - 1) / u * (new - x), u
        x = new
    return unit * x


def repeats(hist: np.ndarray, pats: np.ndarray, times: np.ndarray, count: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """((pattern, repeats), the histogram they leave): the running sum of the counts is rounded, which keeps the sums of
    neighbouring patterns, and no length is used more often than it occurs."""
    out, left = [], hist.copy()
    whole = np.diff(np.floor(np.cumsum(count) + 0.5), prepend=0).astype(np.int64)
    some = np.flatnonzero(whole)
    for p, n, c in zip(pats[some].tolist(), times[some].tolist(), whole[some].tolist(), strict=True):
        runs = [(v, k) for v, k in zip(p, n, strict=True) if v]
        m = min([c, *(int(left[v]) // k for v, k in runs)])
        if m > 0:
            out.append((tuple(v for v, k in runs for _ in range(k)), m))
            for v, k in runs:
                left[v] -= k * m
    return out, left


#: Patterns that a plan may have for every length that occurs: the first fit, over all patterns, is thinned to these in
#: proportion to its counts; and the steps of the first and the second fit.
SUPPORT, STEPS = 8, (40, 100)
#: Parts of the fitted counts that a plan may take: a residual in which all lengths are left packs better.
PARTS_TAKEN = (0.95, 0.9, 0.8)


def plan(hist: np.ndarray, cap: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold the histogram exactly: full pieces, fitted patterns, and the residual packed best-fit
    decreasing, which is exact for whatever the fit leaves. All patterns with each of the parts of their counts, and those
    of one or two lengths once each alone, are tried, and the plan of the fewest sequences is returned."""
    rest = hist.astype(np.int64).copy()
    rest[cap] = 0
    goal, (pats, times) = rest.astype(float), patterns(rest, cap)
    few = (pats[:, 2] == 0) & (times.sum(1) == 2)
    tries = [(pats[few], times[few], fit_counts(goal, pats[few], times[few], STEPS[1]))]
    total = np.cumsum(fit_counts(goal, pats, times, STEPS[0]))
    if len(total) and total[-1] > 0:
        most = SUPPORT * np.count_nonzero(rest)
        some = np.diff(np.floor(total * (most / total[-1]) + 0.5), prepend=0) > 0
        pats, times = pats[some], times[some]
        fitted = fit_counts(goal, pats, times, STEPS[1])
        tries = [*((pats, times, part * fitted) for part in PARTS_TAKEN), *tries]
    full: list[tuple[tuple[int, ...], int]] = [((cap,), int(hist[cap]))] if hist[cap] else []
    plans = []
    for p, n, count in tries:
        some, left = repeats(rest, p, n, count)
        plans.append(full + some + best_fit(left, cap))
    return min(plans, key=lambda v: sum(k for _, k in v))


def ranked(df: DataFrame, by: str) -> DataFrame:
    """df, which is checkpointed and has a unique rid, with rank from 0 within each value of `by`: counts of hashed
    buckets give each bucket its first rank, so that a hot value is ranked by many tasks."""
    size = df.groupBy(by).agg(F.ceil(F.count("*") / RANKED).alias("parts"))
    parts = F.broadcast(size)  # one row a value of `by`: the caller bounds them
    d = df.join(parts, by).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts"))).drop("parts")
    first = d.groupBy(by, "part").count()
    w = Window.partitionBy(by).orderBy("part")
    first = first.select(by, "part", (F.sum("count").over(w) - F.col("count")).alias("first"))
    d = d.join(first, [by, "part"])
    w = Window.partitionBy(by, "part").orderBy("rid")
    return d.withColumn("rank", F.row_number().over(w) - 1 + F.col("first")).drop("first", "part")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, with_ids: bool = False) -> DataFrame:
    """Place every piece of every document: id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    Only documents over max_len are cut. Null and empty texts are the one id 0. Repeated rows are packed each; null ids
    pass through; an empty table gives an empty result; further columns are ignored. tokenizer is the path of a
    tokenizer file on every executor, of a kind that drops white space.
    """
    spark = docs.sparkSession
    cutp = cut(pieces(docs, tokenizer, id_col, text_col, max_len, with_ids).withColumn("rid", F.monotonically_increasing_id()))
    hist = np.zeros(max_len + 1, np.int64)
    for r in cutp.groupBy("length").count().collect():  # at most max_len rows
        hist[r["length"]] = r["count"]
    rows, used, seq = [], np.zeros(max_len + 1, np.int64), 0
    for pattern, k in plan(hist, max_len):
        at = 0
        for v, run in groupby(pattern):
            n = sum(1 for _ in run)
            rows.append((int(v), int(used[v]), int(used[v]) + n * k, seq, at, n))
            used[v] += n * k
            at += n * v
        seq += k
    table = local_table(spark, rows, "length long, lo long, hi long, seq0 long, first long, run long")
    # The table's size follows max_len and the number of patterns, not the input.
    got = ranked(cutp, "length").join(F.broadcast(table), "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    # Pieces of one length that stand side by side in a sequence have following ranks.
    nth = F.col("rank") - F.col("lo")
    places = [F.expr("seq0 + (rank - lo) div run").alias("sequence_id"), (F.col("first") + nth % F.col("run") * F.col("length")).alias("offset")]
    cols = ["id", "piece", "start", "length", "ids_crc32", *places]
    return got.select(*cols, *(["ids"] if with_ids else []))
