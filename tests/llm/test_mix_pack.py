import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from geopanel.llm import mixing
from geopanel.llm.mixing import mix, split_quotas, targets
from geopanel.llm.packing import best_fit, pack, patterns, plain_words, plan

DOCS = "doc_id long, text string, source string"


def docs(spark, n=400, sources=7):
    r = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 40, 200]))), None if i % sources == 6 else f"s{i % sources if i % 3 else 0}") for i in range(n)]
    return spark.createDataFrame(rows, DOCS), rows


def test_targets_reshare_the_excess():
    size = {"a": 10, "b": 100, "c": 100}
    got = targets(size, {"a": 5, "b": 2, "c": 1}, 315, 2)
    assert got["a"] == 20 and abs(sum(got.values()) - 315) < 1e-9 and all(got[s] <= 2 * size[s] for s in size)
    assert abs(got["b"] / got["c"] - 2) < 1e-9 or got["b"] == 200


def test_tree_keeps_quotas_and_shard_sizes():
    rng = np.random.default_rng(0)
    q = np.array([100, 0, 37, 5])
    out = split_quotas(q, 6, rng)
    assert (out.sum(0) == q).all() and out.sum(1).max() - out.sum(1).min() <= 1 and (out >= 0).all()
    many = np.mean([split_quotas(np.array([40, 20]), 4, rng)[0, 0] for _ in range(400)])
    assert abs(many - 10) < 0.5


def test_mix_meets_targets_and_reruns_agree(spark):
    df, rows = docs(spark)
    a = sorted(tuple(r) for r in mix(df, digest=True).select("id", "size", "source_size", "target", "taken").collect())
    assert a == sorted(tuple(r) for r in mix(df.repartition(5), digest=True).select("id", "size", "source_size", "target", "taken").collect())
    assert len(a) == len(rows) and all(t <= 2 * s for _, s, _, _, t in a)
    by = {}
    src = {i: s for i, _, s in rows}
    for i, _, _, goal, t in a:
        by.setdefault(src[i], [goal, 0])[1] += t
    assert all(abs(got - goal) <= 5 for goal, got in by.values())


def test_mixed_rows_are_the_digest(spark):
    df, _ = docs(spark, 120)
    want = {r.id: r.taken for r in mix(df, digest=True).collect()}
    got = Counter()
    full = mix(df, ordered=True)
    assert full.columns == ["doc_id", "text", "source", "copy", "shard", "place"]
    for r in full.collect():
        got[r.doc_id] += len(r.text.split())
    assert all(got[i] == t for i, t in want.items())
    shards = full.groupBy("shard").count().collect()
    assert 1 < len(shards) <= 16


def test_mix_of_odd_tables(spark):
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mix(spark.createDataFrame([], DOCS), digest=True).count() == 0
    one = spark.createDataFrame([(1, None, None), (1, None, None), (2, "", "a")], DOCS)
    assert {(r.id, r["size"], r.taken) for r in mix(one, digest=True).collect()} == {(1, 0, 0), (2, 0, 0)}
    clash = spark.createDataFrame([(1, "a b c", "s", 9)], DOCS + ", shard long")
    assert mix(clash).columns.count("shard") == 1


def test_plans_hold_the_histogram():
    rng = np.random.default_rng(1)
    for cap in (8, 50, 512):
        hist = np.zeros(cap + 1, np.int64)
        hist[1:] = rng.integers(0, 30, cap)
        for p in (plan(hist, cap), best_fit(hist, cap)):
            back = np.zeros(cap + 1, np.int64)
            for pattern, k in p:
                assert sum(pattern) <= cap and k > 0
                for v in pattern:
                    back[v] += k
            assert (back == hist).all()
        least = -(-int((hist * np.arange(cap + 1)).sum()) // cap)
        assert sum(k for _, k in plan(hist, cap)) <= min(1.05 * least + 1, sum(k for _, k in best_fit(hist, cap)))


@pytest.mark.parametrize("cap", [16, 2048])
def test_packing_is_a_round_trip(spark, cap):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    r = random.Random(2)
    texts = [" ".join(r.choice(["The", "quick,", "don't", "naïve", "ÉTÉ!", "12", "x_y", "日本", "a b", "ΣΑΣ", "'s"]) for _ in range(r.randint(0, 300))) for _ in range(60)]
    texts += [None, "", "\x1c x", " ".join(["long"] * 5000), "café", "<|endoftext|>"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack(df, path, max_len=cap, with_ids=True).collect()
    seqs, per = {}, {}
    for p in got:
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and p.length == len(p.ids)
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
        if p.id != 3:
            per.setdefault(p.id, []).append((p.piece, p.start, p.ids))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= cap
    for i, t in rows[:-1]:
        if i == 3:
            continue
        want = tok.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(per[i])
        assert [v for _, _, ids in pieces for v in ids] == want
        assert all(len(ids) == cap for _, _, ids in pieces[:-1]) and [s for _, s, _ in pieces] == [k * cap for k in range(len(pieces))]
    total = sum(p.length for p in got)
    assert len(seqs) <= 1.1 * total / cap + 2


def test_packing_an_empty_table(spark):
    out = pack(spark.createDataFrame([], "doc_id long, text string, length int"), public_tokenizers.path("word_bpe_49k.json"))
    assert out.count() == 0 and out.select(F.col("offset")).count() == 0


@pytest.mark.parametrize("times", [1, 100])
def test_fitted_patterns_place_most_pieces(times):
    rng = np.random.default_rng(4)
    cap, n = 2048, 12_000
    size = np.minimum(np.exp(rng.normal(6.2, 1.1, n)).astype(int) + 1, 20_000)
    hist = np.bincount(size % cap, minlength=cap + 1)
    hist[0], hist[cap] = 0, (size // cap).sum()
    hist = hist * times
    got = plan(hist, cap)
    least = -(-int((hist * np.arange(cap + 1)).sum()) // cap)
    assert sum(k for _, k in got) <= 1.001 * least + 2
    few = sum(k * len(p) for p, k in got if sum(p) == cap and len(p) <= 3)
    assert few > 0.6 * hist.sum()


@pytest.mark.parametrize("low, high", [(20, 200), (20, 120), (100, 400), (5, 30)])
def test_patterns_place_short_texts(low, high):
    cap, n = 2048, 50_000
    hist = np.bincount(np.random.default_rng(0).integers(low, high + 1, n), minlength=cap + 1)
    got = plan(hist, cap)
    least = -(-int((hist * np.arange(cap + 1)).sum()) // cap)
    assert sum(k for _, k in got) <= 1.001 * least + 1
    assert sum(k * len(p) for p, k in got if sum(p) == cap and len(set(p)) <= 3) > 0.75 * n


def test_patterns_of_lengths_that_never_fill():
    cap = 2048
    hist = np.bincount(np.random.default_rng(0).integers(600, 641, 30_001), minlength=cap + 1)
    assert sum(k for _, k in plan(hist, cap)) == 10_001
    lengths, times = patterns(hist, cap)
    assert len(lengths) == 41 and (times[:, 0] == 3).all()


def test_patterns_against_all_sums():
    """Every pattern of the named kinds, by brute force."""
    cap, rng = 24, np.random.default_rng(3)
    hist = np.where(rng.random(cap + 1) < 0.5, rng.integers(0, 6, cap + 1), 0)
    hist[0] = hist[cap] = 0
    want = set()
    for a in range(1, cap):
        for b in range(a):
            for c in range(b if b else 1):
                for ka in range(1, int(hist[a]) + 1):
                    for kb in range(1, int(hist[b]) + 1) if b else [0]:
                        if c and (ka, kb) != (1, 1) or c and not hist[c]:
                            continue
                        if ka * a + kb * b + c == cap:
                            want.add(((a, b, c), (ka, kb, int(c > 0))))
    lengths, times = patterns(hist, cap)
    got = [(tuple(p), tuple(k)) for p, k in zip(lengths.tolist(), times.tolist(), strict=True)]
    assert len(got) == len(set(got))
    assert {(p, k) for p, k in got if sum(v * n for v, n in zip(p, k, strict=True)) == cap} == want


def test_runs_of_equal_lengths_in_tables(spark):
    """Short documents, many of one length: sequences without gaps, at the bound."""
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('the ', int(20 + id % 7))").alias("text"))
    got = pack(df, path, max_len=512).toPandas().sort_values(["sequence_id", "offset"])
    assert len(got) == 4000 and got["id"].nunique() == 4000
    ends = got["offset"] + got["length"]
    first = got["sequence_id"] != got["sequence_id"].shift()
    assert (got["offset"] == ends.shift(fill_value=0).where(~first, 0)).all() and ends.max() <= 512
    assert got["sequence_id"].nunique() <= -(-int(got["length"].sum()) // 512) + 2


def test_letters_and_signs_of_words():
    words = ["Hello!!", "ÉTÉ", "a.b", "×x", "naïve", "!?", "Ÿ", "ab_", "ß,", "ÀÖØÞ", "don't", "x́"]
    raw = [w.encode() for w in words]
    lead = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    low, plain, letters = plain_words(np.frombuffer(b"".join(raw), np.uint8), lead)
    want = [True, True, False, False, True, False, False, True, True, True, False, False]
    assert plain.tolist() == want
    for i, w in enumerate(words):
        if want[i]:
            assert low[lead[i] : lead[i + 1]].tobytes().decode() == w.lower()
            assert raw[i][: letters[i]].decode().isalpha() and not any(c.isalpha() for c in raw[i][letters[i] :].decode())


def test_the_digest_follows_the_tree(spark, monkeypatch):
    df, _ = docs(spark)
    want = {r.id: r for r in mix(df, digest=True).collect()}
    assert all(len(r.places) * r["size"] == r.taken and len({p.copy for p in r.places}) == len(r.places) for r in want.values())
    shards = Counter(p.shard for r in want.values() for p in r.places)
    assert set(shards) <= set(range(16)) and len(shards) > 3
    monkeypatch.setattr(mixing, "split_quotas", lambda q, k, rng: np.vstack([q, np.zeros((k - 1, len(q)), np.int64)]))
    got = {r.id: r for r in mix(df, digest=True).collect()}
    assert {p.shard for r in got.values() for p in r.places} == {0} and got != want
    assert all(got[i].taken == want[i].taken for i in want)


def test_blocks_of_a_large_source_are_shared_out(spark):
    df = spark.range(20_000).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 30 as int)) text", "if(id % 3 = 0, 'a', 'b') source")
    out = mix(df, digest=True).collect()
    by = {}
    for r in out:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
        assert r.taken <= 2 * r["size"]
    assert all(abs(taken - goal) <= 30 for goal, taken in by.values())
    shards = Counter(p.shard for r in out for p in r.places)
    assert len(shards) == 16 and max(shards.values()) < 1.3 * min(shards.values())


def test_mix_of_many_sources_and_of_lost_ids(spark):
    many = spark.range(60_000).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 9 as int)) text", "concat('s', id % 20000) source")
    got = mix(many, digest=True).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("n")).collect()
    assert len(got) == 20_000 and all(r.taken <= 2 * r.n for r in got)
    assert abs(sum(r.taken for r in got) / sum(r.target for r in got) - 1) < 0.1
    lost = spark.range(1000).selectExpr("cast(null as long) doc_id", "concat(repeat('w ', 9), id) text", "if(id < 600, 'a', 'b') source")
    by = {}
    for r in mix(lost, digest=True).collect():
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(taken - goal) <= 10 for goal, taken in by.values())
