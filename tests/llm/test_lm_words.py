import random

import numpy as np

from geopanel.llm import lm_score


def test_words_of_a_shared_slot_score_by_their_counts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HELD", 50, raising=False)  # the other counts are joined
    r = random.Random(1)
    text = [" ".join(f"c{r.randrange(800)}" for _ in range(200)) for _ in range(200)]
    text += ["seldom " * 20] * 5 + ["once more"]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").repartition(3)
    vocab, net = lm_score.train(df)
    words = {x.h: x.n for x in lm_score.count_words(df, "text").collect()}
    # Words of one slot have the network's probability of the slot, times their part of it.
    h = np.array(sorted(words), np.int64).view(np.uint64)
    slot = vocab.slot(h)
    rare = np.flatnonzero(slot >= lm_score.SLOTS - lm_score.RARE)
    assert len(rare) > 30 and vocab.counts.sum() == sum(words.values())
    s = slot[rare[0]]
    mine = [words[int(k)] for k in h[slot == s].view(np.int64)]
    assert abs(sum(n + lm_score.EXTRA for n in mine) + lm_score.EXTRA - vocab.share[s - lm_score.SLOTS + lm_score.RARE]) < 1e-9
    # Scores add the joined logarithms up.
    plain = lm_score.Vocabulary(vocab.keys, vocab.slots, vocab.counts)
    test = spark.createDataFrame([(0, text[0]), (1, "once"), (2, "seldom"), (3, "zqxj neverseen"), (1, "once"), (None, "once"), (5, None)], "doc_id long, text string")
    full = sorted((str(x.id), x.n_tokens, x.log_prob) for x in lm_score.score(test, vocab, net).collect())
    bare = sorted((str(x.id), x.n_tokens, x.log_prob) for x in lm_score.score(test, plain, net).collect())
    assert [x[:2] for x in full] == [x[:2] for x in bare]
    texts = {"0": text[0], "1": "once", "2": "seldom", "3": "zqxj neverseen", "None": "once", "5": ""}
    for (i, _, a), (_, _, b) in zip(full, bare):
        raw = texts[i].encode()
        hs = lm_score.hash_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True)[0]
        want = sum(np.log((words.get(int(k.view(np.int64)), 0) + lm_score.EXTRA) / vocab.share[v - lm_score.SLOTS + lm_score.RARE]) for k, v in zip(hs, vocab.slot(hs)) if v >= lm_score.SLOTS - lm_score.RARE)
        assert abs(a - b - want) < 1e-6


def test_every_token_is_trained_on(spark):
    for n in (1, 2, 3):
        df = spark.createDataFrame([(i, " ".join(["word"] * n)) for i in range(20)], "doc_id long, text string").coalesce(1)
        vocab, net = lm_score.train(df)
        assert not np.array_equal(net.flat(), lm_score.Net.start(vocab.counts).flat())
    row = np.repeat(np.arange(40), np.arange(40))
    nth = np.arange(len(row)) - np.repeat(np.cumsum(np.arange(40)) - np.arange(40), np.arange(40))
    assert (sum(lm_score.in_round(row, nth, r).astype(int) for r in range(lm_score.ROUNDS)) == 1).all()


def test_scores_do_not_follow_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "GROUP", 20_000)
    monkeypatch.setattr(lm_score, "COPIES", 5)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same = df.limit(1).crossJoin(spark.range(40)).drop("id")
    df = df.unionByName(same)
    out = []
    for n in (2, 16):
        vocab, net = lm_score.train(df.repartition(n))
        out.append({x.id: x.log_prob for x in lm_score.score(df, vocab, net).collect()})
    assert set(out[0]) == set(out[1])
    # Copies of one row, dealt to all groups, are the only ones that may change groups.
    assert max(abs(out[0][i] - out[1][i]) / (1 + abs(out[0][i])) for i in out[0]) < 2e-2
    plain = []
    for n in (2, 16):
        vocab, net = lm_score.train(df.distinct().repartition(n))
        plain.append(net.flat())
    assert np.allclose(plain[0], plain[1], atol=1e-6)


def test_held_out_text_is_likelier_than_by_frequency(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    vocab, net = lm_score.train(df.where("doc_id % 5 <> 0"))
    held = df.where("doc_id % 5 = 0")

    def perplexity(n):
        r = lm_score.score(held, vocab, n).agg({"log_prob": "sum", "n_tokens": "sum"}).first()
        return np.exp(-r["sum(log_prob)"] / r["sum(n_tokens)"])

    assert perplexity(net) < 0.9 * perplexity(lm_score.Net.start(vocab.counts))


def test_far_logits_have_finite_logarithms():
    z = np.array([[-150.0] + [-200.0] * 31, [200.0] + [0.0] * 31], np.float32)
    got = lm_score._log_softmax_at(z.copy(), np.array([0, 1]))
    assert np.isfinite(got).all() and abs(got[0]) < 1e-6 and abs(got[1] + 200) < 1e-3
    assert np.isfinite(lm_score._softmax(z.copy())).all()


def test_batches_do_not_follow_calls():
    rng = np.random.default_rng(0)
    net = lm_score.Net.start(np.ones(lm_score.SLOTS))
    slots = rng.integers(0, 900, 9000).astype(np.uint16)
    padded, place, row, nth = lm_score._laid_out(slots, np.arange(0, 9001, 30))
    ends = []
    for size in (9000, 700):
        t = lm_score.Trainer(net, 0.1)
        for i in range(0, len(place), size):
            t.feed(padded, place[i : i + size])
        ends.append(t.end())
        assert t.seen == 9000
    assert np.array_equal(ends[0], ends[1])
