import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from geopanel.llm.outliers import flag
from geopanel.llm.quality import Machine, features, fit, score
from geopanel.llm.sharding import shard


def labelled(spark, n=400):
    r = random.Random(0)
    words = "the of and to in on stone river light water field house green paper".split()
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 120))]
        bad = i % 4 == 0
        if bad:
            kind = r.randrange(3)
            w = [x + "###" for x in w] if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else [y for x in w for y in (x, "|")]
        docs.append((i, " ".join(w), None))
        labels.append((i, 0 if bad else 1))
    docs += [(n, None, 3), (n + 1, "", 4)]
    return spark.createDataFrame(docs, "doc_id long, text string, score long"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = labelled(spark)
    m = fit(docs, labels.where("doc_id % 5 <> 0"))
    out = score(docs, m)
    assert out.columns == ["doc_id", "text", "score"]
    got = {r.doc_id: r.score for r in out.collect()}
    assert len(got) == 402 and all(0 <= v <= 1 for v in got.values())
    held = [r for r in labels.where("doc_id % 5 = 0").collect()]
    assert np.mean([(got[r.doc_id] >= 0.3) == (r.quality == 1) for r in held]) > 0.95


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    n = 20
    m = Machine(0.3, rng.normal(0, 1, n), rng.normal(0, 1, (n, 3)))
    slot, x = np.array([1, 4, 7, 9]), np.array([0.5, 1.0, 0.2, 0.7])
    z = 0.3 + (m.w[slot] * x).sum() + sum(m.v[slot[i]] @ m.v[slot[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(m.score(np.array([0, 4]), slot, x)[0] - 1 / (1 + np.exp(-z))) < 1e-12


def test_features_of_empty_texts():
    b, s, v = features(np.zeros(0, np.uint8), np.array([0, 0, 0]), [])
    assert len(b) == 3 and (np.diff(b) > 0).all() and len(s) == len(v) == b[-1]


def test_without_labels_or_documents(spark):
    docs, labels = labelled(spark, 8)
    m = fit(docs, labels.limit(0))
    assert {r.score for r in score(docs, m).collect()} == {0.5}
    assert score(docs.limit(0), m).count() == 0
    meta = fit(docs.withColumn("n", F.lit(None).cast("long")), labels, metadata=("n",))
    assert score(docs.withColumn("n", F.lit(5)), meta, metadata=("n",)).count() == 10


def test_rendezvous_law(spark):
    rows = [(i, f"text {i}", "x") for i in range(3000)] + [(7, "again", "x")] * 5 + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    out = shard(df, ["doc_id"], [1.0] * 7 + [3.0])
    got = out.collect()
    assert out.columns == ["doc_id", "text", "shard", "grown_shard", "slot"] and len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert abs(len(by[7]) / 3000 - 0.3) < 0.04
    again = {r.doc_id: r.shard for r in shard(df.repartition(6), ["doc_id"], [1.0] * 7 + [3.0]).collect()}
    assert all(again[r.doc_id] == r.shard for r in got)
    grown = {r.doc_id: r.shard for r in shard(df, ["doc_id"], [1.0] * 7 + [3.0, 1.0]).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    assert shard(df.limit(0), ["doc_id"], [1.0]).count() == 0


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [v for v in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", v)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    inside = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_outliers_against_brute_force(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        n = int(np.exp(r.gauss(5, 0.6)))
        w = [r.choice("abcdefghij") + "".join(r.choice("aeiou") for _ in range(r.randint(1, 7))) for _ in range(n)]
        text = "\n".join(" ".join(w[k : k + 40]) for k in range(0, n, 40))
        if i % 40 == 0:
            text = " ".join(x + "###" for x in w)
        if i % 41 == 0:
            text += "\n" + " ".join(w[:9]) + "\n" + " ".join(w[:9])
        rows.append((i, text, "en", f"s{i % 2}", 1))
    rows += [(900, None, None, None, 1), (901, "", "en", None, 1), (902, "a b a b a b a b a b a b a b a b a b a b a b a b", "en", "s1", 1), (903, "é " * 30 + "\n\nx\nx\n", "xx", "lonely", 1), rows[5], rows[5]]
    out = flag(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")).collect()
    text = {i: t for i, t, *_ in rows}
    assert len(out) == len(rows)
    for o in out:
        want = base(text[o.id])
        assert (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words) == want
        assert o.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (o.base_failed and o.kept)
    ordinary = [o for o in out if not o.base_failed and o.id < 600 and o.id % 40 and o.id % 41]
    noisy = [o for o in out if not o.base_failed and o.id < 600 and o.id % 40 == 0]
    assert np.mean([o.kept for o in ordinary]) > 0.995 and not any(o.kept for o in noisy)


def test_outliers_of_an_empty_table(spark):
    assert flag(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_crc_of_texts_in_the_query(spark):
    from geopanel.llm.queries import op4_rendezvous_shards

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op4_rendezvous_shards(spark, d).collect()
    assert all(zlib.crc32(docs[r.doc_id].encode()) == r.text_crc32 and len(docs[r.doc_id].encode()) + 1 == r["size"] for r in got)
