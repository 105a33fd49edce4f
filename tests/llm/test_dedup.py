import random
import re

import pytest
from pyspark.sql import functions as F

from geopanel.llm import minhash
from geopanel.llm.line_dedup import drop_common_lines
from geopanel.llm.minhash import band_keys, fast_sketch, near_duplicates, shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k):
    if text is None:
        return frozenset()
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed=0, groups=6):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.randint(5, 120))]
        for c in range(r.randint(1, 30)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w).title() if c % 3 else "\t".join(w)))
    rows += [(len(rows), "one"), (len(rows) + 1, "One"), (len(rows) + 2, ""), (len(rows) + 3, None), (len(rows) + 4, " \n ")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k", [(0, 2), (1, 2), (2, 5)])
def test_near_duplicates_equal_brute_force(spark, seed, k):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in near_duplicates(df, k=k).collect())
    assert got == brute(rows, k)


def test_sets_that_share_their_first_number_stay_apart(spark, monkeypatch):
    whole = minhash._number
    monkeypatch.setattr(minhash, "_number", lambda seed: whole(seed) if seed else F.pmod(whole(seed), F.lit(5)))
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in near_duplicates(df, k=2).collect()) == brute(rows, 2)


def test_near_duplicates_of_odd_tables(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (3, None, None)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()}
    assert got == {(1, 2, 1, True), (None, 2, 1, False), (3, 0, 3, True)}


def test_sketch_coordinates_estimate_similarity():
    import numpy as np

    text = [" ".join(f"t{i}" for i in range(a, b)) for a, b in ((0, 400), (100, 500))]
    raw = [t.encode() for t in text]
    off = np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])])
    a, b = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), off, 1)
    x, y = fast_sketch(a, 2048), fast_sketch(b, 2048)
    assert abs((x == y).mean() - 0.6) < 0.05
    assert len(band_keys(x, 512)) == 512
    tiny = fast_sketch(a[:1], 64)
    assert len(set((tiny >> np.uint64(32)).tolist())) > 1  # later rounds fill the bins that one element leaves


def brute_lines(rows, min_sites, min_words):
    def words(s):
        return re.findall(r"[^\x20\x09-\x0D]+", s)

    sites = {}
    for _, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            if len(words(line)) >= min_words:
                sites.setdefault(line.strip(" \t\n\r\x0b\x0c"), set()).add(s)
    common = {k for k, v in sites.items() if len(v) >= min_sites}
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        hit = [len(words(v)) >= min_words and v.strip(" \t\n\r\x0b\x0c") in common for v in lines]
        gone = sum(len(words(v)) for v, h in zip(lines, hit) if h)
        if any(hit) and 4 * gone <= 3 * len(words(t or "")):
            out.append((d, "\n".join(v for v, h in zip(lines, hit) if not h), sum(hit), gone))
        else:
            out.append((d, t, 0, 0))
    return sorted(out, key=repr)


def test_boilerplate_lines_go_and_copies_stay(spark):
    r = random.Random(3)
    rows = []
    for i in range(160):
        own = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 400)) for _ in range(r.randint(2, 9))) for _ in range(4)]
        if i % 2:
            own.insert(r.randrange(4), "  subscribe to our weekly letter now ")
        if i % 5 == 0:
            own.insert(0, "short line")
        rows.append((i, "\n".join(own), "en", None if i % 13 == 12 else f"s{i % 13}", 0))
    rows += [(1000 + i, "the very same document on every site\nand its second line of words", "en", f"s{i}", 0) for i in range(12)]
    rows += [(2000, None, "en", "s1", 0), (2001, "", None, None, None), (2002, "subscribe to our weekly letter now", "en", "q", 0), rows[1], rows[1]]
    df = spark.createDataFrame(rows, DOCS)
    got = [tuple(x) for x in drop_common_lines(df).select("doc_id", "text", "lines_removed", "words_removed").collect()]
    want = brute_lines(rows, 10, 4)
    assert sorted(got, key=repr) == want
    assert any(w[2] for w in want) and all(g[2] == 0 for g in got if 1000 <= g[0] < 1012)


def test_lines_of_odd_tables(spark):
    out = drop_common_lines(spark.createDataFrame([], DOCS))
    assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    df = spark.createDataFrame([(1, "a\nb", "s", "kept")], "doc_id long, text string, source string, line string")
    assert drop_common_lines(df).first().line == "kept"
    assert drop_common_lines(df).agg(F.sum("lines_removed")).first()[0] == 0
