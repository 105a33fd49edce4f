import math
import random
import re
from collections import Counter

import pytest

from geopanel.llm import lexical

ITEMS = "item_id long, text string, rank int, doc_id string"
DOCS = "doc_id long, text string, rank int, item_id string, score string"


def cut(text):
    return re.findall(lexical.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(items, docs, k=10, repeats=False):
    sets = {}
    for i, t in items:
        sets.setdefault(i, Counter()).update(cut(t))
    docs = [(d, Counter(cut(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, total = len(docs), sum(size for *_, size in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for i, wanted in sets.items():
        scored = []
        for row, (d, c, size) in enumerate(docs):
            m = 10 + (90 * size * n) // total
            s = sum((times if repeats else 1) * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in wanted.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, row))
        out += [(i, r, None if null else d, -s) for r, (s, null, d, _) in enumerate(sorted(scored)[:k], 1)]
    return out


def order(rows):
    return sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in rows)


def found(spark, items, docs, parts=3, **options):
    a = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    b = spark.createDataFrame([(d, t, 1, "y", "z") for d, t in docs], DOCS).repartition(parts)
    return [tuple(r) for r in lexical.search(a, b, **options).collect()]


def texts(rnd, n, words):
    pool = ["".join(rnd.choices("abcXYZ09éß漢😀", k=rnd.randint(1, 4))) for _ in range(words)]
    return ["".join(rnd.choice(pool) + rnd.choice([" ", "-", "_", "\n", "\x7f", ". "]) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("repeats", [False, True])
def test_ranking_agrees_with_brute_force(spark, monkeypatch, repeats):
    rnd = random.Random(7)
    docs = list(enumerate(texts(rnd, 300, 40))) + [(1000, None), (1001, ""), (1002, " .-_ ")] + [(2000 + i, "abc same copy") for i in range(40)] + [(None, "abc same copy"), (2000, "abc same copy")]
    docs.append((3000, "lone " + "filler " * 50_000))
    items = list(enumerate(texts(rnd, 30, 40))) + [(100, "ABC same-copy"), (100, "lone"), (101, None), (102, "nowhere"), (None, "lone filler"), (103, "same same copy"), (103, "same same copy")]
    want = brute(items, docs, repeats=repeats)
    assert order(found(spark, items, docs, repeats=repeats)) == order(want)
    monkeypatch.setattr(lexical, "ENTRIES", 50)  # many blocks
    assert order(found(spark, items, docs, parts=7, repeats=repeats)) == order(want)


def test_ids_keep_their_types(spark):
    items = spark.createDataFrame([("q", "one two")], "item_id string, text string")
    docs = spark.createDataFrame([("b", "one"), ("a", "one"), ("c", "two two"), ("d", "three")], "doc_id string, text string")
    assert [tuple(r)[:3] for r in lexical.search(items, docs).orderBy("rank").collect()] == [("q", 1, "c"), ("q", 2, "a"), ("q", 3, "b")]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, "a")], [(1, None), (2, "--")]) == []
    assert found(spark, [(1, "..")], [(1, "a")]) == []
